"""Queries of the market build and what it is made of."""

from __future__ import annotations

from pyspark.sql import functions as F

from pricewell.functions import columns as P
from pricewell.operators import market as M
from pricewell.operators import rules as R
from pricewell.operators import stats
from pricewell.plans import sql
from pricewell.plans.sql import S
from pricewell.sources import views as V

QUERIES, ORACLES = {}, {}


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return add


SNAPSHOT = ["market_price", "price_range", "trusted_status", "trusted_sample_count", "confidence_score", "confidence_label", "interval_method", "reference_price", "cluster_count", "suspicious_low_clusters", "suspicious_low_rows", "suspicious_high_clusters", "suspicious_high_rows", "selection_sample_count", "selected_gprice_label", "fallback_applied"]
MODEL = ["brand_title", "series_title", "model_title"]
MODELS = ", ".join(MODEL)


def references(spark, sf_dir):
    rows = V.reference_rows(spark, sf_dir)
    return rows.groupBy("brand_title", "series_title", P.sku_title("model_title", "group_title").alias("sku_title")).agg(stats.percentile("reference_price", 0.5).alias("reference_price"))


@query(f"""WITH {sql.CLUSTERS}, totals AS (SELECT {S}, count(*) AS source_row_count, count(DISTINCT lower(sname)) AS source_count, max(imported_at) AS latest_imported_at, min(CAST(price_text AS BIGINT)) AS min_price, max(CAST(price_text AS BIGINT)) AS max_price FROM quotes GROUP BY {S})
SELECT s.*, source_row_count, source_count, latest_imported_at, min_price, max_price, 'variant' AS scope_level, regexp_extract(group_title,'[0-9]+G') AS capacity_label, 'color' AS variant_label,
 lower(regexp_replace(concat_ws('',{S}),'[^\\p{{L}}\\p{{N}}]','','g')) AS search_text_normalized FROM snaps s JOIN totals USING ({S})""")
def live_snapshot(spark, sf_dir):
    """A3 with A1, A2, W1-W10, A10, J2: the flagship."""
    made = M.live_snapshot(V.quotes(spark, sf_dir), V.demo_rules(), references(spark, sf_dir))
    return made.select(*M.SKU, *SNAPSHOT, "source_row_count", "source_count", "latest_imported_at", "min_price", "max_price", "scope_level", "capacity_label", "variant_label", "search_text_normalized")


@query(f"""WITH {sql.CLUSTERS} SELECT {S}, cluster_id, dstatus, sample_count, median_price, price_range, interval_method, confidence_score, score, rnk AS rank FROM clusters""")
def market_clusters(spark, sf_dir):
    """Every scored cluster."""
    made = M.market_clusters(V.quotes(spark, sf_dir), V.demo_rules(), references(spark, sf_dir))
    return made.select(*M.SKU, "cluster_id", "dstatus", "sample_count", "median_price", "price_range", "interval_method", "confidence_score", "score", "rank")


@query(f"""WITH {sql.DEDUPED} SELECT id, {S}, reject_reason, price_value FROM deduped""")
def latest_per_seller(spark, sf_dir):
    """The newest quote of each seller, and why it is no target."""
    return M.prepared(V.quotes(spark, sf_dir), V.demo_rules()).select("id", *M.SKU, "reject_reason", "price_value")


@query(f"""WITH {sql.RAW}, good AS (SELECT *, CAST(price_text AS BIGINT) AS price_value FROM raw){sql.windowed("good", MODELS, 4, 3)} SELECT id, {MODELS}, gprice AS day_label, day_rank, day_rows FROM selected""")
def recent_day_window(spark, sf_dir):
    """Rows of the newest days of each model."""
    return M.recent_days(V.raw_quotes(spark, sf_dir), 4, 3, MODEL).select("id", *MODEL, "day_label", "day_rank", "day_rows")


@query(f"""WITH {sql.RAW}, good AS (SELECT *, CAST(price_text AS BIGINT) AS price_value FROM raw){sql.cleaned("good", MODELS)} SELECT id, alive, outlier_reason, dens AS density, flr AS floor FROM survivors""")
def cleaning_plan(spark, sf_dir):
    """Outlier flags of every quote among those of its model."""
    df = M.recency(V.raw_quotes(spark, sf_dir)).withColumn("price_value", P.parse_price("price_text")).repartition(*MODEL)
    return M.clean_prices(df, V.demo_rules(), MODEL).select("id", "alive", "outlier_reason", "density", "floor")


@query(f"""WITH {sql.RAW}, p AS (SELECT {MODELS}, id, CAST(price_text AS BIGINT) AS v FROM raw),
r AS (SELECT *, count(*) OVER w AS n, row_number() OVER (PARTITION BY {MODELS} ORDER BY v) AS k, {sql.pct("v", 0.5, f" OVER (PARTITION BY {MODELS})")} AS med FROM p WINDOW w AS (PARTITION BY {MODELS})),
m AS (SELECT *, {sql.pct("abs(v-med)", 0.5, f" OVER (PARTITION BY {MODELS})")} AS mad, CASE WHEN n<4 THEN 0 ELSE least(CAST(floor(n*0.1::DOUBLE) AS BIGINT), (n-2)//2) END AS t FROM r),
b AS (SELECT *, max(CASE WHEN k=t+1 THEN v END) OVER (PARTITION BY {MODELS}) AS lo, max(CASE WHEN k=n-t THEN v END) OVER (PARTITION BY {MODELS}) AS hi FROM m)
SELECT {MODELS}, count(*) AS n, {sql.pct("v", 0.5)} AS median_price, {sql.pct("v", 0.25)} AS q1, {sql.pct("v", 0.75)} AS q3, min(v) AS price_min, max(v) AS price_max, max(mad) AS price_mad, CAST(round_even(avg(CASE WHEN k>t AND k<=n-t THEN v END),0) AS BIGINT) AS trimmed_mean, CAST(round_even(avg(least(greatest(v,lo),hi)),0) AS BIGINT) AS winsorized_mean, greatest({sql.pct("v", 0.75)}-{sql.pct("v", 0.25)},0) AS price_iqr FROM b GROUP BY {MODELS}""")
def price_stats(spark, sf_dir):
    """The statistics bundle per model."""
    df = V.raw_quotes(spark, sf_dir).withColumn("price_value", P.parse_price("price_text"))
    return stats.price_stats(df, MODEL)


@query(f"""WITH {sql.DEDUPED}, per AS (SELECT {S}, count(price_value) AS a, count(CASE WHEN reject_reason IS NULL THEN price_value END) AS v FROM deduped GROUP BY {S}) SELECT {S}, CASE WHEN a=0 THEN 'no_numeric_rows' ELSE 'no_valid_rows_after_status_filter' END AS reason FROM per WHERE v=0""")
def skip_reasons(spark, sf_dir):
    """A3, K8: SKUs without a market."""
    return M.skip_reasons(V.quotes(spark, sf_dir), V.demo_rules())


@query(f"""WITH {sql.DEDUPED} SELECT {S}, reject_reason AS reason, count(*) AS n FROM deduped WHERE reject_reason IS NOT NULL GROUP BY ALL""")
def reject_counts(spark, sf_dir):
    """Rejections per SKU and reason."""
    return M.reject_counts(V.quotes(spark, sf_dir), V.demo_rules())


@query(f"""WITH {sql.QUOTES} SELECT id, condition_bucket, is_target_price, needs_review, matched_negative_tags, exclude_reason FROM quotes""")
def classify_quotes(spark, sf_dir):
    """Classes of every quote."""
    return V.quotes(spark, sf_dir).select("id", "condition_bucket", "is_target_price", "needs_review", "matched_negative_tags", "exclude_reason")


@query(f"""WITH {sql.RAW} SELECT id, CASE WHEN gprice NOT IN (SELECT strftime(DATE '1998-12-31' - INTERVAL (i) DAY, '%m-%d') FROM range(120) t(i)) THEN 'drop_by_date' WHEN contains(gprice,'31') THEN 'drop_out_of_stock' WHEN activation<>'' THEN 'drop_by_activation_field'
 WHEN contains(lower(brand_title),'brand#2') AND (NOT (contains(dstatus,'NO') OR contains(dstatus,'AO')) OR contains(dstatus,'RF')) THEN 'drop_by_strict_dstatus' WHEN NOT contains(lower(brand_title),'brand#2') AND contains(dstatus,'AF') THEN 'drop_by_open_dstatus' END AS drop_reason FROM raw""")
def crawl_keep(spark, sf_dir):
    """Why a crawled item is dropped."""
    import datetime

    labels = P.recent_labels(datetime.date(1998, 12, 31), 120)
    return V.raw_quotes(spark, sf_dir).select("id", R.keep_reason(V.demo_rules(), labels).alias("drop_reason"))


@query(f"""WITH {sql.QUOTES}, caps AS (SELECT {MODELS}, regexp_extract(group_title,'[0-9]+G') AS capacity_label, count(*) AS row_count FROM quotes GROUP BY ALL)
SELECT *, 1 AS variant_count, 'color' AS variant_labels, row_number() OVER (PARTITION BY {MODELS} ORDER BY CAST(regexp_extract(capacity_label,'[0-9]+') AS INT)) AS capacity_rank FROM caps""")
def capacity_breakdown(spark, sf_dir):
    """Capacities of every model in order."""
    made = M.capacity_breakdown(V.quotes(spark, sf_dir), V.demo_rules())
    return made.select(*MODEL, "capacity_label", "row_count", "variant_count", "variant_labels", "capacity_rank")


#: The cluster CTEs keyed by capacity instead of the variant and its condition.
_BY_CAPACITY = sql.CLUSTERS.replace(S, "brand_title, series_title, model_title, group_title").replace(", ranked AS (", ", capped AS (SELECT * REPLACE (regexp_extract(group_title,'[0-9]+G') AS group_title) FROM quotes), ranked AS (", 1).replace("AS nth FROM quotes\n), deduped", "AS nth FROM capped\n), deduped", 1)


@query(f"""WITH {_BY_CAPACITY}, t AS (SELECT brand_title, series_title, model_title, group_title, count(*) AS row_count, 1 AS variant_count, 'color' AS variant_labels FROM capped GROUP BY 1,2,3,4)
SELECT t.*, market_price, price_range, trusted_sample_count, confidence_score, row_number() OVER (PARTITION BY brand_title, series_title, model_title ORDER BY CAST(regexp_extract(group_title,'[0-9]+') AS INT), group_title) AS capacity_rank, group_title AS capacity_label FROM t LEFT JOIN snaps USING (brand_title, series_title, model_title, group_title)""")
def capacity_markets(spark, sf_dir):
    """A4: the market of every capacity."""
    return M.capacity_breakdown(V.quotes(spark, sf_dir), V.demo_rules(), references(spark, sf_dir))


@query(f"""WITH {sql.DEDUPED}, c AS (SELECT {S}, reject_reason AS reason, count(*) AS n FROM deduped WHERE reject_reason IS NOT NULL GROUP BY ALL) SELECT {S}, '{{' || string_agg('"'||reason||'":'||n, ',' ORDER BY reason) || '}}' AS reason_counts FROM c GROUP BY {S}""")
def reason_maps(spark, sf_dir):
    """Rejections as one map per SKU."""
    return M.reason_maps(M.reject_counts(V.quotes(spark, sf_dir), V.demo_rules())).select(*M.SKU, F.to_json("reason_counts").alias("reason_counts"))
