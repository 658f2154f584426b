"""Queries of the remaining small operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from pricewell.functions import columns as P
from pricewell.operators import detail, reports, state
from pricewell.operators import market as M
from pricewell.operators import matching as T
from pricewell.plans import sql
from pricewell.plans.search_queries import skus
from pricewell.settled import settle
from pricewell.sources import readers
from pricewell.sources import views as V

QUERIES, ORACLES = {}, {}


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return add


@query("""SELECT p_partkey % 3 AS import_id, min('2024-01-0'||(1+p_partkey % 3)) AS created_at, count(*) AS n FROM part WHERE p_partkey % 3 = 2 GROUP BY 1""")
def latest_import(spark, d):
    """The newest completed import."""
    rows = V.reference_rows(spark, d).withColumn("created_at", F.concat(F.lit("2024-01-0"), (1 + F.col("import_id")).cast("string")))
    runs = rows.groupBy("import_id").agg(F.min("created_at").alias("created_at"), F.count(F.lit(1)).alias("n"), F.lit("completed").alias("status"))
    return T.latest_import(runs).select("import_id", "created_at", "n")


@query(f"""WITH {sql.RAW} SELECT max(run_key) AS run_key FROM raw WHERE run_key<'run_2001'""")
def live_run(spark, d):
    """The pointer names a run without snapshots, so the newest published one is live."""
    rows = V.raw_quotes(spark, d)
    published = rows.where("run_key < 'run_2001'").select("run_key", F.col("run_key").alias("published_at"))
    pointer = spark.range(1).select(F.lit("run_gone").alias("run_key"))
    return reports.live_run(pointer, published, reports.preferred_run(V.runs(spark, d), rows).select("run_key"))


@query(f"""WITH {sql.QUOTES}, m AS (SELECT *, row_number() OVER (PARTITION BY lower(sname) ORDER BY imported_at DESC, gprice DESC, id DESC) AS nth FROM quotes), d AS (SELECT * FROM m WHERE nth=1), r AS (SELECT *, sum(1) OVER (PARTITION BY gprice) AS n, max(struct_pack(a := imported_at, b := gprice, c := id)) OVER (PARTITION BY gprice) AS newest FROM d),
g AS (SELECT gprice, any_value(n) AS n, any_value(newest) AS newest FROM r GROUP BY gprice), g2 AS (SELECT *, row_number() OVER (ORDER BY newest DESC, n DESC, gprice DESC) AS k, sum(n) OVER (ORDER BY newest DESC, n DESC, gprice DESC) AS upto FROM g)
SELECT 'source_rows' AS name, count(*) AS n FROM quotes UNION ALL SELECT 'deduped_rows', count(*) FROM d UNION ALL SELECT 'recent_rows', sum(n) FROM g2 WHERE upto-n<10 AND k<=3 UNION ALL SELECT 'target_rows', count(*) FROM d WHERE is_target_price=1 UNION ALL (SELECT 'brand:'||brand_title, count(*) AS n FROM d GROUP BY brand_title ORDER BY n DESC, brand_title LIMIT 10)""")
def stage_figures(spark, d):
    """The newest quote of each seller over all products, recent days, targets, brands."""
    rows = V.quotes(spark, d).withColumn("whole", F.lit(1))
    deduped = settle(M.latest_per_seller(rows, ["whole"]), "stage-sellers")  # a row for each seller, read by every figure
    return reports.stage_figures(rows, deduped, M.recent_days_wide(deduped, 10, 3, ["whole"]))


@query(f"""WITH {sql.QUOTES}, {sql.TASKS}, {sql.EVENTS}, {sql.RUNS}, {sql.REFERENCES}, f AS (SELECT DISTINCT brand_title, series_title, model_title FROM quotes)
SELECT *, (SELECT least(8, count(*)) FROM f)::INT AS hot_count FROM (SELECT count(*) AS quote_count, max(imported_at) AS latest_quote FROM raw), (SELECT count(*) AS task_count, max(event_time) AS latest_task, sum(total_rows_seen)::BIGINT AS total_rows_seen, sum(row_count)::BIGINT AS kept_rows FROM tasks), (SELECT count(*) AS event_count, strftime(max(ts),'%Y-%m-%d %H:%M:%S') AS latest_event FROM run_events), (SELECT count(*) AS run_count, max(created_at) AS latest_run FROM runs),
 (SELECT count(*) AS reference_count, count(DISTINCT import_id) AS import_count, max(imported_at) AS latest_reference FROM refs)""")
def status_overview(spark, d):
    """The live marker, run summary, reference counts and hot list in one row."""
    tasks = V.tasks(spark, d)
    marker = reports.live_marker(V.raw_quotes(spark, d), tasks, V.events(spark, d), V.runs(spark, d))
    summary = tasks.agg(F.sum("total_rows_seen").alias("total_rows_seen"), F.sum("row_count").alias("kept_rows"))
    references = V.reference_rows(spark, d).agg(F.count(F.lit(1)).alias("reference_count"), F.count_distinct("import_id").alias("import_count"), F.max("imported_at").alias("latest_reference"))
    return reports.overview(marker, T.hot_list(T.model_candidates(skus(spark, d)), F.lit("phone")), summary, references).drop("hot")


@query(f"""WITH {sql.TASKS} SELECT task_key, CASE WHEN id % 4 = 0 THEN upper(brand_title) ELSE brand_title END AS brand_title, CASE WHEN id % 4 = 0 THEN '9' ELSE code END AS code, status FROM tasks WHERE status IN ('ok','error')""")
def task_payloads(spark, d):
    """Payload fields over the columns, by status."""
    rows = V.tasks(spark, d).withColumn("payload_json", F.when(F.col("id") % 4 == 0, F.to_json(F.struct(F.upper("brand_title").alias("brand_title"), F.lit("9").alias("code"), F.lit("").alias("msg")))).when(F.col("id") % 4 == 1, "broken"))
    return readers.task_payloads(rows).where(F.col("status").isin("ok", "error")).select("task_key", "brand_title", "code", "status")


@query("""SELECT CAST(event_id AS VARCHAR) AS message_id, CAST(user_id AS VARCHAR) AS user_id, event_type AS text FROM events""")
def inbound_events(spark, d):
    """Events with key synonyms."""
    rows = V.events(spark, d)
    a = F.to_json(F.struct(F.col("id").cast("string").alias("msgid"), F.col("task_key").alias("sender"), F.col("event_type").alias("text")))
    b = F.to_json(F.struct(F.col("id").cast("string").alias("id"), F.col("task_key").alias("from"), F.concat(F.lit(" "), "event_type").alias("content")))
    return readers.normalise_events(rows.select(F.when(F.col("id") % 2 == 0, a).otherwise(b).alias("body"))).select("message_id", "user_id", "text")


@query("""SELECT s_suppkey::VARCHAR AS "ID" FROM supplier WHERE lower(s_name)=lower('Supplier#000000001')""")
def choose_item(spark, d):
    """the one item with this title."""
    items = V.table(spark, d, "supplier").select(F.col("s_suppkey").cast("string").alias("ID"), F.col("s_name").alias("title"))
    return state.choose_item(items, "Supplier#000000001").select("ID")


@query(f"""WITH {sql.RAW}, c AS (SELECT brand_title, model_title, string_agg(DISTINCT gprice,'|') AS labels, min(CAST(price_text AS BIGINT)) AS lo, max(CAST(price_text AS BIGINT)) AS hi FROM raw GROUP BY 1,2) SELECT brand_title, model_title, array_to_string((list_reverse_sort(string_split(labels,'|')))[1:3],'|') AS newest_labels, lo||'-'||hi AS shown, lo AS low, hi AS high FROM c""")
def label_lists(spark, d):
    """The newest labels of a joined list, range texts and back."""
    df = V.raw_quotes(spark, d).withColumn("p", P.parse_price("price_text")).groupBy("brand_title", "model_title").agg(F.array_join(F.collect_set("gprice"), "|").alias("labels"), P.range_text(F.collect_set("p")).alias("shown"))
    bounds = P.range_bounds(F.col("shown"))
    return df.select("brand_title", "model_title", F.array_join(detail.top_labels(F.col("labels")), "|").alias("newest_labels"), "shown", bounds["low"].alias("low"), bounds["high"].alias("high"))


@query("""SELECT p_partkey AS id, CASE WHEN p_partkey % 2 = 0 THEN p_name||' '||p_size||'G' ELSE p_name END AS label, CASE WHEN p_partkey % 2 = 0 THEN p_type||' / '||p_size||' 条参考' ELSE p_brand||' / '||p_type END AS meta, substr(regexp_replace(lower(p_brand),'[^a-z0-9]','','g'),6) AS bare, p_size||'G' AS phrase FROM part""")
def result_labels(spark, d):
    """Labels, meta texts, brand aliases stripped, refinement phrases."""
    part = V.table(spark, d, "part")
    source = F.when(F.col("p_partkey") % 2 == 0, "external").otherwise("quote_rows")
    title = F.concat_ws(" ", "p_name", F.concat(F.col("p_size").cast("string"), F.lit("G")))
    return part.select(F.col("p_partkey").alias("id"), P.candidate_label(source, title, F.col("p_name"), F.col("p_name")).alias("label"), P.candidate_meta(source, F.col("p_type"), F.col("p_size"), F.col("p_brand"), F.col("p_type")).alias("meta"), P.strip_alias(F.col("p_brand"), ["brand"]).alias("bare"), P.refinement_phrase(F.concat_ws(" ", title, F.lit("brand 2x")), F.concat(F.col("p_name"), F.lit("2x")), ["brand"]).alias("phrase"))
