"""The market build: latest quote per seller, target filter, latest valid day, outlier trims, price clusters, best cluster.

All product variants are built at once. Quotes are hashed by SKU one time; every window after that partitions by the
SKU or by the SKU and more, and rides on the same exchange."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pricewell.functions import columns as P
from pricewell.operators import rules as R
from pricewell.operators.stats import half_even, of_sorted, percentile, with_deviation

SKU = ["brand_title", "series_title", "model_title", "group_title", "condition_bucket"]


def recency(df: DataFrame) -> DataFrame:
    """Adds the recency key: _stamp, _md (day label as month and day), _rid."""
    number = F.coalesce(P.filled("id"), P.filled("gid"), F.lit("0")) if "gid" in df.columns else F.coalesce(P.filled("id"), F.lit("0"))
    return df.withColumns({"_stamp": P.stamp_key("imported_at"), "_label": P.day_label(), "_rid": F.coalesce(number.try_cast("bigint"), F.lit(0))}).withColumn("_md", P.month_day(F.col("_label")))


def newest() -> list[Column]:
    return [F.desc("_stamp"), F.desc("_md"), F.desc("_rid")]


def with_seller(df: DataFrame) -> DataFrame:
    """Adds the recency key and the seller, _merchant."""
    gid = F.col("gid") if "gid" in df.columns else F.lit(None)
    return recency(df).withColumn("_merchant", P.merchant(group_id=gid))


def latest_per_seller(df: DataFrame, by: list[str] = SKU) -> DataFrame:
    """The newest row of each seller within the key; the row id decides ties."""
    w = Window.partitionBy(*by, "_merchant").orderBy(*newest())
    df = df if "_merchant" in df.columns else with_seller(df)
    return df.withColumn("_nth", F.row_number().over(w)).where("_nth = 1").drop("_nth", "_merchant")


def recent_days(df: DataFrame, min_samples: int, max_labels: int, by: list[str] = SKU) -> DataFrame:
    """Rows of the newest day buckets: buckets ordered by newest row, size and label, taken until there are enough rows or
    buckets. Adds day_label, day_rank, day_rows."""
    w = Window.partitionBy(*by, "_bucket.key")
    df = (df if "_stamp" in df.columns else recency(df)).withColumn("_bucket", P.day_bucket(F.col("_label")))
    df = df.withColumns({"_newest": F.max(F.struct("_stamp", "_md", "_rid")).over(w), "day_rows": F.count(F.lit(1)).over(w)})
    ordered = Window.partitionBy(*by).orderBy(F.desc("_newest"), F.desc("day_rows"), F.desc("_bucket.label"), F.desc("_bucket.key"))
    df = df.withColumns({"day_rank": F.dense_rank().over(ordered), "_after": F.rank().over(ordered)})  # rows of newer buckets, and one
    taken = (F.col("_after") <= max(1, min_samples)) & (F.col("day_rank") <= max(1, max_labels))
    return df.withColumn("day_label", F.col("_bucket.label")).where(taken).drop("_newest", "_after", "_bucket")


def recent_days_wide(df: DataFrame, min_samples: int, max_labels: int, by: list[str]) -> DataFrame:
    """The same rows for few and large keys: buckets are aggregated first, ranked as the small table they are, and joined back."""
    df = recency(df).withColumn("_bucket", P.day_bucket(F.col("_label")))
    days = df.groupBy(*by, F.col("_bucket.key").alias("_key")).agg(F.max(F.struct("_stamp", "_md", "_rid")).alias("_newest"), F.count(F.lit(1)).alias("day_rows"), F.first("_bucket.label").alias("day_label"))
    ordered = Window.partitionBy(*by).orderBy(F.desc("_newest"), F.desc("day_rows"), F.desc("day_label"), F.desc("_key"))
    days = days.withColumns({"day_rank": F.row_number().over(ordered), "_upto": F.sum("day_rows").over(ordered.rowsBetween(Window.unboundedPreceding, 0))})
    days = days.where((F.col("_upto") - F.col("day_rows") < max(1, min_samples)) & (F.col("day_rank") <= max(1, max_labels)))
    on = df["_bucket"]["key"].eqNullSafe(days["_key"])
    for k in by:
        on = on & df[k].eqNullSafe(days[k])
    return df.join(days.select(*[days[k] for k in by], "_key", "day_rows", "day_label", "day_rank"), on).drop(*[days[k] for k in by]).drop("_key", "_bucket")


def density(n: Column) -> Column:
    return F.when(n < 8, "sparse").when(n < 15, "balanced").otherwise("dense")


def retained_floor(n: Column, rules: R.Rules) -> Column:
    part = lambda keep, ratio: F.greatest(F.lit(keep), F.ceil(n * F.lit(ratio)).cast("bigint"))
    return F.when(n <= 4, n).when(n < 8, F.greatest(F.lit(rules.sparse_keep), n - rules.sparse_trim)).when(n < 15, part(rules.balanced_keep, rules.balanced_ratio)).otherwise(part(rules.dense_keep, rules.dense_ratio))


def clean_prices(df: DataFrame, rules: R.Rules, by: list[str]) -> DataFrame:
    """Flags outliers among the rows of each group: z-score, then fence, then tail, each over the survivors of the last.

    A step counts only where it leaves the retention floor whole, and none runs once the floor is reached. Adds `alive`,
    `outlier_reason`, `density`, `floor`, `n_numeric`."""
    w = Window.partitionBy(*by)
    df = df.withColumn("n_numeric", F.count(F.lit(1)).over(w))
    df = df.withColumns({"density": density(F.col("n_numeric")), "floor": retained_floor(F.col("n_numeric"), rules), "alive": F.lit(True), "outlier_reason": F.lit("")})
    plans = {"balanced": rules.balanced, "dense": rules.dense}
    setting = lambda f: F.when(F.col("density") == "balanced", F.lit(f(plans["balanced"]))).when(F.col("density") == "dense", F.lit(f(plans["dense"])))
    price = F.when(F.col("alive"), F.col("price_value"))

    def step(df: DataFrame, enabled: Column, removed: Column, reason: Column) -> DataFrame:
        df = df.withColumn("_out", F.col("alive") & F.coalesce(removed, F.lit(False)))
        n, left = F.count(F.when(F.col("alive"), 1)).over(w), F.count(F.when(F.col("alive") & ~F.col("_out"), 1)).over(w)
        df = df.withColumns({"_n": n, "_left": left})
        out = F.col("_out") & F.coalesce(enabled, F.lit(False)) & (F.col("_n") > F.col("floor")) & (F.col("_left") >= F.col("floor"))
        return df.withColumn("_out", out).withColumns({"outlier_reason": F.when(F.col("_out"), reason).otherwise(F.col("outlier_reason")), "alive": F.col("alive") & ~F.col("_out")})

    gap = F.greatest(setting(lambda t: t.gap_floor), half_even(F.col("_median") * setting(lambda t: t.gap_ratio)))
    live = F.count(F.when(F.col("alive"), 1)).over(w)
    df = with_deviation(df.withColumns({"_price": price, "_live": live}), "_price", by)
    far = F.abs(F.col("price_value") - F.col("_median")) >= gap
    z = F.abs(0.6745 * (F.col("price_value") - F.col("_median")) / F.greatest(F.col("_mad"), F.lit(1)))
    df = step(df, setting(lambda t: t.zscore is not None), (F.col("_live") >= 5) & (F.col("_mad") >= 1) & (z > setting(lambda t: float(t.zscore or 0))) & far, F.lit("modified_zscore"))

    df = df.withColumns({"_price": price, "_live": live}).withColumns({"_median": percentile("_price", 0.5, w), "_q1": percentile("_price", 0.25, w), "_q3": percentile("_price", 0.75, w)})
    reach = setting(lambda t: float(t.fence or 0)) * F.greatest(F.col("_q3") - F.col("_q1"), F.lit(1))
    outside = (F.col("price_value") < F.col("_q1") - reach) | (F.col("price_value") > F.col("_q3") + reach)
    df = step(df, setting(lambda t: t.fence is not None), (F.col("_live") >= 5) & outside & far, F.lit("iqr_fence"))

    by_price = w.orderBy(F.asc_nulls_last("_price"), "_rid")
    df = df.withColumns({"_price": price, "_live": live}).withColumns({"_pos": F.row_number().over(by_price), "_gap": F.lead("_price").over(by_price) - F.col("_price")})
    df = df.withColumns({"_widest": F.max(F.struct(F.col("_gap"), -F.col("_pos"))).over(w)}).withColumns({"_cut": -F.col("_widest")["col2"], "_width": F.col("_widest")["_gap"]})
    low = F.col("_cut") <= F.col("_live") - F.col("_cut")
    side = F.when(F.col("_pos") <= F.col("_cut"), low).otherwise(~low)  # of the minority
    df = df.withColumns({"_low": low, "_minor": side & F.col("alive")})
    major = F.when(F.col("alive") & ~F.col("_minor"), F.col("_price"))
    minor = F.when(F.col("_minor"), F.col("_price"))
    df = df.withColumns({"_major": major, "_small": minor}).withColumns({
        "_center": percentile("_major", 0.5, w), "_spread": F.max("_major").over(w) - F.min("_major").over(w), "_nmajor": F.count("_major").over(w), "_nminor": F.count("_small").over(w), "_minor_spread": F.coalesce(F.max("_small").over(w) - F.min("_small").over(w), F.lit(0)),
    })
    compact = F.col("_spread") <= F.greatest(F.lit(120), half_even(F.col("_center") * 0.015))
    few = (F.col("_nmajor") >= 3) & (F.col("_nminor") <= F.greatest(F.lit(2), F.floor(F.col("_live") / 3)))
    wide = F.col("_width") >= F.greatest(F.lit(120), F.col("_spread") * 2, F.greatest(F.lit(20), F.col("_minor_spread")) * 2)
    df = step(df, setting(lambda t: t.tail), (F.col("_live") >= 5) & few & compact & wide & F.col("_minor"), F.when(F.col("_low"), "cluster_gap_low_tail").otherwise("cluster_gap_high_tail"))
    return df.drop("_out", "_n", "_left", "_price", "_live", "_median", "_mad", "_q1", "_q3", "_pos", "_gap", "_widest", "_cut", "_width", "_low", "_minor", "_major", "_small", "_center", "_spread", "_nmajor", "_nminor", "_minor_spread")


def clean_sorted(df: DataFrame, rules: R.Rules) -> DataFrame:
    """clean_prices() for one row per group with its prices as a sorted array `_live`: the steps leave the survivors in it.

    Adds `density`, `floor`, `n_numeric`. Rows of one price are alike to every step, so the array holds all that is asked."""
    df = df.withColumn("n_numeric", F.size("_live").cast("bigint"))
    df = df.withColumns({"density": density(F.col("n_numeric")), "floor": retained_floor(F.col("n_numeric"), rules)})
    plans = {"balanced": rules.balanced, "dense": rules.dense}
    setting = lambda f: F.when(F.col("density") == "balanced", F.lit(f(plans["balanced"]))).when(F.col("density") == "dense", F.lit(f(plans["dense"])))
    live = F.col("_live")
    n = F.size(live)

    def step(df: DataFrame, enabled: Column, kept: Column) -> DataFrame:
        df = df.withColumn("_kept", F.when(F.coalesce(enabled, F.lit(False)) & (n >= 5) & (n > F.col("floor")), kept))
        return df.withColumn("_live", F.when(F.size("_kept") >= F.col("floor"), F.col("_kept")).otherwise(live))

    gap = F.greatest(setting(lambda t: t.gap_floor), half_even(F.col("_median") * setting(lambda t: t.gap_ratio)))
    far = lambda p: F.abs(p - F.col("_median")) >= F.col("_far")
    df = df.withColumn("_median", of_sorted(live, 0.5)).withColumns({"_off": F.sort_array(F.transform(live, lambda p: F.abs(p - F.col("_median")))), "_far": gap})
    df = df.withColumns({"_mad": of_sorted(F.col("_off"), 0.5), "_z": setting(lambda t: float(t.zscore or 0))})
    z = lambda p: F.abs(0.6745 * (p - F.col("_median")) / F.greatest(F.col("_mad"), F.lit(1)))
    df = step(df, setting(lambda t: t.zscore is not None) & (F.col("_mad") >= 1), F.filter(live, lambda p: ~((z(p) > F.col("_z")) & far(p))))

    df = df.withColumns({"_median": of_sorted(live, 0.5), "_q1": of_sorted(live, 0.25), "_q3": of_sorted(live, 0.75)})
    df = df.withColumns({"_far": gap, "_reach": setting(lambda t: float(t.fence or 0)) * F.greatest(F.col("_q3") - F.col("_q1"), F.lit(1))})
    outside = lambda p: (p < F.col("_q1") - F.col("_reach")) | (p > F.col("_q3") + F.col("_reach"))
    df = step(df, setting(lambda t: t.fence is not None), F.filter(live, lambda p: ~(outside(p) & far(p))))

    df = df.withColumn("_widest", F.array_max(F.transform(live, lambda p, i: F.struct((F.get(live, i + 1) - p).alias("gap"), (-1 - i).alias("cut")))))
    df = df.withColumns({"_width": F.col("_widest.gap"), "_cut": -F.col("_widest.cut")})
    head, tail = F.slice(live, F.lit(1), F.col("_cut")), F.slice(live, F.col("_cut") + 1, n - F.col("_cut"))
    low = F.col("_cut") <= n - F.col("_cut")
    df = df.withColumns({"_major": F.when(low, tail).otherwise(head), "_minor": F.when(low, head).otherwise(tail)})
    size, spread = F.size, lambda c: F.get(c, F.size(c) - 1) - F.get(c, F.lit(0))
    df = df.withColumns({"_center": of_sorted(F.col("_major"), 0.5), "_spread": spread("_major"), "_minor_spread": F.coalesce(spread("_minor"), F.lit(0))})
    compact = F.col("_spread") <= F.greatest(F.lit(120), half_even(F.col("_center") * 0.015))
    few = (size("_major") >= 3) & (size("_minor") <= F.greatest(F.lit(2), F.floor(n / 3)))
    wide = F.col("_width") >= F.greatest(F.lit(120), F.col("_spread") * 2, F.greatest(F.lit(20), F.col("_minor_spread")) * 2)
    df = step(df, setting(lambda t: t.tail) & few & compact & wide, F.col("_major"))
    return df.drop("_kept", "_median", "_off", "_far", "_mad", "_z", "_q1", "_q3", "_reach", "_widest", "_width", "_cut", "_major", "_minor", "_center", "_spread", "_minor_spread")


def price_clusters(df: DataFrame) -> DataFrame:
    """One row per price cluster of the sorted array `_live` of each row: _cluster (0, 1, ...) and its prices `_own`. Prices
    are cut where the gap reaches max(80, 1.2 % of the median, 1.5 IQR); two never part."""
    live, n = F.col("_live"), F.size("_live")
    df = df.withColumns({"_median": of_sorted(live, 0.5), "_iqr": of_sorted(live, 0.75) - of_sorted(live, 0.25)})
    df = df.withColumn("_gap", F.greatest(F.lit(80), half_even(F.col("_median") * 0.012), half_even(F.greatest(F.col("_iqr"), F.lit(0)) * 1.5)))
    begins = lambda i: (i == 0) | ((n > 2) & (F.get(live, i) - F.get(live, i - 1) >= F.col("_gap")))
    df = df.withColumn("_begins", F.filter(F.sequence(F.lit(0), n - 1), begins))
    own = F.transform("_begins", lambda i, k: F.slice(live, i + 1, F.coalesce(F.get("_begins", k + 1), n) - i))
    kept = [c for c in df.columns if c not in ("_live", "_median", "_iqr", "_gap", "_begins")]
    return df.select(*kept, F.posexplode(own).alias("_cluster", "_own"))


def status_weight(rules: R.Rules) -> Column:
    status = F.col("dstatus")
    strict = F.lit(rules.status_other)
    for keyword, weight in reversed(rules.status_contains):
        strict = F.when(status.contains(keyword), weight).otherwise(strict)
    for exact, weight in reversed(rules.status_exact):
        strict = F.when(status == exact, weight).otherwise(strict)
    return F.when(rules.is_strict(F.col("brand_title")), strict).otherwise(F.when(status != "", rules.status_some).otherwise(rules.status_none))


def score_clusters(clusters: DataFrame, rules: R.Rules) -> DataFrame:
    """Adds the price interval, score and confidence of clusters (n, median_price, q1, q3, price_min, price_max, reference_price)."""
    n, median = F.col("sample_count"), F.col("median_price")
    pad = F.greatest(F.lit(rules.padding_floor), half_even(F.col("price_min") * rules.padding_ratio)) if rules.padded else F.lit(0)
    few = n <= rules.minmax_most
    method = F.when(n == 1, F.when(pad > 0, "single_quote_padded").otherwise("single_quote_exact")).when(few, "observed_minmax").when(n < rules.iqr_least, "sparse_observed_minmax").otherwise("iqr_band")
    band = method == "iqr_band"
    clusters = clusters.withColumns({"interval_method": method, "band_low": F.when(n == 1, F.col("price_min") - pad).when(band, F.col("q1")).otherwise(F.col("price_min")), "band_high": F.when(n == 1, F.col("price_max") + pad).when(band, F.col("q3")).otherwise(F.col("price_max"))})
    spread = F.greatest(F.col("band_high") - F.col("band_low"), F.lit(0))
    off = F.abs(median - F.col("reference_price"))
    score = n * rules.count_weight + status_weight(rules) - F.least(spread, F.lit(1600)) / max(rules.spread_divisor, 1.0)
    score = score - F.when(n == 1, rules.single_penalty).when(n == 2, rules.pair_penalty).otherwise(0.0)
    score = score - F.coalesce(F.least(off, F.lit(rules.reference_cap)) / max(rules.reference_divisor, 1.0), F.lit(0.0))
    ratio = F.when(median != 0, (F.col("q3") - F.col("q1")) / median).otherwise(1.0)
    sure = F.least(n, F.lit(20)) * 3 + F.when(ratio <= 0.01, 30).when(ratio <= 0.02, 22).when(ratio <= 0.04, 12).otherwise(4)
    away = off / F.greatest(F.col("reference_price"), F.lit(1))
    sure = F.least(F.lit(98), sure + F.when(away <= 0.015, 18).when(away <= 0.03, 10).when(away <= 0.06, 4).otherwise(0)).cast("bigint")
    return clusters.withColumns({"score": F.bround(score, 3), "confidence_score": sure, "price_range": F.concat_ws("-", F.col("band_low").cast("string"), F.col("band_high").cast("string"))}).withColumn("confidence_label", F.when(F.col("confidence_score") >= 80, "high").when(F.col("confidence_score") >= 58, "medium").otherwise("cautious"))


#: What is counted of a key before any filter.
TOTALS = ["source_row_count", "source_count", "latest_imported_at", "min_price", "max_price"]


def prepared(quotes: DataFrame, rules: R.Rules, by: list[str] = SKU, totals: bool = False) -> DataFrame:
    """Latest rows per seller with price_value, reject_reason and the classes of the rules; with totals, TOTALS beside
    every row, which ride on the same exchange as all that follows."""
    keys = with_seller(quotes.withColumns({k: P.plain(k) for k in by if k in quotes.columns}).repartition(*by)).withColumn("price_value", P.parse_price("price_text"))
    w, price = Window.partitionBy(*by), F.col("price_value")
    if totals:  # in the order of the sellers, so that both windows have one sort
        keys = keys.sortWithinPartitions(*by, "_merchant", *newest())
        keys = keys.withColumns({"source_row_count": F.count(F.lit(1)).over(w), "latest_imported_at": F.max(P.plain("imported_at")).over(w), "min_price": F.coalesce(F.min(price).over(w), F.lit(0)), "max_price": F.coalesce(F.max(price).over(w), F.lit(0))})
    if "condition_bucket" in by:
        keys = keys.withColumn("_stored_bucket", F.col("condition_bucket"))
    rows = latest_per_seller(keys, by)
    if totals:  # one row of each seller is left
        rows = rows.withColumn("source_count", F.count(F.lit(1)).over(w))
    rows = R.classify(rows, rules)
    if "condition_bucket" in by:
        rows = rows.withColumn("condition_bucket", F.col("_stored_bucket")).drop("_stored_bucket")
    return rows.withColumn("reject_reason", R.reject_reason(rules))


def latest_numeric_day(rows: DataFrame, by: list[str]) -> DataFrame:
    """Adds raw_day: the newest day label among numeric rows, rejected ones included."""
    w = Window.partitionBy(*by)
    key = F.when(F.col("price_value").isNotNull(), F.struct("_stamp", "_md", "_rid", P.day_bucket(F.col("_label"))["label"].alias("label")))
    return rows.withColumn("raw_day", F.max(key).over(w)["label"])


def market_clusters(quotes: DataFrame, rules: R.Rules, references: DataFrame | None = None, by: list[str] = SKU, totals: bool = False) -> DataFrame:
    """One row per price cluster of every SKU, scored, with cluster_id and rank (1: best); with totals, TOTALS of the SKU."""
    rows = latest_numeric_day(prepared(quotes, rules, by, totals), by)
    good = recent_days(rows.where("reject_reason is null and price_value is not null"), rules.day_min_samples, rules.day_max_labels, by)
    good = good.withColumn("dstatus", F.coalesce(P.filled("dstatus"), F.lit("unlabeled")))
    w, group = Window.partitionBy(*by), [*by, "dstatus"]
    newest_row = ["_stamp", "_md", "_rid"]
    per = good.groupBy(*group).agg(
        F.sort_array(F.collect_list("price_value")).alias("_live"), F.max(F.struct(*newest_row)).alias("_status_newest"), F.max(F.struct(*newest_row, "_label")).alias("_newest_label"), F.max(F.struct(*newest_row, "day_label")).alias("_newest_day"), F.first("raw_day").alias("raw_day"), *[F.first(c).alias(c) for c in TOTALS if totals],
    )
    per = per.withColumns({"selected_rows": F.sum(F.size("_live")).over(w), "selected_label": F.max("_newest_label").over(w)["_label"], "selected_day": F.max("_newest_day").over(w)["day_label"]}).drop("_newest_label", "_newest_day")
    own = F.col("_own")
    clusters = price_clusters(clean_sorted(per, rules)).withColumns({
        "sample_count": F.size(own).cast("bigint"), "median_price": of_sorted(own, 0.5), "q1": of_sorted(own, 0.25), "q3": of_sorted(own, 0.75), "price_min": F.get(own, F.lit(0)), "price_max": F.get(own, F.size(own) - 1),
    }).withColumnsRenamed({"density": "cleaning_profile", "floor": "retention_floor"}).drop("_own")
    if references is not None:
        clusters = with_reference(clusters, references)
    else:
        clusters = clusters.withColumn("reference_price", F.lit(None).cast("bigint"))
    clusters = score_clusters(clusters, rules)
    ids = w.orderBy(F.desc("_status_newest"), "dstatus", "_cluster")
    clusters = clusters.withColumn("cluster_id", F.row_number().over(ids) - 1)
    best = w.orderBy(F.desc("score"), F.desc("sample_count"), F.asc(F.col("band_high") - F.col("band_low")), "cluster_id")
    return clusters.withColumn("rank", F.row_number().over(best)).drop("_cluster", "_status_newest")


def with_reference(df: DataFrame, references: DataFrame) -> DataFrame:
    """Adds reference_price: of the exact SKU title, else of the model alone. references: brand_title, series_title, sku_title, reference_price."""
    exact = references.select(F.col("brand_title").alias("_b"), F.col("series_title").alias("_s"), F.col("sku_title").alias("_t"), F.col("reference_price").alias("_exact"))
    model = exact.select(F.col("_b").alias("_mb"), F.col("_s").alias("_ms"), F.col("_t").alias("_mt"), F.col("_exact").alias("_model"))
    group = F.col("group_title") if "group_title" in df.columns else F.lit("")
    df = df.withColumn("_title", P.sku_title("model_title", group))
    df = df.join(exact, (df["brand_title"] == F.col("_b")) & (df["series_title"] == F.col("_s")) & (F.col("_title") == F.col("_t")), "left")
    df = df.join(model, (df["brand_title"] == F.col("_mb")) & (df["series_title"] == F.col("_ms")) & (df["model_title"] == F.col("_mt")), "left")
    return df.withColumn("reference_price", F.coalesce("_exact", "_model")).drop("_b", "_s", "_t", "_exact", "_mb", "_ms", "_mt", "_model", "_title")


def snapshots(clusters: DataFrame, by: list[str] = SKU) -> DataFrame:
    """One row per SKU from its clusters: the best one, and how many others are suspiciously far from it."""
    w = Window.partitionBy(*by)
    df = clusters.withColumn("_best", F.max(F.when(F.col("rank") == 1, F.col("median_price"))).over(w))
    limit = F.greatest(F.lit(80), half_even(F.col("_best") * 0.015))
    df = df.withColumns({"_low": (F.col("rank") > 1) & (F.col("_best") - F.col("median_price") >= limit), "_high": (F.col("rank") > 1) & (F.col("median_price") - F.col("_best") >= limit)})
    best = lambda c: F.max(F.when(F.col("rank") == 1, F.col(c)))
    out = df.groupBy(*by).agg(
        best("median_price").alias("market_price"), best("price_range").alias("price_range"), best("band_low").alias("band_low"), best("band_high").alias("band_high"), best("dstatus").alias("trusted_status"), best("sample_count").alias("trusted_sample_count"), best("confidence_score").alias("confidence_score"), best("confidence_label").alias("confidence_label"),
        best("interval_method").alias("interval_method"), F.max("reference_price").alias("reference_price"), F.count(F.lit(1)).alias("cluster_count"),
        F.count(F.when(F.col("_low"), 1)).alias("suspicious_low_clusters"), F.coalesce(F.sum(F.when(F.col("_low"), F.col("sample_count"))), F.lit(0)).alias("suspicious_low_rows"), F.count(F.when(F.col("_high"), 1)).alias("suspicious_high_clusters"), F.coalesce(F.sum(F.when(F.col("_high"), F.col("sample_count"))), F.lit(0)).alias("suspicious_high_rows"),
        F.max("selected_rows").alias("selection_sample_count"), F.max("selected_label").alias("selected_gprice_label"), F.max("selected_day").alias("selected_day"), F.max("raw_day").alias("raw_day"), *[F.max(c).alias(c) for c in TOTALS if c in clusters.columns],
    )
    return out.withColumns({"fallback_applied": ((F.col("raw_day") != "") & (F.col("selected_day") != "") & (F.col("raw_day") != F.col("selected_day"))).cast("int"), "low_quality": ((F.col("trusted_sample_count") <= 2) | F.col("interval_method").startswith("single_quote")).cast("int")})


def sku_totals(quotes: DataFrame, by: list[str] = SKU) -> DataFrame:
    """Counts of every SKU before any filter."""
    gid = F.col("gid") if "gid" in quotes.columns else F.lit(None)
    df = quotes.withColumns({k: P.plain(k) for k in by})
    price = P.parse_price("price_text")
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("source_row_count"), F.count_distinct(P.merchant(group_id=gid)).alias("source_count"), F.max(P.plain("imported_at")).alias("latest_imported_at"), F.coalesce(F.min(price), F.lit(0)).alias("min_price"), F.coalesce(F.max(price), F.lit(0)).alias("max_price"))


def live_snapshot(quotes: DataFrame, rules: R.Rules, references: DataFrame | None = None) -> DataFrame:
    """Snapshot rows of all SKUs that have a market, with their totals and scope."""
    spec = P.group_spec("group_title")
    made = snapshots(market_clusters(quotes, rules, references, totals=True))
    return made.withColumns({"scope_level": P.scope_level("group_title", spec), "capacity_label": spec["capacity"], "variant_label": spec["variant"], "selection_mode": F.lit("latest_valid_day_only"), "search_text": P.search_text(*SKU)}).withColumns({"search_text_normalized": P.normalize_search("search_text"), "model_group_normalized": P.normalize_search(P.search_text("model_title", "group_title"))})


def skip_reasons(quotes: DataFrame, rules: R.Rules) -> DataFrame:
    """SKUs without a market and why: no numeric rows, or none left by the status filter."""
    rows = prepared(quotes, rules)
    numeric = F.col("price_value").isNotNull()
    per = rows.groupBy(*SKU).agg(F.count(F.when(numeric, 1)).alias("numeric"), F.count(F.when(numeric & F.col("reject_reason").isNull(), 1)).alias("valid"))
    return per.where("valid = 0").select(*SKU, F.when(F.col("numeric") == 0, "no_numeric_rows").otherwise("no_valid_rows_after_status_filter").alias("reason"))


def reject_counts(quotes: DataFrame, rules: R.Rules) -> DataFrame:
    """Rejections per SKU and reason, in long form."""
    rows = prepared(quotes, rules)
    reason = F.coalesce("reject_reason", F.when(F.col("price_value").isNull(), "missing_numeric_price"))
    return rows.withColumn("reason", reason).where("reason is not null").groupBy(*SKU, "reason").agg(F.count(F.lit(1)).alias("n"))


def reason_maps(counts: DataFrame, by: list[str] = SKU) -> DataFrame:
    """The long form as one map per SKU."""
    return counts.groupBy(*by).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("reason", "n")))).alias("reason_counts"))


def capacity_breakdown(quotes: DataFrame, rules: R.Rules, references: DataFrame | None = None) -> DataFrame:
    """Markets of every model by capacity, in capacity order: variants and rows of each, and its best cluster."""
    by = ["brand_title", "series_title", "model_title", "group_title"]
    spec = P.group_spec("group_title")
    df = quotes.withColumns({"_capacity": spec["capacity"], "_variant": spec["variant"]})
    df = df.withColumn("group_title", F.when(F.col("_capacity") == "DEFAULT", "").otherwise(F.col("_capacity")))
    named = F.when(~F.col("_variant").isin("STANDARD", "UNSPECIFIED"), F.col("_variant"))
    totals = df.withColumns({k: P.plain(k) for k in by}).groupBy(*by).agg(F.count(F.lit(1)).alias("row_count"), F.count_distinct(named).alias("variant_count"), F.array_join(F.array_sort(F.collect_set(named)), "|").alias("variant_labels"))
    made = snapshots(market_clusters(df.drop("condition_bucket"), rules, references, by), by)
    order = P.capacity_order("group_title")
    out = totals.join(made.select(*by, "market_price", "price_range", "trusted_sample_count", "confidence_score"), by, "left")
    place = F.row_number().over(Window.partitionBy("brand_title", "series_title", "model_title").orderBy(order, "group_title"))
    return out.withColumn("capacity_rank", place).withColumn("capacity_label", F.when(F.col("group_title") == "", "DEFAULT").otherwise(F.col("group_title")))
