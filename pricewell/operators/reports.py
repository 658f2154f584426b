"""Operational reports: counts, histograms, catalogs, markers, alerts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pricewell.functions import columns as P

LINE = ["brand_title", "series_title", "model_title", "group_title", "condition_bucket"]


def tally(condition: Column) -> Column:
    return F.count(F.when(condition, 1))


#: Each report: its source, what it groups by, what it measures.
KINDS: dict[str, tuple[str, tuple[str, ...], tuple[str, ...]]] = {
    "brands": ("tasks", ("brand_title",), ("task_count", "ok_tasks", "error_tasks", "exception_tasks", "kept_task_count", "kept_rows")),
    "series": ("tasks", ("brand_title", "series_title"), ("task_count", "ok_tasks", "error_tasks", "exception_tasks", "kept_task_count", "kept_rows")),
    "codes": ("tasks", ("status", "code", "msg"), ("task_count", "kept_rows", "example_model")),
    "condition_buckets": ("quotes", ("condition_bucket",), ("quote_count", "target_quote_count", "review_quote_count", "example_model")),
    "gprice_labels": ("quotes", ("gprice_label",), ("quote_count", "target_quote_count", "example_model")),
    "brand_condition_buckets": ("quotes", ("brand_title", "condition_bucket"), ("quote_count", "target_quote_count", "review_quote_count", "example_model")),
    "brand_gprice_labels": ("quotes", ("brand_title", "gprice_label"), ("quote_count", "target_quote_count", "example_model")),
    "code_brands": ("tasks", ("status", "code", "brand_title"), ("task_count", "kept_rows", "example_model")),
    "error_brands": ("tasks", ("brand_title", "code"), ("task_count", "kept_task_count", "example_model")),
}


def _measures() -> dict[str, Column]:
    status = lambda s: tally(F.col("status") == s)
    return {
        "task_count": F.count(F.lit(1)), "quote_count": F.count(F.lit(1)), "ok_tasks": status("ok"), "error_tasks": status("error"), "exception_tasks": status("exception"),
        "kept_task_count": tally(F.col("row_count") > 0), "kept_rows": F.sum("row_count"), "target_quote_count": tally(F.col("is_target_price") == 1), "review_quote_count": tally(F.col("needs_review") == 1), "example_model": F.min("model_title"),
    }


def report(kind: str, tasks: DataFrame, quotes: DataFrame, run_key: str | None = None) -> DataFrame:
    """One of the nine reports, over all runs or one; callers order and cut it."""
    source, dims, names = KINDS[kind]
    df = tasks if source == "tasks" else quotes
    if run_key:
        df = df.where(F.col("run_key") == run_key)
    if "gprice_label" in dims:
        df = df.withColumn("gprice_label", P.report_label("gprice"))
    made = _measures()
    if "example_model" not in names:
        return df.groupBy(*dims).agg(*[made[n].alias(n) for n in names])
    # the least of a text needs a sort: first count by hash with the model as a key, then sort what few rows are left
    sums = [n for n in names if n != "example_model"]
    parts = df.groupBy(*dims, "model_title").agg(*[made[n].alias(n) for n in sums])
    return parts.groupBy(*dims).agg(*[F.sum(n).alias(n) for n in sums], made["example_model"].alias("example_model"))


def summary(tasks: DataFrame, quotes: DataFrame, events: DataFrame, runs: DataFrame) -> DataFrame:
    """Run summary in long form: (section, name, n)."""
    long = lambda df, section, name: df.groupBy(F.col(name).alias("name")).agg(F.count(F.lit(1)).alias("n")).select(F.lit(section).alias("section"), "name", "n")
    drops = ["total_rows_seen", "row_count", "drop_by_date", "drop_out_of_stock", "drop_invalid_price"]
    totals = tasks.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in drops], F.count(F.lit(1)).alias("task_count"))
    totals = totals.unpivot([], [*drops, "task_count"], "name", "n").select(F.lit("totals").alias("section"), "name", "n")
    counts = quotes.agg(F.count(F.lit(1)).alias("quote_count"), tally(F.col("is_target_price") == 1).alias("target_quote_count"), tally(F.col("needs_review") == 1).alias("review_quote_count"))
    counts = counts.unpivot([], ["quote_count", "target_quote_count", "review_quote_count"], "name", "n").select(F.lit("totals").alias("section"), "name", "n")
    run_count = runs.agg(F.count(F.lit(1)).alias("n")).select(F.lit("totals").alias("section"), F.lit("run_count").alias("name"), "n")
    top = lambda df, section, name: long(df, section, name).orderBy(F.desc("n"), F.asc("name")).limit(10)
    labelled = quotes.withColumn("gprice_label", P.report_label("gprice"))
    parts = [totals, counts, run_count, long(tasks, "task_status", "status"), long(tasks.where("code <> ''"), "api_code", "code"), long(events, "event_type", "event_type"), top(quotes, "top_brands", "brand_title"), top(quotes, "top_condition_buckets", "condition_bucket"), top(labelled, "top_gprice_labels", "gprice_label")]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def run_stats(quotes: DataFrame) -> DataFrame:
    return quotes.groupBy("run_key").agg(F.count(F.lit(1)).alias("quote_count"), F.max("imported_at").alias("latest_imported_at"))


def ranked_runs(runs: DataFrame, quotes: DataFrame) -> DataFrame:
    """Runs with quote statistics and their place: with quotes first, newest first, completed before running before others."""
    df = runs.join(run_stats(quotes), "run_key", "left")
    some = F.when(F.coalesce("quote_count", F.lit(0)) > 0, 0).otherwise(1)
    newest = F.coalesce("latest_imported_at", "started_at", "finished_at", "created_at")
    done = F.when(F.col("status") == "completed", 0).when(F.col("status") == "running", 1).otherwise(2)
    order = [some.asc(), newest.desc_nulls_last(), done.asc(), F.col("created_at").desc_nulls_last(), F.col("run_key").asc()]
    return df.withColumn("place", F.row_number().over(Window.orderBy(*order)))


def preferred_run(runs: DataFrame, quotes: DataFrame) -> DataFrame:
    return ranked_runs(runs, quotes).where("place = 1").select("run_key", "quote_count", "latest_imported_at")


def live_run(pointer: DataFrame, snapshots: DataFrame, preferred: DataFrame) -> DataFrame:
    """The run that is live: the pointer's if it has snapshots, else the newest published, else the preferred one."""
    published = snapshots.groupBy("run_key").agg(F.max("published_at").alias("published_at"))
    pointed = pointer.join(published, "run_key", "left_semi").select(F.lit(0).alias("tier"), "run_key", F.lit("").alias("at"))
    newest = published.select(F.lit(1).alias("tier"), "run_key", F.col("published_at").cast("string").alias("at"))
    rest = preferred.select(F.lit(2).alias("tier"), "run_key", F.lit("").alias("at"))
    return pointed.unionByName(newest).unionByName(rest).orderBy("tier", F.desc("at"), F.desc("run_key")).limit(1).select("run_key")


def live_marker(quotes: DataFrame, tasks: DataFrame, events: DataFrame, runs: DataFrame) -> DataFrame:
    """Counts and newest times of the four tables, in one row."""
    one = lambda df, name, at: df.agg(F.count(F.lit(1)).alias(f"{name}_count"), F.coalesce(F.max(F.col(at).cast("string")), F.lit("")).alias(f"latest_{name}"))
    return one(quotes, "quote", "imported_at").join(one(tasks, "task", "event_time"), how="cross").join(one(events.withColumn("stamp", F.date_format("ts", "yyyy-MM-dd HH:mm:ss")), "event", "stamp"), how="cross").join(one(runs, "run", "created_at"), how="cross")


def sku_catalog(quotes: DataFrame) -> DataFrame:
    """Counts, distinct sellers, price range of leading digits and newest times per SKU."""
    lead = F.regexp_extract(F.coalesce("price_text", F.lit("")), "^([0-9]+)", 1).try_cast("bigint")
    return quotes.groupBy(*LINE).agg(F.count(F.lit(1)).alias("row_count"), F.count_distinct(P.catalog_seller()).alias("source_count"), F.min(lead).alias("min_price"), F.max(lead).alias("max_price"), F.max("imported_at").alias("latest_imported_at"), F.max("gprice").alias("latest_gprice"))


def all_candidates(own: DataFrame, external: DataFrame) -> DataFrame:
    """Own and external candidates as one bag, missing columns null."""
    return own.withColumn("data_source", F.lit("quote_rows")).unionByName(external.withColumn("data_source", F.lit("external")), allowMissingColumns=True)


def drop_statistics(items: DataFrame, by: list[str], reasons: list[str]) -> DataFrame:
    """Kept and dropped items per key, a column per reason of a fixed list."""
    return items.groupBy(*by).agg(F.count(F.lit(1)).alias("total"), tally(F.col("drop_reason").isNull()).alias("kept"), *[tally(F.col("drop_reason") == r).alias(r) for r in reasons])


def group_cap(items: DataFrame, by: list[str], order: str, most: int) -> DataFrame:
    """Keeps the first `most` valid items of each group in source order; adds skipped, the items after the last kept."""
    w = Window.partitionBy(*by)
    valid = F.col("drop_reason").isNull()
    items = items.withColumn("_nth", F.sum(valid.cast("int")).over(w.orderBy(order).rowsBetween(Window.unboundedPreceding, 0)))
    kept = valid & (F.col("_nth") <= most)
    items = items.withColumn("_last", F.max(F.when(F.col("_nth") == most, F.struct(F.when(valid, F.lit(1)).otherwise(0).alias("v"), -F.col(order)))).over(w))
    after = F.sum((F.col("_nth") > most).cast("int")).over(w)
    return items.withColumns({"kept": kept, "skipped": after}).where("kept").drop("_nth", "_last", "kept")


def queue_status(states: DataFrame, as_of: Column) -> DataFrame:
    """Items per status with the age in hours of the oldest and newest."""
    age = F.timestamp_diff("SECOND", F.date_trunc("second", F.col("updated_at").cast("timestamp")), as_of) / 3600.0
    return states.groupBy("status").agg(F.count(F.lit(1)).alias("n"), F.round(F.max(age), 3).alias("oldest_hours"), F.round(F.min(age), 3).alias("newest_hours"))


def alerts(metrics: DataFrame, limits: dict[str, float]) -> DataFrame:
    """Metrics (name, value) over their limit."""
    limit = F.lit(None).cast("double")
    for name, most in limits.items():
        limit = F.when(F.col("name") == name, float(most)).otherwise(limit)
    return metrics.withColumn("limit_value", limit).where(F.col("value") > F.col("limit_value"))


def stage_timings(rows: DataFrame) -> DataFrame:
    """Mean milliseconds per stage (nulls do not count), slowest first by rank."""
    means = rows.where("ms is not null").groupBy("stage").agg(F.avg("ms").alias("mean"), F.count("ms").alias("n"))
    return means.withColumn("place", F.row_number().over(Window.orderBy(F.desc("mean"), "stage"))).withColumn("mean_ms", F.round("mean", 6)).drop("mean")


def import_preview(matched: DataFrame) -> DataFrame:
    """Matched and external rows per source title, and in all."""
    made = [F.count(F.lit(1)).alias("row_count"), tally(F.col("match_level") != "unmatched").alias("matched_count"), tally(F.col("match_level") == "unmatched").alias("external_count")]
    return matched.groupBy("source_title").agg(*made).unionByName(matched.agg(*made).select(F.lit("*").alias("source_title"), "row_count", "matched_count", "external_count"))


def release_gate(snapshots: DataFrame, quotes: DataFrame, required: list[str]) -> DataFrame:
    """One verdict per run: required columns are there, the key is set, and there are snapshots or quotes."""
    missing = sorted(set(required) - set(snapshots.columns))
    a = snapshots.groupBy("run_key").agg(F.count(F.lit(1)).alias("snapshot_count"))
    b = quotes.groupBy("run_key").agg(F.count(F.lit(1)).alias("quote_count"))
    df = a.join(b, "run_key", "full").na.fill(0, ["snapshot_count", "quote_count"])
    good = (F.col("run_key") != "") & ((F.col("snapshot_count") > 0) | (F.col("quote_count") > 0)) & F.lit(not missing)
    return df.withColumn("ok", F.coalesce(good, F.lit(False)))


def overview(marker: DataFrame, hot: DataFrame, *more: DataFrame) -> DataFrame:
    """The live marker with the hot list as one array; all are of one row (more: such as run summary or reference counts)."""
    best = hot.agg(F.array_sort(F.collect_list(F.struct("place", "label"))).alias("hot"))
    for one in more:
        marker = marker.join(one, how="cross")
    return marker.join(best, how="cross").withColumn("hot_count", F.size("hot"))


def stage_figures(source: DataFrame, deduped: DataFrame, recent: DataFrame) -> DataFrame:
    """Rows by stage of the cleaner, and the ten largest brands, in long form."""
    one = lambda df, name: df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("name"), "n")
    target = deduped.where("is_target_price = 1")
    brands = deduped.where("brand_title <> ''").groupBy("brand_title").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "brand_title").limit(10)
    out = one(source, "source_rows").unionByName(one(deduped, "deduped_rows")).unionByName(one(recent, "recent_rows")).unionByName(one(target, "target_rows"))
    return out.unionByName(brands.select(F.concat(F.lit("brand:"), F.col("brand_title")).alias("name"), "n"))
