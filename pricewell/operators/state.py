"""Table state without an update engine: upserts, seeds, replacements and idempotent appends as unions, windows and joins.

Every operator returns the new state of a table; sinks write it partition by partition (see sources/sinks.py)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pricewell.functions import columns as P
from pricewell.operators import rules as R


def upsert(stored: DataFrame, incoming: DataFrame, keys: list[str], order: list[str], keep_first: tuple[str, ...] = ()) -> DataFrame:
    """The last row of each key by arrival; columns of keep_first stay as first written. Incoming rows are newer than stored."""
    both = stored.withColumn("_new", F.lit(0)).unionByName(incoming.withColumn("_new", F.lit(1)), allowMissingColumns=True)
    names = [c for c in both.columns if c not in ("_new", *keys)]
    at = F.struct(F.col("_new"), *[F.col(c) for c in order])
    made = [F.max_by(F.struct(*names), at).alias("_last"), *[F.min_by(F.struct(F.col(c)), at).alias(f"_{c}") for c in keep_first]]
    merged = both.groupBy(*keys).agg(*made)
    return merged.select(*[F.col(c) if c in keys else F.col(f"_{c}")[c].alias(c) if c in keep_first else F.col("_last")[c].alias(c) for c in both.columns if c != "_new"])


def seed_tasks(stored: DataFrame, planned: DataFrame, keys: list[str]) -> DataFrame:
    """Adds planned tasks that are missing; of those there, refreshes titles, keeps the status and a payload that isn't empty."""
    a, b = stored.alias("a"), planned.alias("b")
    out = a.join(b, [F.col(f"a.{k}") == F.col(f"b.{k}") for k in keys], "full")
    pick = lambda c, first, second: F.coalesce(F.col(f"{first}.{c}"), F.col(f"{second}.{c}")).alias(c)
    payload = F.coalesce(F.nullif(F.col("a.payload_json"), F.lit("")), F.col("b.payload_json"), F.lit("")).alias("payload_json")
    return out.select(*[pick(k, "a", "b") for k in keys], *[pick(c, "b", "a") for c in ("brand_title", "series_title", "model_title")], F.coalesce("a.status", F.lit("pending")).alias("status"), payload)


def requeue(tasks: DataFrame, running: str = "running", pending: str = "pending") -> DataFrame:
    """Running tasks wait again, with code and message cleared."""
    hit = F.col("status") == running
    return tasks.withColumns({**{c: F.when(hit, "").otherwise(F.col(c)) for c in ("code", "msg")}, "status": F.when(hit, pending).otherwise(F.col("status"))})


def append_events(events: DataFrame, keys: tuple[str, str] = ("run_key", "event_key")) -> DataFrame:
    """Idempotent append: rows of one (run, key) are one event that keeps its first type and task key and takes the last
    time and details; rows without a key never meet."""
    keyed, free = events.where(F.col(keys[1]).isNotNull()), events.where(F.col(keys[1]).isNull())
    first, last = (lambda c: F.min_by(c, "id").alias(c)), (lambda c: F.max_by(c, "id").alias(c))
    merged = keyed.groupBy(*keys).agg(F.min("id").alias("id"), first("event_type"), first("task_key"), last("ts"), last("details_json"))
    return merged.unionByName(free.select(*merged.columns))


def replace_for_tasks(stored: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """Stored rows of other tasks, and the incoming ones."""
    return stored.join(incoming.select(*keys).distinct(), keys, "left_anti").unionByName(incoming)


def with_task_key(rows: DataFrame) -> DataFrame:
    """Quotes to append: the task key is made of model, city and day where it is absent."""
    return rows.withColumn("task_key", F.coalesce(P.filled("task_key"), P.task_key("model_id", "city_id", "day")))


def parse_enabled(x: Column) -> Column:
    return ~F.lower(P.plain(x)).isin("0", "false", "off", "no")


def import_blacklist(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    rows = incoming.withColumn("enabled", F.when(parse_enabled(F.col("enabled")), "1").otherwise("0"))
    return upsert(stored, rows.where(P.plain("model_id") != ""), ["model_id"], ["enabled"])


def split_blacklist(catalog: DataFrame, blacklist: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(allowed, excluded) catalog items; an item without an id is never excluded."""
    bad = blacklist.where(parse_enabled(F.col("enabled"))).select("model_id").where("model_id <> ''").distinct()
    return catalog.join(bad, "model_id", "left_anti"), catalog.join(bad, "model_id", "left_semi")


def merge_blacklists(existing: DataFrame, new: DataFrame) -> DataFrame:
    """Distinct by id, existing first; origin says where a row came from."""
    both = existing.withColumn("origin", F.lit("existing")).unionByName(new.withColumn("origin", F.lit("new")))
    w = Window.partitionBy("model_id").orderBy("origin", "brand_title", "series_title", "model_title")
    return both.where(P.plain("model_id") != "").withColumn("_nth", F.row_number().over(w)).where("_nth = 1").drop("_nth")


def repair_note(rows: DataFrame, template: str = "imported with %s") -> DataFrame:
    """A note that is empty or mostly question marks is written anew from the batch."""
    marks = F.length("note") - F.length(F.replace("note", F.lit("?"), F.lit("")))
    return rows.withColumn("note", F.when((P.plain("note") == "") | (marks >= 6), F.format_string(template, "source_batch")).otherwise(F.col("note")))


def plan_tasks(catalog: DataFrame, cities: DataFrame, day: str) -> DataFrame:
    """A task per catalog item and city; every pair is wanted, so this product is the result itself."""
    return catalog.join(cities, how="cross").withColumn("task_key", P.task_key("model_id", "city_id", F.lit(day)))


def still_to_do(planned: DataFrame, done: DataFrame) -> DataFrame:
    return planned.join(done.select("task_key").distinct(), "task_key", "left_anti")


def schedulable(tasks: DataFrame) -> DataFrame:
    return tasks.where(F.col("status").isin("pending", "error", "exception") & (P.plain("model_id") != ""))


def blacklist_candidates(tasks: DataFrame, code: str, statuses: list[str]) -> DataFrame:
    """The first task with a final code of each model."""
    hit = tasks.where((F.col("code") == code) & F.col("status").isin(*statuses) & (P.plain("model_id") != ""))
    first = hit.withColumn("_nth", F.row_number().over(Window.partitionBy("model_id").orderBy("id"))).where("_nth = 1")
    note = F.concat(F.lit("status="), F.col("status"), F.lit("; msg="), F.coalesce("msg", F.lit("")))
    return first.select("model_id", "brand_title", "series_title", "model_title", F.lit(f"final_code_{code}").alias("reason"), note.alias("note"))


def reclassified(stored: DataFrame, rules: R.Rules, columns: list[str]) -> DataFrame:
    """Per run: rows scanned, and rows whose stored classes differ under the rules. A row is classified again where it
    lies, so ids need not be unique and only counts are shuffled."""
    before = {c: f"_stored_{c}" for c in columns}
    fresh = R.classify(stored.withColumns({b: F.col(c) for c, b in before.items()}), rules)
    same = F.lit(True)
    for c, b in before.items():
        same = same & F.col(c).eqNullSafe(F.col(b))
    return fresh.groupBy("run_key").agg(F.count(F.lit(1)).alias("scanned"), F.count(F.when(~same, 1)).alias("updated"))


def catalog_filter(catalog: DataFrame, terms: list[str], columns: list[str]) -> DataFrame:
    """Items with a term equal to or contained in one of the columns; no terms keep all."""
    if not terms:
        return catalog
    found = F.lit(False)
    for c in columns:
        found = found | P.any_of(P.match_text(c), terms)
    return catalog.where(found)


def choose_item(items: DataFrame, keyword: str) -> DataFrame:
    """The item of exactly this id, else title, else containing it; a query over the result fails where none or many are left."""
    word = keyword.strip().lower()
    tier = F.when(F.lower("ID") == word, 1).when(F.lower("title") == word, 2).when(F.contains(F.lower("title"), F.lit(word)), 3)
    ranked = items.withColumn("_tier", tier).where("_tier is not null")
    best = ranked.groupBy("_tier").agg(F.count(F.lit(1)).alias("_n")).orderBy("_tier").limit(1)  # of at most three rows
    chosen = ranked.join(F.broadcast(best), "_tier")
    checked = chosen.withColumn("ID", F.when(F.col("_n") == 1, F.col("ID")).otherwise(F.raise_error(F.lit("more than one item fits"))))
    return checked.select(*items.columns)


def resolve_prices(rows: DataFrame, cache: DataFrame) -> DataFrame:
    """The price of each row: its own text, else the cached value of its payload's fingerprint; with what happened."""
    text = P.price_text("price_text")
    keyed = rows.withColumns({"_text": F.when(P.is_price_text(text), text), "_digest": F.when(F.length("payload") > 40, P.fingerprint("payload"))})
    first = cache.where(P.is_price_text(F.col("value"))).withColumn("_nth", F.row_number().over(Window.partitionBy("digest").orderBy("arrival"))).where("_nth = 1").select(F.col("digest").alias("_digest"), F.col("value").alias("_cached"))
    out = keyed.join(first, "_digest", "left")
    how = F.when(F.col("_text").isNotNull(), "plain").when(F.col("_cached").isNotNull(), "cache_hit").when(F.col("_digest").isNotNull(), "to_extract").otherwise("drop_invalid_price")
    return out.withColumns({"resolved_price": F.coalesce("_text", "_cached").try_cast("bigint"), "resolution": how}).drop("_text", "_cached", "_digest")


def consistent_subset(quotes: DataFrame, tasks: DataFrame, events: DataFrame, patterns: list[str], most_events: int = 200) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(families, quotes, tasks, events): the largest model family per pattern, its quotes, their tasks and newest events."""
    family = ["brand_title", "series_title", "model_title"]
    sizes = quotes.groupBy(*family).agg(F.count(F.lit(1)).alias("n"))
    chosen = sizes.withColumn("pattern", F.explode(F.array(*map(F.lit, patterns)))).where(F.expr("model_title LIKE pattern"))
    w = Window.partitionBy("pattern").orderBy(F.desc("n"), *family)
    families = chosen.withColumn("_nth", F.row_number().over(w)).where("_nth = 1").drop("_nth")
    own = quotes.join(families.select(*family).distinct(), family, "left_semi")
    keys = own.select("run_key", "task_key").distinct()
    near = events.join(own.select("task_key").distinct(), "task_key", "left_semi").orderBy(F.desc("id")).limit(most_events)
    return families, own, tasks.join(keys, ["run_key", "task_key"], "left_semi"), near


def best_run_for(quotes: DataFrame, patterns: list[str]) -> DataFrame:
    """Runs by how many patterns they have a model for, newest run key first."""
    hit = quotes.select("run_key", "model_title").distinct().withColumn("pattern", F.explode(F.array(*map(F.lit, patterns)))).where(F.expr("model_title LIKE pattern"))
    found = hit.groupBy("run_key").agg(F.count_distinct("pattern").alias("matched"))
    return found.withColumn("place", F.row_number().over(Window.orderBy(F.desc("matched"), F.desc("run_key"))))


def latest_state(log: DataFrame, key: str, order: str) -> DataFrame:
    """The last state of each item, and how often it was in processing."""
    return log.groupBy(key).agg(F.max_by("status", order).alias("status"), F.max(order).alias("last_order"), F.count(F.when(F.col("status") == "processing", 1)).alias("attempts"))


def gap_lifecycle(events: DataFrame) -> DataFrame:
    """Per task: when a gap was first seen, its attempts, and how it ended."""
    kind = lambda k: F.col("event_type") == k
    return events.groupBy("task_key").agg(F.min(F.when(kind("gap_detected"), F.col("id"))).alias("first_detected"), F.count(F.when(kind("gap_replay"), 1)).alias("attempts"), F.max_by("event_type", "id").alias("last_event"), F.count(F.lit(1)).alias("n_events"))


def retention_plan(artifacts: DataFrame, keep: int, max_age_days: int, as_of: Column) -> DataFrame:
    """What retention would remove: beyond the newest `keep` of its class, or too old; marked ones always stay.

    A class may be most of the table, so places are those within a class's day plus the rows of its later days."""
    df = artifacts.withColumn("_day", F.to_date("mtime"))
    later = Window.partitionBy("class").orderBy(F.desc_nulls_last("_day")).rowsBetween(Window.unboundedPreceding, -1)
    days = df.groupBy("class", "_day").agg(F.count(F.lit(1)).alias("_n")).select(F.col("class").alias("_class"), F.col("_day").alias("_of"), F.coalesce(F.sum("_n").over(later), F.lit(0)).alias("_before"))
    df = df.join(days, F.col("class").eqNullSafe(F.col("_class")) & F.col("_day").eqNullSafe(F.col("_of")))
    w = Window.partitionBy("class", "_day").orderBy(F.desc("mtime"), F.desc("artifact_id"))
    df = df.withColumn("place", F.col("_before") + F.row_number().over(w)).drop("_day", "_class", "_of", "_before")
    stale = F.datediff(as_of, "mtime") > max_age_days
    why = F.when(F.col("marked"), None).when(F.col("place") > keep, "beyond_newest").when(stale, "too_old")
    return df.withColumn("remove_reason", why)
