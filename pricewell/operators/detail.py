"""Nested detail views: branches with capacity groups with colours, assembled from snapshots and refined by a phrase."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pricewell.functions import columns as P


def leaves(snapshots: DataFrame) -> DataFrame:
    """Snapshots as leaf rows: product (brand, series), branch (model), capacity, colour."""
    spec = P.group_spec("group_title")
    return snapshots.withColumns({"capacity": spec["capacity"], "color": spec["variant"]})


PRODUCT, GROUP = ["brand_title", "series_title", "model_title"], ["brand_title", "series_title", "model_title", "capacity"]


def group_leaders(leaf: DataFrame) -> DataFrame:
    """The leading colour of every capacity group: by sample, sellers, time; equal ones by label, the later wins."""
    rank = F.struct("trusted_sample_count", "source_count", "latest_imported_at", "color", "condition_bucket")
    return leaf.groupBy(*GROUP).agg(F.max_by("color", rank).alias("color"), F.max_by("market_price", rank).alias("market_price"), F.min("band_low").alias("low"), F.max("band_high").alias("high"), F.count(F.lit(1)).alias("n_colors"), F.max("trusted_sample_count").alias("sample"), F.max("latest_imported_at").alias("latest"))


def views(leaf: DataFrame) -> DataFrame:
    """One row per product line: array of branches, each with its capacity groups in order, each with its colours in order."""
    color = F.struct((-F.col("trusted_sample_count")).alias("o1"), (-F.col("source_count")).alias("o2"), "color", F.col("market_price").alias("price"), F.concat_ws("-", F.col("band_low").cast("string"), F.col("band_high").cast("string")).alias("price_range"))
    groups = leaf.groupBy(*GROUP).agg(F.array_sort(F.collect_list(color)).alias("colors"), F.min("band_low").alias("low"), F.max("band_high").alias("high"), F.max("trusted_sample_count").alias("sample"), F.max("latest_imported_at").alias("latest"))
    group = F.struct(P.capacity_order("capacity").alias("o"), "capacity", F.concat_ws("-", F.col("low").cast("string"), F.col("high").cast("string")).alias("price_range"), F.transform("colors", lambda c: F.struct(c["color"].alias("color"), c["price"].alias("price"), c["price_range"].alias("price_range"))).alias("colors"))
    branches = groups.groupBy(*PRODUCT).agg(F.array_sort(F.collect_list(group)).alias("groups"), F.max("sample").alias("sample"), F.max("latest").alias("latest"))
    branch = F.struct((-F.col("sample")).alias("o"), F.col("model_title").alias("branch_title"), F.transform("groups", lambda g: F.struct(g["capacity"].alias("capacity"), g["price_range"].alias("price_range"), g["colors"].alias("colors"))).alias("capacity_groups"))
    return branches.groupBy("brand_title", "series_title").agg(F.transform(F.array_sort(F.collect_list(branch)), lambda b: F.struct(b["branch_title"].alias("branch_title"), b["capacity_groups"].alias("capacity_groups"))).alias("branches"))


def exploded(view: DataFrame) -> DataFrame:
    """Leaf rows of nested views, with their places."""
    a = view.select("brand_title", "series_title", F.posexplode("branches").alias("branch_no", "b"))
    b = a.select("brand_title", "series_title", "branch_no", F.col("b.branch_title").alias("model_title"), F.posexplode("b.capacity_groups").alias("group_no", "g"))
    return b.select("brand_title", "series_title", "branch_no", "model_title", "group_no", F.col("g.capacity").alias("capacity"), F.posexplode("g.colors").alias("color_no", "c")).select("*", "c.color", "c.price", "c.price_range").drop("c")


def refine(leaf: DataFrame, capacities: list[str], colors: list[str]) -> DataFrame:
    """Leaf rows that a phrase leaves: of each product line the branches with a hit, in them the groups of the capacity, in
    them the colours; a level where nothing fits keeps all."""
    capacity_hit = F.col("capacity").isin(*[c.upper() for c in capacities]) if capacities else F.lit(False)
    color_hit = P.any_of(F.lower("color"), [c.lower() for c in colors])
    for level, hit in ((["brand_title", "series_title"], capacity_hit), (["brand_title", "series_title"], color_hit)):
        w = Window.partitionBy(*level)
        leaf = leaf.withColumn("_hit", F.coalesce(hit, F.lit(False))).withColumn("_any", F.max("_hit").over(w)).where("_hit or not _any").drop("_hit", "_any")
    return leaf


#: Points of a phrase's match with a leaf, its group and its branch.
EQUAL, BEGINS, INSIDE = 320, 220, 140
LEAF_MATCHED, LEAF_HINT, GROUP_MATCHED, GROUP_CAPACITY, GROUP_TEXT = 160, 80, 220, 120, 80


def text_points(text: Column, q: Column) -> Column:
    """How well a normalised phrase fits a normalised text."""
    return F.when((text == "") | (q == ""), 0).when(text == q, EQUAL).when(F.startswith(text, q), BEGINS).when(F.contains(text, q), INSIDE).otherwise(0)


def token_points(text: Column, tokens: Column) -> Column:
    """The sum over a phrase's tokens; a token that holds the text counts as one inside it."""
    one = lambda t: F.when((text == "") | (t == ""), 0).when(text == t, EQUAL).when(F.startswith(text, t), BEGINS).when(F.contains(text, t) | F.contains(t, text), INSIDE).otherwise(0)
    return F.aggregate(tokens, F.lit(0), lambda a, t: a + one(t))


def color_fits(text: Column, colors: Column) -> Column:
    """Whether one of the colours, with or without the ending 色, is in the text or holds it; no colours fit all."""
    names = lambda c: F.array(c, F.regexp_replace(c, "色$", ""))
    return (F.size(colors) == 0) | F.exists(colors, lambda c: F.exists(names(c), lambda a: (a != "") & (F.contains(a, text) | F.contains(text, a))))


def vocabulary(leaf: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, words): what a view's titles, capacities and colours are called, closed up, with short forms."""
    norm = lambda c: P.normalize_search(F.coalesce(F.col(c), F.lit("")))
    words = leaf.select(*keys, F.explode(F.array(*[norm(c) for c in ("series_title", "model_title", "capacity", "color", "group_title")])).alias("w")).where("w <> ''").distinct()
    bare = F.regexp_replace("w", "^iphone", "")
    short = lambda x: F.when(F.contains(x, F.lit("promax")), F.replace(x, F.lit("promax"), F.lit("pm")))
    all_words = F.filter(F.array(F.col("w"), bare, short(F.col("w")), short(bare)), lambda x: x.isNotNull() & (x != ""))
    return words.select(*keys, F.explode(all_words).alias("w")).groupBy(*keys).agg(F.collect_set("w").alias("words"))


def refined(leaf: DataFrame, requests: DataFrame, model_words: tuple[str, ...] = (), component_words: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """Detail views refined by phrases: (leaf rows that stay, with leaf_points, group_points, branch_points; per request its
    reason: applied, no_match, not_applicable or empty_query, and counts).

    requests: request_id, brand_title, series_title, q (the phrase, normalised), tokens, capacities, colors (normalised).
    A phrase refines where it does not name a model and has a capacity or colour, or all its tokens are in the view's
    vocabulary. Leaves are scored and filtered by capacity, colour and text; component variants go unless asked for,
    where others are there; groups and branches without a match go."""
    view, group = ["request_id"], ["request_id", "model_title", "capacity"]
    norm = lambda *c: P.normalize_search(F.concat_ws(" ", *c))
    none = lambda c: F.size(c) == 0
    keys = ["brand_title", "series_title"]
    words = vocabulary(leaf, keys)
    known = requests.join(words, keys, "left")
    in_view = F.forall("tokens", lambda t: F.exists(F.coalesce("words", F.array().cast("array<string>")), lambda v: F.contains(v, t) | F.contains(t, v)))
    named = P.any_of(F.col("q"), [m.lower().replace(" ", "") for m in model_words]) if model_words else F.lit(False)
    can = ~none("tokens") & ~named & F.col("words").isNotNull() & (~none("capacities") | ~none("colors") | in_view)
    known = known.withColumn("_reason", F.when(F.coalesce(F.col("q"), F.lit("")) == "", "empty_query").when(~F.coalesce(can, F.lit(False)), "not_applicable")).drop("words")
    df = leaf.join(known.where("_reason is null").drop("_reason"), keys)
    df = df.withColumns({"_text": norm("group_title", "color"), "_capacity": norm("capacity"), "_branch": norm("model_title")})
    has_all = lambda text: none("capacities") | F.forall("capacities", lambda h: F.contains(text, h))
    df = df.withColumns({"_in_group": has_all(F.col("_capacity")), "_color": color_fits(F.col("_text"), F.col("colors")), "_tokens": token_points(F.col("_text"), F.col("tokens"))})
    df = df.withColumn("_by_text", ~none("tokens") & none("colors") & (none("capacities") | ~F.col("_in_group")))
    df = df.withColumn("_size", F.col("_in_group") | has_all(F.col("_text")))
    df = df.withColumn("_matched", F.col("_size") & F.col("_color") & (~F.col("_by_text") | (F.col("_tokens") > 0)))
    points = F.when(F.col("_matched"), LEAF_MATCHED).otherwise(0) + text_points(F.col("_text"), F.col("q")) + F.col("_tokens") + F.when(F.col("_color"), LEAF_HINT).otherwise(0) + F.when(F.col("_size"), LEAF_HINT).otherwise(0)
    part = [w.lower().replace(" ", "") for w in component_words]
    of = lambda c: P.any_of(F.col(c), part) if part else F.lit(False)
    df = df.withColumns({"leaf_points": points, "_kept": F.col("_matched") | (none("colors") & ~F.col("_by_text")), "_whole": ~of("_text") | of("q")})
    w = Window.partitionBy(*group)
    df = df.withColumn("_any_whole", F.max(F.col("_kept") & F.col("_whole")).over(w)).withColumn("_kept", F.col("_kept") & (F.col("_whole") | ~F.col("_any_whole")))
    df = df.withColumns({"_any": F.max("_kept").over(w), "_lead": F.coalesce(F.max(F.when(F.col("_kept"), F.col("leaf_points"))).over(w), F.lit(0))})
    df = df.withColumns({"_cm": F.col("_in_group") | F.col("_any"), "_gt": (text_points(F.col("_capacity"), F.col("q")) > 0) | F.exists("tokens", lambda t: (t != "") & F.contains(F.col("_capacity"), t))})
    df = df.withColumn("_gm", F.col("_cm") & (none("colors") | F.col("_any")))
    on = lambda c, n: F.when(F.col(c), n).otherwise(0)
    df = df.withColumn("group_points", on("_gm", GROUP_MATCHED) + on("_cm", GROUP_CAPACITY) + on("_gt", GROUP_TEXT) + F.col("_lead"))
    stays = F.when(~none("capacities") | ~none("colors"), F.col("_gm")).otherwise(F.col("group_points") > 0)
    df = df.where(stays & (F.col("_kept") | ~F.col("_any")))
    first = F.row_number().over(w.orderBy(F.desc("leaf_points"), F.desc("group_title"), F.desc("color"), F.desc("condition_bucket"))) == 1
    df = df.withColumn("_one", F.when(first, F.col("group_points")).otherwise(0))
    df = df.withColumn("branch_points", text_points(F.col("_branch"), F.col("q")) + F.sum("_one").over(Window.partitionBy("request_id", "model_title")))
    kept = df.select(*view, *leaf.columns, "leaf_points", "group_points", "branch_points")
    counts = kept.groupBy(*view).agg(F.count_distinct("model_title").alias("branches"), F.count_distinct("model_title", "capacity").alias("groups"), F.count(F.lit(1)).alias("colors_left"))
    summary = known.select("request_id", "_reason").join(counts, view, "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return kept, summary.select("request_id", F.coalesce("_reason", F.when(F.col("branches") > 0, "applied").otherwise("no_match")).alias("reason"), zero("branches"), zero("groups"), zero("colors_left"))


def group_summary(leaf: DataFrame, by: list[str] = GROUP) -> DataFrame:
    """Range, price of the first leaf and labels of each group's surviving colours; the first has most points, else sample."""
    points = F.col("leaf_points") if "leaf_points" in leaf.columns else F.col("trusted_sample_count")
    order = F.struct(points.alias("p"), "group_title", "color", "condition_bucket")
    return leaf.groupBy(*by).agg(F.min("band_low").alias("low"), F.max("band_high").alias("high"), F.max_by("market_price", order).alias("price"), F.count_distinct("color").alias("n_labels"), F.count(F.lit(1)).alias("n_leaves"))


def branch_markets(wanted: DataFrame, snapshots: DataFrame, computed: DataFrame, keys: list[str]) -> DataFrame:
    """The stored snapshot of each wanted key, else the one computed from rows; tells which."""
    a = wanted.join(snapshots.select(*keys, F.col("market_price").alias("_stored")), keys, "left").join(computed.select(*keys, F.col("market_price").alias("_made")), keys, "left")
    return a.select(*keys, F.coalesce("_stored", "_made").alias("market_price"), F.when(F.col("_stored").isNotNull(), "snapshot").when(F.col("_made").isNotNull(), "computed").otherwise("none").alias("origin"))


def family_models(requests: DataFrame, candidates: DataFrame) -> DataFrame:
    """Models of each request's family: those of the asked bucket, or all where none has it."""
    pairs = requests.join(candidates, ["brand_title", "series_title", "family_title"]).withColumn("_hit", F.col("condition_bucket") == F.col("wanted_bucket"))
    w = Window.partitionBy("request_id")
    return pairs.withColumn("_any", F.max("_hit").over(w)).where("_hit or not _any").drop("_hit", "_any")


def top_labels(joined: Column, most: int = 3) -> Column:
    """The last `most` of a |-joined list, sorted and distinct, newest first."""
    return F.slice(F.reverse(F.array_sort(F.array_distinct(F.filter(F.split(joined, r"\|"), lambda x: x != "")))), 1, most)
