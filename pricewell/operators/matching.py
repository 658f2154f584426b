"""Text matching by blocking: titles of price sheets to the catalog, search phrases to product families.

A token meets texts by one of its character grams, the one that fewest texts have, so that no pair is missed in which the
token is inside the text. Every token meets texts; `block=False` scores all pairs, for checking."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pricewell.functions import columns as P
from pricewell.functions.phrases import Terms
from pricewell.settled import settle

GRAM = 3


def grams(text: Column, size: int) -> Column:
    n = F.length(text) - (size - 1)
    return F.when(n >= 1, F.array_distinct(F.transform(F.sequence(F.lit(1), n), lambda i: F.substring(text, i, F.lit(size))))).otherwise(F.array().cast("array<string>"))


def all_grams(text: Column) -> Column:
    return F.array_union(F.array_union(grams(text, 3), grams(text, 2)), grams(text, 1))


def rarest_grams(left: DataFrame, left_id: str, tokens: Column | str, right: DataFrame, text: str) -> DataFrame:
    """(left_id, g): of every token of the left, the gram that fewest texts of the right have."""
    parts = left.select(left_id, F.explode(F.array_distinct(tokens)).alias("t")).where("t <> ''")
    keys = parts.select(left_id, "t", F.explode(grams(F.col("t"), GRAM)).alias("g")).unionByName(parts.where(F.length("t") < GRAM).select(left_id, "t", F.col("t").alias("g")))
    sizes = right.select(F.explode(all_grams(F.col(text))).alias("g")).groupBy("g").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(left_id, "t").orderBy(F.coalesce("n", F.lit(0)), "g")
    return keys.join(sizes, "g", "left").withColumn("_k", F.row_number().over(w)).where("_k = 1").select(left_id, "g")


def block_pairs(left: DataFrame, left_id: str, tokens: Column | str, right: DataFrame, right_id: str, text: str) -> DataFrame:
    """(left_id, right_id) of all pairs in which some token of the left is inside the text of the right."""
    own = right.select(right_id, F.explode(all_grams(F.col(text))).alias("g"))
    return rarest_grams(left, left_id, tokens, right, text).join(own, "g").select(left_id, right_id).distinct()


MEMORY = r"([0-9]{1,2})\s*\+\s*([0-9]{1,4})"


def signatures(title: Column) -> tuple[Column, Column]:
    """(core: prefix, memory and storage; model: prefix) of a title; the normalised title where it has no memory mark."""
    raw = F.translate(F.lower(P.plain(title)), "＋﹢／", "++/")
    core_raw = F.replace(F.replace(F.regexp_replace(raw, "[｜|]", ""), F.lit("gb"), F.lit("g")), F.lit("tb"), F.lit("t"))
    prefix = lambda x: P.normalize_search(F.substring(x, F.lit(1), F.regexp_instr(x, F.lit(MEMORY)) - 1))
    has = raw.rlike(MEMORY)
    core = F.when(has, F.concat(prefix(core_raw), F.regexp_extract(core_raw, MEMORY, 1), F.regexp_extract(core_raw, MEMORY, 2))).otherwise(P.normalize_search(title))
    return core, F.when(has, prefix(raw)).otherwise(P.normalize_search(title))


def match_score() -> Column:
    """Score of a title (q_*) against a candidate (c_*)."""
    inside = lambda a, b: F.contains(b, a)
    core = F.when((F.col("q_core") == "") | (F.col("c_core") == ""), 0).when(F.col("q_core") == F.col("c_core"), 2600).when(F.startswith("c_core", F.col("q_core")) | F.startswith("q_core", F.col("c_core")), 1900).otherwise(0)
    model = F.when((F.col("q_model") == "") | (F.col("c_model") == ""), 0).when(F.col("q_model") == F.col("c_model"), 700).when(inside(F.col("c_model"), F.col("q_model")) | inside(F.col("q_model"), F.col("c_model")), 320).otherwise(0)
    q, group, full = F.col("q_norm"), F.col("c_group"), F.col("c_full")
    exact = F.when(group == q, 3400).otherwise(0) + F.when(full == q, 3000).otherwise(0)
    part = F.when(F.startswith(group, q), 2200).when(inside(q, group), 1800).when(F.startswith(full, q), 1500).when(inside(q, full), 1200).otherwise(0)
    tokens = F.aggregate(F.filter("q_tokens", lambda t: (t != "") & (t != F.col("q_norm"))), F.lit(0), lambda a, t: a + F.when(F.contains(group, t), 320).when(F.contains(full, t), 200).otherwise(-120))
    popular = F.least(F.coalesce("row_count", F.lit(0)), F.lit(200)) * 0.2
    return F.when(q == "", -1.0).otherwise(core + model + exact + part + tokens + popular)


#: A side of a join of pairs with at most so many rows is broadcast.
MOST_BROADCAST = 200_000


def _bounded(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.limit(MOST_BROADCAST + 1).count() <= MOST_BROADCAST else df


def _prefixes(text: Column) -> Column:
    return F.when(F.length(text) > 0, F.transform(F.sequence(F.lit(1), F.length(text)), lambda i: F.substring(text, F.lit(1), i)))


def title_pairs(q: DataFrame, c: DataFrame) -> Callable[[DataFrame], DataFrame]:
    """A function from titles to all their pairs with candidates that can score over 0, each once, with the columns of
    both: a token (or the title's model) is inside the candidate's text; the candidate's model is inside the title; one
    core starts with the other; or a title of one word meets the most popular candidate, as any candidate's popularity
    is a score then.

    Pairs of the first kind, by far the most, come from the first of a title's grams that is inside the text, so they
    need not be made distinct; the other kinds are settled as pairs of ids."""
    keys = rarest_grams(q, "raw_title", F.array_union("q_tokens", F.array("q_model")), c, "c_full").groupBy("raw_title").agg(F.array_sort(F.collect_set("g")).alias("keys"))
    keys = settle(q.select("raw_title").join(keys, "raw_title", "left").select("raw_title", F.coalesce("keys", F.array().cast("array<string>")).alias("keys")), "title-keys")
    met = F.filter("keys", lambda k: F.contains("c_full", k))
    models, cores = (c.select(x).where(f"{x} <> ''").distinct() for x in ("c_model", "c_core"))
    named = rarest_grams(models, "c_model", F.array("c_model"), q, "q_norm").join(q.select("raw_title", "q_norm", F.explode(all_grams(F.col("q_norm"))).alias("g")), "g").where(F.contains("q_norm", F.col("c_model"))).select("raw_title", "c_model")
    longer = q.select("raw_title", F.explode(_prefixes(F.col("q_core"))).alias("c_core")).join(cores, "c_core")
    shorter = cores.select("c_core", F.explode(_prefixes(F.col("c_core"))).alias("q_core")).join(q, "q_core").select("raw_title", "c_core")
    popular = c.orderBy(F.desc(F.least(F.coalesce("row_count", F.lit(0)), F.lit(200))), "candidate_id").limit(1)
    lone = q.where(F.size(F.filter("q_tokens", lambda t: t != F.col("q_norm"))) == 0).select("raw_title").join(F.broadcast(popular.select("candidate_id", "c_full")), how="cross")
    pair = ["raw_title", "candidate_id", "c_full"]
    rest = named.join(c, "c_model").select(*pair).unionByName(longer.unionByName(shorter).join(c, "c_core").select(*pair)).unionByName(lone.select(*pair))
    rest = settle(rest.join(keys, "raw_title").where(F.size(met) == 0).select("raw_title", "candidate_id").distinct(), "title-pairs")
    spread = c.repartition(int(c.sparkSession.conf.get("spark.sql.shuffle.partitions")), "candidate_id").withColumn("g", F.explode(all_grams(F.col("c_full"))))

    def pairs(q: DataFrame) -> DataFrame:
        there = spread.join(_bounded(q.join(keys, "raw_title").withColumn("g", F.explode("keys"))), "g").where(F.get(met, F.lit(0)) == F.col("g")).drop("g", "keys")
        return there.unionByName(rest.join(q, "raw_title").join(c, "candidate_id"))

    return pairs


def group_score() -> tuple[Column, Column]:
    """(score, tokens): what a title (q_*) scores by a candidate's group, core and model (c_*) alone, and how many of its
    tokens are outside the group; each of these scores 200 or costs 120, by the candidate's whole text."""
    q, group = F.col("q_norm"), F.col("c_group")
    core = F.when((F.col("q_core") == "") | (F.col("c_core") == ""), 0).when(F.col("q_core") == F.col("c_core"), 2600).when(F.startswith("c_core", F.col("q_core")) | F.startswith("q_core", F.col("c_core")), 1900).otherwise(0)
    model = F.when((F.col("q_model") == "") | (F.col("c_model") == ""), 0).when(F.col("q_model") == F.col("c_model"), 700).when(F.contains("q_model", F.col("c_model")) | F.contains("c_model", F.col("q_model")), 320).otherwise(0)
    part = F.when(group == q, 5600).when(F.startswith(group, q), 2200).when(F.contains(group, q), 1800).otherwise(0)
    tokens = F.filter("q_tokens", lambda t: (t != "") & (t != q))
    met = F.size(F.filter(tokens, lambda t: F.contains(group, t)))
    return core + model + part + met * 320, F.size(tokens) - met


def best_pairs(q: DataFrame, c: DataFrame, margin: float) -> DataFrame:
    """Pairs of titles and candidates, each once, with the columns of both: at least all that score over 0 and are a title's
    best or within the margin of it.

    Candidates of equal group, core and model (a family) differ in their whole texts and popularity alone, so a family has a
    greatest and a least score with a title. A title's best is at least the greatest of the least scores; families that
    cannot come within the margin of it are left out. Where a whole text holds the title and the group does not, or is the
    title, the pair is made by itself. Titles whose best bound is so low that a family without any token of theirs could
    come near it meet all their pairs (title_pairs)."""
    family = ["c_group", "c_core", "c_model"]
    popular = F.least(F.coalesce("row_count", F.lit(0)), F.lit(200)) * 0.2
    name = F.to_json(F.struct(*family))  # one text for three
    families = settle(c.groupBy(*family).agg(F.max(F.least(F.coalesce("row_count", F.lit(0)), F.lit(200))).alias("row_count")).select(*family, "row_count", F.col("c_group").alias("c_full"), name.alias("candidate_id")), "title-families")
    score, outside = group_score()
    near = title_pairs(q, families)(q).where("q_norm <> ''").select("raw_title", F.col("candidate_id").alias("family"), score.alias("_known"), outside.alias("_outside"), popular.alias("_popular"))
    near = settle(near.select("raw_title", "family", (F.col("_known") - 120 * F.col("_outside") + F.col("_popular")).alias("least"), (F.col("_known") + 200 * F.col("_outside") + F.col("_popular")).alias("greatest")), "title-bounds")
    floor = near.groupBy("raw_title").agg(F.max("least").alias("floor"))
    others = F.size(F.filter("q_tokens", lambda t: (t != "") & (t != F.col("q_norm")))) * 200 + 40  # the most that a family not met can score
    bound = settle(q.join(floor, "raw_title", "left").select("raw_title", "floor", F.coalesce((F.col("floor") > 0) & (others <= F.col("floor") - margin) & (margin > 0), F.lit(False)).alias("known")), "title-floors")
    known, other = bound.where("known"), bound.where("not known").select("raw_title")
    keys = rarest_grams(q.join(known.select("raw_title"), "raw_title"), "raw_title", F.array("q_norm"), c, "c_full").join(q.select("raw_title", "q_norm"), "raw_title")
    spread = c.select("candidate_id", "c_full", "c_group", F.explode(all_grams(F.col("c_full"))).alias("g"))
    whole = spread.join(_bounded(keys), "g").where(F.contains("c_full", F.col("q_norm")) & (~F.contains("c_group", F.col("q_norm")) | (F.col("c_full") == F.col("q_norm")))).select("raw_title", "candidate_id")
    kept = near.join(known, "raw_title").where((F.col("greatest") > F.col("floor") - margin) & (F.col("greatest") > 0)).select("raw_title", "family")
    found = kept.join(c.select("candidate_id", name.alias("family")), "family").select("raw_title", "candidate_id").unionByName(whole).distinct()
    made = settle(found, "title-best-pairs").join(q, "raw_title").join(c, "candidate_id")
    if other.isEmpty():
        return made
    rest = settle(q.join(other, "raw_title"), "title-others")
    return made.unionByName(title_pairs(rest, c)(rest))


def match_references(rows: DataFrame, candidates: DataFrame, threshold: float = 1900, margin: float = 120, block: bool = True) -> DataFrame:
    """Best candidate of every title and how sure it is: exact, model_only or unmatched.

    Equal titles are scored once. Bounds leave out the pairs that cannot come within the margin of a title's best
    (best_pairs), which alone decide; only those that do are sorted. block=False meets all pairs, with the same results
    where threshold - margin is at least 40, the most that popularity gives.

    rows: row_id, raw_title; candidates: candidate_id, brand_title, series_title, model_title, group_title, condition_bucket, row_count."""
    core, model = signatures(F.col("raw_title"))
    q = rows.select("raw_title").where("raw_title is not null").distinct()
    q = q.select("raw_title", P.normalize_search("raw_title").alias("q_norm"), core.alias("q_core"), model.alias("q_model"), F.filter(F.transform(F.split(F.replace(P.plain("raw_title"), F.lit("/"), F.lit(" ")), r"\s+"), P.normalize_search), lambda t: t != "").alias("q_tokens"))
    title = P.search_text("model_title", "group_title")
    c_core, _ = signatures(title)
    c = candidates.select("candidate_id", "brand_title", "series_title", "model_title", "group_title", "condition_bucket", "row_count", P.normalize_search(P.search_text("brand_title", "series_title", "model_title", "group_title", "condition_bucket")).alias("c_full"), P.normalize_search(title).alias("c_group"), c_core.alias("c_core"), P.normalize_search("model_title").alias("c_model"))
    q, c = settle(q, "titles"), settle(c, "candidates")
    pairs = best_pairs(q, c, margin) if block else q.join(c, how="cross")
    met = settle(pairs.withColumn("score", match_score()).where("score > 0"), "title-scores")
    top = met.groupBy("raw_title").agg(F.max("score").alias("_top"))
    scored = met.join(top, "raw_title").where((F.col("score") == F.col("_top")) | (F.col("score") > F.col("_top") - margin))
    w = Window.partitionBy("raw_title")
    order = w.orderBy(F.desc("score"), "candidate_id")
    scored = scored.withColumns({"place": F.row_number().over(order), "next_score": F.coalesce(F.lead("score").over(order), F.lit(0.0)), "_family": F.count(F.lit(1)).over(Window.partitionBy("raw_title", "score", "brand_title", "series_title", "model_title"))})
    best = scored.where("place = 1")
    sure = (F.col("score") >= threshold) & ((F.col("score") - F.col("next_score") >= margin) | (F.col("next_score") == 0))
    same = (F.col("q_core") != "") & (F.col("c_core") == F.col("q_core")) & (F.col("q_model") != "") & (F.col("c_model") == F.col("q_model"))
    level = F.when(sure, "exact").when((F.col("score") >= threshold) & ((F.col("_family") >= 2) | same), "model_only").otherwise("unmatched")
    best = best.select("raw_title", level.alias("match_level"), F.bround("score", 3).alias("best_score"), "candidate_id", F.col("brand_title").alias("matched_brand"), F.col("model_title").alias("matched_model"), F.when(level == "exact", F.col("group_title")).otherwise("").alias("matched_group"))
    return rows.select("row_id", "raw_title").join(best, "raw_title", "left").select("row_id", "raw_title", F.coalesce("match_level", F.lit("unmatched")).alias("match_level"), *best.columns[2:])


def external_references(rows: DataFrame) -> DataFrame:
    """Reference price per SKU title: median, newest source and time."""
    from pricewell.operators.stats import percentile

    return rows.groupBy("brand_title", "series_title", P.sku_title("model_title", "group_title").alias("sku_title")).agg(percentile("reference_price", 0.5).alias("reference_price"), F.max_by("source_title", F.struct("imported_at", "id")).alias("source_title"), F.max("imported_at").alias("fetched_at"), F.count(F.lit(1)).alias("n"))


def external_candidates(rows: DataFrame) -> DataFrame:
    """Unmatched titles as candidates, by normalised title."""
    return rows.groupBy(P.normalize_search("raw_title").alias("external_key")).agg(F.count(F.lit(1)).alias("row_count"), F.min("reference_price").alias("min_price"), F.max("reference_price").alias("max_price"), F.max("imported_at").alias("latest_imported_at"), F.max_by("raw_title", F.struct("imported_at", "id")).alias("external_title"))


def external_detail(rows: DataFrame) -> DataFrame:
    """Per normalised title: median and range text of its rows."""
    from pricewell.operators.stats import percentile

    return rows.groupBy(P.normalize_search("raw_title").alias("external_key")).agg(percentile("reference_price", 0.5).alias("market_price"), P.range_text(F.collect_set("reference_price")).alias("price_range"))


def latest_import(runs: DataFrame) -> DataFrame:
    return runs.where("status = 'completed'").orderBy(F.desc("created_at"), F.desc("import_id")).limit(1)


# ---- search -----------------------------------------------------------------------------------------------------


def family_title(model: Column | str, brand: Column | str | None = None, series: Column | str | None = None, terms: Terms = Terms()) -> Column:  # noqa: B008
    """Model title without screen size and region suffix; of the terms' one product line with the line's name before a
    number, else the series."""
    text = P.plain(model)
    cut = F.trim(F.regexp_replace(F.regexp_replace(text, r"\s+[0-9]+(?:\.[0-9]+)?寸.*$", ""), r"\s+(国行|港版|美版|欧版|日版|韩版|台版|国际版|海外版).*$", ""))
    cut = F.coalesce(F.nullif(cut, F.lit("")), text)
    if not terms.families or brand is None or series is None:
        return cut
    line = (P.plain(brand) == terms.families["brand"]) & F.startswith(P.plain(series), F.lit(terms.families["series"])) & (text != "")
    return F.when(line & cut.rlike(terms.families["model"]), F.concat(F.lit(terms.families["prefix"]), cut)).when(line, F.trim(P.plain(series))).otherwise(cut)


def _array(*values: str) -> Column:
    return F.array(*map(F.lit, values)) if values else F.array().cast("array<string>")


def family_aliases(terms: Terms) -> Column:
    """What a family (family_title, brand_title, label_norm) is also called: itself, and with the terms' short forms."""
    label, bare = F.col("label_norm"), terms.family_bare
    own = [label]
    if bare:
        stripped = F.substr(label, F.lit(len(bare["prefix"]) + 1))
        named = (F.col("brand_title") == bare["brand"]) & F.startswith(label, F.lit(bare["prefix"])) & (stripped != "")
        own += [F.when(named, stripped), F.when(named & F.endswith(stripped, F.lit("pro")), F.concat(F.expr(f"left(substr(label_norm, {len(bare['prefix']) + 1}), length(label_norm) - {len(bare['prefix']) + 3})"), F.lit(bare["pro"])))]
    shorter = [F.when(F.contains(x, F.lit(a)), F.replace(x, F.lit(a), F.lit(b))) for x in own[:2] for a, bs in terms.family_short.items() for b in bs]
    return F.array_sort(F.array_distinct(F.filter(F.array(*own, *shorter), lambda x: x.isNotNull() & (x != ""))))


def category(text: Column, ordered: list[tuple[str, tuple[str, ...]]], other: str = "phone") -> Column:
    """The first category one of whose keywords is in the text."""
    out = F.lit(other)
    for name, words in reversed(ordered):
        out = F.when(P.any_of(F.lower(text), words), name).otherwise(out)
    return out


def bucket_priority(bucket: Column) -> Column:
    return F.when(bucket == "strict_target", 120).when(bucket == "open_allowed", 110).when(bucket.endswith("_target") & ~bucket.contains("non_target"), 100).when(bucket.contains("allowed"), 90).when(bucket.contains("review"), 30).when(bucket.contains("excluded"), 10).when(bucket.contains("non_target"), 5).when(bucket != "", 40).otherwise(0)


def model_candidates(skus: DataFrame, terms: Terms = Terms()) -> DataFrame:  # noqa: B008
    """SKUs rolled up to product families: sums, ranges, distinct groups and models, the preferred representative, and the
    texts that search reads: label, series, aliases, first texts (family, models), second texts (with brand; variants)."""
    df = skus.withColumn("family_title", family_title("model_title", "brand_title", "series_title", terms))
    rank = F.struct(bucket_priority(F.col("condition_bucket")).alias("p"), "row_count", "source_count", "latest_imported_at", "model_title", "group_title")
    texts = lambda c: F.array_sort(F.array_distinct(F.filter(F.transform(F.collect_set(c), P.normalize_search), lambda t: t != "")))
    out = df.groupBy("brand_title", "series_title", "family_title").agg(
        F.sum("row_count").alias("row_count"), F.max("source_count").alias("source_count"), F.count_distinct("group_title").alias("variant_count"), F.count_distinct("model_title").alias("branch_count"), F.min(F.when(F.col("min_price") > 0, F.col("min_price"))).alias("min_price"), F.max("max_price").alias("max_price"), F.max("latest_imported_at").alias("latest_imported_at"),
        F.max_by("condition_bucket", rank).alias("condition_bucket"), F.max_by("model_title", rank).alias("model_title"), texts("model_title").alias("branch_texts"), texts("group_title").alias("variant_texts"),
    )
    norm = lambda *c: P.normalize_search(P.search_text(*c))
    out = out.withColumns({"candidate_id": F.concat_ws("|", "brand_title", "series_title", "family_title"), "label_norm": P.normalize_search("family_title"), "series_norm": P.normalize_search("series_title"), "keyword_text": F.lower(F.concat_ws(" ", "brand_title", "series_title", "family_title", "model_title"))})
    out = out.withColumns({"alias_texts": family_aliases(terms), "first_texts": F.array_union(F.array(norm("series_title", "family_title")), "branch_texts"), "second_texts": F.array_union(F.array(norm("brand_title", "series_title", "family_title")), "variant_texts"), "category_kind": category(F.col("keyword_text"), list(terms.categories.items()))})
    lines = lambda c: F.concat(F.lit("\n"), F.array_join(c, "\n"), F.lit("\n"))
    out = out.withColumns({"alias_lines": lines("alias_texts"), "first_lines": lines("first_texts"), "second_lines": lines("second_texts")})
    return out.withColumn("all_text", F.concat_ws("\n", "label_norm", "series_norm", "alias_texts", "first_texts", "second_texts"))


#: The scores of text tiers, tokens, hints and categories.
LABEL_TIERS, ALIAS_TIERS, SERIES_TIERS = (4200, 3200, 2850, 2250), (3600, 2900, 2100), (3000, 2100, 1600)
FIRST_EQUAL, SECOND_EQUAL, TEXT_TIERS = 3400, 3000, (2500, 2050, 1650, 1350)
FIRST_TOKEN, SECOND_TOKEN, ALL_TOKENS, MISSED_TOKEN, CORE = 440, 260, 320, -260, 720
BRAND_HIT, BRAND_MISS, SERIES_HIT, SERIES_MISS, COLOR_HIT, CAPACITY_HIT = 1850, -900, 950, -850, 180, 220
EXACT_CATEGORY, SOFT_CATEGORY = 1450, 820
BARE_PHONE, BARE_OTHER, ANY_PHONE, ANY_ACCESSORY, ANY_DEVICE, DEVICE_PHONE, DEVICE_OTHER = 520, -900, 120, -420, -180, 260, -540
SOFT, ACCESSORIES, OTHER_DEVICES = ("charger", "case", "accessory"), ("charger", "case", "accessory"), ("earbuds", "tablet", "wearable", "laptop")


def other_tokens() -> Column:
    """A text's tokens beside the text itself."""
    return F.filter("tokens", lambda t: (t != "") & (t != F.col("norm")))


def tier(q: str, others: list[str], label: str, series: str, alias: str, first: str, second: str, impacts: dict[str, int]) -> int:
    """The tier of a text (q, others: its other_tokens) against a family; negative where it does not fit. A family's texts
    are lines of one string, so that any of them is equal, begins, ends or holds the text where the string holds it between
    line ends. impacts: what the family's tokens so far were worth, kept for its next text."""
    gain = hit = best = 0
    for t in others:
        worth = impacts.get(t)
        if worth is None:
            worth = impacts[t] = FIRST_TOKEN if t in first else SECOND_TOKEN if t in second else 0
        gain, hit = gain + worth, hit + (worth > 0)
    line, begin, end = f"\n{q}\n", f"\n{q}", f"{q}\n"
    if q in label:
        best = LABEL_TIERS[0 if label == q else 1 if label.endswith(q) else 2 if label.startswith(q) else 3]
    if q in alias:
        best = max(best, ALIAS_TIERS[0 if line in alias else 1 if end in alias else 2])
    if q in series:
        best = max(best, SERIES_TIERS[0 if series == q else 1 if series.startswith(q) else 2])
    if q in first:
        best = max(best, FIRST_EQUAL if line in first else TEXT_TIERS[0 if begin in first else 1])
    if q in second:
        best = max(best, SECOND_EQUAL if line in second else TEXT_TIERS[2 if begin in second else 3])
    if not q or (hit == 0 and best == 0):
        return -1
    return best + gain + (0 if hit == 0 else ALL_TOKENS if hit == len(others) else (len(others) - hit) * MISSED_TOKEN)


def best_tiers(pairs: DataFrame) -> DataFrame:
    """(query, candidate_id, tier) of pairs with the phrase's texts (texts: JSON of its norm, others, bonus) and the family's:
    the best tier of the texts that fit, with their bonus; pairs without any are gone."""
    kept = ("query", "candidate_id", "texts", "label_norm", "series_norm", "alias_lines", "first_lines", "second_lines")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts_of = lru_cache(4096)(lambda texts: [(t["norm"], t["others"], t["bonus"]) for t in json.loads(texts)])
        impacts_of = lru_cache(16384)(lambda candidate: {})
        for batch in batches:
            out: list[int | None] = []
            for candidate, texts, *family in zip(*(batch[c].to_pylist() for c in kept[1:]), strict=True):
                lines, impacts = [x or "" for x in family], impacts_of(candidate)
                fits = [got + bonus for q, others, bonus in texts_of(texts) if (got := tier(q, others, *lines, impacts)) >= 0]
                out.append(max(fits, default=None))
            made = pa.array(out, pa.int32())
            yield pa.RecordBatch.from_arrays([batch["query"], batch["candidate_id"], made], names=["query", "candidate_id", "tier"]).filter(made.is_valid())

    return pairs.select(*kept).mapInArrow(run, "query string, candidate_id string, tier int")


def category_score(terms: Terms) -> Column:
    """What a family's category is worth to a phrase; null where it rules the family out."""
    kind, intents = F.col("category_kind"), F.col("category_intents")
    soft = F.lit(False)
    for name in SOFT:
        soft = soft | (F.array_contains(intents, name) & P.any_of(F.col("keyword_text"), list(terms.categories.get(name, ()))))
    asked = F.when(F.array_contains(intents, kind), EXACT_CATEGORY).when(soft, SOFT_CATEGORY)
    bare = F.when(kind == "phone", BARE_PHONE).otherwise(BARE_OTHER)
    plain = F.when(kind == "phone", ANY_PHONE).when(kind.isin("charger", "case"), ANY_ACCESSORY).when(kind.isin(*OTHER_DEVICES), ANY_DEVICE).otherwise(0)
    device = F.when(~F.col("wants_device"), 0).when(kind == "phone", DEVICE_PHONE).when(kind.isin(*ACCESSORIES), None).when(kind.isin(*OTHER_DEVICES), DEVICE_OTHER).otherwise(0)
    return F.when(F.size(intents) > 0, asked).otherwise(F.when(F.col("bare_model"), bare).otherwise(plain) + device)


HINTS = ["brand_hints", "series_hints", "category_intents", "bare_model", "wants_device", "capacity_hints", "color_hints"]


def term_postings(terms: DataFrame, families: DataFrame) -> DataFrame:
    """(term, candidate_id, impact): the families with a term in their texts, and the most it can add to a score there."""
    own = families.select("candidate_id", F.explode(all_grams(F.col("all_text"))).alias("g"))
    met = rarest_grams(terms, "term", F.array("term"), families, "all_text").join(own, "g").select("term", "candidate_id")
    texts = families.select("candidate_id", "all_text", "first_lines", "second_lines")
    impact = F.when(F.contains("first_lines", F.col("term")), FIRST_TOKEN).when(F.contains("second_lines", F.col("term")), SECOND_TOKEN).otherwise(0)
    return met.join(texts, "candidate_id").where(F.contains("all_text", F.col("term"))).select("term", "candidate_id", impact.alias("impact"))


def _terms_of(texts: DataFrame) -> DataFrame:
    """Texts with the terms that a family of theirs must have: the tokens beside the text itself, or else the text."""
    others = other_tokens()
    return texts.withColumn("n", F.size(others)).withColumn("terms", F.when(F.size(others) > 0, F.array_distinct(others)).otherwise(F.array("norm")))


def _ordered(texts: DataFrame, postings: DataFrame) -> DataFrame:
    """Texts with their terms by how few families have them, and `most`: for m = 0, 1, ... the most that a family without m
    of the terms can score. Without any term missing there is no bound; with one missing no text tier holds, the missing
    ones cost, and the others add their impacts at most."""
    sizes = postings.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.max("impact").alias("impact"))
    one = F.struct(F.coalesce("df", F.lit(0)).alias("df"), "term", F.coalesce("impact", F.lit(0)).alias("impact"), "times")
    times = F.size(F.filter("tokens", lambda t: t == F.col("term")))
    terms = texts.withColumn("term", F.explode("terms")).withColumn("times", F.greatest(times, F.lit(1))).join(_bounded(sizes), "term", "left")
    out = terms.groupBy("text", "norm", "tokens", "n").agg(F.array_sort(F.collect_list(one)).alias("t"))
    gains = F.array_sort(F.transform("t", lambda x: x["impact"] * x["times"]))  # least first: those are the ones to be missing
    whole = F.aggregate("t", F.lit(0), lambda s, x: s + x["impact"] * x["times"])
    lost = lambda m: F.aggregate(F.slice(F.col("gains"), F.lit(1), m), F.lit(0), lambda s, x: s + x)
    out = out.withColumns({"gains": gains, "whole": whole})
    bound = F.transform(F.sequence(F.lit(1), F.size("t")), lambda m: F.when(m < F.size("t"), F.col("whole") - lost(m) + m * MISSED_TOKEN))
    return out.select("text", "norm", "tokens", "n", F.transform("t", lambda x: x["term"]).alias("terms"), bound.alias("most"))


def _with_hints(per: DataFrame, candidates: DataFrame, contexts: DataFrame, terms: Terms) -> DataFrame:
    """Pairs (query, candidate_id, tier) with their scores; those under 0 and in ruled-out categories are gone."""
    per = per.join(candidates, "candidate_id").join(contexts.select("query", "has_core", *HINTS), "query")
    met = lambda hints, text: F.size(F.filter(hints, lambda h: F.contains(text, h)))
    size = F.size
    hinted = F.array_contains("brand_hints", F.col("brand_title"))
    brand = F.when(size("brand_hints") == 0, 0).when(hinted, BRAND_HIT).otherwise(BRAND_MISS)
    lines = met("series_hints", F.col("all_text"))
    series = F.when(size("series_hints") == 0, 0).when(lines > 0, lines * SERIES_HIT).otherwise(SERIES_MISS)
    sizes = met("capacity_hints", F.col("variant_lines"))
    capacity = F.when(size("capacity_hints") == 0, 0).when(sizes > 0, sizes * CAPACITY_HIT).when(F.col("has_core"), -F.least(size("capacity_hints") * 120, F.lit(280))).otherwise(0)
    score = F.col("tier") + brand + series + category_score(terms) + capacity + met("color_hints", F.col("variant_lines")) * COLOR_HIT + popularity()
    return per.withColumns({"score": score, "preferred": (size("brand_hints") > 0) & hinted}).where("score >= 0")


def popularity() -> Column:
    return F.least("row_count", F.lit(500)) + F.least(F.col("variant_count") * 25, F.lit(180)) + F.least(F.col("source_count") * 4, F.lit(120))


def _rest_bounds(contexts: DataFrame, candidates: DataFrame, terms: Terms) -> DataFrame:
    """(query, preferred, rest): the most that anything but texts can add to a family of a phrase, by whether the phrase
    names its brand. Hints count only where some family has them."""
    kinds = candidates.groupBy("category_kind").agg(F.max(popularity()).alias("popular")).withColumn("keyword_text", F.lit(" ".join(w for ws in terms.categories.values() for w in ws)))
    hints = contexts.select(F.explode(F.array_union("capacity_hints", "color_hints")).alias("term")).distinct()
    variants = candidates.select("candidate_id", F.array_join("variant_texts", "\n").alias("all_text"))
    own = variants.select("candidate_id", F.explode(all_grams(F.col("all_text"))).alias("g"))
    there = rarest_grams(hints, "term", F.array("term"), variants, "all_text").join(own, "g").join(variants, "candidate_id").where(F.contains("all_text", F.col("term"))).select("term").distinct()
    known = contexts.select("query", F.explode(F.array_union("capacity_hints", "color_hints")).alias("term")).join(_bounded(there), "term").groupBy("query").agg(F.collect_set("term").alias("known"))
    found = contexts.join(known, "query", "left").withColumn("known", F.coalesce("known", F.array().cast("array<string>")))
    size = lambda c: F.size(F.filter(c, lambda h: F.array_contains("known", h)))
    rest = F.size("series_hints") * SERIES_HIT + size("capacity_hints") * CAPACITY_HIT + size("color_hints") * COLOR_HIT
    named = F.when(F.size("brand_hints") > 0, F.array(F.lit(True), F.lit(False))).otherwise(F.array(F.lit(False)))
    found = found.withColumn("rest", rest).withColumn("preferred", F.explode(named))
    brand = F.when(F.size("brand_hints") == 0, 0).when(F.col("preferred"), BRAND_HIT).otherwise(BRAND_MISS)
    scored = found.join(F.broadcast(kinds), how="cross").withColumn("category", category_score(terms)).where("category is not null")  # a few categories
    return scored.groupBy("query", "preferred").agg(F.max(F.col("rest") + brand + F.col("category") + F.col("popular")).alias("rest"))


def search(readings: DataFrame, contexts: DataFrame, candidates: DataFrame, most: int = 6, block: bool = True, terms: Terms = Terms()) -> DataFrame:  # noqa: B008
    """The best `most` families of every phrase, ranked; phrases that only refine find nothing.

    The text score of a pair is that of its best reading, or of its best core (the reading without capacities and
    colours), which counts more; brand, series, category, capacity and colour hints and popularity come on top.

    Families are found by bounds, in rounds: in round m those that lack at most m terms of some text of the phrase. Such a
    family has one of the text's m + 1 rarest terms, so only these terms' postings are read. A phrase is done when what is
    left cannot reach its last result: families lacking more than m terms of every text score at most the sum of the other
    terms' greatest impacts, less the missing ones, and the most that its hints can add. block=False scores all pairs."""
    most = max(1, min(most, 6))
    contexts = settle(contexts, "contexts")
    asked = readings.join(contexts.where("not only_refinement").select("query"), "query", "left_semi")
    text = lambda norm, tokens, bonus: F.struct(F.col(norm).alias("norm"), F.col(tokens).alias("tokens"), F.lit(bonus).alias("bonus"))
    asked = asked.select("query", F.explode(F.array(text("norm", "tokens", 0), text("core", "core_tokens", CORE))).alias("t")).select("query", "t.*").where("norm <> ''")
    asked = asked.withColumn("text", F.concat_ws("#", "norm", F.array_join("tokens", "#"))).groupBy("query", "text", "norm", "tokens").agg(F.max("bonus").alias("bonus"))
    asked = settle(asked, "asked")
    texts_of = settle(asked.groupBy("query").agg(F.to_json(F.collect_list(F.struct("norm", other_tokens().alias("others"), "bonus"))).alias("texts")), "asked-texts")
    kept = ["candidate_id", "preferred", "score", "condition_bucket", "row_count", "variant_count", "source_count", "latest_imported_at", "brand_title", "series_title", "family_title"]
    hinted_by = candidates.select(*[c for c in kept if c in candidates.columns], "all_text", "category_kind", "keyword_text", F.array_join("variant_texts", "\n").alias("variant_lines"))
    families = candidates.select("candidate_id", "all_text", "label_norm", "series_norm", "alias_lines", "first_lines", "second_lines")
    parts = int(candidates.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # a few pairs are much work: they are spread

    def scored(pairs: DataFrame) -> DataFrame:
        """Pairs (query, candidate_id) with the score of their best text."""
        each = pairs.repartition(parts, "query", "candidate_id").join(texts_of, "query").join(families, "candidate_id")
        return _with_hints(best_tiers(each), hinted_by, contexts, terms)

    order = [F.desc("preferred"), F.desc("score"), F.desc(bucket_priority(F.col("condition_bucket"))), F.desc("row_count"), F.desc("variant_count"), F.desc("source_count"), F.desc("latest_imported_at"), "candidate_id"]
    best = lambda df: df.withColumn("place", F.row_number().over(Window.partitionBy("query").orderBy(*order))).where(F.col("place") <= most)
    if not block:
        return best(scored(asked.select("query").distinct().join(candidates.select("candidate_id"), how="cross"))).select("query", "place", "candidate_id", "score", "brand_title", "series_title", "family_title")
    texts = settle(_terms_of(asked.select("text", "norm", "tokens").distinct()), "texts")
    postings = settle(term_postings(texts.select(F.explode("terms").alias("term")).distinct(), families), "postings")
    texts = settle(_ordered(texts, postings), "ordered-texts")
    rest = settle(_rest_bounds(contexts, candidates, terms), "rest-bounds")
    bounds = settle(asked.join(texts.select("text", "terms", "most"), "text").select("query", "text", "bonus", "terms", "most"), "bounds")
    longest = texts.agg(F.max(F.size("terms"))).first()[0] or 0
    hinted = contexts.select("query", F.explode("brand_hints").alias("brand")).join(asked.select("query").distinct(), "query", "left_semi")
    columns = ["query", *kept]
    found = None
    for preferred in (True, False):
        # families of a brand that the phrase names come before all others: the others count where these are too few
        if preferred:
            asks, posted = bounds.join(hinted, "query"), postings.join(candidates.select("candidate_id", F.col("brand_title").alias("brand")), "candidate_id")
        else:
            full = [] if found is None else [found.where(F.col("place") == most).select("query")]
            asks, posted = bounds.withColumn("brand", F.lit("")), postings.withColumn("brand", F.lit(""))
            for df in full:
                asks = asks.join(df, "query", "left_anti")
        asks = settle(asks, "asks")
        if asks.isEmpty():
            continue
        posted = _bounded(posted.select("term", "brand", "candidate_id"))  # few rows, each met often: texts stay where they are dealt
        seen = None
        for m in range(longest):
            reach = asks.where(F.size("terms") > m).select("text", "brand", "terms").distinct().repartition(parts, "text").withColumn("term", F.explode(F.slice("terms", 1, m + 1)))
            missing = F.size(F.filter("terms", lambda t: ~F.contains("all_text", t)))
            near = reach.join(posted, ["term", "brand"]).join(families.select("candidate_id", "all_text"), "candidate_id").where(missing <= m)
            pairs = near.select("text", "brand", "candidate_id").distinct().join(asks.select("query", "text", "brand"), ["text", "brand"]).select("query", "candidate_id").distinct()
            pairs = settle(pairs if seen is None else pairs.join(seen, ["query", "candidate_id"], "left_anti"), "pairs")
            seen = pairs if seen is None else seen.unionByName(pairs)
            made = scored(pairs).where(F.col("preferred") == preferred).select(columns)
            found = settle(best(made if found is None else made.unionByName(found.select(columns))), "best")
            last = found.where(F.col("place") == most).select("query", F.col("preferred").alias("last_preferred"), F.col("score").alias("last_score"))
            # a family that lacks more than m terms of a text can reach a place by it only if the text's bound does
            could = asks.withColumn("could", F.get("most", F.lit(m)) + F.col("bonus")).where("could is not null").join(rest.where(F.col("preferred") == preferred).drop("preferred"), "query").withColumn("could", F.col("could") + F.col("rest"))
            could = could.where("could >= 0").join(last, "query", "left").where(F.col("last_score").isNull() | ((F.col("last_preferred") == preferred) & (F.col("could") >= F.col("last_score"))))
            asks = settle(could.select(asks.columns), "asks")
            if asks.isEmpty():
                break
    if found is None:
        found = best(scored(asked.select("query", F.lit("").alias("candidate_id")).limit(0)))
    return found.select("query", "place", "candidate_id", "score", "brand_title", "series_title", "family_title")


def hot_list(candidates: DataFrame, kind: Column, most: int = 8) -> DataFrame:
    """The most wanted families: phones first, then the rest, each once."""
    order = [F.desc(F.col("_kind") == "phone"), F.desc(bucket_priority(F.col("condition_bucket"))), F.desc("row_count"), F.desc("variant_count"), F.desc("source_count"), F.desc("latest_imported_at"), "candidate_id"]
    return candidates.withColumn("_kind", kind).orderBy(*order).limit(most).withColumn("place", F.row_number().over(Window.orderBy(*order))).select("place", "candidate_id", F.col("family_title").alias("label"))


def relative_cut(scored: DataFrame, floor: int = 60, below: int = 40, most: int = 6) -> DataFrame:
    """Rows at or over max(floor, top - below) of their query, at most `most`."""
    w = Window.partitionBy("query")
    return scored.withColumns({"_top": F.max("score").over(w), "_nth": F.row_number().over(w.orderBy(F.desc("score"), "candidate_id"))}).where((F.col("score") >= F.greatest(F.lit(floor), F.col("_top") - below)) & (F.col("_nth") <= most)).drop("_top", "_nth")


#: Points of the re-rank by preference, and what makes the first result a clear one.
NAMED, PARTLY_NAMED, SHARED_TOKEN = 260, 180, 18
BRAND_KEPT, BRAND_OTHER, FAMILY_EQUAL, FAMILY_INSIDE, BARE_EQUAL, BARE_INSIDE = 220, -120, 200, 140, 160, 110
CELLULAR, CELLULAR_BOTH, CELLULAR_EXTRA, CELLULAR_MISSING = ("蜂窝", "cellular", "esim"), 40, -60, -20
SPECS = (("gps", 24, -30), ("降噪", 26, -18), ("标准款", 26, -18), ("p93", 26, -18), ("p63", 26, -18), ("20w", 26, -18), ("30w", 26, -18), ("45w", 26, -18), ("65w", 26, -18))
CLEAR_POINTS, CLEAR_SCORE, CLEAR_RATIO = 12, 1200, 1.35


def _shared(a: Column, b: Column) -> Column:
    """Points for runs of letters, digits or Han characters that two normalised texts share."""
    runs = lambda x: F.array_distinct(F.regexp_extract_all(x, F.lit(r"([a-z]+|[0-9]+|[\u4e00-\u9fff]{1,4})")))
    return F.size(F.array_intersect(runs(a), runs(b))) * SHARED_TOKEN


def _bare(x: Column, aliases: Column) -> Column:
    """A normalised text without the longest of the aliases that begins it."""
    fitting = F.filter(aliases, lambda a: (a != "") & F.startswith(x, a))
    longest = F.aggregate(fitting, F.lit(0), lambda n, a: F.greatest(n, F.length(a)))
    return F.substr(x, longest + 1)


def preference_points(aliases: Column) -> Column:
    """Points of a result (_query, _family, _brand: normalised) under a preference (_want_brand, _want_family, '' for none)."""
    either = lambda a, b: F.contains(a, b) | F.contains(b, a)
    q, family, brand, wanted, line = (F.col(c) for c in ("_query", "_family", "_brand", "_want_brand", "_want_family"))
    some = (q != "") & (family != "")
    points = F.when(~some, 0).otherwise(F.when(q == family, NAMED).when(either(q, family), PARTLY_NAMED).otherwise(0) + _shared(q, family))
    own = (brand != "") & F.exists(aliases, lambda a: either(brand, a))
    points = points + F.when(wanted == "", 0).when(own, BRAND_KEPT).otherwise(BRAND_OTHER)
    bare_line, bare_family = _bare(line, aliases), _bare(family, aliases)
    bare = F.when((bare_line == "") | (bare_family == ""), 0).otherwise(F.when(bare_line == bare_family, BARE_EQUAL).when(either(bare_line, bare_family), BARE_INSIDE).otherwise(0))
    by_line = F.when(line == family, FAMILY_EQUAL).when(either(line, family), FAMILY_INSIDE).otherwise(bare + F.when((bare_line == "") | (bare_family == ""), 0).otherwise(_shared(bare_line, bare_family)))
    points = points + F.when((line == "") | (family == ""), 0).otherwise(by_line)
    cellular = lambda x: P.any_of(x, CELLULAR)
    spec = F.when(cellular(q) & cellular(family), CELLULAR_BOTH).when(cellular(family), CELLULAR_EXTRA).when(cellular(q), CELLULAR_MISSING).otherwise(0)
    for word, there, missing in SPECS:
        spec = spec + F.when(~F.contains(q, F.lit(word)), 0).when(F.contains(family, F.lit(word)), there).otherwise(missing)
    return points + F.when(some, spec).otherwise(0)


def preferred(results: DataFrame, preferences: DataFrame, aliases: dict[str, tuple[str, ...]] = {}) -> DataFrame:  # noqa: B006
    """Results (query, place, brand_title, family_title) re-ranked by preferences (query, preferred_brand,
    preferred_family; both may be null): the brand's rows if there are any, then the family's if there are any, then by
    points, equal ones in their old order. Adds points. aliases: other names of a brand."""
    norm = lambda c: P.normalize_search(F.coalesce(F.col(c), F.lit("")))
    df = results.join(preferences.select("query", "preferred_brand", "preferred_family"), "query", "left")
    df = df.withColumns({"_query": norm("query"), "_family": norm("family_title"), "_brand": norm("brand_title"), "_want_brand": norm("preferred_brand"), "_want_family": norm("preferred_family")})
    wanted, line, family = F.col("_want_brand"), F.col("_want_family"), F.col("_family")
    names = F.when(wanted == "", F.array().cast("array<string>"))
    for key, words in aliases.items():
        known = [P.normalize_search(F.lit(w)) for w in (key, *words)]
        fits = F.lit(False)
        for w in known:
            fits = fits | F.contains(wanted, w) | F.contains(w, wanted)
        names = names.when(fits, F.array_distinct(F.array(*known)))
    df = df.withColumn("_names", names.otherwise(F.array(wanted)))
    either = lambda a, b: F.contains(a, b) | F.contains(b, a)
    brand_hit = (F.col("_brand") != "") & F.exists("_names", lambda a: either(F.col("_brand"), a))
    bare_line, bare_family = _bare(line, F.col("_names")), _bare(family, F.col("_names"))
    line_hit = (line != "") & (family != "") & (either(line, family) | ((bare_line != "") & either(bare_line, bare_family)))
    w = Window.partitionBy("query")
    for match in (brand_hit, line_hit):
        df = df.withColumn("_hit", F.coalesce(match, F.lit(False))).withColumn("_any", F.max("_hit").over(w)).where("_hit or not _any").drop("_hit", "_any")
    df = df.withColumn("points", preference_points(F.col("_names")))
    return df.withColumn("place", F.row_number().over(w.orderBy(F.desc("points"), "place", "candidate_id"))).drop("_query", "_family", "_brand", "_want_brand", "_want_family", "_names")


def decisions(phrases: DataFrame, results: DataFrame, label: str = "family_title") -> DataFrame:
    """Per phrase of `phrases`: none, single or ambiguous. Several labels, none of them the phrase, are ambiguous.
    clear: whether the first result is far enough ahead (points, score or ratio) to be looked at by itself, or has at
    most one rival. results: query, place, points, score and the label."""
    w = Window.partitionBy("query").orderBy("place")
    norm = P.normalize_search
    led = results.withColumns({"_score": F.lead("score").over(w), "_points": F.lead("points").over(w)})
    first = lambda c: F.max(F.when(F.col("place") == 1, F.col(c)))
    per = led.groupBy("query").agg(F.count_distinct(norm(label)).alias("n_labels"), F.count(F.lit(1)).alias("n_results"), F.max(norm(label) == norm("query")).alias("named"), F.min_by(label, "place").alias("label"), first("score").alias("score"), first("_score").alias("next_score"), first("points").alias("points"), first("_points").alias("next_points"))
    ahead = (F.col("points") - F.col("next_points") >= CLEAR_POINTS) | ((F.col("score") > 0) & (F.col("next_score") <= 0)) | (F.col("score") - F.col("next_score") >= CLEAR_SCORE) | ((F.col("next_score") > 0) & (F.col("score") >= F.col("next_score") * CLEAR_RATIO))
    out = phrases.select("query").distinct().join(per, "query", "left")
    decision = F.when(F.col("n_labels").isNull(), "none").when((F.col("n_labels") == 1) | F.col("named"), "single").otherwise("ambiguous")
    return out.select("query", decision.alias("decision"), F.coalesce((F.col("n_results") <= 2) | ahead, F.lit(False)).alias("clear"), F.coalesce("n_labels", F.lit(0)).alias("n_labels"), "label")


def representative(variants: DataFrame, by: list[str]) -> DataFrame:
    """The variant nearest to its group's price, the more informative label first."""
    info = F.length(P.normalize_search("variant_label"))
    order = F.struct(F.abs(F.col("price") - F.col("group_price")).alias("d"), (-info).alias("i"), "variant_label")
    return variants.groupBy(*by).agg(F.min_by("variant_label", order).alias("variant_label"), F.min_by("price", order).alias("price"))
