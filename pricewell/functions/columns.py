"""Scalar projections as Column expressions: strings, prices, day labels, sellers, capacity labels.

Empty text and null are alike: every function takes both and returns '' (or null where it says so)."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date, timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F

STAMP = r"([0-9]{4}-[0-9]{2}-[0-9]{2})[ T]([0-9]{2}:[0-9]{2}:[0-9]{2})"


def col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def plain(x: Column | str) -> Column:
    """Trimmed text, null as ''."""
    return F.trim(F.coalesce(col(x).cast("string"), F.lit("")))


def filled(x: Column | str) -> Column:
    """Trimmed text, null where nothing is left."""
    return F.nullif(plain(x), F.lit(""))


def any_of(text: Column, keywords: Sequence[str]) -> Column:
    """Whether the text contains one of the keywords."""
    found = F.lit(False)
    for k in keywords:
        found = found | text.contains(k) if k else found
    return found


def normalize_search(x: Column | str) -> Column:
    """Lower-cased letters and digits of any script."""
    return F.regexp_replace(F.lower(plain(x)), r"[^\p{L}\p{N}]", "")


def sku_title(model: Column | str, group: Column | str) -> Column:
    return F.when(plain(group) != "", F.concat_ws("-", plain(model), plain(group))).otherwise(plain(model))


def parse_price(x: Column | str) -> Column:
    """Whole price of an all-digit text, else null."""
    text = plain(x)
    return F.when(text.rlike("^[0-9]+$"), text.try_cast("bigint"))


def price_text(x: Column | str) -> Column:
    """Price text without separators, blanks and currency marks."""
    return F.regexp_replace(plain(x), r"[,\s￥¥]", "")


def is_price_text(x: Column) -> Column:
    return F.coalesce(x.rlike("^[0-9]+$") & (x.try_cast("bigint") > 0), F.lit(False))


def day_label(gprice: Column | str = "gprice", gprice_two: Column | str = "gprice_two") -> Column:
    """The first MM-DD of gprice, else of gprice_two, else ''."""
    found = [F.nullif(F.regexp_extract(plain(x), r"([0-9]{2}-[0-9]{2})", 1), F.lit("")) for x in (gprice, gprice_two)]
    return F.coalesce(*found, F.lit(""))


def month_day(label: Column) -> Column:
    """struct(month, day) of a day_label(), zeros where there is none."""
    part = lambda at: F.coalesce(F.substring(label, at, 2).try_cast("int"), F.lit(0))
    return F.struct(part(1).alias("month"), part(4).alias("day"))


def stamp_key(x: Column | str) -> Column:
    """'YYYY-MM-DD HH:MM:SS' found in the text, zeros where there is none; sorts as the time does."""
    return F.greatest(F.translate(F.regexp_extract(plain(x), STAMP, 0), "T", " "), F.lit("0000-00-00 00:00:00"))


def imported_day(x: Column | str) -> Column:
    return F.regexp_extract(plain(x), r"([0-9]{4}-[0-9]{2}-[0-9]{2})", 1)


def merchant(seller: Column | str = "sname", stall: Column | str = "sno", group_id: Column | str = "gid", row_id: Column | str = "id") -> Column:
    """Seller identity: name, else stall, else id, else unknown."""
    name, place = F.lower(plain(seller)), F.lower(plain(stall))
    number = F.coalesce(filled(group_id), filled(row_id))
    return F.when(name != "", F.concat(F.lit("name:"), name)).when(place != "", F.concat(F.lit("stall:"), place)).otherwise(F.coalesce(F.concat(F.lit("id:"), number), F.lit("unknown")))


def catalog_seller() -> Column:
    """The catalog's own, unprefixed seller key: name, stall or row id."""
    return F.coalesce(filled("sname"), filled("sno"), F.col("id").cast("string"))


def day_bucket(label: Column | None = None) -> Column:
    """struct(key, label, kind): quote day label (day_label(), if not given), else import day, else unlabelled."""
    label, day = day_label() if label is None else label, imported_day("imported_at")
    make = lambda key, lab, kind: F.struct(key.alias("key"), lab.alias("label"), F.lit(kind).alias("kind"))
    return F.when(label != "", make(F.concat(F.lit("label:"), label), label, "label")).when(day != "", make(F.concat(F.lit("day:"), day), day, "day")).otherwise(make(F.lit("unlabelled"), F.lit(""), "unlabelled"))


def run_date(run_key: Column | str) -> Column:
    return F.regexp_extract(plain(run_key), r"([0-9]{4}-[0-9]{2}-[0-9]{2})$", 1)


def report_label(gprice: Column | str) -> Column:
    text = F.coalesce(col(gprice), F.lit(""))
    return F.when(F.length(text) >= 5, F.substring(text, 1, 5)).otherwise(text)


def recent_labels(as_of: Column | date, days: int) -> Column:
    """MM-DD labels of as_of and the days before it; those of a known date are literals, made once for all rows."""
    if isinstance(as_of, date):
        return F.lit([(as_of - timedelta(days=i)).strftime("%m-%d") for i in range(max(1, days))])
    return F.transform(F.sequence(F.lit(0), F.lit(max(1, days) - 1)), lambda i: F.date_format(F.date_sub(as_of, i), "MM-dd"))


def tag_flags(text: Column, pairs: Sequence[tuple[str, str]]) -> dict[str, Column]:
    """For each tag of the (tag, keyword) pairs, in sorted order, whether one of its keywords is in the text."""
    tags = sorted({t for t, k in pairs if t and k})
    return {t: any_of(text, [k for own, k in pairs if own == t]) for t in tags}


def flagged(flags: dict[str, Column], separator: str = "|") -> Column:
    """The names whose flags hold, in the given order, as one text."""
    return F.concat_ws(separator, *[F.when(flag, F.lit(name)) for name, flag in flags.items()])


def keywords_hit(text: Column, keywords: Sequence[str]) -> Column:
    """The keywords in the text, in their own order."""
    if not keywords:
        return F.array().cast("array<string>")
    return F.array_remove(F.array(*[F.when(text.contains(k), F.lit(k)).otherwise(F.lit("")) for k in keywords if k]), "")


def join_text(*parts: Column | str) -> Column:
    return F.concat_ws(" | ", *[filled(p) for p in parts])


CAPACITY = r"(?i)([0-9]+\+[0-9]+(?:GB|G|TB|T)|[0-9]+(?:GB|G|TB|T))"
SEARCH_CAPACITY = r"(?i)([0-9]+(?:GB|G)?\+[0-9]+(?:GB|G|TB|T)|[0-9]+(?:GB|G|TB|T))"


def capacity_label(token: Column) -> Column:
    return F.replace(F.replace(F.replace(F.upper(F.trim(token)), F.lit(" "), F.lit("")), F.lit("GB"), F.lit("G")), F.lit("TB"), F.lit("T"))


def group_spec(group: Column | str, pattern: str = CAPACITY, no_capacity: str = "DEFAULT", no_group: str = "UNSPECIFIED", no_variant: str = "STANDARD") -> Column:
    """struct(capacity, variant) of a group title: the first capacity token, and what stands around it."""
    title = plain(group)
    at = F.regexp_instr(title, F.lit(pattern))
    token = F.regexp_extract(title, pattern, 1)
    trimmed = lambda x: F.regexp_replace(x, r"^[ /\-_+]+|[ /\-_+]+$", "")
    before, after = trimmed(F.substring(title, F.lit(1), at - 1)), trimmed(F.substring(title, at + F.length(token), F.length(title)))
    variant = F.trim(F.regexp_replace(F.trim(F.concat(before, after)), r"^[\\/|,.;:+\-]+|[\\/|,.;:+\-]+$", ""))
    variant = F.regexp_replace(variant, r"\s{2,}", " ")
    make = lambda c, v: F.struct(c.alias("capacity"), v.alias("variant"))
    return F.when(title == "", make(F.lit(no_capacity), F.lit(no_group))).when(token == "", make(F.lit(no_capacity), title)).otherwise(make(capacity_label(token), F.coalesce(F.nullif(variant, F.lit("")), F.lit(no_variant))))


def capacity_order(label: Column | str) -> Column:
    """struct(memory, storage in GB): sorts capacities; unknown ones come last."""
    text = capacity_label(plain(label))
    part = lambda k: F.coalesce(F.regexp_extract(text, r"^(?:([0-9]+)\+)?([0-9]+)(G|T)$", k).try_cast("int"), F.lit(0))
    make = lambda a, b: F.struct(a.alias("memory"), b.alias("storage"))
    size = part(2) * F.when(text.endswith("T"), 1024).otherwise(1)
    return F.when(text == "", make(F.lit(10**9), F.lit(10**9))).when(text.rlike(r"^(?:[0-9]+\+)?[0-9]+(G|T)$"), make(part(1), size)).otherwise(make(F.lit(10**9 - 1), F.lit(10**9 - 1)))


def scope_level(group: Column | str, spec: Column) -> Column:
    return F.when(plain(group) == "", "model").when((spec["capacity"] != "DEFAULT") & (spec["variant"] == "STANDARD"), "capacity").otherwise("variant")


def range_text(values: Column) -> Column:
    """'min-max' of the positive values of an array, or '--'."""
    good = F.filter(values, lambda x: x > 0)
    return F.when(F.size(good) > 0, F.concat_ws("-", F.array_min(good).cast("string"), F.array_max(good).cast("string"))).otherwise("--")


def range_bounds(text: Column) -> Column:
    """struct(low, high) of the numbers in a range text; one number is both."""
    numbers = F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit("([0-9]+)"), F.lit(1)), lambda x: x.try_cast("bigint"))
    low = F.coalesce(F.get(numbers, F.lit(0)), F.lit(0))
    return F.struct(low.alias("low"), F.coalesce(F.get(numbers, F.lit(1)), low).alias("high"))


def coerce_int(x: Column) -> Column:
    return F.coalesce(x.cast("string").try_cast("double").try_cast("bigint"), F.lit(0))


MEMORY = r"(?:^|[^0-9])([0-9]{1,2})(?:g)?\+([0-9]{2,4})(?:g|t)?"


def match_text(x: Column | str) -> Column:
    """Text without blanks and underscores, lower-cased."""
    return F.lower(F.regexp_replace(plain(x), r"[\s_]", ""))


def filter_terms(x: Column | str) -> Column:
    """Terms of a filter text, cut at commas and line ends."""
    return F.filter(F.transform(F.split(plain(x), r"[,，\n]"), match_text), lambda t: t != "")


def distinct_texts(values: Column) -> Column:
    """Trimmed texts in order, the first of each case-folded form.

    Forms are sorted, so that each is compared with the one before it alone; bound() makes an array a variable of a lambda,
    which is computed once."""
    bound = lambda x, use: F.get(F.transform(F.array(x), use), F.lit(0))
    texts = F.filter(F.transform(values, lambda x: F.trim(x)), lambda x: x != "")
    forms = F.array_sort(F.transform(texts, lambda x, i: F.struct(F.lower(x).alias("form"), i.alias("at"), x.alias("text"))))
    first = bound(forms, lambda s: F.filter(s, lambda x, i: (i == 0) | (x["form"] != F.get(s, i - 1)["form"])))
    return F.transform(F.array_sort(F.transform(first, lambda x: F.struct(x["at"].alias("at"), x["text"].alias("text")))), lambda x: x["text"])


def fingerprint(payload: Column | str) -> Column:
    """SHA-1 of a payload without white space."""
    return F.sha1(F.regexp_replace(F.coalesce(col(payload), F.lit("")), r"\s+", ""))


def search_text(*parts: Column | str) -> Column:
    return F.concat_ws(" ", *[filled(p) for p in parts])


def task_key(model: Column | str, city: Column | str, day: Column | str) -> Column:
    return F.concat_ws("__", plain(model), plain(city), plain(day))


#: Status texts with a spelling of their own (fixed values); others get blanks around the slash.
STATUS_TEXT = (
    ("公司纯原封/特定区域销售", "公司纯原封（特定区域）"), ("公司纯原封/可出全国", "公司纯原封（可出全国）"), ("公司纯原封/不怕串", "公司纯原封（不怕串）"), ("公司纯原封/默认", "公司纯原封（默认）"),
    ("全国纯原不怕串", "全国纯原（不怕串）"), ("保证全国纯原", "全国纯原"), ("保证全国纯原/可出全国", "全国纯原（可出全国）"), ("保证省内纯原", "省内纯原"),
)


def status_text(x: Column | str) -> Column:
    """A dealer status as it is shown; '--' where there is none."""
    text = plain(x)
    shown = F.replace(text, F.lit("/"), F.lit(" / "))
    for known, own in STATUS_TEXT:
        shown = F.when(text == known, own).otherwise(shown)
    return F.when(text == "", "--").otherwise(shown)


def candidate_label(source: Column, external_title: Column, family: Column, model: Column) -> Column:
    own = F.coalesce(filled(family), filled(model), F.lit("未命名机型"))
    return F.when(source == "external", F.coalesce(filled(external_title), filled(model), F.lit(""))).otherwise(own)


def candidate_meta(source: Column, source_title: Column, row_count: Column, brand: Column, series: Column) -> Column:
    outside = F.concat(F.coalesce(filled(source_title), F.lit("外部行情图")), F.lit(" / "), coerce_int(row_count).cast("string"), F.lit(" 条参考"))
    return F.when(source == "external", outside).otherwise(F.concat_ws(" / ", filled(brand), filled(series)))


def strip_alias(surface: Column, aliases: Sequence[str]) -> Column:
    """The compact surface without the longest alias that it begins with."""
    text = F.regexp_replace(F.lower(plain(surface)), r"[^\p{L}\p{N}]", "")
    out = text
    for alias in sorted(aliases, key=len):
        out = F.when(text.startswith(alias), F.substring(text, F.lit(len(alias) + 1), F.length(text))).otherwise(out)
    return out


def refinement_phrase(query: Column, family: Column, aliases: Sequence[str]) -> Column:
    """Capacities and spec-like words (with a digit) of a phrase that are no part of the family's or brand's name."""
    tokens = F.array_distinct(F.regexp_extract_all(F.lower(plain(query)), F.lit(r"([\p{L}\p{N}+#]+)"), F.lit(1)))
    name = F.regexp_replace(F.lower(plain(family)), r"[^\p{L}\p{N}]", "")
    size = lambda t: t.rlike(r"^[0-9]+(\+[0-9]+)?(g|gb|t|tb)$")
    sizes = F.array_sort(F.transform(F.filter(tokens, size), capacity_label))
    known = lambda t: F.contains(name, t) | F.contains(t, name)

    def branded(t: Column) -> Column:
        hit = F.lit(False)
        for a in aliases:
            hit = hit | t.contains(a) | F.contains(F.lit(a), t)
        return hit

    words = F.filter(tokens, lambda t: ~size(t) & t.rlike("[0-9]") & (F.length(t) > 1) & ~known(t) & ~branded(t))
    return F.array_join(F.concat(sizes, words), " ")
