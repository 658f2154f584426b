"""Benchmark decontamination with a distributed positional inverted index, in DataFrame functions only.

Test items are cut into windows of `size` consecutive words (a shorter item is one window). Term counts over the whole
corpus give each window its rarest terms; the corpus' postings (term, document, position) of those terms are stored as a
table. Offset-adjusted postings lists (position in the text less position in the item) are intersected per document and
item: places where the rarest terms of a window meet, and the words between agree (postings carry the words around
them), are exact matches; places where they come within `slop` words of each other are proximity matches. Texts are
read where they lie: only postings, matches and word counts are shuffled.

Terms meet texts by broadcast, in blocks of at most TERMS_PER_BLOCK terms, one pass over the texts for each block, so no
text is ever shuffled, however many terms the tests have. A term's postings meet its places in the items in parts of
some PER_PART postings, so a common term is many tasks.

Defined results: a null or empty text has no words, no hits and is clean; a text is read whole, however long; an item
without words has no window; an item with a null id is named ''; items of equal id count once; documents with equal
doc_id and text share their result, with equal doc_id and other text do not; empty tables give no rows, or clean ones;
extra columns stay in decontaminate(), whatever their names and types."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ascii_lower, bounded, settle, without

BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: A word of a text that is not lower-cased yet.
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
WINDOW, SLOP = 13, 4
#: Terms that are broadcast in one pass; postings of a term that are joined in one part.
TERMS_PER_BLOCK, PER_PART = 500_000, 1_000_000


def words_of(text: Column) -> Column:
    return F.filter(F.split(ascii_lower(F.coalesce(text.cast("string"), F.lit(""))), BETWEEN), lambda w: w != "")


DOC = ["id0", "no_id", "text_key"]


def _document() -> list[Column]:
    """What tells documents apart."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return [F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("id0"), F.col("doc_id").isNull().alias("no_id"), F.xxhash64(text).alias("text_key")]


def items_of(benchmark: DataFrame, size: int = WINDOW) -> DataFrame:
    """(item, name, item_words, width): distinct items that have words; width: words of a window."""
    rows = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("name"), words_of(F.col("text")).alias("item_words")).where(F.size("item_words") > 0).distinct()
    return rows.select(F.xxhash64("name", "item_words").alias("item"), "name", "item_words", F.least(F.size("item_words"), F.lit(size)).alias("width"))


def _in_blocks(terms: DataFrame) -> list[DataFrame]:
    """terms (settled, distinct) in blocks by hash, each to be broadcast."""
    n = -(-terms.count() // TERMS_PER_BLOCK)
    return [F.broadcast(terms.where(F.pmod(F.xxhash64("term"), F.lit(n)) == k) if n > 1 else terms) for k in range(n)]


def _all(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x)
    return out


def term_counts(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """(term, n): occurrences in the corpus of the terms that occur."""
    tokens = docs.select(F.explode(words_of(F.col("text"))).alias("term"))
    return _all([tokens.join(block, "term").groupBy("term").agg(F.count(F.lit(1)).alias("n")) for block in _in_blocks(terms)] or [terms.select("term", F.lit(0).cast("long").alias("n")).limit(0)])


def anchors_of(items: DataFrame, counts: DataFrame, rarest: int = 2) -> DataFrame:
    """(item, pos, term, n): the `rarest` rarest places of every window, of those whose terms occur."""
    starts = items.select("item", "item_words", "width", F.explode(F.sequence(F.lit(0), F.size("item_words") - F.col("width"))).alias("start"))
    places = starts.select("item", "start", F.posexplode(F.slice("item_words", F.col("start") + 1, F.col("width"))).alias("k", "term")).withColumn("pos", F.col("start") + F.col("k"))
    w = Window.partitionBy("item", "start")
    ranked = places.join(counts, "term").withColumn("rank", F.row_number().over(w.orderBy("n", "pos")))
    return ranked.where(F.col("rank") <= rarest).select("item", "pos", "term", "n").distinct()


def postings(docs: DataFrame, terms: DataFrame, size: int = WINDOW) -> DataFrame:
    """The positional index of terms: (term, part, document, at, context, left): positions from 0, and the words up to
    size - 1 places around, `left` of them before the term; part: one of the term's `parts`, by document.

    terms: term, parts."""
    tokens = docs.select(*_document(), words_of(F.col("text")).alias("words")).select(*DOC, "words", F.posexplode("words").alias("at", "term"))
    left = F.least("at", F.lit(size - 1))
    part = F.pmod(F.xxhash64(*DOC), F.col("parts")).cast("int").alias("part")
    made = lambda block: tokens.join(block, "term").select("term", part, *DOC, "at", F.slice("words", F.col("at") - left + 1, left + size).alias("context"), left.alias("left"))
    return _all([made(block) for block in _in_blocks(terms)] or [made(terms)])


def alignments(index: DataFrame, anchors: DataFrame, items: DataFrame, slop: int = SLOP) -> tuple[DataFrame, DataFrame]:
    """(exact matches: document, item, shift, starts; proximity matches: document, item). shift: text place of the item's
    word 0; starts: places in the item where windows begin that the text has.

    A posting is verified against the item in its own row, by its context; what moves on is small. An exact match is
    where the offset-adjusted lists of a window's rarest terms intersect, and the words between agree."""
    dealt = anchors.select("item", "pos", "term", F.explode(F.sequence(F.lit(0), F.col("parts").cast("int") - 1)).alias("part"))
    met = index.join(bounded(dealt), ["term", "part"]).join(items.select("item", "item_words", "width"), "item")
    first, last = F.greatest(F.lit(0), F.col("pos") - F.col("width") + 1, F.col("pos") - F.col("left")), F.least("pos", F.size("item_words") - F.col("width"))
    same = lambda s: F.slice("context", F.col("left") + s - F.col("pos") + 1, F.col("width")) == F.slice("item_words", s + 1, F.col("width"))
    starts = F.when(last >= first, F.filter(F.sequence(first, last), same)).otherwise(F.array().cast("array<int>"))
    met = met.select(*DOC, "item", "width", (F.col("at") - F.col("pos")).alias("shift"), "pos", starts.alias("starts"))
    met = met.groupBy(*DOC, "item", "width", "shift").agg(F.collect_set("pos").alias("met"), F.array_distinct(F.flatten(F.collect_list("starts"))).alias("starts"))
    exact = met.where((F.size("met") >= F.least(F.lit(2), "width")) & (F.size("starts") > 0)).select(*DOC, "item", "shift", "width", "starts")
    w = Window.partitionBy(*DOC, "item").orderBy("shift").rangeBetween(-slop, 0)
    near = met.withColumn("close", F.array_distinct(F.flatten(F.collect_list("met").over(w))))
    near = near.where(F.exists("met", lambda p: F.exists("close", lambda q: (p != q) & (F.abs(p - q) < F.col("width")))))
    return exact, near.select(*DOC, "item").distinct()


def contamination(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW, slop: int = SLOP) -> DataFrame:
    """Per document: doc_id, text_key, n_words, n_hit, items (sorted names), near_items (proximity matches alone), contaminated."""
    items = settle(items_of(benchmark, size), "items")
    terms = settle(items.select(F.explode("item_words").alias("term")).distinct(), "terms")
    anchors = anchors_of(items, settle(term_counts(docs, terms), "term-counts"))
    anchors = settle(anchors.withColumn("parts", F.ceil(F.col("n") / PER_PART)), "anchors")
    index = settle(postings(docs, settle(anchors.select("term", "parts").distinct(), "anchor-terms"), size), "postings")
    exact, near = alignments(index, anchors, items, slop)
    names = items.select("item", "name")
    begin = F.col("shift") + F.col("start")
    hits = exact.join(names, "item").select(*DOC, "name", "shift", "width", F.explode("starts").alias("start"))
    hits = hits.groupBy(*DOC).agg(F.array_sort(F.collect_set(F.struct(begin.alias("a"), (begin + F.col("width")).alias("z")))).alias("hit"), F.array_sort(F.collect_set("name")).alias("items"))
    covered = F.aggregate("hit", F.struct(F.lit(0).alias("sum"), F.lit(0).alias("until")), lambda s, x: F.struct((s["sum"] + F.greatest(x["z"] - F.greatest(x["a"], s["until"]), F.lit(0))).alias("sum"), F.greatest(x["z"], s["until"]).alias("until")))
    hits = hits.select(*DOC, covered["sum"].alias("n_hit"), "items")
    close = near.join(names, "item").groupBy(*DOC).agg(F.collect_set("name").alias("near_names"))
    found = hits.join(close, DOC, "full")
    none = F.array().cast("array<string>")
    n_words = F.regexp_count(F.coalesce(F.col("text").cast("string"), F.lit("")), F.lit(WORD)).cast("long")
    rows = docs.select(*_document(), n_words.alias("n_words")).join(settle(found, "found"), DOC, "left")
    rows = rows.select(F.when(~F.col("no_id"), F.col("id0")).alias("doc_id"), "text_key", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.coalesce("items", none).alias("items"), F.coalesce("near_names", none).alias("near_names"))
    rows = rows.withColumn("near_items", F.array_sort(F.array_except("near_names", "items"))).drop("near_names")
    return rows.withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))


def decontaminate(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW) -> DataFrame:
    """The documents that are not contaminated, with all their columns."""
    bad = contamination(docs, benchmark, size).where("contaminated").select("doc_id", "text_key")
    text = F.coalesce(docs["text"].cast("string"), F.lit(""))
    return without(docs, settle(bad, "contaminated"), {"doc_id": docs["doc_id"].cast("long"), "text_key": F.xxhash64(text)})
