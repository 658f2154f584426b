"""Quality rules with robust multivariate outliers, in DataFrame functions only.

Every text gives counts (words, symbols, repeated lines and windows). Base rules reject short and repetitive texts.
The rest is judged by its transformed statistic vector against its language and source: a minimum covariance
determinant estimate (four deterministic starts, concentration steps over all rows until the determinant stands still,
the start with the smallest determinant, consistency factor, one reweighting), and a row is rejected where its
Mahalanobis distance is beyond `cutoff`.

Concentration needs order statistics of distances. They come from counts per fine bin of log distance (BINS_PER_E bins
per factor e), and each bin brings its rows' sums along, so a step is one aggregation of the rows: partial sums, some
thousand bins per group and start, no group of rows in one task. Estimates have one row per group and start; they are
broadcast behind a count, else the rows are salted (common.meet).
The covariance gets a floor (FLOOR per statistic, the differences below which nobody would call a text odd), which also
keeps statistics that are constant in a group from rejecting the first text that differs.

A group under `least` rows is judged with the small groups of its language, those with the small ones of all
languages; where even these are fewer than `least`, all pass.

Defined results: a null or empty text has no words and fails the base; a text is measured whole, however long; equal
rows get equal verdicts; null language or source is a group of its own; null doc_ids are kept; an empty table gives no
rows; extra columns, whatever their names and types, stay in keep_quality() and are not read by quality()."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded, meet, settle, without

WORD, BLANK, SYMBOLS = r"[^\x20\x09-\x0D]+", r"[\x20\x09-\x0D]+", r"[^#*$%&|<>]+"
STATS = ("log_words", "log_word_chars", "symbols", "dup_lines", "repeats")
#: For each statistic the standard deviation that is added (squared) to every variance.
FLOOR = (0.5, 0.15, 0.35, 0.5, 0.8)
BINS_PER_E, SHARE = 64, 0.75
#: A start is at rest where a step lowers the log of its determinant (of the factor) by less than this.
AT_REST = 1e-6
#: sqrt of the chi-square quantile 1 - 1e-6 with 5 degrees of freedom (a fixed value).
CUTOFF = 5.99
#: chi-square quantile 0.975 with 5 degrees of freedom, and 0.75 / chi-square CDF with 7 at the quantile 0.75 with 5 (fixed values).
REWEIGHT, CONSISTENCY = 12.83, 1.41


def counts(text: Column, window: int = 8) -> dict[str, Column]:
    """The columns n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words as stages over a column `text`."""
    return {
        "words": F.filter(F.split(text, BLANK), lambda w: w != ""),
        "n_symbols": F.length(F.regexp_replace(text, SYMBOLS, "")).cast("long"),
        "lines": F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")),
        "window": F.lit(window),
    }


def repeat_words(window: int = 8) -> list[dict[str, Column]]:
    """Stages from `words` to n_repeat_words: windows as hashes; where some are equal, windows sorted with their places,
    those with an equal neighbour (the words are compared too) back in text order, and the words that these cover."""
    n = F.size("words")
    hashes = F.when(n >= window, F.transform(F.sequence(F.lit(1), n - (window - 1)), lambda i: F.xxhash64(F.slice("words", i, F.lit(window)))))
    some = F.size(F.array_distinct("hashes")) < F.size("hashes")
    same = lambda x, y: (x["h"] == y["h"]) & (F.slice("words", x["i"] + 1, F.lit(window)) == F.slice("words", y["i"] + 1, F.lit(window)))
    placed = F.when(some, F.sort_array(F.transform(F.col("hashes"), lambda h, i: F.struct(h.alias("h"), i.alias("i")))))
    twice = F.filter(F.col("placed"), lambda x, i: F.coalesce(same(x, F.get("placed", i + 1)), F.lit(False)) | ((i > 0) & same(x, F.get("placed", F.greatest(i - 1, F.lit(0))))))
    starts = F.sort_array(F.transform(twice, lambda x: x["i"]))
    covered = F.aggregate(F.col("starts"), F.struct(F.lit(0).alias("sum"), F.lit(0).alias("until")), lambda a, s: F.struct((a["sum"] + s + window - F.greatest(a["until"], s)).alias("sum"), (s + window).alias("until")))
    return [{"hashes": hashes}, {"placed": placed}, {"starts": starts}, {"n_repeat_words": F.coalesce(covered["sum"], F.lit(0)).cast("long")}]


def measure(docs: DataFrame, window: int = 8) -> DataFrame:
    """(row_key, doc_id, lang, source, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed) of every text."""
    has = {c.lower() for c in docs.columns}
    pick = lambda c, kind: (F.col(c).cast(kind) if c in has else F.lit(None).cast(kind)).alias(c)
    df = docs.select(pick("doc_id", "long"), pick("lang", "string"), pick("source", "string"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    known = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c)), F.lit("null"))
    df = df.withColumn("row_key", F.xxhash64("doc_id", known("lang"), known("source"), "text"))
    df = df.withColumns(counts(F.col("text"), window)).drop("text")
    df = df.withColumns({
        "n_words": F.size("words").cast("long"),
        "word_chars": F.aggregate("words", F.lit(0).cast("long"), lambda a, w: a + F.length(w)),
        "n_dup_lines": (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long"),
    }).drop("lines", "window")
    for stage in repeat_words(window):
        df = df.withColumns(stage)
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    return df.select("row_key", "doc_id", "lang", "source", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"))


def vectors(measured: DataFrame, least: int) -> DataFrame:
    """The rows that passed the base, with their statistic vector x0, x1... and the group g that judges them (null: none)."""
    x = (
        F.log1p("n_words"), F.log(F.greatest(F.col("word_chars") / F.greatest("n_words", F.lit(1)), F.lit(0.1))),
        F.log1p(100 * F.col("n_symbols") / F.greatest("word_chars", F.lit(1))), F.log1p(F.col("n_dup_lines").cast("double")), F.log1p(100 * F.col("n_repeat_words") / F.greatest("n_words", F.lit(1))),
    )
    rows = measured.where("not base_failed").withColumns({f"x{i}": v for i, v in enumerate(x)})
    sizes = rows.groupBy("lang", "source").agg(F.count(F.lit(1)).alias("n"))
    sizes = sizes.withColumn("level", F.when(F.col("n") >= least, 2).otherwise(1))
    small = F.sum(F.when(F.col("level") == 1, F.col("n")))
    by_lang = sizes.groupBy("lang").agg(small.alias("n_lang"))
    by_lang = by_lang.withColumn("joint", F.col("n_lang") >= least)
    rest = by_lang.where("not joint").agg(F.sum("n_lang").alias("n_all"))
    named = sizes.alias("s").join(by_lang.alias("l"), F.col("s.lang").eqNullSafe(F.col("l.lang")), "left").join(rest, how="left", on=F.lit(True))
    key = lambda level, *c: F.xxhash64(F.lit(level), *[F.coalesce(F.concat(F.lit("="), F.col(v)), F.lit("null")) for v in c])
    g = F.when(F.col("level") == 2, key(2, "s.lang", "s.source")).when(F.col("joint"), key(1, "s.lang")).when(F.col("n_all") >= least, key(0))
    named = named.select(F.col("s.lang").alias("g_lang"), F.col("s.source").alias("g_source"), g.alias("g"))
    on = F.col("lang").eqNullSafe(F.col("g_lang")) & F.col("source").eqNullSafe(F.col("g_source"))
    return rows.join(bounded(settle(named, "groups")), on, "left").drop("g_lang", "g_source")


P = len(STATS)
PAIRS = [(i, j) for i in range(P) for j in range(i + 1)]
SUMS = ["n", *[f"s{i}" for i in range(P)], *[f"q{i}_{j}" for i, j in PAIRS]]
#: Estimates of groups and starts are broadcast up to so many rows (some 250 bytes each).
MOST_ESTIMATES = 100_000


def _at(i: int, j: int) -> int:
    """Place of (i, j), i >= j, in an array of a lower triangle's rows."""
    return i * (i + 1) // 2 + j


def _sums(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Count, sums and sums of products of x0, x1... per key."""
    sums = [F.expr("count(1) AS n"), *[F.expr(f"sum(x{i}) AS s{i}") for i in range(P)], *[F.expr(f"sum(x{i} * x{j}) AS q{i}_{j}") for i, j in PAIRS]]
    return rows.groupBy(*keys).agg(*sums)


def _moments(sums: DataFrame, keys: list[str]) -> DataFrame:
    """Mean m and covariance c (lower triangle, without floor) from sums."""
    c = ", ".join(f"q{i}_{j} / n - s{i} / n * (s{j} / n)" if i != j else f"greatest(q{i}_{i} / n - s{i} / n * (s{i} / n), 0D)" for i, j in PAIRS)
    return sums.selectExpr(*keys, f"array({', '.join(f's{i} / n' for i in range(P))}) AS m", f"array({c}) AS c")


def _factor(estimates: DataFrame, scale: float, floor: tuple) -> DataFrame:
    """Adds the Cholesky factor f (lower triangle) of scale * c + floor, and its log determinant.

    A column of the factor is two stages, so that no expression is copied into the next."""
    df = estimates

    def entry(i: int, j: int) -> str:
        less = "".join(f" - f{_at(i, k)} * f{_at(j, k)}" for k in range(j))
        return f"c[{_at(i, j)}] * {scale}D" + (f" + {floor[i] ** 2}D" if i == j else "") + less

    for j in range(P):
        df = df.selectExpr("*", f"sqrt(greatest({entry(j, j)}, 1e-9D)) AS f{_at(j, j)}")
        if j < P - 1:
            df = df.selectExpr("*", *[f"({entry(i, j)}) / f{_at(j, j)} AS f{_at(i, j)}" for i in range(j + 1, P)])
    f, logdet = ", ".join(f"f{k}" for k in range(len(PAIRS))), " + ".join(f"ln(f{_at(i, i)})" for i in range(P))
    return df.selectExpr(*estimates.columns, f"array({f}) AS f", f"{logdet} AS logdet")


def _distance(rows: DataFrame, estimates: DataFrame, name: str, *extra: str) -> DataFrame:
    """rows with an estimate (m, f; several per group where there are starts): adds the squared Mahalanobis distance of x
    from m, by forward substitution with f."""
    flat = estimates.selectExpr("g", *extra, *[f"m[{i}] AS m{i}" for i in range(P)], *[f"f[{k}] AS f{k}" for k in range(len(PAIRS))])
    out = meet(rows, flat, "g", F.struct(*[c for c in rows.columns if c != "g"]), MOST_ESTIMATES)
    for i in range(P):
        less = "".join(f" - f{_at(i, k)} * z{k}" for k in range(i))
        out = out.selectExpr("*", f"(x{i} - m{i}{less}) / f{_at(i, i)} AS z{i}")
    return out.selectExpr(*rows.columns, *extra, f"{' + '.join(f'z{i} * z{i}' for i in range(P))} AS {name}")


def _nearest(rows: DataFrame, share: float) -> DataFrame:
    """Sums per (g, start) over the bins of distance d2 that hold its nearest `share` of rows."""
    bin_of = F.floor(F.log(F.greatest("d2", F.lit(1e-6))) * BINS_PER_E).cast("int")
    bins = _sums(rows.withColumn("bin", bin_of), ["g", "start", "bin"])  # a few thousand bins at most per group and start
    w = Window.partitionBy("g", "start")
    bins = bins.withColumns({"upto": F.sum("n").over(w.orderBy("bin")), "whole": F.sum("n").over(w)})
    near = bins.where(F.col("upto") - F.col("n") < F.ceil(F.col("whole") * share))
    return near.groupBy("g", "start").agg(*[F.sum(x).alias(x) for x in SUMS])


def _quartiles(rows: DataFrame) -> DataFrame:
    """Per group and statistic i its quartiles l, m and u, from counts of values in bins of 1 / BINS_PER_E."""
    bins = rows.select("g", F.posexplode(F.array(*[f"x{i}" for i in range(P)])).alias("i", "v")).groupBy("g", "i", F.floor(F.col("v") * BINS_PER_E).alias("bin")).agg(F.count(F.lit(1)).alias("k"))
    w = Window.partitionBy("g", "i")
    bins = bins.withColumns({"upto": F.sum("k").over(w.orderBy("bin")), "whole": F.sum("k").over(w)})
    at = lambda q, i: F.min(F.when((F.col("i") == i) & (F.col("upto") >= q * F.col("whole")), (F.col("bin") + 0.5) / BINS_PER_E))
    return bins.groupBy("g").agg(*[at(q, i).alias(f"{name}{i}") for i in range(P) for name, q in (("l", 0.25), ("m", 0.5), ("u", 0.75))])


def _starts(rows: DataFrame, floor: tuple) -> DataFrame:
    """(g, start, m, c): quartiles alone (0), mean and covariance (1), and about the medians the correlations of tanh
    scores (2) and of spatial signs (3) with the quartiles' spread."""
    spread = lambda i: f"((u{i} - l{i}) / 1.349D)"
    tails = _quartiles(rows).selectExpr("g", *[f"m{i}" for i in range(P)], *[f"{spread(i)} AS d{i}" for i in range(P)], *[f"sqrt({spread(i)} * {spread(i)} + {floor[i] ** 2}D) AS e{i}" for i in range(P)])
    tails = settle(tails, "quartiles")
    z = meet(rows, tails, "g", F.struct(*[f"x{i}" for i in range(P)]), MOST_ESTIMATES).selectExpr("g", *[f"x{i}" for i in range(P)], *[f"(x{i} - m{i}) / e{i} AS z{i}" for i in range(P)])
    z = z.selectExpr("*", f"sqrt(greatest({' + '.join(f'z{i} * z{i}' for i in range(P))}, 1e-12D)) AS r")
    kinds = ", ".join(f"struct({k} AS start, {', '.join(f'{v(i)} AS x{i}' for i in range(P))})" for k, v in ((1, lambda i: f"x{i}"), (2, lambda i: f"tanh(z{i})"), (3, lambda i: f"z{i} / r")))
    made = _moments(_sums(z.selectExpr("g", f"inline(array({kinds}))"), ["g", "start"]), ["g", "start"])
    lower = lambda cell: ", ".join(cell(i, j) for i, j in PAIRS)
    m, centre = ", ".join(f"m{i}" for i in range(P)), made.where("start > 1").join(tails, "g")
    scaled = lower(lambda i, j: f"c[{_at(i, j)}] / greatest(sqrt(c[{_at(i, i)}] * c[{_at(j, j)}]), 1e-9D) * d{i} * d{j}")
    plain = tails.selectExpr("g", "0 AS start", f"array({m}) AS m", f"array({lower(lambda i, j: f'd{i} * d{j}' if i == j else '0D')}) AS c")
    return plain.unionByName(made.where("start = 1")).unionByName(centre.selectExpr("g", "start", f"array({m}) AS m", f"array({scaled}) AS c"))


def mcd(rows: DataFrame, share: float = SHARE, floor: tuple = FLOOR) -> DataFrame:
    """(g, m, f): the reweighted estimate of each group of rows (g, x0, x1...).

    A start takes steps until its determinant stands still; starts at rest are not stepped again. The steps end, as each
    but the last lowers a determinant that has a lower bound."""
    rows = rows.where("g is not null").select("g", *[f"x{i}" for i in range(P)])
    keys = ["g", "start"]
    moving = settle(_factor(_starts(rows, floor), 1.0, floor).withColumn("logdet", F.lit(float("inf"))), "mcd")
    rest = moving.limit(0)
    while not moving.isEmpty():
        new = _factor(_moments(_nearest(_distance(rows, moving, "d2", "start"), share), keys), 1.0, floor)
        old = moving.select(*keys, F.struct("m", "c", "f", "logdet").alias("old"))
        step = settle(new.join(old, keys).withColumn("done", F.col("logdet") > F.col("old.logdet") - AT_REST), "mcd")
        worse = F.col("logdet") >= F.col("old.logdet")
        ended = step.where("done").select(*keys, *[F.when(worse, F.col(f"old.{c}")).otherwise(F.col(c)).alias(c) for c in ("m", "c", "f", "logdet")])
        rest, moving = rest.unionByName(ended), step.where("not done").select(*moving.columns)
    best = _factor(rest.select(*keys, "m", "c"), CONSISTENCY, floor).groupBy("g").agg(F.min_by(F.struct("m", "f"), F.struct("logdet", "start")).alias("b"))
    best = settle(best.select("g", "b.m", "b.f"), "mcd")
    near = _distance(rows, best, "d2").where(F.col("d2") <= REWEIGHT)
    return settle(_factor(_moments(_sums(near, ["g"]), ["g"]), 1.0, floor).select("g", "m", "f"), "mcd")


def quality(docs: DataFrame, cutoff: float = CUTOFF, least: int = 50) -> DataFrame:
    """measure()'s columns with distance (null: not judged) and kept."""
    measured = settle(measure(docs), "quality")
    rows = settle(vectors(measured, least), "vectors")
    judged = _distance(rows.where("g is not null"), mcd(rows), "d2").select(*measured.columns, F.sqrt("d2").alias("distance"))
    none = F.lit(None).cast("double").alias("distance")
    passed, failed = rows.where("g is null").select(*measured.columns, none), measured.where("base_failed").select("*", none)
    return judged.unionByName(passed).unionByName(failed).withColumn("kept", ~F.col("base_failed") & F.coalesce(F.col("distance") <= cutoff, F.lit(True)))


def keep_quality(docs: DataFrame, cutoff: float = CUTOFF, least: int = 50) -> DataFrame:
    """The documents that quality() keeps, with all their columns.

    Rows are matched by doc_id and a hash of all that their verdict depends on, so equal rows share theirs."""
    has = {c.lower() for c in docs.columns}
    measured = quality(docs, cutoff, least)
    bad = settle(measured.where("not kept").select("doc_id", "row_key"), "rejected")
    known = lambda c: F.coalesce(F.concat(F.lit("="), docs[c].cast("string")), F.lit("null")) if c in has else F.lit("null")
    key = F.xxhash64(docs["doc_id"].cast("long"), known("lang"), known("source"), F.coalesce(docs["text"].cast("string"), F.lit("")))
    return without(docs, bad, {"doc_id": docs["doc_id"].cast("long"), "row_key": key})
