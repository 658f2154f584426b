"""URL filters: host and path rules, and gradient-boosted trees on lexical features for the urls that no rule covers.

The trees are fitted on labelled urls: the caller's, or by default those of url_labels.py, which two grammars make and
which owe nothing to the rules. The sample is bounded (`most_labelled` urls, by hash order) and fitted on the driver. The
fitted trees are compiled into SQL expressions, so all urls are judged in the JVM; the statistics of suffixes and host
words, bounded by the sample, are maps in them.

Defined results: a null url, or one without ://, has an empty host and path, fits no rule and is judged by the trees; a
url is read whole, however long; labels of one class only, or none, give that class (allow where there is none); equal
rows are rows of their own; an empty table gives no rows; other columns are not read."""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import gbt, url_labels
from .url_labels import labelled_urls

#: (verdict, host, path)
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
MOST_LABELLED, FOLDS = 8_000, 5
LEXICAL = ("url_chars", "host_chars", "path_chars", "depth", "host_labels", "digit_ratio", "host_digits", "entropy", "n_params", "n_dashes", "host_dashes", "longest_part", "tld_chars")


def parts(url: Column) -> tuple[Column, Column]:
    """(host, path) of a url: empty where there is no ://."""
    whole = F.coalesce(url, F.lit(""))
    rest = F.when(F.instr(whole, "://") > 0, F.expr("substring(coalesce(url, ''), instr(coalesce(url, ''), '://') + 3)")).otherwise("")
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def rule_of(rules: tuple) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits the columns host and path."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, host, path in sorted(rules, key=lambda r: len(r[1]) + len(r[2])):
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(path)
        rule, verdict = F.when(fits, host + path).otherwise(rule), F.when(fits, kind).otherwise(verdict)
    return rule, verdict


def lexical(df: DataFrame) -> DataFrame:
    """Adds the features of LEXICAL, and suffix and path_suffix for the suffix statistics."""
    url = F.coalesce("url", F.lit(""))
    n = F.length(url)
    chars = F.array_distinct(F.split(url, ""))
    share = lambda c: (n - F.length(F.replace(url, c, F.lit("")))) / n
    entropy = F.aggregate(F.filter(chars, lambda c: c != ""), F.lit(0.0), lambda a, c: a - share(c) * F.log2(share(c)))
    query = F.regexp_extract(url, r"\?([^#]*)", 1)
    return df.withColumns({
        "url_chars": n.cast("double"), "host_chars": F.length("host").cast("double"), "path_chars": F.length("path").cast("double"),
        "depth": F.regexp_count("path", F.lit("/[^/]")).cast("double"), "host_labels": F.size(F.split("host", r"\.")).cast("double"),
        "digit_ratio": F.when(n > 0, F.regexp_count(url, F.lit("[0-9]")) / n).otherwise(0.0), "entropy": entropy,
        "n_params": F.when(query == "", 0.0).otherwise(F.size(F.split(query, "&")).cast("double")), "n_dashes": F.regexp_count(url, F.lit("[-_]")).cast("double"),
        "longest_part": F.coalesce(F.array_max(F.transform(F.split(url, "[^A-Za-z0-9]+"), F.length)), F.lit(0)).cast("double"),
        "tld_chars": F.length(F.regexp_extract("host", r"[^.]*$", 0)).cast("double"),
        "host_digits": F.regexp_count("host", F.lit("[0-9]")).cast("double"), "host_dashes": F.regexp_count("host", F.lit("-")).cast("double"),
        "suffix": F.regexp_extract("host", r"[^.]*$", 0), "path_suffix": F.regexp_extract("path", r"\.([A-Za-z0-9]{1,6})$", 1),
        "host_words": F.array_distinct(F.filter(F.split(F.regexp_replace("host", r"\.?[^.]*$", ""), "[^a-z]+"), lambda w: w != "")),
    })


#: Suffixes whose share of blocked urls is a feature; the highest share of a host's words is another.
SUFFIXES = ("suffix", "path_suffix")


@dataclass(frozen=True)
class Filter:
    """The trees; the smoothed share of blocked urls by suffix and by host word, and in all."""

    trees: gbt.Trees
    rates: dict[str, dict[str, float]]
    mean: float


def train(labelled: DataFrame, most_labelled: int = MOST_LABELLED) -> Filter:
    """labelled: url, host, path, blocked (0 or 1). A url's shares come from the other FOLDS, so that no label is in its
    own features, and every second url goes without the share of its words, as urls of words that no label has will."""
    rows = lexical(labelled).select(*LEXICAL, *SUFFIXES, "host_words", "blocked").orderBy(F.xxhash64("url"), "url").limit(most_labelled).toPandas()
    y = rows["blocked"].to_numpy(float)
    mean = (y.sum() + 0.5) / (len(y) + 1)
    fold = np.arange(len(y)) % FOLDS
    rates, columns = {}, [rows[[*LEXICAL]].to_numpy(float)]
    for s in (*SUFFIXES, "host_words"):
        lists = [list(x) for x in rows[s]] if s == "host_words" else [[x] for x in rows[s]]
        own = np.full(len(y), mean)
        for k in (*range(FOLDS), None):  # at last the shares of all
            learn = [(ws, b) for ws, b, f in zip(lists, y, fold, strict=True) if f != k]
            seen, bad = Counter(w for ws, _ in learn for w in ws), Counter(w for ws, b in learn for w in ws if b > 0)
            rates[s] = {w: float((bad[w] + 2 * mean) / (n + 2)) for w, n in seen.items()}
            for i in np.flatnonzero(fold == k) if k is not None else ():
                own[i] = max((rates[s].get(w, mean) for w in lists[i]), default=mean)
        if s == "host_words":
            own[1::2] = mean
        columns.append(own.reshape(-1, 1))
    return Filter(gbt.fit(np.concatenate(columns, 1), y, trees=40, depth=4), rates, float(mean))


def odds(model: Filter, df: DataFrame) -> DataFrame:
    """Adds blocked_odds, the log-odds of being blocked, to urls with host and path."""
    spark = df.sparkSession
    names = [f"rates_of_{s}" for s in (*SUFFIXES, "host_words")]
    kind = ", ".join(f"{n} map<string,double>" for n in names)
    rates = spark.createDataFrame([tuple(model.rates[s] for s in (*SUFFIXES, "host_words"))], kind)  # one row, as large as the sample's words
    scored = lexical(df).join(F.broadcast(rates), how="cross")
    mean = F.lit(model.mean)
    share = {f"rate_{s}": F.coalesce(F.col(f"rates_of_{s}")[F.col(s)], mean) for s in SUFFIXES}
    share["rate_host_words"] = F.coalesce(F.array_max(F.transform("host_words", lambda w: F.coalesce(F.col("rates_of_host_words")[w], mean))), mean)
    scored = scored.withColumns(share)
    return scored.select(*df.columns, gbt.score_column(model.trees, [F.col(x) for x in (*LEXICAL, *share)]).alias("blocked_odds"))


def judge_urls(pages: DataFrame, rules: tuple = RULES, labelled: DataFrame | None = None, most_labelled: int = MOST_LABELLED) -> DataFrame:
    """(page_id, url, host, path, rule, verdict, blocked_odds): the rule's verdict, else the trees'. labelled: url, blocked."""
    host, path = parts(F.col("url"))
    rule, verdict = rule_of(rules)
    urls = pages.select("page_id", F.col("url").cast("string").alias("url")).withColumns({"host": host, "path": path}).withColumns({"rule": rule, "ruled": verdict})
    if labelled is None:
        labelled = pages.sparkSession.createDataFrame(labelled_urls(most_labelled), "url string, blocked int")
    model = train(labelled.select("url", "blocked").withColumns({"host": host, "path": path}), most_labelled)
    out = odds(model, urls)
    return out.withColumn("verdict", F.coalesce("ruled", F.when(F.col("blocked_odds") > 0, "block").otherwise("allow"))).drop("ruled")
