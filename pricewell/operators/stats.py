"""Robust statistics of whole prices: percentiles, deviation, trimmed and winsorised means, rounded half to even.

`over` gives a value beside every row of a window; `price_stats` gives the bundle per group. percentile() keeps a value
map per group, fit for product groups; `approximate=True` trades exactness for bounded state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F


def half_even(x: Column) -> Column:
    return F.bround(x).cast("bigint")


def percentile(x: Column | str, ratio: float, over: WindowSpec | None = None) -> Column:
    """Linearly interpolated percentile, rounded; nulls do not count, nothing gives 0."""
    value = F.percentile(x, F.lit(ratio))
    return F.coalesce(half_even(value.over(over) if over is not None else value), F.lit(0))


def with_deviation(df: DataFrame, price: str, by: list[str]) -> DataFrame:
    """Adds _median and _mad per group: the deviation is from the rounded median, and rounded itself."""
    w = Window.partitionBy(*by)
    df = df.withColumn("_median", percentile(price, 0.5, w))
    return df.withColumn("_mad", percentile(F.abs(F.col(price) - F.col("_median")), 0.5, w))


def _at(ratio: float) -> list[Column]:
    """The two values between which a percentile lies, from the running counts `_upto` of values in order."""
    place = (F.col("_n") - 1) * F.lit(float(ratio))
    return [F.min(F.when(F.col("_upto") > place_of(place), F.col("_v"))) for place_of in (F.floor, F.ceil)]


def _between(low: Column, high: Column, n: Column, ratio: float) -> Column:
    place = (n - 1) * F.lit(float(ratio))
    between = (F.ceil(place) - place) * low + (place - F.floor(place)) * high
    return half_even(F.when(low == high, low.cast("double")).otherwise(between))


def _running(counts: DataFrame, by: list[str]) -> DataFrame:
    """Counts (by, _v, _c) with `_upto`, the rows up to a value, and `_n`, all rows of the group."""
    w = Window.partitionBy(*by)
    return counts.withColumns({"_upto": F.sum("_c").over(w.orderBy("_v")), "_n": F.sum("_c").over(w)})


def of_sorted(values: Column, ratio: float) -> Column:
    """percentile() of a sorted array without nulls; an empty one gives 0."""
    n = F.size(values)
    place = (n - 1) * F.lit(float(ratio))
    at = lambda k: F.get(values, k(place).cast("int"))
    return F.coalesce(_between(at(F.floor), at(F.ceil), n, ratio), F.lit(0))


def price_stats(df: DataFrame, by: list[str], price: str = "price_value", trim: float = 0.1, approximate: bool = False) -> DataFrame:
    """Per group: n, median, q1, q3, min, max, iqr, mad, trimmed and winsorised mean.

    Rows are counted by value before anything else, so a group of any share of the rows is as large as its distinct prices;
    places of rows are then places in the running counts. approximate=True gives the quartiles by sketches instead, for
    groups without a bound on their distinct prices."""
    counts = df.where(F.col(price).isNotNull()).groupBy(*by, F.col(price).alias("_v")).agg(F.count(F.lit(1)).alias("_c"))
    ranked = _running(counts, by)
    cut = F.when(F.col("_n") < 4, 0).otherwise(F.least(F.floor(F.col("_n") * trim), F.floor((F.col("_n") - 2) / 2)))
    ranked = ranked.withColumn("_k", cut)
    first = {f"_{name}{side}": x for name, ratio in (("m", 0.5), ("a", 0.25), ("z", 0.75)) for side, x in zip((0, 1), _at(ratio), strict=True)}
    ends = {"_low": F.min(F.when(F.col("_upto") > F.col("_k"), F.col("_v"))), "_high": F.min(F.when(F.col("_upto") >= F.col("_n") - F.col("_k"), F.col("_v")))}
    inside = F.greatest(F.least("_upto", F.col("_n") - F.col("_k")) - F.greatest(F.col("_upto") - F.col("_c"), F.col("_k")), F.lit(0))
    per = ranked.groupBy(*by).agg(F.max("_n").alias("n"), F.min("_v").alias("price_min"), F.max("_v").alias("price_max"), (F.sum(F.col("_v") * inside) / F.sum(inside)).alias("_trimmed"), *[x.alias(c) for c, x in (first | ends).items()])
    quartile = lambda name, ratio: _between(F.col(f"_{name}0"), F.col(f"_{name}1"), F.col("n"), ratio)
    per = per.select(*by, "n", "price_min", "price_max", "_low", "_high", half_even(F.col("_trimmed")).alias("trimmed_mean"), quartile("m", 0.5).alias("median_price"), quartile("a", 0.25).alias("q1"), quartile("z", 0.75).alias("q3"))
    beside = counts.join(per.select(*[F.col(c).alias(f"_by_{c}") for c in by], "median_price", "_low", "_high"), [F.col(c).eqNullSafe(F.col(f"_by_{c}")) for c in by]).drop(*[f"_by_{c}" for c in by])
    winsorized = beside.groupBy(*by).agg(half_even(F.sum(F.least(F.greatest("_v", "_low"), F.col("_high")) * F.col("_c")) / F.sum("_c")).alias("winsorized_mean"))
    off = beside.groupBy(*by, F.abs(F.col("_v") - F.col("median_price")).alias("_v")).agg(F.sum("_c").alias("_c"))
    low, high = _at(0.5)
    mad = _running(off, by).groupBy(*by).agg(low.alias("_m0"), high.alias("_m1"), F.max("_n").alias("_n")).select(*by, _between(F.col("_m0"), F.col("_m1"), F.col("_n"), 0.5).alias("price_mad"))
    out = per.drop("_low", "_high")
    for more in (winsorized, mad):
        keyed = more.select(*[F.col(c).alias(f"_by_{c}") for c in by], more.columns[-1])
        out = out.join(keyed, [F.col(c).eqNullSafe(F.col(f"_by_{c}")) for c in by]).drop(*[f"_by_{c}" for c in by])
    if approximate:
        sketch = df.where(F.col(price).isNotNull()).groupBy(*[F.col(c).alias(f"_by_{c}") for c in by]).agg(*[half_even(F.percentile_approx(price, r, 10_000)).alias(f"_{c}") for c, r in (("median_price", 0.5), ("q1", 0.25), ("q3", 0.75))])
        out = out.join(sketch, [F.col(c).eqNullSafe(F.col(f"_by_{c}")) for c in by]).withColumns({c: F.col(f"_{c}") for c in ("median_price", "q1", "q3")})
    columns = ["n", "median_price", "q1", "q3", "price_min", "price_max", "price_mad", "trimmed_mean", "winsorized_mean"]
    return out.select(*by, *columns, F.greatest(F.col("q3") - F.col("q1"), F.lit(0)).alias("price_iqr"))
