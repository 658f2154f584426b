"""Helpers that the operators of this subpackage share: the shared folder, settled tables, Arrow row access."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pricewell.settled import new_dir, settle, shared_dir  # noqa: F401

#: A side of a join with at most so many rows (of a few numbers each) is broadcast; beyond it, Spark shuffles both sides.
MOST_BROADCAST = 500_000
#: Beyond that bound, a key with more than so many rows is joined apart from the others.
HOT = 1_000_000


def bounded(df: DataFrame, most: int | None = None) -> DataFrame:
    """df, to be broadcast where a count shows that it has few enough rows."""
    most = MOST_BROADCAST if most is None else most
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def fresh(df: DataFrame, *names: str) -> list[str]:
    """For each of names a column name that df does not have (names are compared without case)."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def whole_row(df: DataFrame) -> Column:
    """All columns of a row as one text, which orders rows of any type, maps too."""
    return F.to_json(F.struct(*[F.col(_quoted(c)).alias(f"c{k}") for k, c in enumerate(df.columns)]), {"ignoreNullFields": "false"})


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def meet(rows: DataFrame, small: DataFrame, key: str, salt: Column, most: int | None = None, salts: int = 64) -> DataFrame:
    """The inner join of rows to small (a settled table with few rows per key) on the column key.

    small is broadcast where a count shows at most `most` rows. Beyond it rows are dealt by the key and one of `salts`
    numbers taken from salt, and small is copied for each, so that a key with a third of all rows is many tasks."""
    most = MOST_BROADCAST if most is None else most
    if small.limit(most + 1).count() <= most:
        return rows.join(F.broadcast(small), key)
    (name,) = fresh(rows, "salt")
    dealt = rows.withColumn(name, F.pmod(F.xxhash64(salt), F.lit(salts)).cast("int"))
    copied = small.withColumn(name, F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return dealt.join(copied, [key, name]).drop(name)


def meet_counted(rows: DataFrame, keyed: DataFrame, key: list[str], most: int | None = None, hot: int | None = None) -> DataFrame:
    """The left join of rows to keyed (settled, one row per key, with the column n: rows that have the key) without n.

    keyed is broadcast where a count shows at most `most` rows. Beyond it only the keys of more than `hot` rows are, of
    which there are at most rows / hot; the others are joined by shuffle, where no key has more than `hot` rows."""
    most, hot = MOST_BROADCAST if most is None else most, HOT if hot is None else hot
    if keyed.limit(most + 1).count() <= most:
        return rows.join(F.broadcast(keyed.drop("n")), key, "left")
    many, few = F.broadcast(keyed.where(F.col("n") > hot).drop("n")), keyed.where(F.col("n") <= hot).drop("n")
    return rows.join(many, key).unionByName(rows.join(many, key, "left_anti").join(few, key, "left"))


def without(docs: DataFrame, bad: DataFrame, keys: dict[str, Column], most: int | None = None) -> DataFrame:
    """The rows of docs, with their own columns only, whose keys (name in bad: expression over docs, null-safe) are not in bad.

    Beyond `most` rows bad is joined by shuffle; its rows are distinct keys, and a hot key of docs is dealt by AQE."""
    most = MOST_BROADCAST if most is None else most
    own = fresh(docs, *(f"bad_{k}" for k in keys))
    bad = bad.select(*[F.col(k).alias(n) for k, n in zip(keys, own, strict=True)]).distinct()
    on = F.lit(True)
    for n, x in zip(own, keys.values(), strict=True):
        on = on & x.eqNullSafe(F.col(n))
    return docs.join(bounded(bad, most), on, "left_anti")


def slices(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """The same rows in small slices, so that few texts are Python strings at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def bytes_of(column: pa.Array) -> list[bytes]:
    """UTF-8 of a string column; null is empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def ascii_lower(text):
    """A-Z lower-cased, every other character as it is (lower() is quick, and right for pure ASCII)."""
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(
        F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
