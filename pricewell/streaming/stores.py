"""Tables that streams write batch by batch: last rows by key (merge on read), and ids that were seen.

Both deal rows to buckets by a hash of the key. A batch writes its own rows alone, under a name of its own, and then a line
in a log; readers follow the log, so a lost attempt leaves nothing behind and a batch that is run again counts once."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

LINE = "epoch long, kind string, version string, at long, buckets array<int>, keys array<string>, order array<string>, n_buckets int"


def there(read: Callable[[], DataFrame]) -> DataFrame | None:
    """The table, or None where nothing was written yet."""
    try:
        return read()
    except AnalysisException as e:
        if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
    return None


def bucket_of(keys: list[str], n: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(n)).cast("int")


class LastRows:
    """The last row of each key. A batch appends one row per key of its own (a delta); a reader merges the deltas of a
    bucket with the bucket's base; after `compact_after` deltas the touched buckets get new bases. So what a batch writes
    follows the batch, and what a compaction writes follows the buckets that changed.

    A later epoch's row wins; within an epoch the greatest by `order` does. Rows keep their epoch in _epoch."""

    def __init__(self, spark: SparkSession, path: str, keys: list[str], order: list[str], buckets: int = 32, compact_after: int = 8) -> None:
        self.spark, self.path, self.keys, self.order, self.buckets, self.compact_after = spark, path.rstrip("/"), keys, order, buckets, compact_after

    @classmethod
    def of(cls, spark: SparkSession, path: str) -> LastRows:
        """A table that is there, as its log describes it."""
        line = spark.read.schema(LINE).parquet(f"{path}/log").orderBy(F.desc("epoch"), F.desc("at")).first()
        return cls(spark, path, list(line["keys"]), list(line["order"]), line["n_buckets"])

    def write(self, batch: DataFrame, epoch: int) -> None:
        """For foreachBatch."""
        self._add(self._merged(batch.withColumns({"_epoch": F.lit(epoch).cast("long"), "bucket": bucket_of(self.keys, self.buckets)})), "delta", epoch)
        deltas = {x["epoch"] for x in self._lines() if x["kind"] == "delta"}
        if len(deltas) >= self.compact_after:
            self.compact(epoch)

    def compact(self, epoch: int) -> None:
        """New bases, up to this epoch, of the buckets that have deltas."""
        touched = sorted({b for x in self._lines() if x["kind"] == "delta" for b in x["buckets"]})
        rows = self._stored(touched)
        if rows is not None:
            self._add(self._merged(rows), "base", epoch, touched)

    def read(self, before: int | None = None) -> DataFrame:
        """The table, or what epochs before one left (as long as no base reaches beyond it)."""
        rows = self._stored(None, before)
        if rows is None:
            raise ValueError(f"nothing was written to {self.path}")
        return self._merged(rows).drop("_epoch", "bucket")

    def _merged(self, rows: DataFrame) -> DataFrame:
        names = [c for c in rows.columns if c not in self.keys]
        last = F.max_by(F.struct(*names), F.struct("_epoch", *self.order)).alias("_last")
        return rows.groupBy(*self.keys).agg(last).select(*[F.col(c) if c in self.keys else F.col("_last")[c].alias(c) for c in rows.columns])

    def _add(self, rows: DataFrame, kind: str, epoch: int, buckets: list[int] | None = None) -> None:
        version = f"{kind}-{epoch}-{uuid.uuid4().hex}"
        rows.write.partitionBy("bucket").parquet(f"{self.path}/{version}")
        if buckets is None:
            made = there(lambda: self.spark.read.parquet(f"{self.path}/{version}"))
            buckets = sorted(r["bucket"] for r in made.select("bucket").distinct().collect()) if made is not None else []  # at most all buckets
        line = [(epoch, kind, version, time.time_ns(), buckets, self.keys, self.order, self.buckets)]
        self.spark.createDataFrame(line, LINE).coalesce(1).write.mode("append").parquet(f"{self.path}/log")

    def _lines(self, before: int | None = None) -> list:
        """What a reader needs of the log: each bucket's newest base, and the last attempt of every epoch after it."""
        log = there(lambda: self.spark.read.schema(LINE).parquet(f"{self.path}/log"))
        if log is None:
            return []
        log = log if before is None else log.where(F.col("epoch") < before)
        buckets = log.withColumn("bucket", F.explode("buckets"))
        based = buckets.where("kind = 'base'").groupBy("bucket").agg(F.max("epoch").alias("from"))
        live = buckets.join(based, "bucket", "left").where("from is null or epoch > from or (kind = 'base' and epoch = from)")
        live = live.groupBy("epoch", "kind", "version", "at").agg(F.collect_set("bucket").alias("buckets"))
        last: dict[tuple, object] = {}
        for x in sorted(live.collect(), key=lambda x: x["at"]):  # some lines for each bucket
            last[x["kind"], x["epoch"]] = x
        return list(last.values())

    def _stored(self, only: list[int] | None, before: int | None = None) -> DataFrame | None:
        out = None
        for x in self._lines(before):
            wanted = [b for b in x["buckets"] if only is None or b in only]
            if wanted:
                rows = self.spark.read.parquet(f"{self.path}/{x['version']}").where(F.col("bucket").isin(wanted))
                out = rows if out is None else out.unionByName(rows, allowMissingColumns=True)
        return out


class SeenIds:
    """Rows by the first sight of their id. A batch reads only the buckets its ids fall in, of other batches' files; few
    ids are looked up by value, so that files whose Bloom filters rule them out are not read."""

    def __init__(self, spark: SparkSession, path: str, key: str, buckets: int = 64, few: int = 50) -> None:
        self.spark, self.path, self.key, self.buckets, self.few = spark, path.rstrip("/"), key, buckets, few

    def write(self, batch: DataFrame, epoch: int) -> None:
        """For foreachBatch: appends rows whose id no other batch has. A batch that is run again writes its folder again."""
        new = batch.dropDuplicates([self.key]).withColumn("bucket", bucket_of([self.key], self.buckets))
        done = there(lambda: self.spark.read.parquet(self.path))
        if done is not None:
            done = self.candidates(done.where(F.col("epoch") != epoch), new)
            new = new.join(done.select("bucket", self.key), ["bucket", self.key], "left_anti")
        new = new.repartition(min(self.buckets, 8), "bucket").sortWithinPartitions("bucket", self.key)
        new.write.mode("overwrite").option(f"parquet.bloom.filter.enabled#{self.key}", "true").partitionBy("bucket").parquet(f"{self.path}/epoch={epoch}")

    def candidates(self, done: DataFrame, new: DataFrame) -> DataFrame:
        """The stored rows that can have an id of the batch."""
        ids = [r[0] for r in new.select(self.key).limit(self.few + 1).collect()]
        if len(ids) <= self.few:
            one = F.lit(False)
            for i in ids:
                one = one | (F.col(self.key) == i)
            done = done.where(one)
        buckets = [r[0] for r in new.select("bucket").distinct().collect()]  # at most all buckets
        return done.where(F.col("bucket").isin(buckets))
