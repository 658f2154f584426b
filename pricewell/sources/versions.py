"""Tables whose partitions are replaced as a whole, under a new version, at one moment.

A version is a folder of its own with the partitions it replaces; a line in the table's log, written last, makes it count.
Readers take each partition from its newest version, so they find the old rows or the new ones, never none, and a lost
attempt leaves nothing that counts. Partitions that do not change keep their files."""

from __future__ import annotations

import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pricewell.operators import rules as R
from pricewell.streaming.stores import there

LOG = "version string, at long, partitions array<string>, by string"


class Versions:
    """A table in the folder `path`, partitioned by one text column. Readers that keep a snapshot() see its rows alone."""

    def __init__(self, spark: SparkSession, path: str, by: str = "run_key") -> None:
        self.spark, self.path, self.by = spark, path.rstrip("/"), by

    def replace(self, df: DataFrame, partitions: list[str] | None = None) -> str:
        """Puts df in the place of the partitions that it has, or of those named (which may then be left empty)."""
        version = uuid.uuid4().hex
        df.write.partitionBy(self.by).parquet(f"{self.path}/version={version}")
        if partitions is None:
            made = there(lambda: self._files(version))
            partitions = [r[0] for r in made.select(self.by).distinct().collect()] if made is not None else []  # those of one attempt
        line = [(version, time.time_ns(), sorted(partitions), self.by)]
        self.spark.createDataFrame(line, LOG).coalesce(1).write.mode("append").parquet(f"{self.path}/_versions")
        return version

    def _files(self, version: str) -> DataFrame:
        rows = self.spark.read.parquet(f"{self.path}/version={version}")
        return rows.withColumn(self.by, F.col(self.by).cast("string"))

    def snapshot(self, at: int | None = None) -> dict[str, str]:
        """The version of every partition, now or at a time of the log: one entry for each partition."""
        log = there(lambda: self.spark.read.schema(LOG).parquet(f"{self.path}/_versions"))
        if log is None:
            return {}
        log = log if at is None else log.where(F.col("at") <= at)
        newest = log.select("version", "at", F.explode("partitions").alias("p")).groupBy("p").agg(F.max_by("version", "at").alias("version"))
        return {r["p"]: r["version"] for r in newest.collect()}

    def read(self, snapshot: dict[str, str] | None = None, only: list[str] | None = None) -> DataFrame:
        """The rows of a snapshot (the newest one if not given), of all partitions or only some."""
        wanted: dict[str, list[str]] = {}
        for p, version in (self.snapshot() if snapshot is None else snapshot).items():
            if only is None or p in only:
                wanted.setdefault(version, []).append(p)
        out = None
        for version, partitions in sorted(wanted.items()):
            made = there(lambda version=version: self._files(version))
            if made is not None:
                rows = made.where(F.col(self.by).isin(partitions))
                out = rows if out is None else out.unionByName(rows, allowMissingColumns=True)
        if out is None:
            raise ValueError(f"{self.path} has no such partitions")
        return out

    def paths(self, snapshot: dict[str, str] | None = None) -> DataFrame:
        """(partition, file): the files that the rows lie in."""
        return self.read(snapshot).select(F.col(self.by).alias("partition"), F.input_file_name().alias("file")).distinct()


def write_back(table: Versions, rules: R.Rules, columns: list[str], at: str, events_path: str) -> DataFrame:
    """Classifies the stored rows again and rewrites the partitions in which a class changes, and no others; logs an event
    (run_key, event_type, ts, details_json) for each. Returns (run_key, scanned, updated)."""
    from pricewell.operators import state
    from pricewell.settled import settle

    before = table.snapshot()
    stored = table.read(before)
    counts = settle(state.reclassified(stored, rules, columns), "reclassified")
    changed = [r[0] for r in counts.where("updated > 0").select(table.by).collect()]  # partitions, not rows
    if changed:
        old = table.read(before, changed)
        table.replace(R.classify(old, rules).select(*old.columns), changed)
        details = F.to_json(F.struct("scanned", "updated")).alias("details_json")
        events = counts.where("updated > 0").select(table.by, F.lit("reclassified").alias("event_type"), F.lit(at).alias("ts"), details)
        events.coalesce(1).write.mode("append").parquet(events_path)
    return counts


def replace_task_rows(table: Versions, incoming: DataFrame, keys: list[str]) -> None:
    """Puts the incoming rows in the place of the stored ones of their tasks, in the partitions that they touch alone."""
    from pricewell.operators import state

    touched = [r[0] for r in incoming.select(table.by).distinct().collect()]
    before = table.snapshot()
    there_now = [p for p in touched if p in before]
    rows = state.replace_for_tasks(table.read(before, there_now), incoming, [table.by, *keys]) if there_now else incoming
    table.replace(rows, touched)


class Clustered:
    """A table laid out for lookups by key: ranges of the keys in files of their own, sorted, with Bloom filters, and a
    manifest of every file's first and last key. A lookup reads the files whose range holds the key, and no others."""

    def __init__(self, spark: SparkSession, path: str, keys: list[str]) -> None:
        self.spark, self.path, self.keys = spark, path.rstrip("/"), keys

    def write(self, df: DataFrame, files: int, most_rows: int = 500_000) -> None:
        """Keys are texts (null is empty). There are `files` files, or more where a file would have over `most_rows` rows, so
        a task's rows are bounded. A key with many rows may fill several files; a lookup then reads them all."""
        from pricewell.settled import settle

        rows = settle(df.withColumns({k: F.coalesce(F.col(k).cast("string"), F.lit("")) for k in self.keys}), "unclustered")
        files = max(files, -(-rows.count() // most_rows))
        spread = rows.withColumn("_spread", F.rand(42)).repartitionByRange(files, *self.keys, "_spread").sortWithinPartitions(*self.keys).drop("_spread")
        spread.write.options(**{f"parquet.bloom.filter.enabled#{k}": "true" for k in self.keys}).parquet(f"{self.path}/data")
        key = F.struct(*self.keys)
        made = self.spark.read.parquet(f"{self.path}/data").groupBy(F.input_file_name().alias("file")).agg(F.min(key).alias("first"), F.max(key).alias("last"), F.count(F.lit(1)).alias("n"))
        made.coalesce(1).write.parquet(f"{self.path}/manifest")

    def manifest(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/manifest")

    def lookup(self, **values: str) -> DataFrame:
        """The rows with these values of the first keys (any number of them, from the first on)."""
        names = self.keys[: len(values)]
        if sorted(names) != sorted(values):
            raise ValueError(f"values are needed for {self.keys} from the first on")
        own = F.struct(*[F.lit(values[k]).alias(k) for k in names])
        part = lambda side: F.struct(*[F.col(side)[k].alias(k) for k in names])
        files = [r["file"] for r in self.manifest().where((part("first") <= own) & (part("last") >= own)).select("file").collect()]  # those of one key
        table = self.spark.read.parquet(f"{self.path}/data")
        rows = self.spark.read.schema(table.schema).parquet(*files) if files else table.limit(0)
        for k in names:
            rows = rows.where(F.col(k) == values[k])
        return rows
