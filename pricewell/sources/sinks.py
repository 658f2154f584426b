"""Sinks: partition replacement, pointers, exports. Data is written first, what points to it last."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pricewell.operators import rules as R
from pricewell.sources import readers, schemas
from pricewell.sources.versions import Versions


def replace_partitions(df: DataFrame, path: str, by: str = "run_key") -> None:
    """Replaces the partitions that df has, and no others."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)


def append_quotes(df: DataFrame, path: str) -> None:
    df.write.mode("append").partitionBy("run_key").parquet(path)


def import_run(spark: SparkSession, csv_path: str | list[str], table_path: str, rules: R.Rules, run_key: str, imported_at: str, multi_line: bool = False) -> DataFrame:
    """A CSV run (one folder or more) classified and put in place of the run's old rows; returns what was written. multi_line: see read_csv."""
    rows = readers.read_csv(spark, csv_path, schemas.QUOTE_CSV, multi_line).withColumns({"run_key": F.lit(run_key), "imported_at": F.lit(imported_at)})
    rows = rows.withColumn("id", F.xxhash64(*rows.columns).bitwiseAND(F.lit((1 << 60) - 1)))  # the same for a repeated task, another in other runs
    replace_partitions(R.classify(rows, rules), table_path)
    return spark.read.parquet(table_path).where(F.col("run_key") == run_key)


def set_state(spark: SparkSession, path: str, key: str, value: str, at: str) -> None:
    """Sets a key of the state: a row is appended, so a reader finds the old value or the new one, never none."""
    row = spark.range(1).select(F.lit(key).alias("state_key"), F.lit(value).alias("state_value"), F.lit(at).alias("updated_at"))
    row.coalesce(1).write.mode("append").parquet(f"{path}/{key}")


def get_state(spark: SparkSession, path: str, key: str) -> DataFrame:
    """(state_key, state_value, updated_at): the newest value of a key, in no row or one; of equal times the greater value."""
    newest = F.max(F.struct("updated_at", "state_value")).alias("s")
    kept = spark.read.parquet(f"{path}/{key}").groupBy("state_key").agg(newest)
    return kept.select("state_key", "s.state_value", "s.updated_at")


def live_state(state: DataFrame, summary: str = "run_key string, published_at string, summary map<string,string>") -> DataFrame:
    """The live market's state with its JSON value parsed; a plain value is the run's key."""
    parsed = F.from_json("state_value", summary)
    return state.select(F.coalesce(parsed["run_key"], F.col("state_value")).alias("run_key"), F.coalesce(parsed["published_at"], F.col("updated_at")).alias("published_at"), F.coalesce(parsed["summary"], F.create_map().cast("map<string,string>")).alias("summary"))


def publish(snapshots: DataFrame, path: str, state_path: str, run_key: str, published_at: str, events_path: str | None = None) -> None:
    """Replaces the run's snapshots under a new version (versions.Versions), then points to them, then logs that they were
    published; a reader meanwhile finds the run's old rows."""
    spark = snapshots.sparkSession
    table = Versions(spark, path)
    table.replace(snapshots.withColumns({"run_key": F.lit(run_key), "published_at": F.lit(published_at)}), [run_key])
    set_state(spark, state_path, "live_run", run_key, published_at)
    if events_path:
        n = table.read(only=[run_key]).agg(F.count(F.lit(1)).alias("n"))
        event = n.select(F.lit(run_key).alias("run_key"), F.lit("publish_live_market").alias("event_type"), F.lit(published_at).alias("ts"), F.to_json(F.struct("n")).alias("details_json"))
        event.coalesce(1).write.mode("append").parquet(events_path)


def write_csv(df: DataFrame, path: str, columns: list[str]) -> None:
    """CSV with a header and the columns in this order, absent ones empty; without rows a file of the header alone."""
    have = set(df.columns)
    df.select(*[(F.col(c) if c in have else F.lit(None)).cast("string").alias(c) for c in columns]).write.mode("overwrite").option("header", True).csv(path)


def export(snapshots: DataFrame, clusters: DataFrame, folder: str, snapshot_columns: list[str] | None = None, cluster_columns: list[str] | None = None) -> None:
    """Snapshot and cluster CSV with headers and fixed columns, and a one-row JSON summary."""
    write_csv(snapshots, f"{folder}/snapshots", snapshot_columns or snapshots.columns)
    write_csv(clusters, f"{folder}/clusters", cluster_columns or clusters.columns)
    counts = snapshots.agg(F.count(F.lit(1)).alias("published_snapshots")).join(clusters.agg(F.count(F.lit(1)).alias("cluster_rows")), how="cross")
    counts.coalesce(1).write.mode("overwrite").json(f"{folder}/summary")


def manifest(spark: SparkSession, folder: str) -> DataFrame:
    """Files of a release with their sizes; contents are not read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select("path", "length", "modificationTime")


def release_manifest(spark: SparkSession, folder: str, tables: dict[str, DataFrame], versions: dict[str, str]) -> DataFrame:
    """(section, name, value): rows of each table, versions, and the files of the folder with their sizes."""
    kind = "section string, name string, value string"
    out = spark.createDataFrame([("version", k, v) for k, v in sorted(versions.items())], kind)
    for name, df in sorted(tables.items()):
        out = out.unionByName(df.agg(F.count(F.lit(1)).cast("string").alias("value")).select(F.lit("count").alias("section"), F.lit(name).alias("name"), "value"))
    files = manifest(spark, folder)
    root = F.lit(folder.rstrip("/").rsplit("/", 1)[-1] + "/")
    inside = F.expr("substr(path, instr(path, r) + length(r))")
    return out.unionByName(files.withColumn("r", root).select(F.lit("file").alias("section"), inside.alias("name"), F.col("length").cast("string").alias("value")))
