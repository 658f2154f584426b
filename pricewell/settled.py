"""The shared folder, and tables settled in it."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Used only where the session names no shared folder and runs in one process, as in tests.
_LOCAL: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see, as the session names it in spark.checkpoint.dir."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return _LOCAL.setdefault("dir", "file://" + tempfile.mkdtemp(prefix="pricewell-"))


def new_dir(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/pricewell-{name}-{uuid.uuid4().hex}"


def settle(df: DataFrame, name: str) -> DataFrame:
    """Writes df as a table in the shared folder and returns the table read back: the lineage ends there, a lost
    executor costs nothing that was settled, and the reader knows the table's true size."""
    spark, path = df.sparkSession, new_dir(df.sparkSession, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
