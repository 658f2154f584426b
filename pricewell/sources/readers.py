"""Readers of external files: CSV runs, JSON lines, blacklists, price sheets, mixed encodings."""

from __future__ import annotations

import re

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pricewell.functions import columns as P
from pricewell.operators import state
from pricewell.operators.textscan import decode_content
from pricewell.sources import schemas


def read_csv(spark: SparkSession, path: str | list[str], schema: T.StructType, multi_line: bool = False) -> DataFrame:
    """Header-driven CSV, all strings, byte-order mark allowed; columns of the schema that a file lacks are null.

    Files are split among tasks; with multi_line cells may hold line ends, and a file is one task."""
    found = spark.read.option("header", True).option("encoding", "UTF-8").option("multiLine", multi_line).csv(path)
    names = {c.lstrip("﻿").strip(): c for c in found.columns}
    return found.select(*[(F.col(f"`{names[f.name]}`") if f.name in names else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema.fields])


def read_json_lines(spark: SparkSession, path: str, schema: T.StructType, strict: bool = False) -> DataFrame:
    """JSON lines; blank lines are skipped, malformed ones dropped, or with strict fail the job."""
    return spark.read.schema(schema).option("mode", "FAILFAST" if strict else "DROPMALFORMED").json(path)


def read_objects(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """JSON objects, in an array over many lines or one on each line; the text's first character tells."""
    first = spark.read.text(path).select(F.ltrim("value").alias("v")).where("v <> ''").limit(1).collect()  # one line
    lines = bool(first) and first[0]["v"].startswith("{") and first[0]["v"].rstrip().endswith("}")
    return spark.read.schema(schema).option("multiLine", not lines).json(path)


def read_blacklist(spark: SparkSession, path: str) -> DataFrame:
    """Enabled model ids of a JSON, CSV (with or without header) or text blacklist."""
    if path.endswith(".json"):
        rows = read_objects(spark, path, schemas.BLACKLIST)
    else:
        lines = spark.read.text(path).where((F.trim("value") != "") & ~F.startswith(F.trim("value"), F.lit("#")))
        cells = F.split("value", ",")
        named = F.exists(cells, lambda c: F.regexp_replace(F.trim(c), "^\ufeff", "") == "model_id")  # a header has this name in one cell
        header = lines.where(named).select(F.transform(cells, lambda c: F.regexp_replace(F.trim(c), "^\ufeff", "")).alias("names")).distinct().orderBy("names").limit(1)
        place = {n: i for r in header.collect() for i, n in enumerate(r["names"])}  # one line at most
        pick = lambda n, other: F.trim(F.get(cells, F.lit(place[n]))) if n in place else other
        rows = lines.where(~named).select(pick("model_id", F.trim(F.get(cells, F.lit(0)))).alias("model_id"), pick("enabled", F.lit("1")).alias("enabled"))
    return rows.where(state.parse_enabled(F.col("enabled")) & (P.plain("model_id") != "")).select("model_id").distinct()


def latest_healthy_prices(spark: SparkSession, root: str, least_rows: int = 1000) -> DataFrame:
    """Prices of the newest import folder whose summary counts enough rows; of equal keys the last line wins."""
    summaries = spark.read.schema("supplier_rows long, finished_at string").option("multiLine", True).json(f"{root}/*/summary.json").withColumn("path", F.col("_metadata.file_path"))
    best = summaries.where(F.col("supplier_rows") >= least_rows).orderBy(F.desc("finished_at"), F.desc("path")).limit(1).collect()  # one row
    names = "brand_title series_title sku_title reference_price"
    if not best:
        return spark.createDataFrame([], "brand_title string, series_title string, sku_title string, reference_price bigint")
    rows = read_csv(spark, re.sub(r"/summary\.json(/.*)?$", "", best[0]["path"]) + "/prices.csv", T.StructType([T.StructField(n, T.StringType()) for n in names.split()]))
    rows = rows.withColumn("_n", F.monotonically_increasing_id()).withColumn("reference_price", P.parse_price("reference_price"))
    return rows.groupBy("brand_title", "series_title", "sku_title").agg(F.max_by("reference_price", "_n").alias("reference_price"))


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """(path, text) of files in UTF-8, UTF-8 with mark, or GB18030."""
    return decode_content(spark.read.format("binaryFile").load(path)).select("path", "text")


def read_catalog(spark: SparkSession, paths: list[str]) -> DataFrame:
    """The first readable catalog of a list."""
    schema = "brand_id string, brand_title string, series_id string, series_title string, model_id string, model_title string"
    for path in paths:
        try:
            return read_objects(spark, path, schema)
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
    raise FileNotFoundError(f"none of {paths}")


def task_payloads(tasks: DataFrame) -> DataFrame:
    """Task rows with their payload's fields over the columns; status is always the column's."""
    fields = ("brand_title", "series_title", "model_title", "code", "msg")
    parsed = F.from_json("payload_json", ", ".join(f"{f} string" for f in fields))
    return tasks.withColumn("_p", parsed).withColumns({f: F.coalesce(F.nullif(F.col(f"_p.{f}"), F.lit("")), F.col(f)) for f in fields}).drop("_p")


def normalise_events(events: DataFrame, body: str = "body") -> DataFrame:
    """Inbound events with key synonyms: message id, sender, text, time."""
    e = F.from_json(body, "msgid string, id string, sender string, from string, text string, content string, ts string, time string")
    pick = lambda *names: F.coalesce(*[P.filled(e[n]) for n in names])
    return events.select(pick("msgid", "id").alias("message_id"), pick("sender", "from").alias("user_id"), pick("text", "content").alias("text"), F.try_to_timestamp(pick("ts", "time")).alias("ts"))
