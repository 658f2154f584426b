"""Places of rows in the order of their group, found without a window: ranges of the whole order, counted, then shifted."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .common import MOST_BROADCAST, settle


def ranked(rows: DataFrame, group: str | None, order: list[str], name: str, place: str = "place", keep: list[str] | None = None) -> DataFrame:
    """rows (settled) with `place`: 0, 1, ... in the order of the columns `order` (nulls first) within equal values of the
    number column `group`, or over all rows. A group may hold any share of the rows: the whole order is cut in ranges, each
    range numbers its own rows as they stream by, and a range's numbers then go up by what earlier ranges have of the group.

    Of the columns only those in `keep` (all, if not given; with the group) are returned. Rows that are equal in all of `order` are told apart by a random number, so that they too fall in many ranges."""
    keys = [group] if group else []
    spread = rows.withColumn("_spread", F.rand(42))
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    by = [F.col(c).asc_nulls_first() for c in [*keys, *order, "_spread"]]
    dealt = spread.repartitionByRange(parts, *by).sortWithinPartitions(*by).select(*(keep or rows.columns), F.spark_partition_id().cast("long").alias("_range"))

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, n = None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            own = batch[group].to_numpy(zero_copy_only=False) if group else np.zeros(batch.num_rows, np.int64)
            fresh = np.append(own[0] != last or last is None, own[1:] != own[:-1])
            starts = np.flatnonzero(fresh)
            begin = np.zeros(batch.num_rows, np.int64)
            begin[starts] = starts
            begin = np.maximum.accumulate(begin)
            place_of = np.arange(batch.num_rows) - begin
            head = int(starts[0]) if len(starts) else batch.num_rows
            place_of[:head] += n
            last, n = own[-1], int(place_of[-1]) + 1
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(place_of)], names=[*batch.schema.names, place])

    schema = StructType([*dealt.schema.fields, StructField(place, LongType())])
    local = settle(dealt.mapInArrow(number, schema), name)
    counts = local.groupBy(*keys, "_range").agg(F.count(F.lit(1)).alias("_n"))
    earlier = Window.partitionBy(*keys, F.lit(0)).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    before = settle(counts.select(*keys, "_range", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before")), f"{name}-before")
    small = F.broadcast(before) if before.limit(MOST_BROADCAST + 1).count() <= MOST_BROADCAST else before
    return local.join(small, [*keys, "_range"]).withColumn(place, F.col(place) + F.col("_before")).drop("_range", "_before")
