"""Structured Streaming jobs: deduplication, processed-once, session state, counters, log upserts.

Each takes and returns streaming DataFrames; sinks that merge are functions for foreachBatch. Batch twins of the same
operators are in operators/state.py and operators/reports.py."""

from __future__ import annotations

import os
import sys
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from pricewell.operators import state as S
from pricewell.settled import settle
from pricewell.sources import sinks
from pricewell.streaming.stores import LastRows, SeenIds, there


def read_parquet_stream(spark: SparkSession, path: str, schema: T.StructType, files: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def drop_repeated(events: DataFrame, key: list[str], ttl: str = "24 hours", at: str = "ts") -> DataFrame:
    """The first event of each key within the TTL, measured from first sight; later ones than the watermark are dropped."""
    return events.withWatermark(at, ttl).dropDuplicatesWithinWatermark(key)


def process_once(spark: SparkSession, out: str, key: str = "message_id") -> Callable[[DataFrame, int], None]:
    """For foreachBatch: appends messages that no earlier batch had, by a table of ids (stores.SeenIds)."""
    return SeenIds(spark, out, key).write


def _micros(t: pd.Timestamp) -> int:
    """Microseconds since 1970; as whole numbers, since they come back out."""
    return t.value // 1000


class Renewed(StatefulProcessor):
    """One state per key: when it was last seen. A row passes if the key was not seen for `seconds`; every sight renews."""

    def __init__(self, seconds: float, at: str) -> None:
        self.renew, self.at = int(seconds * 1_000_000), at

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.last = handle, handle.getValueState("last", T.StructType([T.StructField("us", T.LongType())]))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        last = self.last.get()[0] if self.last.exists() else None
        for chunk in rows:
            chunk = chunk.sort_values(self.at)
            us = chunk[self.at].map(_micros)
            before = us.shift(fill_value=us.iloc[0] - self.renew - 1 if last is None else last)
            last = us.iloc[-1] if last is None else max(us.iloc[-1], last)
            yield chunk[us - before > self.renew]
        self.last.update((int(last),))
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        self.handle.registerTimer((int(last) + self.renew) // 1000 + 1)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        self.last.clear()
        return iter(())

    def close(self) -> None:
        pass


def drop_renewed(events: DataFrame, key: list[str], seconds: float, at: str = "ts", delay: str = "0 seconds") -> DataFrame:
    """Rows of each key that come more than `seconds` after the key's last sight, whether that passed or not. The state is
    let go when the watermark passes the end of the time to live. Needs the RocksDB state store."""
    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    return events.withWatermark(at, delay).groupBy(*key).transformWithStateInPandas(Renewed(seconds, at), events.schema, "Append", "EventTime")


def renewed_sink(spark: SparkSession, path: str, key: list[str], seconds: float, at: str = "ts", delay: float = 0) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: what drop_renewed keeps, by a window over the batch's rows of each key instead of a call of Python for
    each key. Rows go to {path}/rows. {path}/state has the last sight of the keys whose time to live the watermark (the
    newest time so far less `delay` seconds) has not passed; others are let go, and rows before the watermark are dropped.
    A batch reads the state of the one before it and overwrites its own, so it may be run again."""
    renew = int(seconds * 1_000_000)

    def sink(batch: DataFrame, epoch: int) -> None:
        rows = batch.withColumns({"_us": F.unix_micros(at), "_last": F.lit(None).cast("long")})
        mark = None
        if epoch:
            mark = spark.read.parquet(f"{path}/mark/epoch={epoch - 1}").first()["us"]  # one row
            if mark is not None:
                rows = rows.where(F.col("_us") >= mark - int(delay * 1_000_000))
            rows = rows.unionByName(spark.read.parquet(f"{path}/state/epoch={epoch - 1}"), allowMissingColumns=True)
        w = Window.partitionBy(*key)
        before = F.greatest(F.lag("_us").over(w.orderBy("_us")), F.max("_last").over(w))
        rows = settle(rows.withColumn("_before", before), "renewed")
        kept = rows.where(F.col("_us").isNotNull() & (F.col("_before").isNull() | (F.col("_us") - F.col("_before") > renew)))
        kept.select(batch.columns).write.mode("overwrite").parquet(f"{path}/rows/epoch={epoch}")
        newest = rows.agg(F.greatest(F.max("_us"), F.lit(mark).cast("long")).alias("us")).first()["us"]
        live = rows.groupBy(*key).agg(F.greatest(F.max("_us"), F.max("_last")).alias("_last"))
        live = live.where(F.col("_last") + renew >= (newest or 0) - int(delay * 1_000_000))
        live.write.mode("overwrite").parquet(f"{path}/state/epoch={epoch}")
        spark.createDataFrame([(newest,)], "us long").coalesce(1).write.mode("overwrite").parquet(f"{path}/mark/epoch={epoch}")

    return sink


def count_by(events: DataFrame, column: str) -> DataFrame:
    """Running counters; run in update mode with a processing-time trigger of some seconds."""
    return events.groupBy(column).agg(F.count(F.lit(1)).alias("n"))


def upsert_log(spark: SparkSession, table: str, keys: list[str], order: list[str]) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: last status per key, merged when read (stores.LastRows)."""
    return LastRows(spark, table, keys, order).write


def current_version(spark: SparkSession, table: str) -> DataFrame:
    """The table that upsert_log has made so far."""
    return LastRows.of(spark, table).read()


def on_change(spark: SparkSession, state_path: str, marker: Callable[[], str], rebuild: Callable[[int], None]) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: rebuilds only when the marker differs from the one of the last rebuild, which is kept in the state
    (see sources/sinks.py) and so outlives the driver. The state is set after the rebuild: a lost one is done again."""

    def sink(batch: DataFrame, epoch: int) -> None:
        now = marker()
        known = there(lambda: sinks.get_state(spark, state_path, "index_marker"))
        last = known.first() if known is not None else None
        if last is None or last["state_value"] != now:
            rebuild(epoch)
            sinks.set_state(spark, state_path, "index_marker", now, f"{epoch:020d}")

    return sink


SESSION = T.StructType([T.StructField("phase", T.StringType()), T.StructField("since", T.LongType()), T.StructField("turns", T.LongType()), T.StructField("lapsed", T.BooleanType())])
SESSION_OUT = "user_id string, message_id string, phase string, turns long, expired boolean, at timestamp"
PENDING = ("awaiting_choice", "awaiting_image")


def next_phase(phase: str, intent: str) -> str:
    """The session's phase after a message."""
    if intent == "reset":
        return "idle"
    if intent == "image":
        return "awaiting_image"
    if intent == "choice":
        return "ready" if phase == "awaiting_choice" else phase
    return "awaiting_choice" if intent == "query" else phase


class Sessions(StatefulProcessor):
    """One state per user: phase, when it began, turns. A pending phase is idle again after `minutes`: a timer says so
    when the watermark passes, or the next message if that comes first; either way one row without a message tells it."""

    def __init__(self, minutes: float = 15) -> None:
        self.wait = int(minutes * 60_000_000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.value = handle, handle.getValueState("session", SESSION)

    def _lapse(self, key, since: int, turns: int) -> tuple:
        return (key[0], None, "idle", turns, True, pd.Timestamp(since + self.wait, unit="us"))

    def _rows(self, rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=["user_id", "message_id", "phase", "turns", "expired", "at"])

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        phase, since, turns, lapsed = self.value.get() if self.value.exists() else ("idle", 0, 0, False)
        for chunk in rows:
            out = []
            for r in chunk.sort_values(["ts", "message_id"]).itertuples():
                at = _micros(r.ts)
                if phase in PENDING and at - since > self.wait:
                    out.append(self._lapse(key, since, turns))
                    phase, lapsed = "idle", True
                phase = next_phase(phase, r.intent)
                since, turns = at, turns + 1
                out.append((key[0], r.message_id, phase, turns, lapsed, pd.Timestamp(at, unit="us")))
                lapsed = False
            yield self._rows(out)
        self.value.update((phase, since, turns, lapsed))
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        if phase in PENDING:
            self.handle.registerTimer((since + self.wait) // 1000 + 1)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        phase, since, turns, lapsed = self.value.get()
        if phase in PENDING:
            self.value.update(("idle", since, turns, True))
            yield self._rows([self._lapse(key, since, turns)])

    def close(self) -> None:
        pass


def sessions(messages: DataFrame, minutes: float = 15, delay: str = "0 seconds") -> DataFrame:
    """messages: user_id, message_id, ts, intent. Needs the RocksDB state store (spark.sql.streaming.stateStore.providerClass)."""
    cloudpickle.register_pickle_by_value(sys.modules[__name__])  # the state worker does not see shipped packages
    return messages.withWatermark("ts", delay).groupBy("user_id").transformWithStateInPandas(Sessions(minutes), SESSION_OUT, "Append", "EventTime")


ITEM = T.StructType([T.StructField("status", T.StringType()), T.StructField("opened", T.LongType()), T.StructField("attempts", T.LongType()), T.StructField("claimed", T.LongType())])
CLAIM = T.StructType([T.StructField("id", T.LongType())])
ARCHIVE = "task_key string, opened_id long, closed_id long, outcome string, attempts long, claims string"


class WorkQueue(StatefulProcessor):
    """One open item per task key: queued, or processing since a claim; a list of its claims. A claim that is not closed
    within `lease` seconds lapses by a timer. A failed item waits again until its attempts are used up; completed and
    given-up items leave for the archive."""

    def __init__(self, lease: float, most: int) -> None:
        self.lease, self.most = int(lease * 1_000_000), most

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.item, self.claims = handle, handle.getValueState("item", ITEM), handle.getListState("claims", CLAIM)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        item = self.item.get() if self.item.exists() else None
        for chunk in rows:
            out = []
            for r in chunk.sort_values(["ts", "id"]).itertuples():
                status, opened, attempts, claimed = item or (None, 0, 0, 0)
                at = _micros(r.ts)
                if status == "processing" and at - claimed > self.lease:
                    status = "queued"
                if r.action == "queue" and status is None:
                    item = ("queued", r.id, 0, 0)
                elif r.action == "claim" and status == "queued":
                    item = ("processing", opened, attempts + 1, at)
                    self.claims.appendValue((r.id,))
                elif r.action in ("complete", "fail") and status == "processing" and (r.action == "complete" or attempts >= self.most):
                    claims = ",".join(str(c[0]) for c in self.claims.get())
                    out.append((key[0], opened, r.id, "completed" if r.action == "complete" else "given_up", attempts, claims))
                    self.claims.clear()
                    item = None
                elif status is not None:
                    item = ("queued" if r.action == "fail" else status, opened, attempts, claimed)
            yield pd.DataFrame(out, columns=["task_key", "opened_id", "closed_id", "outcome", "attempts", "claims"])
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        if item is None:
            self.item.clear()
            return
        self.item.update(item)
        if item[0] == "processing":
            self.handle.registerTimer((item[3] + self.lease) // 1000 + 1)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        status, opened, attempts, claimed = self.item.get()
        if status == "processing":
            self.item.update(("queued", opened, attempts, claimed))
        return iter(())

    def close(self) -> None:
        pass


def work_queue(actions: DataFrame, lease_seconds: float = 1800, most_attempts: int = 3, delay: str = "0 seconds") -> DataFrame:
    """actions: task_key, id, ts, action (queue, claim, complete, fail); the archive of closed items."""
    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    return actions.withWatermark("ts", delay).groupBy("task_key").transformWithStateInPandas(WorkQueue(lease_seconds, most_attempts), ARCHIVE, "Append", "EventTime")


def gap_counts(events: DataFrame) -> DataFrame:
    """A batch's part of the gap lifecycle of each task; parts add up (see gap_sink)."""
    return S.gap_lifecycle(events).join(events.groupBy("task_key").agg(F.max("id").alias("last_id")), "task_key")


def gap_sink(spark: SparkSession, path: str) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: every task's lifecycle so far, as a table of last rows: a batch's part is added to what the table
    has of its tasks from other epochs."""
    store = LastRows(spark, path, ["task_key"], ["last_id"])

    def sink(batch: DataFrame, epoch: int) -> None:
        part = gap_counts(batch)
        if epoch:
            known = store.read(before=epoch).select("task_key", *[F.col(c).alias(f"_{c}") for c in ("first_detected", "attempts", "last_event", "n_events", "last_id")])
            zero = lambda c: F.coalesce(F.col(c), F.lit(0))
            newer = F.coalesce(F.col("_last_id") > F.col("last_id"), F.lit(False))
            part = part.join(known, "task_key", "left").select("task_key", F.least("first_detected", "_first_detected").alias("first_detected"), (F.col("attempts") + zero("_attempts")).alias("attempts"), F.when(newer, F.col("_last_event")).otherwise(F.col("last_event")).alias("last_event"), (F.col("n_events") + zero("_n_events")).alias("n_events"), F.greatest("last_id", "_last_id").alias("last_id"))
        store.write(part, epoch)

    return sink


def session_windows(messages: DataFrame, gap: str = "15 minutes") -> DataFrame:
    """The batch twin: sessions by gaps, with messages in each."""
    return messages.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count(F.lit(1)).alias("n"), F.max_by("intent", "ts").alias("last_intent")).select("user_id", F.col("w.start").alias("begins"), "n", "last_intent")


def run_available(stream: DataFrame, sink: Callable[[DataFrame, int], None] | None, checkpoint: str, mode: str = "append", name: str | None = None):
    """Runs a stream over what is there and waits for its end."""
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True)
    query = (writer.foreachBatch(sink) if sink else writer.format("memory").queryName(name)).start()
    query.awaitTermination()
    return query


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder for a stream's checkpoint and output, under the shared folder the session names."""
    import tempfile

    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="pricewell-stream-")
    return os.path.join(base.rstrip("/"), f"pricewell-{name}-{uuid.uuid4().hex}")
