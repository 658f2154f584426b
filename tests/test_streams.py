"""Stateful streams against plain Python."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from pricewell.plans import stream_queries
from pricewell.streaming import jobs, walks

SF = "/root/testdata/sf0.001"
INTENT = {"click": "choice", "error": "reset", "purchase": "image"}


def test_sessions_against_plain_python(spark):
    rows = spark.read.parquet(f"{SF}/events.parquet").selectExpr("cast(user_id as string) u", "cast(event_id as string) m", "cast(ts as timestamp) t", "event_type e").collect()
    states, want = {}, Counter()
    for r in sorted(rows, key=lambda r: (r["t"], r["m"])):
        phase, since, turns = states.get(r["u"], ("idle", 0.0, 0))
        at = r["t"].timestamp()
        expired = phase in jobs.PENDING and at - since > 15 * 60
        phase = jobs.next_phase("idle" if expired else phase, INTENT.get(r["e"], "query"))
        states[r["u"]] = phase, at, turns + 1
        want[r["u"], r["m"], phase, turns + 1, expired] += 1
    got = Counter(tuple(r) for r in stream_queries.QUERIES["stream_sessions"](spark, SF).select("user_id", "message_id", "phase", "turns", "expired").collect())
    assert got == want and sum(k[4] for k in want) > 0


def test_upsert_log_survives_a_lost_attempt(spark, tmp_path):
    """A batch that wrote its version but not its line, or both, is run again: the table is as after one run."""
    table = f"file://{tmp_path}/log"
    sink = jobs.upsert_log(spark, table, ["k"], ["n"])
    batch = lambda *rows: spark.createDataFrame(rows, "k string, n int")
    sink(batch(("a", 1), ("b", 1)), 0)
    sink(batch(("a", 2)), 1)
    spark.createDataFrame([("z", 9)], "k string, n int").write.parquet(f"{table}/v2-lost")
    for _ in range(2):
        sink(batch(("b", 3), ("c", 3)), 2)
    assert {tuple(r) for r in jobs.current_version(spark, table).collect()} == {("a", 2), ("b", 3), ("c", 3)}


def test_renewals_by_batches_against_plain_python(spark, tmp_path):
    """Three batches, each run twice: keys seen again within the time to live, at its end, after it, and across batches."""
    import random

    rng = random.Random(8)
    rows = sorted((rng.randrange(9_000), f"k{rng.randrange(40)}", i) for i in range(600))
    rows = [(k, at, i) for n, (at, k, i) in enumerate(rows) if not n or rows[n - 1][0] != at]  # no equal times
    want, last = set(), {}
    for k, at, i in rows:
        if k not in last or at - last[k] > 600:
            want.add(i)
        last[k] = at
    out, sent, calls = f"file://{tmp_path}/renewed", "k string, s long, i long", []
    sink = jobs.renewed_sink(spark, out, ["k"], 600)
    for epoch, (low, high) in enumerate(((0, 3_000), (3_000, 3_300), (3_300, 9_000))):
        batch = spark.createDataFrame([r for r in rows if low <= r[1] < high], sent).selectExpr("k", "timestamp_seconds(s) AS ts", "i")
        for _ in range(2):
            sink(batch, epoch)
        calls.append(spark.read.parquet(f"{out}/state/epoch={epoch}").count())
    assert {r["i"] for r in spark.read.parquet(f"{out}/rows").collect()} == want and 40 < len(want) < 500
    assert calls[2] == sum(at + 600 >= max(r[1] for r in rows) for at in last.values()) < 40


def test_stream_renewed_calls_no_python_for_each_key(spark, monkeypatch):
    monkeypatch.setattr(jobs.Renewed, "handleInputRows", None)
    monkeypatch.setattr(jobs, "drop_renewed", None)
    got = sorted(r[0] for r in stream_queries.QUERIES["stream_renewed"](spark, SF).collect())
    assert got and len(got) == len(set(got))


def _in_batches(spark, sink, rows, schema, bounds):
    """Sends rows (key, seconds, ...) in batches between the bounds, every batch twice."""
    for epoch, (low, high) in enumerate(zip(bounds, bounds[1:], strict=False)):
        batch = spark.createDataFrame([r for r in rows if low <= r[1] < high], schema).withColumn("ts", F.timestamp_seconds("s")).drop("s")
        for _ in range(2):
            sink(batch, epoch)


def test_sessions_by_batches_against_plain_python(spark, tmp_path):
    """Lapses before a message, at a batch's end, across batches and after the last message; each is told once."""
    rng = random.Random(5)
    rows = [(f"u{rng.randrange(25)}", at, f"m{at}", rng.choice(["query", "choice", "image", "reset"])) for at in sorted(rng.sample(range(9_000), 400))]
    want, states, top = Counter(), {}, max(r[1] for r in rows)
    for u, at, m, intent in rows:
        phase, since, turns = states.get(u, ("idle", 0, 0))
        lapsed = phase in jobs.PENDING and at - since > 900
        if lapsed:
            want[u, None, "idle", turns, True, since + 900] += 1
        phase = jobs.next_phase("idle" if lapsed else phase, intent)
        states[u] = phase, at, turns + 1
        want[u, m, phase, turns + 1, lapsed, at] += 1
    want.update((u, None, "idle", turns, True, since + 900) for u, (phase, since, turns) in states.items() if phase in jobs.PENDING and since + 900 < top)
    out = f"file://{tmp_path}/sessions"
    _in_batches(spark, walks.sessions_sink(spark, out), rows, "user_id string, s long, message_id string, intent string", (0, 3_000, 3_400, 9_000))
    got = Counter((r["user_id"], r["message_id"], r["phase"], r["turns"], r["expired"], r["at_us"] // 1_000_000) for r in spark.read.parquet(f"{out}/rows").collect())
    assert got == want and sum(k[1] is None for k in want) > 10


def test_queue_by_batches_against_plain_python(spark, tmp_path):
    """Claims that lapse, attempts used up, items that stay open over batches."""
    rng = random.Random(6)
    rows = [(f"t{rng.randrange(20)}", at, at, rng.choice(["queue", "claim", "claim", "fail", "complete"])) for at in sorted(rng.sample(range(9_000), 700))]
    want, items = Counter(), {}
    for t, at, number, action in rows:
        item = items.get(t)
        if item and item["claimed"] is not None and at - item["claimed"] > 600:
            item["claimed"] = None
        if item is None:
            if action == "queue":
                items[t] = {"opened": number, "claimed": None, "claims": []}
        elif action == "claim" and item["claimed"] is None:
            item["claimed"], item["claims"] = at, [*item["claims"], number]
        elif action in ("fail", "complete") and item["claimed"] is not None and (action == "complete" or len(item["claims"]) >= 3):
            want[t, item["opened"], number, "completed" if action == "complete" else "given_up", len(item["claims"]), ",".join(map(str, item["claims"]))] += 1
            del items[t]
        elif action == "fail":
            item["claimed"] = None
    out = f"file://{tmp_path}/queue"
    _in_batches(spark, walks.queue_sink(spark, out, 600, 3), rows, "task_key string, s long, id long, action string", (0, 3_000, 3_400, 9_000))
    got = Counter(tuple(r) for r in spark.read.parquet(f"{out}/rows").select("task_key", "opened_id", "closed_id", "outcome", "attempts", "claims").collect())
    assert got == want and len({k[3] for k in want}) == 2


@pytest.mark.parametrize("name", ["stream_sessions", "stream_lapses", "stream_queue"])
def test_machines_call_no_python_for_each_key(spark, monkeypatch, name):
    monkeypatch.setattr(jobs, "sessions", None)
    monkeypatch.setattr(jobs, "work_queue", None)
    assert stream_queries.QUERIES[name](spark, SF).count() >= 0
