"""Tables that are replaced by versions, stores that streams write, and misspelt words, against plain Python."""

import os
import random

import pytest
from pyspark.sql import functions as F

from pricewell.functions import phrases as X
from pricewell.operators import rules as R
from pricewell.sources import sinks, versions
from pricewell.sources.versions import Clustered, Versions
from pricewell.streaming import jobs
from pricewell.streaming.stores import LastRows, SeenIds


def written(path):
    """Bytes of data files below a folder."""
    return sum(os.path.getsize(f"{d}/{f}") for d, _, names in os.walk(path) for f in names if f.startswith("part-"))


def test_last_rows_write_what_the_batch_has(spark, tmp_path):
    """A large first batch, then small ones: each writes little, whatever the table holds; compaction changes no row."""
    path = f"{tmp_path}/t"
    store = LastRows(spark, f"file://{path}", ["k"], ["n"], buckets=4, compact_after=4)
    want, rng = {}, random.Random(4)
    text = "x" * 200
    rows = [(k, k, text + str(k)) for k in range(4_000)]
    store.write(spark.createDataFrame(rows, "k long, n long, v string"), 0)
    want |= {k: (n, v) for k, n, v in rows}
    first = written(path)
    for epoch in range(1, 7):
        rows = [(rng.randrange(4_100), rng.randrange(9), f"{epoch}-{i}") for i in range(6)]
        before = written(path)
        for _ in range(2 if epoch == 3 else 1):  # one batch is run again
            store.write(spark.createDataFrame(rows, "k long, n long, v string"), epoch)
        for k in {r[0] for r in rows}:
            want[k] = max(((n, v) for kk, n, v in rows if kk == k), key=lambda x: x[0])
        compacted = any(x["kind"] == "base" for x in store._lines())
        assert compacted or written(path) - before < first / 4, epoch
    got = {r["k"]: (r["n"], r["v"]) for r in LastRows.of(spark, f"file://{path}").read().collect()}
    assert set(got) == set(want) and all(got[k][0] == want[k][0] for k in want)
    assert any(x["kind"] == "base" for x in store._lines()) and len(store._lines()) < 7


def test_lost_attempts_leave_nothing(spark, tmp_path):
    store = LastRows(spark, f"file://{tmp_path}/t", ["k"], ["n"])
    store.write(spark.createDataFrame([("a", 1)], "k string, n int"), 0)
    spark.createDataFrame([("z", 1, 1, 3)], "k string, n int, _epoch long, bucket int").write.partitionBy("bucket").parquet(f"file://{tmp_path}/t/delta-1-lost")
    store.write(spark.createDataFrame([("b", 1)], "k string, n int").limit(0), 1)
    assert [tuple(r) for r in store.read().collect()] == [("a", 1)]


def test_seen_ids_read_only_their_buckets(spark, tmp_path):
    store = SeenIds(spark, f"file://{tmp_path}/ids", "message_id", buckets=16)
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "message_id string")
    store.write(ids(*map(str, range(400))), 0)
    store.write(ids("7", "7", "x1", "x2"), 1)
    store.write(ids("7", "x3", "x2"), 2)
    store.write(ids("7", "x3", "x2"), 2)
    rows = spark.read.parquet(f"file://{tmp_path}/ids")
    assert sorted(r[0] for r in rows.where("epoch > 0").select("message_id").collect()) == ["x1", "x2", "x3"] and rows.count() == 403
    read = store.candidates(rows.where("epoch <> 9"), ids("7").withColumn("bucket", F.lit(3)))
    assert len(read.inputFiles()) > 1 and "bucket" in read._jdf.queryExecution().executedPlan().toString().split("PartitionFilters")[1][:200]


def test_a_key_repeated_every_23_hours_passes_once(spark, tmp_path):
    rows = [("a", f"2026-01-{1 + 23 * k // 24:02d} {23 * k % 24:02d}:00:00") for k in range(6)] + [("a", "2026-01-08 00:00:00"), ("b", "2026-01-02 00:00:00")]
    schema = "k string, ts timestamp"
    for k, r in enumerate(sorted(rows, key=lambda r: r[1])):
        spark.createDataFrame([r], "k string, t string").select("k", F.col("t").cast("timestamp").alias("ts")).coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/in")
    old = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        stream = spark.readStream.schema(schema).parquet(f"file://{tmp_path}/in")
        sink = lambda batch, epoch: batch.write.mode("overwrite").parquet(f"file://{tmp_path}/out/epoch={epoch}")
        jobs.run_available(jobs.drop_renewed(stream, ["k"], 24 * 3600), sink, f"file://{tmp_path}/check")
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", old)
    got = sorted((r["k"], str(r["ts"])) for r in spark.read.parquet(f"file://{tmp_path}/out").collect())
    assert got == [("a", "2026-01-01 00:00:00"), ("a", "2026-01-08 00:00:00"), ("b", "2026-01-02 00:00:00")]


def test_versions_show_old_rows_or_new_ones(spark, tmp_path):
    """A reader that keeps a snapshot sees the old rows; a version without its line does not count; others keep files."""
    table = Versions(spark, f"file://{tmp_path}/t")
    rows = lambda *x: spark.createDataFrame(x, "run_key string, v int")
    table.replace(rows(("a", 1), ("a", 2), ("b", 3)))
    old, files = table.snapshot(), {(r["partition"], r["file"]) for r in table.paths().collect()}
    rows(("a", 9)).write.partitionBy("run_key").parquet(f"file://{tmp_path}/t/version=lost")
    table.replace(rows(("a", 5)))
    assert sorted(tuple(r) for r in table.read().select("run_key", "v").collect()) == [("a", 5), ("b", 3)]
    assert sorted(tuple(r) for r in table.read(old).select("run_key", "v").collect()) == [("a", 1), ("a", 2), ("b", 3)]
    assert {x for x in files if x[0] == "b"} <= {(r["partition"], r["file"]) for r in table.paths().collect()}
    table.replace(rows(("a", 0)).limit(0), ["a"])
    assert [tuple(r) for r in table.read().select("run_key", "v").collect()] == [("b", 3)]
    with pytest.raises(ValueError):
        table.read(only=["zzz"])
    again = Versions(spark, f"file://{tmp_path}/t")
    versions.replace_task_rows(again, spark.createDataFrame([("b", 3), ("c", 1)], "run_key string, v int"), ["v"])
    assert sorted(tuple(r) for r in again.read().select("run_key", "v").collect()) == [("b", 3), ("c", 1)]


def test_publishing_a_live_run_again(spark, tmp_path):
    path, states = f"file://{tmp_path}/s", f"file://{tmp_path}/state"
    df = spark.createDataFrame([("x", 1), ("y", 2)], "sku string, market_price long")
    sinks.publish(df, path, states, "run_1", "2026-01-01", f"file://{tmp_path}/e")
    reader = Versions(spark, path)
    before = reader.snapshot()
    sinks.publish(df.limit(1), path, states, "run_1", "2026-01-02", f"file://{tmp_path}/e")
    assert reader.read(before).count() == 2 and reader.read().count() == 1


def test_write_back_leaves_other_runs_alone(spark, tmp_path):
    made = spark.createDataFrame([("r1", "苹果", "", "", "", "公司纯原封", ""), ("r2", "小米", "", "", "", "", "")], "run_key string, brand_title string, series_title string, model_title string, group_title string, dstatus string, activation string")
    rules, table = R.load(), Versions(spark, f"file://{tmp_path}/q")
    stored = R.classify(made, rules).withColumn("condition_bucket", F.when(F.col("run_key") == "r1", "stale").otherwise(F.col("condition_bucket")))
    table.replace(stored)
    old = table.snapshot()
    counts = versions.write_back(table, rules, ["condition_bucket"], "now", f"file://{tmp_path}/e")
    assert {tuple(r) for r in counts.collect()} == {("r1", 1, 1), ("r2", 1, 0)}
    new = table.snapshot()
    assert new["r1"] != old["r1"] and new["r2"] == old["r2"] and {r["condition_bucket"] for r in table.read().collect()} == {"strict_target", "open_allowed"}
    assert [r["run_key"] for r in spark.read.parquet(f"file://{tmp_path}/e").collect()] == ["r1"]


def test_mended_words_against_brute_force(spark):
    rng = random.Random(8)
    word = lambda n: "".join(rng.choice("abcdefgh") for _ in range(n))
    known = list(dict.fromkeys(word(rng.randrange(3, 9)) for _ in range(4_000)))
    tokens = []
    for _ in range(150):
        t = list(rng.choice(known) if rng.random() < 0.8 else word(rng.randrange(1, 10)))
        for _ in range(rng.randrange(3)):
            i = rng.randrange(len(t))
            t[i : i + 2] = rng.choice([t[i : i + 2][::-1], t[i : i + 1], ["z", *t[i : i + 2]], []])
            t = t or ["q"]
        tokens.append("".join(t))
    lexicon = spark.createDataFrame([(w, k) for k, w in enumerate(known)], "word string, place int")
    got = {r["token"]: r["word"] for r in X.mends(spark.createDataFrame([(t,) for t in tokens], "token string"), lexicon).collect()}
    assert got == X._measured([" ".join(tokens)], known) and len(got) > 50


def test_substitutions_and_codes():
    table = X.Substitutions({"ab": ("x", "y"), "a": ("z",), "missing": ("w",)})
    assert table.of("cab a") == ["cx a", "cy a", "czb z"] and table.of("cab", (frozenset(["ab"]), frozenset(["x"]))) == ["cy", "czb"]
    assert X.closed_codes("k 80 pro mate 60 pro gan 65w", ("pro",)) == ["k80 pro mate 60 pro gan 65w", "k 80 pro mate60 pro gan 65w", "k 80 pro mate 60 pro gan65w"]
    assert X.read_digits("1o24l") == "10241" and X.read_digits("oil") == "oil"


def test_lookups_read_the_files_of_their_key(spark, tmp_path):
    rows = [(f"b{k % 7}", f"m{k % 50:02d}", k) for k in range(3_000)] + [("hot", "one", k) for k in range(2_000)] + [(None, "x", 1)]
    table = Clustered(spark, f"file://{tmp_path}/c", ["brand", "model"])
    table.write(spark.createDataFrame(rows, "brand string, model string, v long"), 20)
    want = lambda b, m=None: sorted(v for x, y, v in rows if (x or "") == b and m in (None, y))
    for b, m in (("b3", "m10"), ("hot", "one"), ("", "x"), ("none", "m10")):
        found = table.lookup(brand=b, model=m)
        assert sorted(r["v"] for r in found.collect()) == want(b, m)
        assert b == "hot" or len(found.inputFiles()) <= 2
    assert sorted(r["v"] for r in table.lookup(brand="b5").collect()) == want("b5")
    with pytest.raises(ValueError):
        table.lookup(model="m10")


def test_clustered_files_have_bounded_rows(spark, tmp_path):
    rows = spark.range(3_000).selectExpr("concat('b', id % 7) AS brand", "id AS v")
    table = Clustered(spark, f"file://{tmp_path}/c", ["brand"])
    table.write(rows, 2, most_rows=200)
    assert table.manifest().agg(F.max("n")).first()[0] <= 400 and table.manifest().count() >= 10
    assert sorted(r["v"] for r in table.lookup(brand="b3").collect()) == list(range(3, 3_000, 7))


def test_published_runs_read_settled_rows(spark, monkeypatch):
    """Each publication reads the runs' settled rows, not the tables that they are joined from."""
    from pricewell.plans import file_queries

    read, publish = [], file_queries.sinks.publish
    monkeypatch.setattr(file_queries.sinks, "publish", lambda df, *a: (read.extend(df.inputFiles()), publish(df, *a)))
    made = file_queries.QUERIES["published_runs"](spark, "/root/testdata/sf0.001").collect()
    assert len(made) > 1 and all(r["n"] == r["published"] for r in made)
    assert read and not any("lineitem" in f or "supplier" in f for f in read)
