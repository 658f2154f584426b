"""The market build cleans and splits sorted price arrays: the survivors are those of the row-wise flags, and few windows are left."""

import random
from collections import defaultdict

from pyspark.sql import functions as F

from pricewell.functions import columns as P
from pricewell.operators import market as M
from pricewell.operators import rules as R
from pricewell.operators import stats
from pricewell.sources import views as V


def test_sorted_prices_survive_as_rows_do(spark):
    rng = random.Random(4)
    rows = []
    for g in range(240):
        base, near = rng.choice([100, 3000, 9000]), rng.choice([1, 20, 400])
        rows += [(g, k, base + rng.randrange(near) + rng.choice([0] * 9 + [-900, 700, 5000])) for k in range(rng.choice([1, 2, 3, 4, 5, 7, 8, 11, 14, 15, 22, 40]))]
    df = spark.createDataFrame(rows, "g long, _rid long, price_value long")
    want, facts = defaultdict(list), {}
    for r in M.clean_prices(df, R.load(), ["g"]).collect():
        facts[r["g"]] = (r["density"], r["floor"], r["n_numeric"])
        if r["alive"]:
            want[r["g"]].append(r["price_value"])
    arrays = df.groupBy("g").agg(F.sort_array(F.collect_list("price_value")).alias("_live"))
    cleaned = M.clean_sorted(arrays, R.load())
    got = {r["g"]: r for r in cleaned.collect()}
    assert {g: r["_live"] for g, r in got.items()} == {g: sorted(v) for g, v in want.items()}
    assert {g: (r["density"], r["floor"], r["n_numeric"]) for g, r in got.items()} == facts
    assert sum(len(v) for v in want.values()) < len(rows)
    parts = defaultdict(list)
    for r in M.price_clusters(cleaned).orderBy("g", "_cluster").collect():
        parts[r["g"]].append(r["_own"])
    assert {g: [p for part in own for p in part] for g, own in parts.items()} == {g: sorted(v) for g, v in want.items()}
    assert any(len(own) > 1 for own in parts.values()) and all(len(own) == 1 for g, own in parts.items() if len(want[g]) < 3)


def test_percentile_of_a_sorted_array(spark):
    df = spark.createDataFrame([([],), ([7],), ([5524, 5525],), ([1, 2, 10, 40, 41],)], "v array<long>")
    for ratio in (0.0, 0.25, 0.5, 0.75, 1.0):
        rows = df.select(stats.of_sorted(F.col("v"), ratio).alias("x"), "v").collect()
        for r in rows:
            assert r["x"] == spark.createDataFrame([(x,) for x in r["v"]], "v long").agg(stats.percentile("v", ratio).alias("x")).first()["x"]


def test_recency_key(spark):
    texts = ["at 2026-04-16T10:00:07 or so", "2026-04-16 10:00:07", "2026-04-16", "", None]
    df = spark.createDataFrame([(t, "x 04-16 y" if k % 2 else None) for k, t in enumerate(texts)], "t string, d string")
    rows = df.select(P.stamp_key("t").alias("s"), P.month_day(P.day_label("d", "d")).alias("m")).collect()
    assert [r["s"] for r in rows] == ["2026-04-16 10:00:07"] * 2 + ["0000-00-00 00:00:00"] * 3
    assert [tuple(r["m"]) for r in rows] == [(0, 0), (4, 16), (0, 0), (4, 16), (0, 0)]


def test_few_windows_see_rows(spark):
    plan = M.market_clusters(V.quotes(spark, "/root/testdata/sf0.001"), V.demo_rules(), totals=True)._jdf.queryExecution().optimizedPlan().toString()
    assert sum(line.lstrip(" :+-").startswith("Window ") for line in plan.split("\n")) <= 10
