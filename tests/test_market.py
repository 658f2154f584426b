"""The market build on small tables whose results are known, and what must hold for any input."""

import pytest
from pyspark.sql import functions as F

from pricewell.functions import columns as P
from pricewell.operators import market as M
from pricewell.operators import rules as R
from pricewell.operators import stats

QUOTE = "id long, brand_title string, series_title string, model_title string, group_title string, condition_bucket string, sname string, sno string, gid string, gprice string, gprice_two string, price_text string, dstatus string, activation string, imported_at string"


def quotes(spark, rows):
    """rows: (seller, day label, price, status); other columns are those of one product."""
    made = [(i, "苹果", "iPhone", "17 Pro", "256G 黑色", "strict_target", s, "", "", day, "", price, status, "", f"2026-{day} 10:00:00") for i, (s, day, price, status) in enumerate(rows, 1)]
    return spark.createDataFrame(made, QUOTE)


PURE = "公司纯原封"


def snapshot(spark, rows):
    return M.live_snapshot(quotes(spark, rows), R.load()).collect()


def test_latest_valid_day_only(spark):
    r = snapshot(spark, [("a", "04-16", "5520", PURE), ("b", "04-16", "5530", PURE), ("c", "04-15", "5480", PURE), ("d", "04-15", "5490", PURE)])
    assert len(r) == 1 and r[0]["selected_gprice_label"] == "04-16" and r[0]["price_range"] == "5520-5530" and r[0]["trusted_sample_count"] == 2 and r[0]["fallback_applied"] == 0


def test_noisy_latest_day_falls_back(spark):
    rows = [("a", "04-16", "5000", PURE + " 国补"), ("b", "04-16", "5010", PURE + " 补贴"), ("c", "04-15", "5500", PURE)]
    r = snapshot(spark, rows)
    assert r[0]["fallback_applied"] == 1 and r[0]["selected_gprice_label"] == "04-15"
    counts = {x["reason"]: x["n"] for x in M.reject_counts(quotes(spark, rows), R.load()).collect()}
    assert counts == {"status_noise_keyword": 2}


def test_single_quote(spark):
    r = snapshot(spark, [("a", "04-16", "7399", PURE)])
    assert r[0]["price_range"] == "7399-7399" and r[0]["trusted_sample_count"] == 1 and r[0]["low_quality"] == 1


def test_isolated_outlier_is_a_cluster_of_its_own(spark):
    r = snapshot(spark, [(str(i), "04-16", str(p), PURE) for i, p in enumerate((4500, 4510, 4520, 4530, 4540, 4180))])
    assert r[0]["cluster_count"] == 2 and r[0]["band_low"] >= 4500 and r[0]["suspicious_low_rows"] >= 1


def test_no_market(spark):
    df = quotes(spark, [("a", "04-16", "ask", PURE)])
    assert M.live_snapshot(df, R.load()).count() == 0
    assert [x["reason"] for x in M.skip_reasons(df, R.load()).collect()] == ["no_numeric_rows"]
    assert M.live_snapshot(df.limit(0), R.load()).count() == 0


def test_latest_row_per_seller(spark):
    df = quotes(spark, [("A", "04-15", "9600", PURE), ("a ", "04-16", "9610", PURE), ("B", "04-16", "9620", PURE)])
    got = {r["sname"]: r["price_text"] for r in M.latest_per_seller(df).collect()}
    assert got == {"a ": "9610", "B": "9620"}


def test_day_window_back_fills(spark):
    df = quotes(spark, [("a", "04-13", "1", PURE), ("b", "04-13", "2", PURE), ("c", "04-12", "3", PURE), ("d", "04-12", "4", PURE), ("e", "04-12", "5", PURE), ("f", "04-11", "6", PURE)])
    rows = M.recent_days(df, 4, 3).collect()
    assert len(rows) == 5 and {(r["day_label"], r["day_rank"]) for r in rows} == {("04-13", 1), ("04-12", 2)}


def test_percentiles_round_half_to_even(spark):
    df = spark.createDataFrame([(5524,), (5525,)], "v long")
    assert df.agg(stats.percentile("v", 0.5).alias("x")).first()["x"] == 5524
    assert df.limit(0).agg(stats.percentile("v", 0.5).alias("x")).first()["x"] == 0


@pytest.mark.parametrize("prices", [[100] * 20 + [900], [5000 + i for i in range(14)] + [9000], [1, 2, 3, 4], list(range(3000, 3015)) + [4000, 4010]])
def test_trims_keep_the_floor(spark, prices):
    df = M.recency(quotes(spark, [(str(i), "04-16", str(p), PURE) for i, p in enumerate(prices)])).withColumn("price_value", P.parse_price("price_text"))
    rows = M.clean_prices(df, R.load(), ["model_title"]).collect()
    alive = [r["price_value"] for r in rows if r["alive"]]
    assert len(rows) == len(prices) and len(alive) >= rows[0]["floor"] and all(bool(r["outlier_reason"]) != r["alive"] for r in rows)


def test_tail_is_cut(spark):
    prices = [3000 + i for i in range(15)] + [4000, 4010]
    df = M.recency(quotes(spark, [(str(i), "04-16", str(p), PURE) for i, p in enumerate(prices)])).withColumn("price_value", P.parse_price("price_text"))
    removed = {r["price_value"]: r["outlier_reason"] for r in M.clean_prices(df, R.load(), ["model_title"]).collect() if not r["alive"]}
    assert set(removed) == {4000, 4010}


def test_classes(spark):
    cases = [(PURE, "", "strict_target", 1), (PURE + "/激活", "", "strict_target_but_excluded", 0), (PURE, "2026-01-01", "strict_target_but_excluded", 0), ("原封", "", "strict_other_sealed_non_target", 0), ("拆封未激活", "", "strict_opened_not_activated", 0), ("官换", "", "strict_special_model_non_target", 0), ("好价", "", "strict_condition_unspecified_non_target", 0), ("?", "", "strict_unknown_review", 0)]
    df = spark.createDataFrame([(i, "苹果", "s", "m", "g", s, a) for i, (s, a, _, _) in enumerate(cases)], "id long, brand_title string, series_title string, model_title string, group_title string, dstatus string, activation string")
    got = {r["id"]: (r["condition_bucket"], r["is_target_price"]) for r in R.classify(df, R.load()).collect()}
    assert got == {i: (b, t) for i, (_, _, b, t) in enumerate(cases)}


def test_rules_document_is_checked():
    with pytest.raises(ValueError):
        R.from_document({"crawler": {}})
    with pytest.raises(ValueError):
        R.from_document({"crawler": {"typo": 1}, "cleaning": {}})


def test_group_specs(spark):
    cases = [("16+512G 黑色", "16+512G", "黑色"), ("256GB", "256G", "STANDARD"), ("", "DEFAULT", "UNSPECIFIED"), ("黑色", "DEFAULT", "黑色"), ("蓝 1TB /", "1T", "蓝")]
    df = spark.createDataFrame([(g,) for g, _, _ in cases], "g string").select(P.group_spec("g").alias("s"), P.capacity_order(P.group_spec("g")["capacity"]).alias("o"))
    rows = df.collect()
    assert [(r["s"]["capacity"], r["s"]["variant"]) for r in rows] == [c[1:] for c in cases]
    assert [tuple(r["o"]) for r in rows][:2] == [(16, 512), (0, 256)] and tuple(rows[4]["o"]) == (0, 1024)


def test_price_and_label_columns(spark):
    df = spark.createDataFrame([("12,300￥", "价 04-16 更新", "5520"), (None, None, "x1"), ("", "", "٣")], "a string, b string, c string")
    rows = df.select(P.price_text("a").alias("a"), P.day_label("b", "a").alias("b"), P.parse_price("c").alias("c")).collect()
    assert [tuple(r) for r in rows] == [("12300", "04-16", 5520), ("", "", None), ("", "", None)]
    texts = spark.createDataFrame([(["A ", "a", "", "b"],)], "x array<string>").select(P.distinct_texts(F.col("x")).alias("x")).first()["x"]
    assert texts == ["A", "b"]


def test_approximate_statistics_stay_within_their_neighbours(spark):
    from pricewell.operators import stats

    df = spark.range(2000).selectExpr("id % 3 AS g", "(id * 7919) % 1000 AS price_value")
    exact = {r["g"]: r for r in stats.price_stats(df, ["g"]).collect()}
    for r in stats.price_stats(df, ["g"], approximate=True).collect():
        e = exact[r["g"]]
        assert (r["n"], r["price_min"], r["price_max"], r["trimmed_mean"]) == (e["n"], e["price_min"], e["price_max"], e["trimmed_mean"])
        assert all(abs(r[c] - e[c]) <= 4 for c in ("median_price", "q1", "q3"))


def test_recent_labels_of_a_known_date_are_made_once(spark):
    from datetime import date

    df = spark.range(2).select(P.recent_labels(date(2024, 3, 1), 3).alias("known"), P.recent_labels(F.to_date(F.lit("2024-03-01")), 3).alias("column"))
    assert [r["known"] for r in df.collect()] == [["03-01", "02-29", "02-28"]] * 2 == [r["column"] for r in df.collect()]
    assert "lambda" not in df.select("known")._jdf.queryExecution().optimizedPlan().toString()
