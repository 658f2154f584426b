"""State operators, sources, sinks, matching, detail views, text scans and streams on small tables."""

import json

import pytest
from pyspark.sql import functions as F

from pricewell.functions import phrases as X
from pricewell.operators import detail as D
from pricewell.operators import matching as T
from pricewell.operators import rules as R
from pricewell.operators import state, textscan
from pricewell.sources import readers, schemas, sinks
from pricewell.sources import views as V

SF = "/root/testdata/sf0.001"


def test_upsert_and_seed(spark):
    stored = spark.createDataFrame([(1, "a", "t1"), (2, "b", "t1")], "k long, v string, created string")
    new = spark.createDataFrame([(2, "c", "t2"), (2, "d", "t3"), (3, "e", "t3")], "k long, v string, created string")
    got = {tuple(r) for r in state.upsert(stored, new, ["k"], ["created"], ("created",)).collect()}
    assert got == {(1, "a", "t1"), (2, "d", "t1"), (3, "e", "t3")}


def test_reclassified_counts_rows_of_equal_id_once(spark):
    from dataclasses import replace

    rules = V.demo_rules()
    rows = [(7, "run_a", "Brand#1", "AF"), (7, "run_b", "Brand#1", "NO"), (7, "run_b", "Brand#1", "AF"), (None, "run_b", "Brand#1", "NO")]
    df = spark.createDataFrame([(i, r, b, "s", "m", "g", s, "") for i, r, b, s in rows], "id long, run_key string, brand_title string, series_title string, model_title string, group_title string, dstatus string, activation string")
    got = state.reclassified(R.classify(df, rules), replace(rules, open_exclude=()), ["condition_bucket", "is_target_price"])
    assert {tuple(r) for r in got.collect()} == {("run_a", 1, 1), ("run_b", 3, 1)}


def test_quote_ids_are_unique_at_any_size(spark, tmp_path):
    """200,000 parts, 20,000 suppliers and order keys beyond 10^9: no two lines share an id, and none overflows."""
    line = spark.range(200_000).select((F.col("id") + 2_000_000_000).alias("l_orderkey"), F.lit(1).alias("l_linenumber"), F.col("id").alias("l_partkey"), (F.col("id") % 20_000).alias("l_suppkey"), F.to_timestamp(F.lit("1998-05-25")).alias("l_shipdate"), F.lit("N").alias("l_returnflag"), F.lit("O").alias("l_linestatus"), F.lit(10.0).alias("l_extendedprice"), F.lit(2.0).alias("l_quantity"), F.lit(0.0).alias("l_discount"))
    line.write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.range(200_000).select(F.col("id").alias("p_partkey"), F.lit("b").alias("p_brand"), F.lit("t").alias("p_type"), F.lit("n").alias("p_name"), F.lit(1).alias("p_size")).write.parquet(f"{tmp_path}/part.parquet")
    spark.range(20_000).select(F.col("id").alias("s_suppkey"), F.lit("s").alias("s_name")).write.parquet(f"{tmp_path}/supplier.parquet")
    n = V.raw_quotes(spark, str(tmp_path)).agg(F.count_distinct("id").alias("d"), F.count("id").alias("n")).first()
    assert (n["d"], n["n"]) == (200_000, 200_000)


def test_choose_item(spark):
    items = spark.createDataFrame([("1", "Red"), ("2", "Red widget"), ("3", "Blue")], "ID string, title string")
    assert [r["ID"] for r in state.choose_item(items, "red").collect()] == ["1"]
    assert [r["ID"] for r in state.choose_item(items, "wid").collect()] == ["2"]
    assert state.choose_item(items, "none").collect() == []
    with pytest.raises(Exception, match="more than one"):
        state.choose_item(items.unionByName(items), "blue").collect()


def test_notes_are_repaired(spark):
    df = spark.createDataFrame([("", "b1"), ("??????", "b2"), ("fine?", "b3")], "note string, source_batch string")
    assert [r["note"] for r in state.repair_note(df).collect()] == ["imported with b1", "imported with b2", "fine?"]


def test_csv_run_import_replaces_the_run(spark, tmp_path):
    path, table = tmp_path / "run.csv", f"file://{tmp_path}/quotes"
    path.write_text("﻿brand_title,model_title,dstatus,price_text,activation\n苹果,17,公司纯原封,5000,\n小米,15,,3000,\n", encoding="utf-8")
    first = sinks.import_run(spark, f"file://{path}", table, R.load(), "run_a", "2026-01-01 00:00:00")
    assert {(r["brand_title"], r["condition_bucket"]) for r in first.collect()} == {("苹果", "strict_target"), ("小米", "open_allowed")}
    sinks.import_run(spark, f"file://{path}", table, R.load(), "run_b", "2026-01-02 00:00:00")
    sinks.import_run(spark, f"file://{path}", table, R.load(), "run_a", "2026-01-03 00:00:00")
    assert {(r["run_key"], r["count"]) for r in spark.read.parquet(table).groupBy("run_key").count().collect()} == {("run_a", 2), ("run_b", 2)}


def test_json_lines_and_blacklists(spark, tmp_path):
    (tmp_path / "p.jsonl").write_text('{"run_key": "a", "status": "ok"}\n\nnot json\n{"run_key": "b"}\n')
    assert {r["run_key"] for r in readers.read_json_lines(spark, f"file://{tmp_path}/p.jsonl", schemas.TASKS).where("run_key is not null").collect()} == {"a", "b"}
    with pytest.raises(Exception):
        readers.read_json_lines(spark, f"file://{tmp_path}/p.jsonl", schemas.TASKS, strict=True).collect()
    for name, text in (("a.txt", "# old\n11\n\n12\n"), ("b.csv", "enabled,model_id\n1,11\nno,13\n1,12\n"), ("c.csv", "11,x\n12,y\n"), ("d.json", '[{"model_id": "11", "enabled": "1"}, {"model_id": "12"}, {"model_id": "13", "enabled": "off"}]')):
        (tmp_path / name).write_text(text)
        assert {r["model_id"] for r in readers.read_blacklist(spark, f"file://{tmp_path}/{name}").collect()} == {"11", "12"}, name


def test_newest_healthy_prices(spark, tmp_path):
    for name, rows, at in (("a", 2000, "2026-01-01"), ("b", 10, "2026-01-03"), ("c", 1500, "2026-01-02")):
        (tmp_path / name).mkdir()
        (tmp_path / name / "summary.json").write_text(json.dumps({"supplier_rows": rows, "finished_at": at}))
        (tmp_path / name / "prices.csv").write_text(f"brand_title,series_title,sku_title,reference_price\nB,S,{name},1\nB,S,{name},2\n")
    assert [tuple(r) for r in readers.latest_healthy_prices(spark, f"file://{tmp_path}").collect()] == [("B", "S", "c", 2)]


def test_mixed_encodings(spark, tmp_path):
    for name, data in (("a", "中文".encode()), ("b", "﻿中文".encode()), ("c", "中文".encode("gb18030"))):
        (tmp_path / name).write_bytes(data)
    assert {r["text"] for r in readers.read_texts(spark, f"file://{tmp_path}").collect()} == {"中文"}
    lines = spark.createDataFrame([("中文字".encode().decode("gb18030", "ignore"),), ("plain",), (None,)], "line string")
    assert [r["repaired"] for r in textscan.repair_lines(lines).collect()][1:] == ["plain", None]


def test_damaged_lines_are_repaired_one_by_one(spark, tmp_path):
    bad = "中文字符".encode().decode("gb18030")
    mixed = spark.createDataFrame([(1, f"{bad}\ncafé — 中文\nplain\n")], "doc_id long, text string")
    lines = mixed.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    assert [r["repaired"] for r in textscan.repair_lines(lines).orderBy("line_no").collect()] == ["中文字符", "café — 中文", "plain", ""]
    text = "中文字符\ncafé — x\nplain\n\né"
    damaged = {r["line_no"]: r["line"] for r in textscan.damaged_lines(spark.createDataFrame([(1, text), (2, None)], "doc_id long, text string")).collect()}
    assert damaged[1] == bad and damaged[3] == "plain" and len(damaged) == 5
    spark.createDataFrame([(1, text), (2, None)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    from pricewell.plans import search_queries

    got = sorted(tuple(r) for r in search_queries.QUERIES["repair_text"](spark, str(tmp_path)).collect())
    assert got == [(1, k, x) for k, x in enumerate(text.split("\n"), 1)]


def test_publish_points_last(spark, tmp_path):
    df = spark.createDataFrame([("x", 1)], "sku string, market_price long")
    sinks.publish(df, f"file://{tmp_path}/s", f"file://{tmp_path}/state", "run_1", "now")
    assert spark.read.parquet(f"file://{tmp_path}/state/live_run").first()["state_value"] == "run_1"
    sinks.export(df, df, f"file://{tmp_path}/out")
    assert spark.read.json(f"file://{tmp_path}/out/summary").first()["published_snapshots"] == 1
    assert sinks.manifest(spark, f"file://{tmp_path}/out").where("length > 0").count() >= 3


def test_payloads_and_events(spark):
    tasks = spark.createDataFrame([("t", "B", "S", "M", "1", "m", "ok", '{"code": "3", "msg": ""}'), ("u", "B", "S", "M", "1", "m", "ok", "broken")], "task_key string, brand_title string, series_title string, model_title string, code string, msg string, status string, payload_json string")
    assert {(r["task_key"], r["code"], r["msg"]) for r in readers.task_payloads(tasks).collect()} == {("t", "3", "m"), ("u", "1", "m")}
    df = spark.createDataFrame([('{"msgid": "1", "from": "a", "content": " hi ", "time": "2026-01-01 00:00:00"}',), ('{"id": "2", "sender": "b", "text": "x"}',)], "body string")
    assert [(r["message_id"], r["user_id"], r["text"], r["ts"] is None) for r in readers.normalise_events(df).collect()] == [("1", "a", "hi", False), ("2", "b", "x", True)]


def test_blocking_loses_no_match(spark):
    skus = V.reference_rows(spark, SF).select(F.col("id").cast("string").alias("candidate_id"), "brand_title", "series_title", "model_title", "group_title", F.lit("open_allowed").alias("condition_bucket"), F.lit(5).alias("row_count"))
    titles = spark.createDataFrame([(1, "red widget 12G"), (2, "Brand#2 small ring"), (3, "idget"), (4, ""), (5, None), (6, "zzz"), (7, "hot/gear 31g extra")], "row_id long, raw_title string")
    columns = ["row_id", "match_level", "best_score", "candidate_id"]
    full = {tuple(r) for r in T.match_references(titles, skus, block=False).select(*columns).collect()}
    blocked = {tuple(r) for r in T.match_references(titles, skus).select(*columns).collect()}
    strong = lambda rows: {r for r in rows if (r[2] or 0) >= 1780}
    assert strong(full) == strong(blocked) and {r[:2] for r in full} == {r[:2] for r in blocked}


def test_blocking_gives_all_scores(spark):
    """Titles of 1 to 10 tokens, with unknown tokens, models inside one another and shared cores."""
    names = [("Galaxy S24 Ultra 5G", "12+256 Titanium Black"), ("Galaxy S24 Ultra 5G", "12+512 Titanium Black"), ("Galaxy S24", "8+256 Black"), ("Mate60ProPlus", "8+256"), ("小米14Pro", "8+256T 黑"), ("Phone 8GB", "8+128"), ("", "16+1024 only"), ("Pad", "")]
    skus = spark.createDataFrame([(f"c{k}", "Brand", "Series", m, g, "open_allowed", 7 * k) for k, (m, g) in enumerate(names)], "candidate_id string, brand_title string, series_title string, model_title string, group_title string, condition_bucket string, row_count long")
    texts = ["5G S24 Ultra Galaxy 12+256 Titanium Black 现货", "5G S24 Ultra Galaxy 12+256 Titanium Black 现货 顺丰 包邮", "Galaxy S24 8+256 Black new sealed", "Mate60Pro8+256GB", "小米14Pro8+256TB", "Mate 60", "Phone 8GB 8+128", "phone8g8128xx", "zzz", "zzz yyy", "", "pad/zzz", "16+1024", None, "Galaxy S24 Ultra 5G 12+256 Titanium Black", "xx"]
    titles = spark.createDataFrame(list(enumerate([*texts, texts[0]])), "row_id long, raw_title string")
    full, blocked = ({tuple(r) for r in T.match_references(titles, skus, block=b).collect()} for b in (False, True))
    assert full == blocked and len(full) == len(texts) + 1
    assert {r[0]: r[2:5] for r in blocked}[0] == ("exact", 2120.0, "c0")


def test_memory_signatures(spark):
    rows = spark.createDataFrame([("Redmi Note 13 8＋256GB",), ("Mate 60",)], "t string").select(*[c.alias(n) for c, n in zip(T.signatures(F.col("t")), ("core", "model"))]).collect()
    assert [tuple(r) for r in rows] == [("redminote138256", "redminote13"), ("mate60", "mate60")]


def test_phrase_readings():
    assert X.surface("苹果１７ProMax") == "苹果 17 pro max" and X.surface("十七 pro") == "17 pro" and X.numeral_value("二十三") == "23" and X.numeral_value("一二") == "12"
    assert X.alignment_distance("iphnoe", "iphone", 1) == 1 and X.alignment_distance("abc", "xyz", 1) == 2
    got = X.variants("iphnoe 17 256g 黑色", X.Terms(aliases={"iphone": ("苹果",)}, known=("iphone",), colors=("黑色",)))
    assert {"iphone17256g黑色", "苹果17256g黑色"} <= {v["norm"] for v in got} and all(v["capacities"] == ["256"] and v["colors"] == ["黑色"] for v in got)
    assert got[0]["core"] == "iphnoe17" and got[0]["core_tokens"] == ["iphnoe", "17"]
    assert [(v["capacities"], v["core"]) for v in X.variants("1t", X.Terms())] == [(["1t"], "")]


def test_search_finds_families(spark):
    readings = X.expand(spark.createDataFrame([("red widget",), ("red widegt",), ("",), ("256g",)], "query string"), X.Terms(known=("widget", "red")))
    contexts = X.context(readings)
    skus = V.reference_rows(spark, SF).select("brand_title", "series_title", "model_title", "group_title", F.lit("open_allowed").alias("condition_bucket"), F.lit(5).cast("long").alias("row_count"), F.lit(1).cast("long").alias("source_count"), F.lit(1).cast("long").alias("min_price"), F.lit(2).cast("long").alias("max_price"), F.lit("t").alias("latest_imported_at"))
    families = T.model_candidates(skus)
    found = T.search(readings, contexts, families).collect()
    assert {r["query"] for r in found} == {"red widget", "red widegt"} and {r["family_title"] for r in found if r["place"] == 1} == {"red widget"} and max(r["place"] for r in found) <= 6
    full = T.search(readings, contexts, families, block=False)
    assert {tuple(r) for r in full.collect()} == {tuple(r) for r in found}


def test_views_nest_and_refine(spark):
    rows = [("B", "S", "M1", "128G 黑", 10, 100, 90, 110), ("B", "S", "M1", "256G 黑", 30, 200, 190, 210), ("B", "S", "M1", "256G 白", 20, 205, 195, 215), ("B", "S", "M2", "1T", 5, 300, 300, 300)]
    df = spark.createDataFrame([(*r[:4], "open_allowed", r[4], 1, "t", *r[5:]) for r in rows], "brand_title string, series_title string, model_title string, group_title string, condition_bucket string, trusted_sample_count long, source_count long, latest_imported_at string, market_price long, band_low long, band_high long")
    leaf = D.leaves(df)
    flat = D.exploded(D.views(leaf)).orderBy("branch_no", "group_no", "color_no").collect()
    assert [(r["model_title"], r["capacity"], r["color"]) for r in flat] == [("M1", "128G", "黑"), ("M1", "256G", "黑"), ("M1", "256G", "白"), ("M2", "1T", "STANDARD")]
    assert [r["market_price"] for r in D.refine(leaf, ["256g"], ["白"]).collect()] == [205]
    assert D.refine(leaf, ["999g"], []).count() == 4
    assert D.refine(leaf.limit(0), ["256g"], []).count() == 0


def test_items_and_scan(spark):
    pages = spark.createDataFrame([('<option value="0">-</option><option value="7">Seven</option><option value="7">Seven</option>',), (None,)], "html string")
    assert [tuple(r) for r in textscan.items_from_html(pages, '<option value="([^"]*)">([^<]*)</option>').collect()] == [("7", "Seven")]
    bodies = spark.createDataFrame([('{"a": [{"ID": 1, "title": "x", "sub": {"id": "2", "name": "y"}}]}',), ("broken{",), (None,)], "body string")
    assert {tuple(r) for r in textscan.items_from_json(bodies).collect()} == {("1", "x"), ("2", "y")}
    docs = spark.createDataFrame([(1, "fine\nbad �\n中??\nwhat????"), (2, None)], "doc_id long, text string")
    assert {(r["line_no"], r["problem"]) for r in textscan.scan_lines(docs).collect()} == {(2, "replacement_char"), (3, "question_burst"), (4, "question_burst")}


def test_entry_and_catalog(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("margin", [120, 700])
def test_titles_meet_few_candidates(spark, margin):
    """Bounds keep a small part of the pairs that share a token, and every pair that decides; also for titles of a brand, of a
    whole text, of one word, of unknown words, and of nothing."""

    names = [f"{a} {b}" for a in ("red", "blue", "hot", "cold") for b in ("widget", "gizmo", "ring", "bolt")]
    skus = [(f"{b}|{m}|{g}|{c}", f"Brand#{b}", f"TYPE {b % 3}", m, f"color {g}G", c, 1 + (b * 37 + g) % 230) for b in range(12) for m in names for g in (1, 5, 10, 15, 25) for c in ("open_allowed", "strict_target")]
    skus = spark.createDataFrame(skus, "candidate_id string, brand_title string, series_title string, model_title string, group_title string, condition_bucket string, row_count long")
    titles = [f"{m} {g}G" for m in names for g in (1, 5, 10, 33)] + ["red", "brand 3", "Brand#3 TYPE 0", "widget open allowed", "red widget color 5G", "Brand#5 TYPE 2 red ring color 10G strict_target", "type 1 red widget", "nothing known", "gcolor", "", "5G strict", "brand#7 hot bolt 15G unknown"]
    rows = spark.createDataFrame(list(enumerate(titles)), "row_id long, raw_title string")
    met, best = [], T.best_pairs
    try:
        T.best_pairs = lambda *a: (met.append(best(*a)), met[-1])[1]
        got = {tuple(r) for r in T.match_references(rows, skus, margin=margin).collect()}
    finally:
        T.best_pairs = best
    assert got == {tuple(r) for r in T.match_references(rows, skus, margin=margin, block=False).collect()}
    many = met[0].where(F.col("raw_title").isin(titles[:64]))
    assert margin > 120 or many.select("raw_title", "candidate_id").distinct().count() == many.count() < 64 * 1920 / 20
