"""Search with the phone market's terms on a small catalog, against what a dealer expects, and against plain Python."""

import pytest
from pyspark.sql import functions as F

from pricewell.functions import phrases as X
from pricewell.operators import detail as D
from pricewell.operators import matching as T

TERMS = X.load_terms()
CATALOG = [
    ("苹果", "iPhone 17", "17", ("256G 黑色", "512G 白色"), 80), ("苹果", "iPhone 17 Pro", "17 Pro", ("256G 银色",), 60), ("苹果", "iPhone 17 Pro Max", "17 Pro Max", ("256G 星宇橙", "512G 深蓝色"), 70),
    ("苹果", "配件", "Apple充电头/数据线", ("20W 充电头",), 40), ("苹果", "配件", "Apple原装保护壳", ("iPhone 17 保护壳",), 50), ("苹果", "iPad", "iPad Air 11寸 M3", ("128G 蓝色",), 20), ("苹果", "AirPods", "AirPods Pro 3", ("标准款",), 30),
    ("红米", "K系列", "Redmi K80", ("12+256G 黑",), 30), ("红米", "K系列", "Redmi K80 至尊版", ("12+256G 黑",), 25), ("华为", "Mate", "Mate80RS 非凡大师", ("16+512G 黑",), 20), ("华为", "Mate", "Mate80", ("12+256G 黑",), 22), ("联想", "小新", "小新14SE(14C) 2025款", ("16+512G 灰",), 12),
]


@pytest.fixture(scope="module")
def found(spark):
    rows = [(b, s, m, g, "open_allowed", n, 5, 100, 200, "2026-01-01") for b, s, m, gs, n in CATALOG for g in gs]
    skus = spark.createDataFrame(rows, "brand_title string, series_title string, model_title string, group_title string, condition_bucket string, row_count long, source_count long, min_price long, max_price long, latest_imported_at string")
    families = T.model_candidates(skus, TERMS)

    def run(*phrases, block=True):
        readings = X.expand(spark.createDataFrame([(p,) for p in phrases], "query string"), TERMS)
        return T.search(readings, X.context(readings, TERMS), families, block=block, terms=TERMS)

    run.families, run.skus = families, skus
    return run


def test_dealers_phrases_find_their_family(found):
    want = {"ping guo 17 pm": "iPhone 17 Pro Max", "hong mi k80": "Redmi K80", "苹果17 256": "iPhone 17", "苹果20w": "Apple充电头/数据线", "mate80rs": "Mate80RS 非凡大师", "xiao xin 14 se": "小新14SE(14C) 2025款", "iphnoe 17 pro": "iPhone 17 Pro", "k80至尊": "Redmi K80 至尊版", "苹果平板": "iPad Air", "苹果耳机": "AirPods Pro 3"}
    top = {r["query"]: r["family_title"] for r in found(*want, "白色 512", "").collect() if r["place"] == 1}
    want["苹果平板"] = "iPad Air"
    assert top == want


def test_devices_come_before_accessories(found):
    got = [r["family_title"] for r in found("苹果17").orderBy("place").collect()]
    assert got[0] == "iPhone 17" and set(got[1:3]) == {"iPhone 17 Pro", "iPhone 17 Pro Max"} and "Apple原装保护壳" not in got


def test_only_refining_phrases_and_context(spark, found):
    readings = X.expand(spark.createDataFrame([("白色 512",), ("苹果20w",), ("mate80",), ("ab12",)], "query string"), TERMS)
    got = {r["query"]: r for r in X.context(readings, TERMS).collect()}
    assert got["白色 512"]["only_refinement"] and got["白色 512"]["capacity_hints"] == ["512"] and got["白色 512"]["color_hints"] == ["白色"] and not got["白色 512"]["has_core"]
    assert "charger" in got["苹果20w"]["category_intents"] and not got["苹果20w"]["wants_device"] and got["苹果20w"]["series_hints"] == []
    assert got["mate80"]["series_hints"] == ["mate"] and got["mate80"]["brand_hints"] == ["华为"] and got["mate80"]["wants_device"]
    assert got["ab12"]["bare_model"] and found("白色 512").count() == 0


def plain_score(reading, f):
    """The tier of one reading (norm, tokens) against a family row, in plain Python."""
    q, tokens = reading
    if not q:
        return -1
    label, series, alias, first, second = f["label_norm"], f["series_norm"], f["alias_texts"], f["first_texts"], f["second_texts"]
    best = 4200 if label == q else 3200 if label.endswith(q) else 2850 if label.startswith(q) else 2250 if q in label else 0
    best = max(best, 3600 if q in alias else 2900 if any(a.endswith(q) for a in alias) else 2100 if any(q in a for a in alias) else 0)
    best = max(best, 3000 if series == q else 2100 if series.startswith(q) else 1600 if q in series else 0)
    best = max(best, 3400 if q in first else 0, 3000 if q in second else 0)
    best = max(best, 2500 if any(t.startswith(q) for t in first) else 2050 if any(q in t for t in first) else 1650 if any(t.startswith(q) for t in second) else 1350 if any(q in t for t in second) else 0)
    others, met = [t for t in tokens if t and t != q], 0
    for t in others:
        gain = 440 if any(t in x for x in first) else 260 if any(t in x for x in second) else 0
        best, met = best + gain, met + (gain > 0)
    if others and met == len(others):
        return best + 320
    if met:
        return best - (len(others) - met) * 260
    return best if best > 0 else -1


def test_scores_against_plain_python(spark, found):
    phrases = ["ping guo 17 pm", "苹果17 256 黑色", "苹果20w", "mate80", "k80", "pro", "苹果壳", "xiaoxin", "17", "红米 平板", "zzz"]
    readings = X.expand(spark.createDataFrame([(p,) for p in phrases], "query string"), TERMS)
    families, contexts = found.families.collect(), {r["query"]: r for r in X.context(readings, TERMS).collect()}
    want = {}
    for p in phrases:
        own, c = [r for r in readings.collect() if r["query"] == p], contexts[p]
        for f in families:
            best = max(plain_score((r["norm"], r["tokens"]), f) for r in own)
            core = max(plain_score((r["core"], r["core_tokens"]), f) for r in own)
            best = max(best, core + 720) if core >= 0 else best
            if best < 0 or c["only_refinement"]:
                continue
            kind, intents = f["category_kind"], c["category_intents"]
            if c["brand_hints"]:
                best += 1850 if f["brand_title"] in c["brand_hints"] else -900
            if c["series_hints"]:
                n = sum(h in f["all_text"] for h in c["series_hints"])
                best += n * 950 if n else -850
            if intents:
                soft = any(k in intents and any(w in f["keyword_text"] for w in TERMS.categories[k]) for k in ("charger", "case", "accessory"))
                if kind not in intents and not soft:
                    continue
                best += 1450 if kind in intents else 820
            else:
                if c["bare_model"]:
                    best += 520 if kind == "phone" else -900
                else:
                    best += 120 if kind == "phone" else -420 if kind in ("charger", "case") else -180 if kind in ("earbuds", "tablet", "wearable", "laptop") else 0
                if c["wants_device"]:
                    if kind in ("charger", "case", "accessory"):
                        continue
                    best += 260 if kind == "phone" else -540 if kind in ("earbuds", "tablet", "wearable", "laptop") else 0
            if c["capacity_hints"]:
                n = sum(any(h in t for t in f["variant_texts"]) for h in c["capacity_hints"])
                best += n * 220 if n else -min(len(c["capacity_hints"]) * 120, 280) if c["has_core"] else 0
            best += 180 * sum(any(h in t for t in f["variant_texts"]) for h in c["color_hints"])
            best += min(f["row_count"], 500) + min(f["variant_count"] * 25, 180) + min(f["source_count"] * 4, 120)
            if best >= 0:
                want[p, f["candidate_id"]] = best
    got = {(r["query"], r["candidate_id"]): r["score"] for r in found(*phrases).collect()}
    full = {(r["query"], r["candidate_id"]): r["score"] for r in found(*phrases, block=False).collect()}
    assert got == full and all(want[k] == v for k, v in got.items()) and len(got) == sum(min(6, sum(k[0] == p for k in want)) for p in phrases)


def test_preferences_and_decisions(spark):
    rows = [("17", 1, "a", "苹果", "iPhone 17", 5000), ("17", 2, "b", "华为", "Mate 17", 3000), ("17", 3, "c", "苹果", "iPhone 17 Pro", 2900), ("x", 1, "d", "A", "x", 10), ("x", 2, "e", "A", "y", 9), ("one", 1, "f", "A", "same", 5), ("one", 2, "g", "B", "Same", 5)]
    results = spark.createDataFrame(rows, "query string, place int, candidate_id string, brand_title string, family_title string, score int")
    wants = spark.createDataFrame([("17", "apple", "17 pro"), ("x", None, None)], "query string, preferred_brand string, preferred_family string")
    ranked = T.preferred(results, wants, {"苹果": ("apple", "iphone")})
    got = [(r["candidate_id"], r["points"]) for r in ranked.where("query = '17'").orderBy("place").collect()]
    # the brand's rows; 17 inside iphone17pro: 180, shared run 17: 18; brand 220; the line inside 140, or bare inside 110 and a run
    assert got == [("c", 180 + 18 + 220 + 140), ("a", 180 + 18 + 220 + 110 + 18)]
    phrases = spark.createDataFrame([("17",), ("x",), ("one",), ("none",)], "query string")
    made = {r["query"]: (r["decision"], r["clear"]) for r in T.decisions(phrases, ranked).collect()}
    assert made == {"17": ("ambiguous", True), "x": ("single", True), "one": ("single", True), "none": ("none", False)}
    plain = spark.createDataFrame([("q", k, f"l{k}", 100 - k, 1000 - 400 * k) for k in range(1, 4)], "query string, place int, family_title string, points int, score int")
    assert [tuple(r)[:2] for r in T.decisions(plain.select("query"), plain).collect()] == [("q", "ambiguous")] and T.decisions(plain.select("query"), plain).first()["clear"]


def test_refined_views(spark):
    rows = [("苹果", "iPhone 17", "iPhone 17 Pro", c, g, "open_allowed", 10, 1, "t", p, p - 5, p + 5) for c, g, p in (("256G", "黑色", 100), ("256G", "白色", 105), ("512G", "白色", 200), ("512G", "左耳 白色", 50))]
    leaf = spark.createDataFrame([(b, s, m, f"{c} {g}", k, n, q, t, p, lo, hi, c, g) for b, s, m, c, g, k, n, q, t, p, lo, hi in rows], "brand_title string, series_title string, model_title string, group_title string, condition_bucket string, trusted_sample_count long, source_count long, latest_imported_at string, market_price long, band_low long, band_high long, capacity string, color string")
    asks = [(1, "白色512", ["白色", "512"], ["512"], ["白色"]), (2, "iphone17", ["iphone17"], [], []), (3, "", [], [], []), (4, "17pro", ["17pro"], [], []), (5, "1t", ["1t"], ["1t"], []), (6, "左耳", ["左耳"], [], []), (7, "zzz", ["zzz"], [], [])]
    requests = spark.createDataFrame([(i, "苹果", "iPhone 17", q, t, c, k) for i, q, t, c, k in asks], "request_id long, brand_title string, series_title string, q string, tokens array<string>, capacities array<string>, colors array<string>")
    kept, why = D.refined(leaf, requests, ("iphone", "苹果"), ("左耳",))
    assert {r["request_id"]: (r["reason"], r["colors_left"]) for r in why.collect()} == {1: ("applied", 1), 2: ("not_applicable", 0), 3: ("empty_query", 0), 4: ("applied", 4), 5: ("no_match", 0), 6: ("applied", 3), 7: ("not_applicable", 0)}
    left = lambda i: sorted((r["capacity"], r["color"]) for r in kept.where(F.col("request_id") == i).collect())
    assert left(1) == [("512G", "白色")] and left(6) == [("256G", "白色"), ("256G", "黑色"), ("512G", "左耳 白色")] and left(5) == []
    one = kept.where("request_id = 1").first()
    # matched 160; 白色512 is not inside 512g白色白色: 0; 白色 140 and 512 begins: 220; colour 80, capacity 80; group 220 + 120 + 80
    assert one["leaf_points"] == 160 + 140 + 220 + 80 + 80 and one["group_points"] == one["leaf_points"] + 420 and one["branch_points"] == one["group_points"]
    assert D.refined(leaf.limit(0), requests)[1].where("reason = 'applied'").count() == 0 and D.refined(leaf, requests.limit(0))[0].count() == 0


def test_branch_markets_build_the_snapshots_once(spark):
    from pricewell.plans import search_queries

    made = search_queries.QUERIES["branch_markets"](spark, "/root/testdata/sf0.001")
    assert any("snapshots" in f for f in made.inputFiles())
    assert made._jdf.queryExecution().optimizedPlan().toString().count("percentile") == 0
    origins = {r["origin"] for r in made.select("origin").distinct().collect()}
    assert "computed" in origins


@pytest.mark.parametrize("name", ["refined_details", "refinement_reasons"])
def test_refinements_build_the_market_once(spark, name):
    from pricewell.plans import search_queries

    made = search_queries.QUERIES[name](spark, "/root/testdata/sf0.001")
    assert not any("lineitem" in f for f in made.inputFiles()) and any("leaves" in f for f in made.inputFiles())
    assert made.count() > 0
