"""Queries of reference matching, search, detail views and text scans."""

from __future__ import annotations

from pyspark.sql import functions as F

from pricewell.functions import columns as P
from pricewell.functions import phrases as X
from pricewell.operators import detail as D
from pricewell.operators import market as M
from pricewell.operators import matching as T
from pricewell.operators import reports, textscan
from pricewell.plans import sql
from pricewell.plans.market_queries import references
from pricewell.plans.sql import S
from pricewell.settled import settle
from pricewell.sources import views as V

QUERIES, ORACLES = {}, {}


def query(oracle: str | None = None, name: str | None = None):
    def add(f):
        QUERIES[name or f.__name__] = f
        if oracle:
            ORACLES[name or f.__name__] = oracle
        return f

    return add


def skus(spark, d):
    """One candidate per SKU, with a stable id."""
    return reports.sku_catalog(V.quotes(spark, d)).withColumn("candidate_id", F.concat_ws("|", *reports.LINE))


def titles(spark, d):
    return V.reference_rows(spark, d).select(F.col("id").alias("row_id"), "raw_title", "source_title")


_N = lambda x: f"regexp_replace(lower({x}),'[^\\p{{L}}\\p{{N}}]','','g')"
MATCH = f"""WITH {sql.QUOTES}, {sql.REFERENCES}, c AS (SELECT {S}, count(*) AS row_count FROM quotes GROUP BY {S}),
cc AS (SELECT *, concat_ws('|',{S}) AS candidate_id, {_N(f"concat_ws('',{S})")} AS c_full, {_N("model_title||group_title")} AS c_group, {_N("model_title||group_title")} AS c_core, {_N("model_title")} AS c_model FROM c),
q AS (SELECT id AS row_id, raw_title, {_N("raw_title")} AS q_norm, list_transform(string_split(raw_title,' '), lambda t: {_N("t")}) AS toks FROM refs),
p AS (SELECT q.row_id, cc.*, q_norm, CASE WHEN c_core=q_norm THEN 2600 WHEN starts_with(c_core,q_norm) OR starts_with(q_norm,c_core) THEN 1900 ELSE 0 END + CASE WHEN c_model=q_norm THEN 700 WHEN contains(q_norm,c_model) OR contains(c_model,q_norm) THEN 320 ELSE 0 END + CASE WHEN c_group=q_norm THEN 3400 ELSE 0 END + CASE WHEN c_full=q_norm THEN 3000 ELSE 0 END
 + CASE WHEN starts_with(c_group,q_norm) THEN 2200 WHEN contains(c_group,q_norm) THEN 1800 WHEN starts_with(c_full,q_norm) THEN 1500 WHEN contains(c_full,q_norm) THEN 1200 ELSE 0 END
 + list_sum(list_transform(list_filter(toks, lambda t: t<>'' AND t<>q_norm), lambda t: CASE WHEN contains(c_group,t) THEN 320 WHEN contains(c_full,t) THEN 200 ELSE -120 END)) + least(row_count,200)*0.2::DOUBLE AS score FROM q, cc),
r AS (SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY score DESC, candidate_id) AS place, coalesce(lead(score) OVER (PARTITION BY row_id ORDER BY score DESC, candidate_id),0) AS nxt, count(*) OVER (PARTITION BY row_id, score, brand_title, series_title, model_title) AS fam FROM p WHERE score>0)
SELECT row_id, CASE WHEN score>=1900 AND (score-nxt>=120 OR nxt=0) THEN 'exact' WHEN score>=1900 AND (fam>=2 OR (c_core=q_norm AND c_model=q_norm)) THEN 'model_only' ELSE 'unmatched' END AS match_level, round_even(score,3) AS best_score, candidate_id FROM r WHERE place=1"""


@query(MATCH)
def match_references(spark, d):
    """Every sheet title against the catalog, blocked."""
    return T.match_references(titles(spark, d), skus(spark, d)).select("row_id", "match_level", "best_score", "candidate_id")


@query(f"""WITH m AS ({MATCH}), t AS (SELECT p_type AS source_title, coalesce(match_level,'unmatched') AS match_level FROM part LEFT JOIN m ON row_id=p_partkey) SELECT source_title, count(*) AS row_count, count(CASE WHEN match_level<>'unmatched' THEN 1 END) AS matched_count, count(CASE WHEN match_level='unmatched' THEN 1 END) AS external_count FROM t GROUP BY 1 UNION ALL SELECT '*', count(*), count(CASE WHEN match_level<>'unmatched' THEN 1 END), count(CASE WHEN match_level='unmatched' THEN 1 END) FROM t""")
def import_preview(spark, d):
    """Matched and external rows per source."""
    made = T.match_references(titles(spark, d), skus(spark, d)).select("row_id", "match_level")
    return reports.import_preview(titles(spark, d).join(made, "row_id", "left").withColumn("match_level", F.coalesce("match_level", F.lit("unmatched"))))


@query(f"""WITH {sql.REFERENCES} SELECT brand_title, series_title, model_title||'-'||group_title AS sku_title, {sql.pct("reference_price", 0.5)} AS reference_price, arg_max(source_title, id) AS source_title, max(imported_at) AS fetched_at, count(*) AS n FROM refs GROUP BY 1,2,3""")
def external_references(spark, d):
    """A13."""
    return T.external_references(V.reference_rows(spark, d))


@query(f"""WITH {sql.REFERENCES} SELECT {_N("raw_title")} AS external_key, count(*) AS row_count, min(reference_price) AS min_price, max(reference_price) AS max_price, max(imported_at) AS latest_imported_at, arg_max(raw_title, id) AS external_title FROM refs GROUP BY 1""")
def external_candidates(spark, d):
    """A14."""
    return T.external_candidates(V.reference_rows(spark, d))


@query(f"""WITH {sql.REFERENCES} SELECT {_N("raw_title")} AS external_key, {sql.pct("reference_price", 0.5)} AS market_price, min(reference_price)||'-'||max(reference_price) AS price_range FROM refs GROUP BY 1""")
def external_detail(spark, d):
    """A15, P25."""
    return T.external_detail(V.reference_rows(spark, d))


@query(f"""WITH {sql.QUOTES}, s AS (SELECT {S}, count(*) AS row_count, count(DISTINCT sname) AS source_count, min(CAST(price_text AS BIGINT)) AS min_price, max(CAST(price_text AS BIGINT)) AS max_price, max(imported_at) AS latest_imported_at FROM quotes GROUP BY {S})
SELECT brand_title, series_title, model_title AS family_title, sum(row_count) AS row_count, max(source_count) AS source_count, count(DISTINCT group_title) AS variant_count, count(DISTINCT model_title) AS branch_count, min(min_price) AS min_price, max(max_price) AS max_price, max(latest_imported_at) AS latest_imported_at FROM s GROUP BY 1,2,3""")
def model_candidates(spark, d):
    """Product families."""
    return T.model_candidates(skus(spark, d)).select("brand_title", "series_title", "family_title", "row_count", "source_count", "variant_count", "branch_count", "min_price", "max_price", "latest_imported_at")


def _phrases(spark, d):
    """Phrases over the whole catalog: a model with its brand or its size, some misspelt."""
    part = V.table(spark, d, "part")
    name = F.when(F.col("p_partkey") % 7 == 0, F.regexp_replace("p_name", "widget", "widegt")).otherwise(F.col("p_name"))
    return part.select(F.concat_ws(" ", F.lower("p_brand"), name, F.when(F.col("p_partkey") % 2 == 0, F.concat(F.col("p_size").cast("string"), F.lit("G")))).alias("query")).distinct()


WORDS = ("widget", "gizmo", "bolt", "gear", "ring", "small", "large", "red", "blue", "green", "cold", "hot")
CATEGORIES = {"ring": ("ring",), "bolt": ("bolt",)}
#: The stand-in catalog's terms; they put the same branches to work that the phone market's do.
TERMS = X.Terms(
    aliases={"gizmo": ("gadget",)}, spelled={"redwidget": ("red widget",)}, known=WORDS, code_tails=("g",), colors=("red", "blue"), brands={f"Brand#{i}": (f"brand {i} ",) for i in range(1, 26)}, series={"small": ("small",), "hot": ("hot",)}, primary_series=("hot",), categories=CATEGORIES,
    bridges=({"find": "gear", "give": ("cog",)}, {"of": ("ring",), "find": r"\bhot (\w+)", "whole": (r"\1 ring",)}), shorthand={"g": ("gear",)}, family_short={"widget": ("wgt",)},
)


def _readings(spark, d):
    return X.expand(_phrases(spark, d), TERMS)


_APART = lambda x: f"trim(regexp_replace(regexp_replace(regexp_replace({x},'[^a-z0-9]+',' ','g'),'([0-9])([a-z])','\\1 \\2','g'),'([a-z]{{2,}})([0-9])','\\1 \\2','g'))"
_HINTS = lambda words, one: "concat_ws(','," + ",".join(f"CASE WHEN {one(w)} THEN '{w}' END" for w in sorted(words)) + ")"
_INSIDE = lambda w: f"contains(texts,'{w}')"


@query(f"""WITH p AS (SELECT DISTINCT lower(p_brand)||' '||CASE WHEN p_partkey%7=0 THEN replace(p_name,'widget','widegt') ELSE p_name END||CASE WHEN p_partkey%2=0 THEN ' '||p_size||'G' ELSE '' END AS query FROM part),
s AS (SELECT query, {_APART("lower(query)")} AS written, regexp_replace(lower(query),'[^a-z0-9]+','','g') AS shut FROM p),
w AS (SELECT query, unnest(string_split(written,' ')) AS token, generate_subscripts(string_split(written,' '),1) AS i FROM s),
known AS (SELECT unnest({list(WORDS)!r}) AS word, generate_subscripts({list(WORDS)!r},1) AS place),
m AS (SELECT token, arg_min(word, struct_pack(d := damerau_levenshtein(token,word), p := place)) AS word FROM (SELECT DISTINCT token FROM w WHERE regexp_matches(token,'^[a-z]{{3,}}$')), known WHERE damerau_levenshtein(token,word) <= CASE WHEN length(word)<=5 THEN 1 ELSE 2 END GROUP BY 1),
r AS (SELECT query, string_agg(coalesce(word,token),' ' ORDER BY i) AS mended FROM w LEFT JOIN m USING (token) GROUP BY 1),
x AS (SELECT query, written, mended, array_to_string(list_transform(range(1,length(shut)+1), lambda i: CASE WHEN regexp_matches(substr(' '||shut,i,1)||substr(shut||' ',i+1,1),'[0-9]') THEN translate(substr(shut,i,1),'oil','011') ELSE substr(shut,i,1) END),'') AS digits FROM s JOIN r USING (query)),
t AS (SELECT query, written, regexp_replace(written||chr(10)||mended||chr(10)||{_APART("digits")},'([0-9]) (gb?|tb?)\\b','\\1\\2','g') AS closed, written||chr(10)||mended||chr(10)||{_APART("digits")} AS texts FROM x),
k AS (SELECT *, regexp_split_to_array(closed,'\\s') AS toks FROM t),
c AS (SELECT query, {_HINTS([f"Brand#{i}" for i in range(1, 26)], lambda b: f"contains(texts,'brand {b[6:]} ')")} AS brand_hints, {_HINTS(("small", "hot"), _INSIDE)} AS series_hints, {_HINTS(CATEGORIES, _INSIDE)} AS category_intents,
 array_to_string(list_sort(list_distinct(list_transform(list_filter(toks, lambda y: regexp_matches(y,'^([0-9]+[gt]b?|64|128|256|512|1024|2048)$')), lambda y: regexp_replace(y,'^(64|128|256|512|1024|2048)gb?$','\\1')))),',') AS capacity_hints, {_HINTS(("red", "blue"), lambda h: f"list_contains(toks,'{h}')")} AS color_hints,
 len(list_filter(toks, lambda y: NOT regexp_matches(y,'^([0-9]+[gt]b?|64|128|256|512|1024|2048)$') AND y NOT IN ('red','blue')))>0 AS has_core, len(list_filter(string_split(written,' '), lambda y: NOT regexp_matches(y,'^[a-z]$')))<=3 AS short FROM k)
SELECT query, brand_hints, series_hints, category_intents, capacity_hints, color_hints, short AND brand_hints='' AND category_intents='' AS bare_model, (capacity_hints<>'' OR color_hints<>'') AND NOT has_core AS only_refinement, has_core, category_intents='' AND (contains(series_hints,'hot') OR (short AND brand_hints='')) AS wants_device FROM c""")
def query_context(spark, d):
    """Hints of every phrase, over all its readings; lists joined by commas."""
    made = X.context(_readings(spark, d), TERMS)
    lists = ("brand_hints", "series_hints", "category_intents", "capacity_hints", "color_hints")
    return made.select("query", *[F.array_join(c, ",").alias(c) for c in lists], "bare_model", "only_refinement", "has_core", "wants_device")


@query("""WITH p AS (SELECT DISTINCT unnest(string_split(lower(regexp_replace(p_name,'^([a-z])([a-z])','\\2\\1')),' ')) AS token FROM part), t AS (SELECT token FROM p WHERE regexp_matches(token,'^[a-z]{3,}$')), l AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text),'[a-z]{3,12}')) AS word FROM documents UNION SELECT DISTINCT unnest(string_split(lower(p_name),' ')) FROM part),
m AS (SELECT token, word, damerau_levenshtein(token, word) AS d FROM t, l WHERE abs(length(token)-length(word)) <= 2), n AS (SELECT *, row_number() OVER (PARTITION BY token ORDER BY d, word) AS k FROM m WHERE d <= CASE WHEN length(word)<=5 THEN 1 ELSE 2 END) SELECT token, word FROM n WHERE k=1""")
def mended_words(spark, d):
    """Misspelt words of product names against the lexicon of all words of documents and names, by shortened forms."""
    part, docs = V.table(spark, d, "part"), V.table(spark, d, "documents")
    tokens = part.select(F.explode(F.split(F.lower(F.regexp_replace("p_name", "^([a-z])([a-z])", "$2$1")), " ")).alias("token"))
    words = docs.select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("([a-z]{3,12})"), F.lit(1))).alias("word")).unionByName(part.select(F.explode(F.split(F.lower("p_name"), " ")).alias("word")))
    lexicon = settle(words.distinct().withColumn("place", F.col("word")), "lexicon")
    return X.mends(tokens.where(F.col("token").rlike("^[a-z]{3,}$")), lexicon)


def _search(spark, d):
    readings = settle(_readings(spark, d), "readings")
    families = settle(T.model_candidates(skus(spark, d), TERMS), "families")
    return T.search(readings, X.context(readings, TERMS), families, terms=TERMS)


@query()
def product_search(spark, d):
    """The six best families per phrase, by text tiers and aliases, hints, categories and popularity."""
    return _search(spark, d)


@query()
def search_decisions(spark, d):
    """Relative cut-off, preferences and the answer decision of every phrase."""
    phrases = _phrases(spark, d)
    found = T.relative_cut(_search(spark, d), 60, 2000)
    wants = phrases.select("query", F.concat(F.lit("Brand#"), F.regexp_extract("query", "brand#([0-9]+)", 1)).alias("preferred_brand"), F.regexp_extract("query", "(red|blue|hot|cold) [a-z]+", 0).alias("preferred_family"))
    return T.decisions(phrases, T.preferred(found, wants, {"Brand#1": ("first",)}))


@query(f"""WITH {sql.QUOTES}, s AS (SELECT {S}, count(*) AS row_count, count(DISTINCT sname) AS source_count, max(imported_at) AS latest_imported_at, CASE WHEN condition_bucket='strict_target' THEN 120 WHEN condition_bucket='open_allowed' THEN 110 WHEN contains(condition_bucket,'allowed') THEN 90 WHEN contains(condition_bucket,'review') THEN 30 WHEN contains(condition_bucket,'excluded') THEN 10 WHEN contains(condition_bucket,'non_target') THEN 5 ELSE 40 END AS pr FROM quotes GROUP BY {S}),
f AS (SELECT brand_title, series_title, model_title, concat_ws('|',brand_title,series_title,model_title) AS candidate_id, max(pr) AS pr, sum(row_count) AS rc, count(DISTINCT group_title) AS vc, max(source_count) AS sc, max(latest_imported_at) AS lat FROM s GROUP BY 1,2,3),
o AS (SELECT *, row_number() OVER (ORDER BY CASE WHEN contains(model_title,'ring') OR contains(model_title,'bolt') THEN 1 ELSE 0 END, pr DESC, rc DESC, vc DESC, sc DESC, lat DESC, candidate_id) AS place FROM f) SELECT place, candidate_id, model_title AS label FROM o WHERE place<=8""")
def hot_list(spark, d):
    """The eight most wanted families."""
    return T.hot_list(T.model_candidates(skus(spark, d)), T.category(F.col("family_title"), list(CATEGORIES.items())))


def _snapshots(spark, d):
    return M.live_snapshot(V.quotes(spark, d), V.demo_rules(), references(spark, d))


LEAF = f"WITH {sql.CLUSTERS}, t AS (SELECT {S}, count(DISTINCT lower(sname)) AS source_count, max(imported_at) AS latest_imported_at FROM quotes GROUP BY {S}), leaf AS (SELECT s.*, source_count, latest_imported_at, regexp_extract(group_title,'[0-9]+G') AS capacity, 'color' AS color FROM snaps s JOIN t USING ({S}))"


@query(LEAF + """, b AS (SELECT brand_title, series_title, model_title, row_number() OVER (PARTITION BY brand_title, series_title ORDER BY max(trusted_sample_count) DESC, model_title)-1 AS branch_no FROM leaf GROUP BY 1,2,3), g AS (SELECT brand_title, series_title, model_title, capacity, row_number() OVER (PARTITION BY brand_title, series_title, model_title ORDER BY CAST(regexp_extract(capacity,'[0-9]+') AS INT), capacity)-1 AS group_no FROM leaf GROUP BY 1,2,3,4)
SELECT brand_title, series_title, branch_no, model_title, group_no, capacity, row_number() OVER (PARTITION BY brand_title, series_title, model_title, capacity ORDER BY trusted_sample_count DESC, source_count DESC, color, market_price, price_range)-1 AS color_no, color, market_price AS price FROM leaf JOIN b USING (brand_title, series_title, model_title) JOIN g USING (brand_title, series_title, model_title, capacity)""")
def detail_views(spark, d):
    """Nested views as leaf rows, in order."""
    return D.exploded(D.views(D.leaves(_snapshots(spark, d)))).drop("price_range")




@query(LEAF + """ SELECT brand_title, series_title, model_title, capacity, arg_max(market_price, struct_pack(a := trusted_sample_count, b := source_count, c := latest_imported_at, d := color, e := condition_bucket)) AS market_price, count(*) AS n_colors, max(trusted_sample_count) AS sample, max(latest_imported_at) AS latest FROM leaf GROUP BY 1,2,3,4""")
def capacity_leaders(spark, d):
    """The leading variant of each capacity group."""
    return D.group_leaders(D.leaves(_snapshots(spark, d))).select(*D.GROUP, "market_price", "n_colors", "sample", "latest")


@query(LEAF + """, h AS (SELECT *, capacity IN ('12G','30G') AS hit, max(CASE WHEN capacity IN ('12G','30G') THEN 1 ELSE 0 END) OVER (PARTITION BY brand_title, series_title) AS hits FROM leaf) SELECT brand_title, series_title, model_title, group_title, condition_bucket, market_price FROM h WHERE hit OR hits=0""")
def refine_views(spark, d):
    """N1 in its plain form: leaf rows that a capacity and a colour leave (refined_details has the scored form)."""
    return D.refine(D.leaves(_snapshots(spark, d)), ["12g", "30g"], ["purple"]).select(*M.SKU, "market_price")


def _settled_leaves(spark, d):
    """Leaf rows settled: a refinement reads them twice, for the vocabulary and the leaves, and the market is built once."""
    return settle(D.leaves(_snapshots(spark, d)), "leaves")


_TEXT_POINTS = lambda text, q: f"CASE WHEN {text}='' OR {q}='' THEN 0 WHEN {text}={q} THEN 320 WHEN starts_with({text},{q}) THEN 220 WHEN contains({text},{q}) THEN 140 ELSE 0 END"
#: The refinement of detail views step by step: requests, vocabulary, leaf points, groups; `left_over` holds the rows that stay.
REFINED = LEAF + f""", lines AS (SELECT p_brand AS brand_title, p_type AS series_title, min(p_name) AS m, ('0x'||substr(md5(p_brand||'|'||p_type),1,8))::BIGINT % 6 AS k FROM part GROUP BY 1,2),
asked AS (SELECT *, brand_title||'|'||series_title AS request_id, CASE k WHEN 0 THEN '12G' WHEN 1 THEN '30g color' WHEN 2 THEN m WHEN 3 THEN 'unheard of' WHEN 4 THEN 'the phone 12g' ELSE '' END AS phrase FROM lines),
asked2 AS (SELECT brand_title, series_title, request_id, {_N("phrase")} AS q, list_filter(list_transform(string_split(lower(phrase),' '), lambda t: {_N("t")}), lambda t: t<>'') AS toks FROM asked),
asked3 AS (SELECT *, list_filter(toks, lambda t: regexp_matches(t,'^[0-9]+g$')) AS caps, list_filter(toks, lambda t: t='color') AS cols FROM asked2),
w0 AS (SELECT DISTINCT brand_title, series_title, unnest([{_N("series_title")},{_N("model_title")},{_N("capacity")},{_N("color")},{_N("group_title")}]) AS w FROM leaf),
w1 AS (SELECT brand_title, series_title, w FROM w0 UNION SELECT brand_title, series_title, regexp_replace(w,'^iphone','') FROM w0),
w2 AS (SELECT brand_title, series_title, list(w) AS words FROM (SELECT * FROM w1 UNION SELECT brand_title, series_title, replace(w,'promax','pm') FROM w1) WHERE w<>'' GROUP BY 1,2),
known AS (SELECT a.*, CASE WHEN q='' THEN 'empty_query' WHEN len(toks)=0 OR contains(q,'phone') OR words IS NULL OR (len(caps)=0 AND len(cols)=0 AND len(list_filter(toks, lambda t: len(list_filter(words, lambda v: contains(v,t) OR contains(t,v)))=0))>0) THEN 'not_applicable' END AS why FROM asked3 a LEFT JOIN w2 USING (brand_title, series_title)),
r0 AS (SELECT leaf.*, request_id, q, toks, caps, cols, {_N("group_title||color")} AS txt, {_N("capacity")} AS cap FROM leaf JOIN known USING (brand_title, series_title) WHERE why IS NULL),
r1 AS (SELECT *, len(list_filter(caps, lambda h: NOT contains(cap,h)))=0 AS in_group, len(list_filter(caps, lambda h: NOT contains(txt,h)))=0 AS in_text, len(cols)=0 OR len(list_filter(cols, lambda c: contains(c,txt) OR contains(txt,c)))>0 AS hued,
 coalesce(list_sum(list_transform(toks, lambda t: CASE WHEN txt=t THEN 320 WHEN starts_with(txt,t) THEN 220 WHEN contains(txt,t) OR contains(t,txt) THEN 140 ELSE 0 END)),0) AS tp FROM r0),
r2 AS (SELECT *, len(toks)>0 AND len(cols)=0 AND (len(caps)=0 OR NOT in_group) AS by_text, in_group OR in_text AS sized FROM r1),
r3 AS (SELECT *, sized AND hued AND (NOT by_text OR tp>0) AS matched FROM r2),
r4 AS (SELECT *, CASE WHEN matched THEN 160 ELSE 0 END + {_TEXT_POINTS("txt", "q")} + tp + CASE WHEN hued THEN 80 ELSE 0 END + CASE WHEN sized THEN 80 ELSE 0 END AS leaf_points, matched OR (len(cols)=0 AND NOT by_text) AS kept0, NOT contains(txt,'small') OR contains(q,'small') AS whole FROM r3),
r5 AS (SELECT *, kept0 AND (whole OR NOT bool_or(kept0 AND whole) OVER g) AS kept FROM r4 WINDOW g AS (PARTITION BY request_id, model_title, capacity)),
r6 AS (SELECT *, bool_or(kept) OVER g AS any_kept, coalesce(max(CASE WHEN kept THEN leaf_points END) OVER g,0) AS lead_points FROM r5 WINDOW g AS (PARTITION BY request_id, model_title, capacity)),
r7 AS (SELECT *, in_group OR any_kept AS cm, {_TEXT_POINTS("cap", "q")}>0 OR len(list_filter(toks, lambda t: contains(cap,t)))>0 AS gt FROM r6),
r8 AS (SELECT *, cm AND (len(cols)=0 OR any_kept) AS gm FROM r7),
left_over AS (SELECT * FROM r8 WHERE (kept OR NOT any_kept) AND CASE WHEN len(caps)>0 OR len(cols)>0 THEN gm ELSE CASE WHEN gm THEN 220 ELSE 0 END + CASE WHEN cm THEN 120 ELSE 0 END + CASE WHEN gt THEN 80 ELSE 0 END + lead_points > 0 END)"""


def _requests(spark, d):
    """A phrase for every product line of the catalog: of sizes, colours, model words or tokens that no view has."""
    lines = V.catalog(spark, d).select("brand_title", "series_title", "model_title").groupBy("brand_title", "series_title").agg(F.min("model_title").alias("m"), F.count(F.lit(1)).alias("n"))
    k = F.conv(F.substring(F.md5(F.concat_ws("|", "brand_title", "series_title")), 1, 8), 16, 10).cast("long") % 6
    text = F.when(k == 0, "12G").when(k == 1, "30g color").when(k == 2, F.col("m")).when(k == 3, "unheard of").when(k == 4, "the phone 12g").otherwise("")
    tokens = F.filter(F.transform(F.split(F.lower(text), " "), P.normalize_search), lambda t: t != "")
    sizes = F.filter(tokens, lambda t: t.rlike("^[0-9]+g$"))
    return lines.select(F.concat_ws("|", "brand_title", "series_title").alias("request_id"), "brand_title", "series_title", P.normalize_search(text).alias("q"), tokens.alias("tokens"), sizes.alias("capacities"), F.filter(tokens, lambda t: t == "color").alias("colors"))


@query(REFINED + """ SELECT request_id, brand_title, series_title, model_title, capacity, min(CAST(split_part(price_range,'-',1) AS BIGINT)) AS low, max(CAST(split_part(price_range,'-',2) AS BIGINT)) AS high, arg_max(market_price, struct_pack(p := leaf_points, g := group_title, c := color, b := condition_bucket)) AS price, count(DISTINCT color) AS n_labels, count(*) AS n_leaves FROM left_over GROUP BY 1,2,3,4,5""")
def refined_details(spark, d):
    """Detail views of all product lines refined by a phrase each; the surviving groups, re-summarised."""
    kept, _ = D.refined(_settled_leaves(spark, d), _requests(spark, d), ("phone",), ("small",))
    return D.group_summary(kept, ["request_id", *D.GROUP])


@query(REFINED + """, n AS (SELECT request_id, count(DISTINCT model_title) AS branches, count(DISTINCT model_title||'|'||capacity) AS groups, count(*) AS colors_left FROM left_over GROUP BY 1) SELECT request_id, coalesce(why, CASE WHEN branches>0 THEN 'applied' ELSE 'no_match' END) AS reason, coalesce(branches,0) AS branches, coalesce(groups,0) AS groups, coalesce(colors_left,0) AS colors_left FROM known LEFT JOIN n USING (request_id)""")
def refinement_reasons(spark, d):
    """Why each phrase refined its view or not, and what was left."""
    return D.refined(_settled_leaves(spark, d), _requests(spark, d), ("phone",), ("small",))[1]


@query(f"""WITH {sql.CLUSTERS}, w AS (SELECT DISTINCT {S} FROM quotes) SELECT {S}, market_price, CASE WHEN cluster_count>1 THEN 'snapshot' WHEN cluster_count IS NOT NULL THEN 'computed' ELSE 'none' END AS origin FROM w LEFT JOIN snaps USING ({S})""")
def branch_markets(spark, d):
    """Stored snapshot of each SKU, else the computed one."""
    made = settle(_snapshots(spark, d), "snapshots")  # read twice: stored and computed
    keys = [*M.SKU]
    return D.branch_markets(V.quotes(spark, d).select(*keys).distinct(), made.where("cluster_count > 1"), made, keys)


@query(f"""WITH {sql.QUOTES}, c AS (SELECT DISTINCT {S} FROM quotes), r AS (SELECT p_partkey AS request_id, p_brand AS brand_title, p_type AS series_title, p_name AS model_title FROM part), p AS (SELECT request_id, c.*, c.condition_bucket='open_allowed' AS hit, max(CASE WHEN c.condition_bucket='open_allowed' THEN 1 ELSE 0 END) OVER (PARTITION BY request_id) AS hits FROM r JOIN c USING (brand_title, series_title, model_title)) SELECT request_id, group_title, condition_bucket FROM p WHERE hit OR hits=0""")
def family_models(spark, d):
    """Models of each product's family, of the asked bucket where there is one."""
    asked = V.catalog(spark, d).select(F.col("model_id").cast("long").alias("request_id"), "brand_title", "series_title", T.family_title("model_title").alias("family_title"), F.lit("open_allowed").alias("wanted_bucket"))
    return D.family_models(asked, V.quotes(spark, d).select(*M.SKU).distinct().withColumn("family_title", T.family_title("model_title"))).select("request_id", "group_title", "condition_bucket")


@query(f"""WITH {sql.RAW}, g AS (SELECT brand_title, model_title, group_title, {sql.pct("CAST(price_text AS BIGINT)", 0.5)} AS group_price FROM raw GROUP BY 1,2,3), v AS (SELECT brand_title, model_title, group_title AS variant_label, group_price AS price, {sql.pct("group_price", 0.5, " OVER (PARTITION BY brand_title, model_title)")} AS mid FROM g) SELECT brand_title, model_title, arg_min(variant_label, struct_pack(d := abs(price-mid), i := -length(regexp_replace(variant_label,'[^\\p{{L}}\\p{{N}}]','','g')), v := variant_label)) AS variant_label FROM v GROUP BY 1,2""")
def representatives(spark, d):
    """K6: the variant nearest to its model's price."""
    from pyspark.sql import Window

    from pricewell.operators.stats import percentile

    g = V.raw_quotes(spark, d).withColumn("v", P.parse_price("price_text")).groupBy("brand_title", "model_title", F.col("group_title").alias("variant_label")).agg(percentile("v", 0.5).alias("price"))
    g = g.withColumn("group_price", percentile("price", 0.5, Window.partitionBy("brand_title", "model_title")))
    return T.representative(g, ["brand_title", "model_title"]).select("brand_title", "model_title", "variant_label")


@query("""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)),1) AS line_no FROM documents), p AS (SELECT doc_id, line_no, CASE WHEN contains(line, chr(65533)) THEN 'replacement_char' WHEN regexp_matches(line,'[一-鿿]\\?{2,}|\\?{2,}[一-鿿]|\\?{4,}') THEN 'question_burst' WHEN contains(line,'password') OR contains(line,'ß') OR contains(line,'$$$') THEN 'garbled' END AS problem, length(line) AS line_chars FROM l) SELECT * FROM p WHERE problem IS NOT NULL""")
def scan_text(spark, d):
    """lines with text problems."""
    return textscan.scan_lines(V.table(spark, d, "documents"), ("password", "ß", "$$$"))


@query("""SELECT doc_id, generate_subscripts(string_split(text, chr(10)),1) AS line_no, unnest(string_split(text, chr(10))) AS repaired FROM documents""")
def repair_text(spark, d):
    """lines read back; the damage is made from the documents' own lines, where GB18030 can hold it."""
    return textscan.repair_lines(textscan.damaged_lines(V.table(spark, d, "documents"))).select("doc_id", "line_no", "repaired")


@query("""WITH m AS (SELECT DISTINCT unnest(regexp_extract_all(html,'<li><a href="/([^"]*)">([^<]*)</a>',1)) AS ID, unnest(regexp_extract_all(html,'<li><a href="/([^"]*)">([^<]*)</a>',2)) AS title FROM pages) SELECT DISTINCT trim(ID) AS ID, trim(title) AS title FROM m WHERE trim(ID) NOT IN ('','0','-1') AND trim(title)<>''""")
def html_items(spark, d):
    """Distinct items of menu lists."""
    return textscan.items_from_html(V.table(spark, d, "pages"), '<li><a href="/([^"]*)">([^<]*)</a>')


@query("""SELECT DISTINCT CAST(user_id AS VARCHAR) AS ID, event_type AS title FROM events UNION SELECT DISTINCT CAST(json_extract(props,'$.k') AS VARCHAR), 'k' FROM events""")
def json_items(spark, d):
    """Distinct items at any depth of JSON texts."""
    inner = F.struct(F.get_json_object("details_json", "$.k").alias("id"), F.lit("k").alias("name"))
    body = V.events(spark, d).select(F.to_json(F.struct(F.col("task_key").alias("ID"), F.col("event_type").alias("title"), F.array(F.struct(F.array(inner).alias("data"))).alias("A"))).alias("body"))
    return textscan.items_from_json(body)


@query("""SELECT l_orderkey AS task_key, l_returnflag AS group_title, l_partkey AS sid, row_number() OVER (PARTITION BY l_orderkey, l_returnflag ORDER BY l_partkey, l_linenumber, l_suppkey, l_quantity)-1 AS group_row_index FROM lineitem""")
def flatten_response(spark, d):
    """Nested responses to rows."""
    line = V.table(spark, d, "lineitem")
    data = line.groupBy("l_orderkey", "l_returnflag").agg(F.array_sort(F.collect_list(F.struct(F.col("l_partkey").alias("sid"), "l_linenumber", "l_suppkey", "l_quantity"))).alias("data"))
    made = data.groupBy(F.col("l_orderkey").alias("task_key")).agg(F.array_sort(F.collect_list(F.struct(F.col("l_returnflag").alias("title"), "data"))).alias("A"))
    return textscan.flatten_response(made).select("task_key", "group_title", "sid", F.col("group_row_index").cast("long"))


INTENTS = [("help", ("help", "que ")), ("reset", ("reset", "und ")), ("status", ("status", "the "))]


@query("""SELECT conv_id, turn, CASE WHEN trim(coalesce(text,''))='' THEN 'empty' WHEN regexp_matches(trim(text),'^[1-9]$') THEN 'choice' WHEN contains(lower(trim(text)),'help') OR contains(lower(trim(text)),'que ') THEN 'help' WHEN contains(lower(trim(text)),'reset') OR contains(lower(trim(text)),'und ') THEN 'reset' WHEN contains(lower(trim(text)),'status') OR contains(lower(trim(text)),'the ') THEN 'status' ELSE 'query' END AS intent FROM conversations WHERE role='user'""")
def message_intents(spark, d):
    """intent of every user message."""
    rows = V.table(spark, d, "conversations").where("role = 'user'")
    return rows.select("conv_id", "turn", textscan.intent(F.col("text"), INTENTS).alias("intent"))
