"""The views of sources/views.py as DuckDB common table expressions, for the SQL twins of queries."""

from __future__ import annotations

RAW = """raw AS (
 SELECT ('0x'||substr(md5(concat_ws('-',l_orderkey,l_linenumber,l_partkey,l_suppkey,strftime(l_shipdate,'%Y%m%d'))),1,15))::BIGINT AS id, 'run_'||year(l_shipdate)||'-01-01' AS run_key, CAST(l_orderkey AS VARCHAR) AS task_key, CAST(l_partkey AS VARCHAR) AS model_id,
  p_brand AS brand_title, p_type AS series_title, p_name AS model_title, 'color '||p_size||'G' AS group_title, s_name AS sname, '' AS sno, l_returnflag||l_linestatus AS dstatus, strftime(l_shipdate,'%m-%d') AS gprice, '' AS gprice_two,
  CAST(CAST(floor(l_extendedprice/l_quantity) AS BIGINT) AS VARCHAR) AS price_text, CASE WHEN l_discount>=0.10 THEN 'x' ELSE '' END AS activation, strftime(l_shipdate,'%Y-%m-%d %H:%M:%S') AS imported_at
 FROM lineitem JOIN part ON l_partkey=p_partkey JOIN supplier ON l_suppkey=s_suppkey)"""

QUOTES = RAW + """, tagged AS (
 SELECT *, series_title||' | '||model_title||' | '||group_title||' | '||dstatus AS txt FROM raw
), tagged2 AS (
 SELECT *, list_sort(list_filter([CASE WHEN contains(txt,'red') THEN 'opened' END, CASE WHEN contains(txt,'NF') THEN 'activated' END, CASE WHEN contains(txt,'cold') THEN 'opened_not_activated' END, CASE WHEN contains(txt,'SMALL') THEN 'demo' END, CASE WHEN activation<>'' THEN 'activation_date_present' END], lambda x: x IS NOT NULL)) AS neg,
  contains(txt,'RO') AS sealed, contains(txt,'AO') AS pure, contains(txt,'bolt') AS sale, brand_title='Brand#2' AS strict, contains(txt,'ring') AS special, contains(dstatus,'NO') AS tgt, contains(dstatus,'AF') AS open_hit FROM tagged
), tagged3 AS (
 SELECT *, list_contains(neg,'activated') OR list_contains(neg,'activation_date_present') AS hard, len(neg)>0 AS flagged,
  list_contains(neg,'opened') OR list_contains(neg,'activated') OR list_contains(neg,'activation_date_present') AS opened FROM tagged2
), quotes AS (
 SELECT id, run_key, task_key, model_id, brand_title, series_title, model_title, group_title, sname, sno, dstatus, gprice, gprice_two, price_text, activation, imported_at,
  CASE WHEN strict THEN CASE WHEN special THEN 'strict_special_model_non_target' WHEN tgt AND NOT flagged THEN 'strict_target' WHEN tgt THEN 'strict_target_but_excluded' WHEN sealed AND flagged THEN 'strict_sealed_but_excluded' WHEN sealed THEN 'strict_other_sealed_non_target'
    WHEN list_contains(neg,'opened_not_activated') THEN 'strict_opened_not_activated' WHEN opened THEN 'strict_opened_or_activated' WHEN pure THEN 'strict_pure_original_non_target' WHEN flagged THEN 'strict_flagged_non_target' WHEN sale THEN 'strict_condition_unspecified_non_target' ELSE 'strict_unknown_review' END
   WHEN hard THEN 'open_hard_excluded' WHEN open_hit THEN 'open_excluded' ELSE 'open_allowed' END AS condition_bucket,
  CASE WHEN strict THEN CASE WHEN NOT special AND tgt AND NOT flagged THEN 1 ELSE 0 END WHEN hard OR open_hit THEN 0 ELSE 1 END AS is_target_price,
  CASE WHEN strict AND NOT special AND NOT tgt AND NOT sealed AND NOT flagged AND NOT pure AND NOT sale THEN 1 ELSE 0 END AS needs_review,
  array_to_string(neg,'|') AS matched_negative_tags,
  CASE WHEN strict THEN CASE WHEN special THEN 'special_model_tag' WHEN tgt THEN array_to_string(neg,'|') WHEN sealed AND flagged THEN array_to_string(neg,'|') WHEN sealed THEN 'not_target_sealed' WHEN list_contains(neg,'opened_not_activated') THEN 'opened_not_activated' WHEN opened THEN array_to_string(neg,'|') WHEN pure THEN 'pure_original_without_clean_sealed_status' WHEN flagged THEN array_to_string(neg,'|') WHEN sale THEN 'condition_unspecified' ELSE 'unknown_strict_condition' END
   ELSE array_to_string(list_concat(list_filter(neg, lambda x: x IN ('activated','activation_date_present')), CASE WHEN open_hit THEN ['open_dstatus_keyword'] ELSE [] END),'|') END AS exclude_reason
 FROM tagged3)"""

TASKS = """lines AS (SELECT l_orderkey, count(*) AS rc, count(CASE WHEN l_returnflag='R' THEN 1 END) AS dd, count(CASE WHEN l_linestatus='F' THEN 1 END) AS ds, count(CASE WHEN l_discount>=0.10 THEN 1 END) AS di FROM lineitem GROUP BY 1),
tasks AS (
 SELECT o_orderkey AS id, 'run_'||year(o_orderdate)||'-01-01' AS run_key, CAST(o_orderkey AS VARCHAR) AS task_key, strftime(o_orderdate,'%Y-%m-%d %H:%M:%S') AS event_time, coalesce(c_mktsegment,'') AS brand_title, o_orderpriority AS series_title, coalesce(c_name,'') AS model_title,
  CAST(o_custkey % 50 AS VARCHAR) AS model_id, CASE o_orderstatus WHEN 'F' THEN 'ok' WHEN 'O' THEN 'error' ELSE 'exception' END AS status, substr(o_orderpriority,1,1) AS code, substr(o_orderpriority,3,20) AS msg,
  coalesce(rc,0)+coalesce(dd,0) AS total_rows_seen, coalesce(rc,0) AS row_count, coalesce(dd,0) AS drop_by_date, coalesce(ds,0) AS drop_out_of_stock, coalesce(di,0) AS drop_invalid_price
 FROM orders LEFT JOIN customer ON o_custkey=c_custkey LEFT JOIN lines ON o_orderkey=l_orderkey)"""

EVENTS = """run_events AS (SELECT event_id AS id, 'run_'||strftime(ts,'%Y-%m-%d') AS run_key, CASE WHEN event_id % 3 <> 0 THEN CAST(user_id AS VARCHAR)||'-'||event_type END AS event_key, ts, event_type, CAST(user_id AS VARCHAR) AS task_key, value, props AS details_json FROM events)"""

RUNS = """runs AS (SELECT 'run_'||y||'-01-01' AS run_key, strftime(a,'%Y-%m-%d %H:%M:%S') AS started_at, strftime(b,'%Y-%m-%d %H:%M:%S') AS finished_at, CASE WHEN n % 2 = 0 THEN 'completed' ELSE 'running' END AS status, strftime(a,'%Y-%m-%d %H:%M:%S') AS created_at
 FROM (SELECT year(o_orderdate) AS y, min(o_orderdate) AS a, max(o_orderdate) AS b, count(*) AS n FROM orders GROUP BY 1))"""

REFERENCES = """refs AS (SELECT p_partkey AS id, p_partkey % 3 AS import_id, p_type AS source_title, p_name||' '||p_size||'G' AS raw_title, p_brand AS brand_title, p_type AS series_title, p_name AS model_title, 'color '||p_size||'G' AS group_title, CAST(floor(p_retailprice) AS BIGINT) AS reference_price, '2024-01-01 00:00:00' AS imported_at FROM part)"""

BLACKLIST = """blacklist AS (SELECT CAST(p_partkey AS VARCHAR) AS model_id, CASE WHEN p_size=30 THEN '0' ELSE '1' END AS enabled, p_brand AS brand_title, p_type AS series_title, p_name AS model_title FROM part WHERE p_size % 10 = 0)"""

#: The numeric market rows: newest quote per seller and SKU, with the reason that rejects it.
DEDUPED = QUOTES + """, ranked AS (
 SELECT *, row_number() OVER (PARTITION BY brand_title, series_title, model_title, group_title, condition_bucket, 'name:'||lower(sname) ORDER BY imported_at DESC, gprice DESC, id DESC) AS nth FROM quotes
), deduped AS (
 SELECT *, CAST(price_text AS BIGINT) AS price_value,
  CASE WHEN activation<>'' THEN 'activation_field_present' WHEN contains(lower(brand_title),'brand#2') AND contains(dstatus,'RF') THEN 'status_noise_keyword' WHEN NOT contains(lower(brand_title),'brand#2') AND (contains(dstatus,'RF') OR contains(dstatus,'AF')) THEN 'status_noise_keyword' WHEN is_target_price<>1 THEN 'condition_not_target' END AS reject_reason
 FROM ranked WHERE nth=1)"""

S = "brand_title, series_title, model_title, group_title, condition_bucket"


def windowed(source: str, key: str, least: int, most: int) -> str:
    """Rows of the newest days of each key: CTEs from `source` to `selected`."""
    return f""", bucketed AS (SELECT *, max(struct_pack(a := imported_at, b := gprice, c := id)) OVER (PARTITION BY {key}, gprice) AS newest, count(*) OVER (PARTITION BY {key}, gprice) AS day_rows FROM {source}),
days AS (SELECT {key}, gprice AS day, any_value(newest) AS newest, any_value(day_rows) AS n FROM bucketed GROUP BY {key}, gprice),
days2 AS (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY newest DESC, n DESC, day DESC) AS day_rank, sum(n) OVER (PARTITION BY {key} ORDER BY newest DESC, n DESC, day DESC) AS upto FROM days),
selected AS (SELECT b.*, d.day_rank FROM bucketed b JOIN days2 d USING ({key}) WHERE b.gprice=d.day AND d.upto-d.n < {least} AND d.day_rank <= {most})"""


def pct(x: str, r: float, over: str = "") -> str:
    return f"coalesce(CAST(round_even(quantile_cont(CAST({x} AS DOUBLE), {r}){over},0) AS BIGINT),0)"


def cleaned(source: str, key: str) -> str:
    """Outlier flags per key by three steps: CTEs from `source` to `survivors` (alive, outlier_reason)."""
    w = f" OVER (PARTITION BY {key})"
    live = "CASE WHEN alive THEN price_value END"

    def gap(kind: str) -> str:
        return f"greatest(CASE {kind} WHEN 'balanced' THEN 140 WHEN 'dense' THEN 120 END, CAST(round_even(med*CASE {kind} WHEN 'balanced' THEN 0.02 WHEN 'dense' THEN 0.018 END,0) AS BIGINT))"

    def apply(prev: str, name: str, removed: str, enabled: str, reason: str) -> str:
        return f"""{name}_a AS (SELECT *, alive AND coalesce({removed}, false) AS out FROM {prev}),
{name}_b AS (SELECT *, count(CASE WHEN alive THEN 1 END){w} AS n_alive, count(CASE WHEN alive AND NOT out THEN 1 END){w} AS n_left FROM {name}_a),
{name}_c AS (SELECT * EXCLUDE (out, n_alive, n_left), out AND {enabled} AND n_alive > flr AND n_left >= flr AS out FROM {name}_b),
{name} AS (SELECT * REPLACE (alive AND NOT out AS alive, CASE WHEN out THEN {reason} ELSE outlier_reason END AS outlier_reason) FROM {name}_c)"""

    return f""", c0 AS (SELECT *, count(*){w} AS n_numeric FROM {source}),
c1 AS (SELECT *, CASE WHEN n_numeric<8 THEN 'sparse' WHEN n_numeric<15 THEN 'balanced' ELSE 'dense' END AS dens, CASE WHEN n_numeric<=4 THEN n_numeric WHEN n_numeric<8 THEN greatest(4,n_numeric-1) WHEN n_numeric<15 THEN greatest(4,CAST(ceil(n_numeric*0.65::DOUBLE) AS BIGINT)) ELSE greatest(5,CAST(ceil(n_numeric*0.45::DOUBLE) AS BIGINT)) END AS flr, true AS alive, '' AS outlier_reason FROM c0),
z0 AS (SELECT *, {pct(live, 0.5, w)} AS med, count({live}){w} AS n_live FROM c1),
z1 AS (SELECT *, {pct(f"abs(({live})-med)", 0.5, w)} AS mad FROM z0),
{apply("z1", "z2", f"n_live>=5 AND mad>=1 AND abs(0.6745::DOUBLE*(price_value-med)/mad) > CASE dens WHEN 'balanced' THEN 4.0 WHEN 'dense' THEN 3.5 END AND abs(price_value-med) >= {gap('dens')}", "dens IN ('balanced','dense')", "'modified_zscore'")},
i0 AS (SELECT * EXCLUDE (med, n_live, mad, out), {pct(live, 0.5, w)} AS med, {pct(live, 0.25, w)} AS q1, {pct(live, 0.75, w)} AS q3, count({live}){w} AS n_live FROM z2),
i1 AS (SELECT *, CASE dens WHEN 'balanced' THEN 2.4 WHEN 'dense' THEN 2.0 END*greatest(q3-q1,1) AS reach FROM i0),
{apply("i1", "i2", f"n_live>=5 AND (price_value < q1-reach OR price_value > q3+reach) AND abs(price_value-med) >= {gap('dens')}", "dens IN ('balanced','dense')", "'iqr_fence'")},
t0 AS (SELECT * EXCLUDE (med, q1, q3, n_live, reach, out), count({live}){w} AS n_live, row_number() OVER (PARTITION BY {key} ORDER BY {live} ASC NULLS LAST, id) AS pos, lead({live}) OVER (PARTITION BY {key} ORDER BY {live} ASC NULLS LAST, id) - ({live}) AS gap FROM i2),
t1 AS (SELECT *, max(gap){w} AS width FROM t0),
t2 AS (SELECT *, min(CASE WHEN gap=width THEN pos END){w} AS cut FROM t1),
t3 AS (SELECT *, cut <= n_live-cut AS low FROM t2),
t4 AS (SELECT *, alive AND CASE WHEN pos<=cut THEN low ELSE NOT low END AS minor FROM t3),
t5 AS (SELECT *, {pct("CASE WHEN alive AND NOT minor THEN price_value END", 0.5, w)} AS center, max(CASE WHEN alive AND NOT minor THEN price_value END){w}-min(CASE WHEN alive AND NOT minor THEN price_value END){w} AS spread, count(CASE WHEN alive AND NOT minor THEN 1 END){w} AS nmajor, count(CASE WHEN minor THEN 1 END){w} AS nminor, coalesce(max(CASE WHEN minor THEN price_value END){w}-min(CASE WHEN minor THEN price_value END){w},0) AS mspread FROM t4),
{apply("t5", "t6", "n_live>=5 AND nmajor>=3 AND nminor<=greatest(2,n_live//3) AND spread<=greatest(120,CAST(round_even(center*0.015::DOUBLE,0) AS BIGINT)) AND width>=greatest(120,spread*2,greatest(20,mspread)*2) AND minor", "dens='dense'", "CASE WHEN low THEN 'cluster_gap_low_tail' ELSE 'cluster_gap_high_tail' END")},
survivors AS (SELECT * EXCLUDE (n_live, pos, gap, width, cut, low, minor, center, spread, nmajor, nminor, mspread, out) FROM t6)"""


#: All CTEs from the quotes to scored and ranked clusters.
CLUSTERS = (
    DEDUPED
    + f""", with_raw AS (SELECT *, max(struct_pack(a := imported_at, b := gprice, c := id)) OVER (PARTITION BY {S}) AS raw_newest FROM deduped),
good AS (SELECT * FROM with_raw WHERE reject_reason IS NULL)"""
    + windowed("good", S, 12, 30)
    + f""", picked AS (SELECT *, count(*) OVER (PARTITION BY {S}) AS selected_rows, max(newest) OVER (PARTITION BY {S}) AS sel_newest, max(struct_pack(a := imported_at, b := gprice, c := id)) OVER (PARTITION BY {S}, dstatus) AS status_newest FROM selected)"""
    + cleaned("picked", f"{S}, dstatus")
    + f""", k0 AS (SELECT *, count(*) OVER (PARTITION BY {S}, dstatus) AS k, {pct("price_value", 0.5, f" OVER (PARTITION BY {S}, dstatus)")} AS kmed, {pct("price_value", 0.75, f" OVER (PARTITION BY {S}, dstatus)")}-{pct("price_value", 0.25, f" OVER (PARTITION BY {S}, dstatus)")} AS kiqr FROM survivors WHERE alive),
k1 AS (SELECT *, CASE WHEN k>2 AND price_value-lag(price_value) OVER (PARTITION BY {S}, dstatus ORDER BY price_value, id) >= greatest(80, CAST(round_even(kmed*0.012::DOUBLE,0) AS BIGINT), CAST(round_even(kiqr*1.5::DOUBLE,0) AS BIGINT)) THEN 1 ELSE 0 END AS begins FROM k0),
k2 AS (SELECT *, sum(begins) OVER (PARTITION BY {S}, dstatus ORDER BY price_value, id) AS cl FROM k1),
cl0 AS (SELECT {S}, dstatus, cl, count(*) AS sample_count, {pct("price_value", 0.5)} AS median_price, {pct("price_value", 0.25)} AS q1, {pct("price_value", 0.75)} AS q3, min(price_value) AS price_min, max(price_value) AS price_max, any_value(selected_rows) AS selected_rows, any_value(sel_newest) AS sel_newest, any_value(raw_newest) AS raw_newest, any_value(status_newest) AS status_newest FROM k2 GROUP BY {S}, dstatus, cl),
cl1 AS (SELECT c.*, r.reference_price FROM cl0 c LEFT JOIN (SELECT brand_title, series_title, model_title, group_title, {pct("reference_price", 0.5)} AS reference_price FROM refs GROUP BY 1,2,3,4) r USING (brand_title, series_title, model_title, group_title)),
cl2 AS (SELECT *, CASE WHEN sample_count=1 THEN 'single_quote_exact' WHEN sample_count<=3 THEN 'observed_minmax' ELSE 'iqr_band' END AS interval_method, CASE WHEN sample_count>=4 THEN q1 ELSE price_min END AS band_low, CASE WHEN sample_count>=4 THEN q3 ELSE price_max END AS band_high FROM cl1),
cl3 AS (SELECT *, round_even(sample_count*14.0::DOUBLE + CASE WHEN contains(lower(brand_title),'brand#2') THEN CASE WHEN dstatus='NO' THEN 36 WHEN contains(dstatus,'O') THEN 22 ELSE 0 END ELSE 10 END - least(greatest(band_high-band_low,0),1600)/18.0::DOUBLE - CASE sample_count WHEN 1 THEN 14 WHEN 2 THEN 6 ELSE 0 END - coalesce(least(abs(median_price-reference_price),2000)/45.0::DOUBLE,0),3) AS score,
 least(98, least(sample_count,20)*3 + CASE WHEN (q3-q1)/median_price::DOUBLE<=0.01 THEN 30 WHEN (q3-q1)/median_price::DOUBLE<=0.02 THEN 22 WHEN (q3-q1)/median_price::DOUBLE<=0.04 THEN 12 ELSE 4 END + CASE WHEN abs(median_price-reference_price)/greatest(reference_price,1)::DOUBLE<=0.015 THEN 18 WHEN abs(median_price-reference_price)/greatest(reference_price,1)::DOUBLE<=0.03 THEN 10 WHEN abs(median_price-reference_price)/greatest(reference_price,1)::DOUBLE<=0.06 THEN 4 ELSE 0 END) AS confidence_score FROM cl2),
cl4 AS (SELECT *, row_number() OVER (PARTITION BY {S} ORDER BY status_newest DESC, dstatus, cl)-1 AS cluster_id, band_low||'-'||band_high AS price_range, CASE WHEN confidence_score>=80 THEN 'high' WHEN confidence_score>=58 THEN 'medium' ELSE 'cautious' END AS confidence_label FROM cl3),
clusters AS (SELECT *, row_number() OVER (PARTITION BY {S} ORDER BY score DESC, sample_count DESC, band_high-band_low, cluster_id) AS rnk FROM cl4),
bests AS (SELECT *, max(CASE WHEN rnk=1 THEN median_price END) OVER (PARTITION BY {S}) AS best FROM clusters),
snaps AS (SELECT {S}, max(CASE WHEN rnk=1 THEN median_price END) AS market_price, max(CASE WHEN rnk=1 THEN price_range END) AS price_range, max(CASE WHEN rnk=1 THEN dstatus END) AS trusted_status, max(CASE WHEN rnk=1 THEN sample_count END) AS trusted_sample_count, max(CASE WHEN rnk=1 THEN confidence_score END) AS confidence_score, max(CASE WHEN rnk=1 THEN confidence_label END) AS confidence_label, max(CASE WHEN rnk=1 THEN interval_method END) AS interval_method, max(reference_price) AS reference_price, count(*) AS cluster_count,
 count(CASE WHEN rnk>1 AND best-median_price>=lim THEN 1 END) AS suspicious_low_clusters, coalesce(sum(CASE WHEN rnk>1 AND best-median_price>=lim THEN sample_count END),0) AS suspicious_low_rows, count(CASE WHEN rnk>1 AND median_price-best>=lim THEN 1 END) AS suspicious_high_clusters, coalesce(sum(CASE WHEN rnk>1 AND median_price-best>=lim THEN sample_count END),0) AS suspicious_high_rows,
 any_value(selected_rows) AS selection_sample_count, any_value(sel_newest.b) AS selected_gprice_label, CASE WHEN any_value(sel_newest.b)<>any_value(raw_newest.b) THEN 1 ELSE 0 END AS fallback_applied
 FROM (SELECT *, greatest(80, CAST(round_even(best*0.015::DOUBLE,0) AS BIGINT)) AS lim FROM bests) GROUP BY {S})"""
)
CLUSTERS = REFERENCES + ", " + CLUSTERS
