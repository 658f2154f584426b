"""Queries of reports, table state and planning."""

from __future__ import annotations

from pyspark.sql import functions as F

from pricewell.functions import columns as P
from pricewell.operators import reports, state
from pricewell.operators import rules as R
from pricewell.plans import sql
from pricewell.plans.sql import S
from pricewell.sources import views as V

QUERIES, ORACLES = {}, {}


def query(oracle: str | None = None, name: str | None = None):
    def add(f):
        QUERIES[name or f.__name__] = f
        if oracle:
            ORACLES[name or f.__name__] = oracle
        return f

    return add


_SQL = {
    "task_count": "count(*)", "quote_count": "count(*)", "ok_tasks": "count(CASE WHEN status='ok' THEN 1 END)", "error_tasks": "count(CASE WHEN status='error' THEN 1 END)", "exception_tasks": "count(CASE WHEN status='exception' THEN 1 END)", "kept_task_count": "count(CASE WHEN row_count>0 THEN 1 END)", "kept_rows": "sum(row_count)",
    "target_quote_count": "count(CASE WHEN is_target_price=1 THEN 1 END)", "review_quote_count": "count(CASE WHEN needs_review=1 THEN 1 END)", "example_model": "min(model_title)",
}


def _report(kind):
    source, dims, names = reports.KINDS[kind]
    label = ", substr(gprice,1,5) AS gprice_label" if "gprice_label" in dims else ""
    text = f"WITH {sql.TASKS if source == 'tasks' else sql.QUOTES} SELECT {', '.join(dims)}, {', '.join(f'{_SQL[n]} AS {n}' for n in names)} FROM (SELECT *{label} FROM {source}) GROUP BY {', '.join(dims)}"
    query(text, f"report_{kind}")(lambda spark, d, k=kind: reports.report(k, V.tasks(spark, d), V.quotes(spark, d)))


for _kind in reports.KINDS:
    _report(_kind)


@query(f"""WITH {sql.QUOTES}, {sql.TASKS}, {sql.EVENTS}, {sql.RUNS}
SELECT 'totals' AS section, 'run_count' AS name, count(*) AS n FROM runs UNION ALL SELECT 'totals','task_count',count(*) FROM tasks UNION ALL SELECT 'totals','total_rows_seen',sum(total_rows_seen) FROM tasks UNION ALL SELECT 'totals','row_count',sum(row_count) FROM tasks UNION ALL SELECT 'totals','drop_by_date',sum(drop_by_date) FROM tasks UNION ALL SELECT 'totals','drop_out_of_stock',sum(drop_out_of_stock) FROM tasks UNION ALL SELECT 'totals','drop_invalid_price',sum(drop_invalid_price) FROM tasks
UNION ALL SELECT 'totals','quote_count',count(*) FROM quotes UNION ALL SELECT 'totals','target_quote_count',count(CASE WHEN is_target_price=1 THEN 1 END) FROM quotes UNION ALL SELECT 'totals','review_quote_count',count(CASE WHEN needs_review=1 THEN 1 END) FROM quotes
UNION ALL SELECT 'task_status', status, count(*) FROM tasks GROUP BY status UNION ALL SELECT 'api_code', code, count(*) FROM tasks WHERE code<>'' GROUP BY code UNION ALL SELECT 'event_type', event_type, count(*) FROM run_events GROUP BY event_type
UNION ALL (SELECT 'top_brands', brand_title, count(*) AS n FROM quotes GROUP BY brand_title ORDER BY n DESC, brand_title LIMIT 10) UNION ALL (SELECT 'top_condition_buckets', condition_bucket, count(*) AS n FROM quotes GROUP BY condition_bucket ORDER BY n DESC, condition_bucket LIMIT 10) UNION ALL (SELECT 'top_gprice_labels', substr(gprice,1,5) AS l, count(*) AS n FROM quotes GROUP BY l ORDER BY n DESC, l LIMIT 10)""")
def run_summary(spark, d):
    """A18."""
    return reports.summary(V.tasks(spark, d), V.quotes(spark, d), V.events(spark, d), V.runs(spark, d))


@query(f"""WITH {sql.RAW}, {sql.RUNS}, st AS (SELECT run_key, count(*) AS quote_count, max(imported_at) AS latest_imported_at FROM raw GROUP BY 1)
SELECT run_key, quote_count, latest_imported_at, row_number() OVER (ORDER BY CASE WHEN coalesce(quote_count,0)>0 THEN 0 ELSE 1 END, coalesce(latest_imported_at, started_at, finished_at, created_at) DESC NULLS LAST, CASE status WHEN 'completed' THEN 0 WHEN 'running' THEN 1 ELSE 2 END, created_at DESC NULLS LAST, run_key) AS place FROM runs LEFT JOIN st USING (run_key)""")
def preferred_run(spark, d):
    """Runs in order of preference."""
    return reports.ranked_runs(V.runs(spark, d), V.raw_quotes(spark, d)).select("run_key", "quote_count", "latest_imported_at", "place")


@query(f"""WITH {sql.RAW}, {sql.TASKS}, {sql.EVENTS}, {sql.RUNS}
SELECT * FROM (SELECT count(*) AS quote_count, max(imported_at) AS latest_quote FROM raw), (SELECT count(*) AS task_count, max(event_time) AS latest_task FROM tasks), (SELECT count(*) AS event_count, strftime(max(ts),'%Y-%m-%d %H:%M:%S') AS latest_event FROM run_events), (SELECT count(*) AS run_count, max(created_at) AS latest_run FROM runs)""")
def live_marker(spark, d):
    """A19, A32."""
    return reports.live_marker(V.raw_quotes(spark, d), V.tasks(spark, d), V.events(spark, d), V.runs(spark, d))


@query(f"""WITH {sql.QUOTES} SELECT {S}, count(*) AS row_count, count(DISTINCT sname) AS source_count, min(CAST(price_text AS BIGINT)) AS min_price, max(CAST(price_text AS BIGINT)) AS max_price, max(imported_at) AS latest_imported_at, max(gprice) AS latest_gprice FROM quotes GROUP BY ALL""")
def sku_catalog(spark, d):
    """A12."""
    return reports.sku_catalog(V.quotes(spark, d))


@query(f"""WITH {sql.QUOTES}, own AS (SELECT {S}, count(*) AS row_count, 'quote_rows' AS data_source, NULL AS reference_price FROM quotes GROUP BY {S}), {sql.REFERENCES}
SELECT * FROM own UNION ALL SELECT brand_title, series_title, model_title, group_title, NULL, NULL, 'external', reference_price FROM refs""")
def candidate_union(spark, d):
    """Own and external candidates."""
    own = reports.sku_catalog(V.quotes(spark, d)).select(*reports.LINE, "row_count")
    return reports.all_candidates(own, V.reference_rows(spark, d).select("brand_title", "series_title", "model_title", "group_title", "reference_price"))


@query(f"""WITH {sql.RAW}, k AS (SELECT *, CASE WHEN contains(gprice,'31') THEN 'drop_out_of_stock' WHEN activation<>'' THEN 'drop_by_activation_field' WHEN contains(lower(brand_title),'brand#2') AND (NOT (contains(dstatus,'NO') OR contains(dstatus,'AO')) OR contains(dstatus,'RF')) THEN 'drop_by_strict_dstatus' WHEN NOT contains(lower(brand_title),'brand#2') AND contains(dstatus,'AF') THEN 'drop_by_open_dstatus' END AS r FROM raw)
SELECT task_key, count(*) AS total, count(CASE WHEN r IS NULL THEN 1 END) AS kept, count(CASE WHEN r='drop_out_of_stock' THEN 1 END) AS drop_out_of_stock, count(CASE WHEN r='drop_by_activation_field' THEN 1 END) AS drop_by_activation_field, count(CASE WHEN r='drop_by_strict_dstatus' THEN 1 END) AS drop_by_strict_dstatus, count(CASE WHEN r='drop_by_open_dstatus' THEN 1 END) AS drop_by_open_dstatus FROM k GROUP BY task_key""")
def drop_statistics(spark, d):
    """Kept and dropped rows per task."""
    return reports.drop_statistics(_dropped(spark, d), ["task_key"], ["drop_out_of_stock", "drop_by_activation_field", "drop_by_strict_dstatus", "drop_by_open_dstatus"])


def _dropped(spark, d):
    rows = V.raw_quotes(spark, d)
    return rows.withColumn("drop_reason", R.keep_reason(V.demo_rules(), F.array(F.regexp_extract("gprice", "([0-9]{2}-[0-9]{2})", 1))))


@query(f"""WITH {sql.RAW}, v AS (SELECT *, NOT (contains(gprice,'31') OR activation<>'' OR CASE WHEN contains(lower(brand_title),'brand#2') THEN NOT (contains(dstatus,'NO') OR contains(dstatus,'AO')) OR contains(dstatus,'RF') ELSE contains(dstatus,'AF') END) AS ok FROM raw),
n AS (SELECT *, sum(CAST(ok AS INT)) OVER (PARTITION BY brand_title, model_title, group_title ORDER BY id) AS nth FROM v), s AS (SELECT *, sum(CAST(nth>10 AS INT)) OVER (PARTITION BY brand_title, model_title, group_title) AS skipped FROM n) SELECT id, skipped FROM s WHERE ok AND nth<=10""")
def group_cap(spark, d):
    """the first ten valid rows of each group."""
    return reports.group_cap(_dropped(spark, d), ["brand_title", "model_title", "group_title"], "id", V.demo_rules().per_group_limit).select("id", "skipped")


@query("""SELECT event_type AS stage, row_number() OVER (ORDER BY avg(value) DESC, event_type) AS place, round(avg(value),6) AS mean_ms, count(value) AS n FROM events WHERE value IS NOT NULL GROUP BY event_type""")
def stage_timings(spark, d):
    """A27."""
    return reports.stage_timings(V.events(spark, d).select(F.col("event_type").alias("stage"), F.col("value").alias("ms")))


@query("""SELECT event_type AS status, count(*) AS n, round((epoch(TIMESTAMP '2024-02-01 00:00:00') - min(CAST(floor(epoch(ts)) AS BIGINT)))/3600.0::DOUBLE,3) AS oldest_hours, round((epoch(TIMESTAMP '2024-02-01 00:00:00') - max(CAST(floor(epoch(ts)) AS BIGINT)))/3600.0::DOUBLE,3) AS newest_hours FROM events GROUP BY 1""")
def queue_status(spark, d):
    """A25."""
    return reports.queue_status(V.events(spark, d).select(F.col("event_type").alias("status"), F.col("ts").alias("updated_at")), F.to_timestamp(F.lit("2024-02-01 00:00:00")))


@query("""SELECT event_type||'_backlog' AS name, CAST(count(*) AS DOUBLE) AS value, 10.0::DOUBLE AS limit_value FROM events WHERE event_type IN ('error','view') GROUP BY 1 HAVING count(*)>10""")
def alerts(spark, d):
    """Figures over their limits."""
    made = V.events(spark, d).groupBy(F.concat("event_type", F.lit("_backlog")).alias("name")).agg(F.count(F.lit(1)).cast("double").alias("value"))
    return reports.alerts(made, {"error_backlog": 10, "view_backlog": 10})


@query(f"""WITH {sql.EVENTS}, k AS (SELECT run_key, event_key, min(id) AS id, arg_min(event_type,id) AS event_type, arg_min(task_key,id) AS task_key, arg_max(ts,id) AS ts, arg_max(details_json,id) AS details_json FROM run_events WHERE event_key IS NOT NULL GROUP BY 1,2)
SELECT * FROM k UNION ALL SELECT run_key, event_key, id, event_type, task_key, ts, details_json FROM run_events WHERE event_key IS NULL""")
def append_events(spark, d):
    """S24, T1 as a batch: idempotent append by key."""
    return state.append_events(V.events(spark, d))


@query(f"""WITH {sql.TASKS}, r AS (SELECT *, row_number() OVER (PARTITION BY model_id ORDER BY event_time DESC, id DESC) AS nth, first_value(event_time) OVER (PARTITION BY model_id ORDER BY event_time, id) AS created FROM tasks) SELECT model_id, id, status, code, created AS created_at FROM r WHERE nth=1""")
def upsert_tasks(spark, d):
    """S21, T5 as a batch: the last row of each key, with its first time (upsert_stored has a stored side)."""
    rows = V.tasks(spark, d).select("model_id", "id", "status", "code", F.col("event_time").alias("created_at"), "event_time")
    return state.upsert(rows.limit(0), rows, ["model_id"], ["event_time", "id"], ("created_at",)).drop("event_time")


@query(f"""WITH {sql.TASKS}, p AS (SELECT run_key, task_key, brand_title, series_title, upper(model_title) AS model_title, '{{}}' AS payload_json FROM tasks WHERE id % 2 = 0 UNION ALL SELECT run_key, task_key||'x', brand_title, series_title, model_title, '{{}}' FROM tasks WHERE id % 3 = 0), s AS (SELECT *, CASE WHEN id % 5 = 0 THEN msg ELSE '' END AS payload_json FROM tasks)
SELECT coalesce(s.run_key,p.run_key) AS run_key, coalesce(s.task_key,p.task_key) AS task_key, coalesce(p.brand_title,s.brand_title) AS brand_title, coalesce(p.series_title,s.series_title) AS series_title, coalesce(p.model_title,s.model_title) AS model_title, coalesce(s.status,'pending') AS status, coalesce(nullif(s.payload_json,''),p.payload_json,'') AS payload_json FROM s FULL JOIN p ON s.run_key=p.run_key AND s.task_key=p.task_key""")
def seed_tasks(spark, d):
    """Planned tasks meet stored ones."""
    rows = V.tasks(spark, d)
    stored = rows.withColumn("payload_json", F.when(F.col("id") % 5 == 0, F.col("msg")).otherwise(""))
    cols = ["run_key", "task_key", "brand_title", "series_title", "model_title"]
    again = rows.where("id % 2 = 0").withColumn("model_title", F.upper("model_title")).select(*cols)
    new = rows.where("id % 3 = 0").withColumn("task_key", F.concat("task_key", F.lit("x"))).select(*cols)
    return state.seed_tasks(stored, again.unionByName(new).withColumn("payload_json", F.lit("{}")), ["run_key", "task_key"])


@query(f"""WITH {sql.TASKS} SELECT id, CASE WHEN status='exception' THEN 'pending' ELSE status END AS status, CASE WHEN status='exception' THEN '' ELSE code END AS code, CASE WHEN status='exception' THEN '' ELSE msg END AS msg FROM tasks""")
def requeue_tasks(spark, d):
    """S23."""
    return state.requeue(V.tasks(spark, d), "exception").select("id", "status", "code", "msg")


@query(f"""WITH {sql.RAW}, inc AS (SELECT * FROM raw WHERE dstatus='NO'), keep AS (SELECT * FROM raw WHERE (run_key, task_key) NOT IN (SELECT (run_key, task_key) FROM inc)) SELECT id, price_text FROM keep UNION ALL SELECT id, '1' FROM inc""")
def replace_task_rows(spark, d):
    """Rows of the incoming tasks replaced."""
    rows = V.raw_quotes(spark, d)
    fresh = rows.where("dstatus = 'NO'").withColumn("price_text", F.lit("1"))
    return state.replace_for_tasks(rows, fresh, ["run_key", "task_key"]).select("id", "price_text")


@query(f"""WITH {sql.RAW} SELECT id, CASE WHEN id % 2 = 0 THEN task_key ELSE model_id||'__7__'||gprice END AS task_key FROM raw""")
def task_keys(spark, d):
    """Task keys made where absent."""
    rows = V.raw_quotes(spark, d).withColumns({"task_key": F.when(F.col("id") % 2 == 0, F.col("task_key")), "city_id": F.lit("7"), "day": F.col("gprice")})
    return state.with_task_key(rows).select("id", "task_key")


@query(f"""WITH {sql.BLACKLIST} SELECT CAST(p_partkey AS VARCHAR) AS model_id, CASE WHEN CAST(p_partkey AS VARCHAR) IN (SELECT model_id FROM blacklist WHERE enabled<>'0') THEN 'excluded' ELSE 'allowed' END AS verdict FROM part""")
def blacklist_split(spark, d):
    """Allowed and excluded catalog items."""
    allowed, excluded = state.split_blacklist(V.catalog(spark, d), V.blacklist(spark, d))
    return allowed.select("model_id", F.lit("allowed").alias("verdict")).unionByName(excluded.select("model_id", F.lit("excluded").alias("verdict")))


@query(f"""WITH {sql.BLACKLIST}, b AS (SELECT *, 'new' AS origin FROM (SELECT CAST(p_partkey AS VARCHAR) AS model_id, p_brand AS brand_title FROM part WHERE p_size % 5 = 0)) SELECT model_id, brand_title, 'existing' AS origin FROM blacklist UNION ALL SELECT model_id, brand_title, origin FROM b WHERE model_id NOT IN (SELECT model_id FROM blacklist)""")
def merge_blacklists(spark, d):
    """A29."""
    new = V.catalog(spark, d).join(V.table(spark, d, "part").where("p_size % 5 = 0").select(F.col("p_partkey").cast("string").alias("model_id")), "model_id", "left_semi")
    cols = ["model_id", "brand_title", "series_title", "model_title"]
    return state.merge_blacklists(V.blacklist(spark, d).select(*cols), new.select(*cols)).select("model_id", "brand_title", "origin")


@query("""SELECT CAST(p_partkey AS VARCHAR)||'__'||n_nationkey||'__01-01' AS task_key FROM part, nation""")
def plan_tasks(spark, d):
    """A task per item and city."""
    return state.plan_tasks(V.catalog(spark, d), V.cities(spark, d), "01-01").select("task_key")


@query(f"""WITH {sql.TASKS} SELECT id FROM tasks WHERE status IN ('pending','error','exception') AND model_id<>'' AND task_key NOT IN (SELECT task_key FROM tasks WHERE code='1')""")
def resume_tasks(spark, d):
    """Schedulable tasks less those done."""
    rows = V.tasks(spark, d)
    return state.still_to_do(state.schedulable(rows), rows.where("code = '1'")).select("id")


@query(f"""WITH {sql.TASKS}, r AS (SELECT *, row_number() OVER (PARTITION BY model_id ORDER BY id) AS nth FROM tasks WHERE code='3' AND status IN ('error')) SELECT model_id, brand_title, series_title, model_title, 'final_code_3' AS reason, 'status='||status||'; msg='||msg AS note FROM r WHERE nth=1""")
def blacklist_candidates(spark, d):
    """A21."""
    return state.blacklist_candidates(V.tasks(spark, d), "3", ["error"])


@query(f"""WITH {sql.QUOTES} SELECT run_key, count(*) AS scanned, count(CASE WHEN condition_bucket='open_excluded' THEN 1 END) AS updated FROM quotes GROUP BY 1""")
def reclassify(spark, d):
    """Rows that changed rules would classify anew."""
    from dataclasses import replace

    return state.reclassified(V.quotes(spark, d), replace(V.demo_rules(), open_exclude=()), ["condition_bucket", "is_target_price"])


@query("""SELECT p_partkey::VARCHAR AS model_id FROM part WHERE contains(replace(lower(p_brand),' ',''),'brand#1') OR contains(replace(lower(p_name),' ',''),'redwidget')""")
def catalog_filter(spark, d):
    """Items with a term in brand or model."""
    return state.catalog_filter(V.catalog(spark, d), ["brand#1", "redwidget"], ["brand_title", "model_title"]).select("model_id")


@query(f"""WITH {sql.RAW}, r AS (SELECT id, CASE WHEN id % 3 = 0 THEN price_text END AS t, CASE WHEN id % 3 = 1 THEN repeat(sname,3)||CAST(id % 97 AS VARCHAR) ELSE 'short' END AS p, id % 97 AS k, sname FROM raw), c AS (SELECT repeat(s_name,3)||CAST(i AS VARCHAR) AS p, CAST(100+i AS VARCHAR) AS v FROM supplier, range(50) t(i))
SELECT id, CASE WHEN t IS NOT NULL THEN 'plain' WHEN length(r.p)>40 AND c.v IS NOT NULL THEN 'cache_hit' WHEN length(r.p)>40 THEN 'to_extract' ELSE 'drop_invalid_price' END AS resolution, CAST(coalesce(t, CASE WHEN length(r.p)>40 THEN c.v END) AS BIGINT) AS resolved_price FROM r LEFT JOIN c ON r.p=c.p""")
def resolve_prices(spark, d):
    """Plain prices, cached ones, and those to extract."""
    rows = V.raw_quotes(spark, d)
    payload = lambda name, k: F.concat(F.repeat(name, 3), k.cast("string"))
    rows = rows.withColumns({"payload": F.when(F.col("id") % 3 == 1, payload("sname", F.col("id") % 97)).otherwise("short"), "price_text": F.when(F.col("id") % 3 == 0, F.col("price_text"))})
    cache = V.table(spark, d, "supplier").select("s_name", F.explode(F.sequence(F.lit(0), F.lit(49))).alias("i")).select(P.fingerprint(payload("s_name", F.col("i"))).alias("digest"), (F.col("i") + 100).cast("string").alias("value"), F.col("i").alias("arrival"))
    return state.resolve_prices(rows, cache).select("id", "resolution", "resolved_price")


@query(f"""WITH {sql.QUOTES}, f AS (SELECT brand_title, series_title, model_title, count(*) AS n FROM quotes GROUP BY ALL), m AS (SELECT *, row_number() OVER (PARTITION BY p ORDER BY n DESC, brand_title, series_title, model_title) AS nth FROM f, (VALUES ('red%'),('%widget')) v(p) WHERE model_title LIKE p), k AS (SELECT DISTINCT brand_title, series_title, model_title FROM m WHERE nth=1) SELECT q.id FROM quotes q JOIN k USING (brand_title, series_title, model_title)""")
def consistent_subset(spark, d):
    """Quotes of the largest family per pattern."""
    return state.consistent_subset(V.quotes(spark, d), V.tasks(spark, d), V.events(spark, d), ["red%", "%widget"])[1].select("id")


@query(f"""WITH {sql.RAW}, h AS (SELECT run_key, count(DISTINCT p) AS matched FROM raw, (VALUES ('red%'),('%widget'),('zzz%')) v(p) WHERE model_title LIKE p GROUP BY 1) SELECT *, row_number() OVER (ORDER BY matched DESC, run_key DESC) AS place FROM h""")
def best_run_for(spark, d):
    """J11."""
    return state.best_run_for(V.raw_quotes(spark, d), ["red%", "%widget", "zzz%"])


@query(f"""WITH {sql.EVENTS} SELECT task_key, arg_max(event_type,id) AS status, max(id) AS last_order, count(CASE WHEN event_type='processing' THEN 1 END) AS attempts FROM (SELECT id, task_key, CASE event_type WHEN 'click' THEN 'processing' WHEN 'error' THEN 'failed' WHEN 'purchase' THEN 'completed' ELSE 'queued' END AS event_type FROM run_events) GROUP BY 1""")
def queue_states(spark, d):
    """T8 as a batch: last state and attempts per item."""
    kind = F.when(F.col("event_type") == "click", "processing").when(F.col("event_type") == "error", "failed").when(F.col("event_type") == "purchase", "completed").otherwise("queued")
    return state.latest_state(V.events(spark, d).select("id", "task_key", kind.alias("status")), "task_key", "id")


@query(f"""WITH {sql.EVENTS}, g AS (SELECT id, task_key, CASE event_type WHEN 'error' THEN 'gap_detected' WHEN 'click' THEN 'gap_replay' WHEN 'purchase' THEN 'gap_resolved' ELSE 'gap_unresolved' END AS event_type FROM run_events) SELECT task_key, min(CASE WHEN event_type='gap_detected' THEN id END) AS first_detected, count(CASE WHEN event_type='gap_replay' THEN 1 END) AS attempts, arg_max(event_type,id) AS last_event, count(*) AS n_events FROM g GROUP BY 1""")
def gap_lifecycle(spark, d):
    """T4 as a batch."""
    kind = F.when(F.col("event_type") == "error", "gap_detected").when(F.col("event_type") == "click", "gap_replay").when(F.col("event_type") == "purchase", "gap_resolved").otherwise("gap_unresolved")
    return state.gap_lifecycle(V.events(spark, d).select("id", "task_key", kind.alias("event_type")))


@query("""WITH r AS (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderdate DESC, o_orderkey DESC) AS place FROM orders) SELECT o_orderkey AS artifact_id, place, CASE WHEN o_orderkey % 97 = 0 THEN NULL WHEN place > 200 THEN 'beyond_newest' WHEN date_diff('day', o_orderdate, TIMESTAMP '2001-09-01 00:00:00') > 60 THEN 'too_old' END AS remove_reason FROM r""")
def retention_plan(spark, d):
    """W12."""
    return state.retention_plan(V.artifacts(spark, d), 200, 60, F.to_date(F.lit("2001-09-01"))).select("artifact_id", "place", "remove_reason")


@query(f"""WITH {sql.QUOTES}, {sql.CLUSTERS.split(sql.QUOTES)[0].rstrip(', ')} SELECT run_key, count(*) AS quote_count, 0 AS snapshot_count, true AS ok FROM quotes GROUP BY run_key""")
def release_gate(spark, d):
    """A verdict per run without snapshots (release_gates has some)."""
    rows = V.quotes(spark, d)
    return reports.release_gate(rows.limit(0).select("run_key"), rows, ["run_key"]).select("run_key", "quote_count", "snapshot_count", "ok")


@query(f"""WITH {sql.QUOTES} SELECT id, run_key, brand_title, price_text, imported_at FROM quotes WHERE run_key='run_1998-01-01'""")
def scan_run(spark, d):
    """Quotes of a run."""
    return V.quotes(spark, d).where("run_key = 'run_1998-01-01'").select("id", "run_key", "brand_title", "price_text", "imported_at")


@query(f"""WITH {sql.QUOTES}, f AS (SELECT *, row_number() OVER (PARTITION BY {S} ORDER BY imported_at DESC, id DESC) AS place, count(*) OVER (PARTITION BY brand_title, series_title, model_title) AS family_rows FROM quotes) SELECT id, place, family_rows FROM f""")
def sku_rows(spark, d):
    """Rows of every SKU newest first, with the size of the model's family."""
    from pyspark.sql import Window

    df = V.quotes(spark, d)
    return df.select("id", F.row_number().over(Window.partitionBy(*reports.LINE).orderBy(F.desc("imported_at"), F.desc("id"))).alias("place"), F.count(F.lit(1)).over(Window.partitionBy("brand_title", "series_title", "model_title")).alias("family_rows"))


@query(f"""WITH {sql.EVENTS}, r AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY id DESC) AS place FROM run_events) SELECT id, event_type, CAST(json_extract(details_json,'$.k') AS BIGINT) AS k FROM r WHERE place<=200""")
def newest_events(spark, d):
    """The newest 200 events of each type, payload parsed."""
    from pyspark.sql import Window

    df = V.events(spark, d).withColumn("place", F.row_number().over(Window.partitionBy("event_type").orderBy(F.desc("id")))).where("place <= 200")
    return df.select("id", "event_type", F.from_json("details_json", "k long")["k"].alias("k"))


@query(f"""WITH {sql.RAW} SELECT id, lower(regexp_replace(model_title||group_title,'[^\\p{{L}}\\p{{N}}]','','g')) AS normal, model_title||'-'||group_title AS title, CAST(substr(gprice,1,2) AS INT) AS month, 'name:'||lower(sname) AS merchant, 'label:'||gprice AS bucket, right(run_key,10) AS run_day, regexp_extract(group_title,'[0-9]+G') AS capacity, CAST(regexp_extract(group_title,'[0-9]+') AS INT) AS storage, sha1(replace(sname||' '||gprice,' ','')) AS print FROM raw""")
def scalar_columns(spark, d):
    """P1-P13, P16-P19, P33, P36 over every quote."""
    spec = P.group_spec("group_title")
    return V.raw_quotes(spark, d).select(
        "id", P.normalize_search(P.search_text("model_title", "group_title")).alias("normal"), P.sku_title("model_title", "group_title").alias("title"), P.month_day(P.day_label())["month"].alias("month"), P.merchant(group_id=F.lit(None)).alias("merchant"), P.day_bucket()["key"].alias("bucket"), P.run_date("run_key").alias("run_day"),
        spec["capacity"].alias("capacity"), P.capacity_order(spec["capacity"])["storage"].alias("storage"), P.fingerprint(F.concat_ws(" ", "sname", "gprice")).alias("print"),
    )
