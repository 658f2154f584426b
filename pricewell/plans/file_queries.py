"""Queries that write whole tables as files, in the formats and with the faults that sources have, and read them back."""

from __future__ import annotations

from dataclasses import replace

import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf
from pyspark.sql.types import BinaryType

from pricewell.functions import columns as P
from pricewell.operators import reports, state, textscan
from pricewell.operators import rules as R
from pricewell.plans import sql
from pricewell.plans.sql import S
from pricewell.settled import new_dir, settle
from pricewell.sources import readers, schemas, sinks, versions
from pricewell.sources import views as V
from pricewell.sources.versions import Clustered, Versions

QUERIES, ORACLES = {}, {}


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return add


@query(f"""WITH {sql.TASKS} SELECT task_key, status, row_count FROM tasks WHERE id % 7 <> 0 AND id % 11 <> 0""")
def json_lines(spark, d):
    """Tasks as JSON lines, some blank and some malformed, scanned back."""
    rows, path = V.tasks(spark, d), new_dir(spark, "lines")
    line = F.when(F.col("id") % 7 == 0, "{broken").when(F.col("id") % 11 == 0, "").otherwise(F.to_json(F.struct("run_key", "task_key", "status", "row_count")))
    rows.select(line.alias("value")).write.text(path)
    return readers.read_json_lines(spark, path, schemas.TASKS).select("task_key", "status", "row_count")


def _blacklist_files(spark, d):
    rows, folder = V.blacklist(spark, d), new_dir(spark, "blacklist")
    plain = F.concat_ws(",", "model_id", "brand_title")
    rows.select(F.explode(F.array(F.when(F.col("enabled") == "1", plain).otherwise(F.concat(F.lit("# "), plain)), F.lit("")))).write.text(f"{folder}/plain.txt")
    rows.select("enabled", "brand_title", "model_id").write.option("header", True).csv(f"{folder}/named.csv")
    rows.select("model_id", "enabled").write.json(f"{folder}/rows.json")
    return folder


@query(f"""WITH {sql.BLACKLIST} SELECT f.f AS format, model_id FROM blacklist, (VALUES ('plain.txt'),('named.csv'),('rows.json')) f(f) WHERE enabled<>'0'""")
def blacklist_files(spark, d):
    """Enabled model ids of a text, a CSV and a JSON blacklist."""
    folder, out = _blacklist_files(spark, d), None
    for name in ("plain.txt", "named.csv", "rows.json"):
        ids = readers.read_blacklist(spark, f"{folder}/{name}").select(F.lit(name).alias("format"), "model_id")
        out = ids if out is None else out.unionByName(ids)
    return out


@query(f"""WITH {sql.BLACKLIST} SELECT model_id, CASE CAST(model_id AS BIGINT) % 3 WHEN 0 THEN 'imported with batch1' WHEN 1 THEN 'imported with batch1' ELSE 'kept ?' END AS note FROM blacklist""")
def blacklist_notes(spark, d):
    """Blacklist CSV with fixed columns written, read back, notes that are empty or mostly question marks written anew."""
    rows, path = V.blacklist(spark, d), new_dir(spark, "notes")
    k = F.col("model_id").cast("long") % 3
    rows = rows.withColumn("note", F.when(k == 0, "").when(k == 1, "????????").otherwise("kept ?"))
    sinks.write_csv(rows, path, schemas.BLACKLIST.names)
    back = readers.read_csv(spark, path, schemas.BLACKLIST)
    return state.repair_note(back).select("model_id", "note")


@query("""SELECT p_brand AS brand_title, p_type AS series_title, p_name||'-'||p_size AS sku_title, arg_max(CAST(floor(p_retailprice) AS BIGINT), p_partkey) AS reference_price FROM part GROUP BY 1,2,3""")
def healthy_prices(spark, d):
    """Of three price imports, the newest that counts enough rows."""
    part, root = V.table(spark, d, "part"), new_dir(spark, "prices")
    n = part.count()
    for name, rows, at, price in (("a", n, "2026-01-01", F.lit("1")), ("b", 0, "2026-01-03", F.lit("2")), ("c", n, "2026-01-02", F.floor("p_retailprice").cast("long").cast("string"))):
        priced = part.select(F.col("p_brand").alias("brand_title"), F.col("p_type").alias("series_title"), F.concat_ws("-", "p_name", "p_size").alias("sku_title"), price.alias("reference_price"), "p_partkey")
        priced = priced.groupBy("brand_title", "series_title", "sku_title").agg(F.max_by("reference_price", "p_partkey").alias("reference_price"))
        priced.write.option("header", True).csv(f"{root}/{name}/prices.csv")
        spark.range(1).select(F.lit(rows).alias("supplier_rows"), F.lit(at).alias("finished_at")).coalesce(1).write.json(f"{root}/{name}/summary.json")
    return readers.latest_healthy_prices(spark, root, min(n, 1000))


@arrow_udf(BinaryType())
def _gb18030(texts: pa.Array) -> pa.Array:
    return pa.array([None if x is None else x.encode("gb18030") for x in texts.to_pylist()], pa.binary())


@query("""SELECT doc_id, sha256(coalesce(text,'')) AS digest FROM documents""")
def decoded_texts(spark, d):
    """Texts as UTF-8, UTF-8 with mark and GB18030 bytes, decoded by what they are."""
    text = F.coalesce("text", F.lit(""))
    k = F.pmod("doc_id", F.lit(3))
    plain = F.encode(text, "UTF-8")
    docs = V.table(spark, d, "documents").select("doc_id", F.when(k == 0, plain).when(k == 1, F.concat(F.unhex(F.lit("EFBBBF")), plain)).otherwise(_gb18030(text)).alias("content"))
    return textscan.decode_content(docs).select("doc_id", F.sha2("text", 256).alias("digest"))


@query("""SELECT p_brand AS brand_title, p_name AS model_title, CAST(p_partkey AS VARCHAR) AS model_id FROM part""")
def first_catalog(spark, d):
    """The first of several catalogs that is there."""
    folder = new_dir(spark, "catalog")
    V.catalog(spark, d).write.json(f"{folder}/all.json")
    return readers.read_catalog(spark, [f"{folder}/brand.json", f"{folder}/all.json"]).select("brand_title", "model_title", "model_id")


@query(f"""WITH {sql.QUOTES} SELECT model_id, condition_bucket, is_target_price::BIGINT AS is_target_price, count(*) AS n FROM quotes WHERE run_key <> 'run_1995-01-01' GROUP BY ALL UNION ALL SELECT model_id, condition_bucket, is_target_price::BIGINT, count(*) FROM quotes GROUP BY ALL""")
def import_runs(spark, d):
    """CSV runs imported, classified, one of them again; the runs' rows by class, and those of a second import of all."""
    table, raw, out = new_dir(spark, "quotes"), V.raw_quotes(spark, d), None
    csv, rest = new_dir(spark, "run"), new_dir(spark, "run")
    late = F.coalesce(F.col("run_key") == "run_1995-01-01", F.lit(True))
    sinks.write_csv(raw.where(~late), csv, schemas.QUOTE_CSV.names)
    sinks.write_csv(raw.where(late), rest, schemas.QUOTE_CSV.names)
    both = [csv, rest]  # every row is written once, and all of them are two folders
    for path, run in ((both, "run_a"), (csv, "run_a"), (both, "run_b")):
        sinks.import_run(spark, path, table, V.demo_rules(), run, "2026-01-01 00:00:00")
    out = spark.read.parquet(table)
    return out.groupBy("run_key", "model_id", "condition_bucket", F.col("is_target_price").cast("long").alias("is_target_price")).agg(F.count(F.lit(1)).alias("n")).drop("run_key")


SNAPSHOT = ["brand_title", "series_title", "model_title", "group_title", "condition_bucket", "row_count", "latest_gprice", "remark"]


@query(f"""WITH {sql.QUOTES} SELECT {S}, CAST(count(*) AS VARCHAR) AS row_count, max(gprice) AS latest_gprice, CAST(NULL AS VARCHAR) AS remark FROM quotes GROUP BY {S}""")
def exported_snapshots(spark, d):
    """SKUs exported as CSV with fixed columns, read back; an export without rows has the header alone."""
    folder, rows = new_dir(spark, "export"), reports.sku_catalog(V.quotes(spark, d))
    sinks.export(rows, rows.limit(0), folder, SNAPSHOT, ["model_title"])
    kind = schemas.T.StructType([schemas.T.StructField(c, schemas.T.StringType()) for c in SNAPSHOT])
    back = readers.read_csv(spark, f"{folder}/snapshots", kind)
    empty = spark.read.option("header", True).csv(f"{folder}/clusters")
    return back if empty.columns == ["model_title"] and empty.isEmpty() else back.limit(0)


@query(f"""WITH {sql.QUOTES}, r AS (SELECT run_key, count(*) AS n FROM (SELECT DISTINCT run_key, {S} FROM quotes) GROUP BY 1), m AS (SELECT max(run_key) AS k FROM r) SELECT r.run_key, n, r.run_key=m.k AS live, n AS published FROM r, m""")
def published_runs(spark, d):
    """Every run published in turn, one of them twice; the pointer names the last, events tell the rows."""
    path, states, events = new_dir(spark, "published"), new_dir(spark, "state"), new_dir(spark, "events")
    rows = settle(V.quotes(spark, d).select("run_key", *reports.LINE).distinct(), "run-lines")  # every run reads it: the joins run once
    runs = [r["run_key"] for r in rows.select("run_key").distinct().orderBy("run_key").collect()]  # one per year
    for at, run in enumerate([runs[0], *runs]):
        sinks.publish(rows.where(F.col("run_key") == run).drop("run_key"), path, states, run, f"2026-01-01 00:00:{at:02d}", events)
    live = sinks.live_state(sinks.get_state(spark, states, "live_run")).select(F.col("run_key").alias("live_key"))
    told = spark.read.parquet(events).groupBy("run_key").agg(F.max_by(F.from_json("details_json", "n long")["n"], "ts").alias("published"))
    kept = Versions(spark, path).read().groupBy("run_key").agg(F.count(F.lit(1)).alias("n")).join(told, "run_key").join(F.broadcast(live), how="cross")
    return kept.select(F.col("run_key").cast("string").alias("run_key"), "n", (F.col("run_key") == F.col("live_key")).alias("live"), "published")


@query(f"""WITH {sql.QUOTES}, q AS (SELECT *, CAST(substr(run_key,5,4) AS INT) % 2 = 1 AND condition_bucket='open_excluded' AS stale FROM quotes) SELECT run_key, count(*) AS n, count(CASE WHEN stale THEN 1 END) AS updated, bool_or(stale) AS rewritten, sum(CASE WHEN condition_bucket='open_excluded' THEN 1 ELSE is_target_price END)::BIGINT AS targets FROM q GROUP BY 1""")
def written_back(spark, d):
    """Stored rows classified again under changed rules; runs with a change are rewritten under a new version and
    logged, other runs (here the even ones, which the changed rules have classified already) keep their files. Done twice:
    the second time nothing changes."""
    path, events = new_dir(spark, "stored"), new_dir(spark, "events")
    table, changed, raw = Versions(spark, path), replace(V.demo_rules(), open_exclude=()), V.raw_quotes(spark, d)
    odd = F.substring("run_key", 5, 4).cast("int") % 2 == 1
    rows = R.classify(raw.where(odd), V.demo_rules()).unionByName(R.classify(raw.where(~odd), changed))
    table.replace(rows.select("run_key", "id", "brand_title", "series_title", "model_title", "group_title", "dstatus", "activation", "condition_bucket", "is_target_price"))
    before = table.snapshot()
    versions.write_back(table, changed, ["condition_bucket", "is_target_price"], "2026-01-01 00:00:00", events)
    again = versions.write_back(table, changed, ["condition_bucket", "is_target_price"], "2026-01-02 00:00:00", events)
    after = spark.createDataFrame([(p, v != before[p]) for p, v in table.snapshot().items()], "run_key string, rewritten boolean")  # a row for each run
    told = spark.read.parquet(events).select("run_key", F.from_json("details_json", "updated long")["updated"].alias("told"))
    rows = table.read().groupBy("run_key").agg(F.count(F.lit(1)).alias("n"), F.sum("is_target_price").alias("targets"))
    out = rows.join(after, "run_key").join(told, "run_key", "left").join(again.where("updated = 0").select("run_key"), "run_key")
    return out.select("run_key", "n", F.coalesce("told", F.lit(0)).alias("updated"), "rewritten", "targets")


@query(f"""WITH {sql.QUOTES}, t AS (SELECT DISTINCT run_key, task_key FROM quotes WHERE run_key IN ('run_1994-01-01','run_1996-01-01') AND CAST(task_key AS BIGINT) % 5 = 0) SELECT run_key, count(*) AS n, count(CASE WHEN (run_key, task_key) IN (SELECT (run_key, task_key) FROM t) THEN 1 END) AS replaced, run_key IN ('run_1994-01-01','run_1996-01-01') AS rewritten FROM (SELECT run_key, task_key FROM quotes WHERE (run_key, task_key) NOT IN (SELECT (run_key, task_key) FROM t) UNION ALL SELECT * FROM t) GROUP BY 1""")
def replaced_in_place(spark, d):
    """A run's rows of some tasks replaced by one row each, in stored partitions; other runs keep their files."""
    table, rows = Versions(spark, new_dir(spark, "stored")), V.quotes(spark, d).select("run_key", "task_key", "price_text")
    table.replace(rows)
    before = table.snapshot()
    some = rows.where(F.col("run_key").isin("run_1994-01-01", "run_1996-01-01") & (F.col("task_key").cast("long") % 5 == 0)).select("run_key", "task_key").distinct()
    versions.replace_task_rows(table, some.withColumn("price_text", F.lit("new")), ["task_key"])
    after = spark.createDataFrame([(p, v != before.get(p)) for p, v in table.snapshot().items()], "run_key string, rewritten boolean")  # a row for each run
    made = table.read().groupBy("run_key").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("price_text") == "new", 1)).alias("replaced"))
    return made.join(after, "run_key")


@query(f"""WITH {sql.QUOTES}, n AS (SELECT brand_title, series_title, model_title, count(*) AS n FROM quotes GROUP BY ALL), k AS (SELECT brand_title, series_title, model_title FROM n ORDER BY n DESC, brand_title, series_title, model_title LIMIT 1) SELECT id, group_title, condition_bucket, gprice, price_text, true AS few_files FROM quotes JOIN k USING (brand_title, series_title, model_title)""")
def sku_lookup(spark, d):
    """The quotes of one product, the most quoted one, from a clustered layout; the lookup reads few of its files."""
    rows, keys = V.quotes(spark, d), ["brand_title", "series_title", "model_title"]
    table = Clustered(spark, new_dir(spark, "clustered"), keys)
    table.write(rows.select(*keys, "id", "group_title", "condition_bucket", "gprice", "price_text"), 40)
    best = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), *keys).first()
    found = table.lookup(**{k: best[k] for k in keys})
    few = len(found.inputFiles()) * 8 <= table.manifest().count()
    return found.select("id", "group_title", "condition_bucket", "gprice", "price_text", F.lit(few).alias("few_files"))


@query(f"""WITH {sql.BLACKLIST}, n AS (SELECT CAST(p_partkey AS VARCHAR) AS model_id, CASE WHEN p_partkey % 2 = 0 THEN '0' ELSE '1' END AS enabled FROM part WHERE p_size % 15 = 0) SELECT coalesce(n.model_id, b.model_id) AS model_id, coalesce(n.enabled, b.enabled) AS enabled FROM blacklist b FULL JOIN n ON b.model_id=n.model_id""")
def import_blacklist(spark, d):
    """A blacklist upserted by model id, enabled flags parsed."""
    part = V.table(spark, d, "part").where("p_size % 15 = 0")
    new = part.select(F.col("p_partkey").cast("string").alias("model_id"), F.when(F.col("p_partkey") % 2 == 0, " Off ").otherwise("yes").alias("enabled"))
    return state.import_blacklist(V.blacklist(spark, d).select("model_id", "enabled"), new).select("model_id", "enabled")


@query(f"""WITH {sql.QUOTES} SELECT 'count' AS section, 'quotes' AS name, CAST(count(*) AS VARCHAR) AS value FROM quotes UNION ALL SELECT 'count', 'skus', CAST(count(*) AS VARCHAR) FROM (SELECT DISTINCT {S} FROM quotes) UNION ALL SELECT 'file', 'skus/'||brand_title, CAST(sum(strlen(concat_ws(',', series_title, model_title, group_title, condition_bucket))+1) AS VARCHAR) FROM (SELECT DISTINCT {S} FROM quotes) GROUP BY brand_title UNION ALL SELECT 'version', 'app', '1.2'""")
def release_manifest(spark, d):
    """Row counts, versions, and the size of each folder of the release, by the sizes of its files."""
    folder, rows = new_dir(spark, "release"), V.quotes(spark, d)
    skus = rows.select(*reports.LINE).distinct()
    skus.write.partitionBy("brand_title").csv(f"{folder}/skus")
    made = sinks.release_manifest(spark, folder, {"quotes": rows, "skus": skus}, {"app": "1.2"})
    brand = F.concat(F.lit("skus/"), F.url_decode(F.regexp_extract("name", "brand_title=([^/]+)/", 1)))
    files = made.where("section = 'file'").groupBy(brand.alias("name")).agg(F.sum(F.col("value").cast("long")).cast("string").alias("value"))
    return made.where("section <> 'file'").unionByName(files.select(F.lit("file").alias("section"), "name", "value"))


@query("""WITH w AS (SELECT doc_id, trim(x, ' ') AS x, i FROM (SELECT doc_id, unnest(string_split(coalesce(text,''), ' ')) AS x, generate_subscripts(string_split(coalesce(text,''), ' '), 1) AS i FROM documents)), f AS (SELECT *, row_number() OVER (PARTITION BY doc_id, lower(x) ORDER BY i) AS n FROM w WHERE x<>'') SELECT doc_id, coalesce(string_agg(CASE WHEN n=1 THEN x END, ' ' ORDER BY i),'') AS labels FROM documents LEFT JOIN f USING (doc_id) GROUP BY doc_id""")
def distinct_labels(spark, d):
    """Ordered distinct texts, case-folded, of all words of each text."""
    words = F.split(F.coalesce("text", F.lit("")), " ")
    return V.table(spark, d, "documents").select("doc_id", F.array_join(P.distinct_texts(words), " ").alias("labels"))


@query(f"""WITH {sql.QUOTES}, m AS (SELECT {S}, count(*) AS n FROM quotes WHERE is_target_price=1 GROUP BY {S}) SELECT run_key, count(*) AS quote_count, CASE WHEN right(left(run_key,8),1) IN ('3','5','7') THEN count(DISTINCT ({S})) ELSE 0 END AS snapshot_count, true AS ok FROM quotes GROUP BY run_key""")
def release_gates(spark, d):
    """A verdict per run, where some runs have snapshots and others only quotes."""
    rows = V.quotes(spark, d)
    snapshots = rows.select("run_key", *reports.LINE).distinct().where(F.substring("run_key", 8, 1).isin("3", "5", "7"))
    return reports.release_gate(snapshots, rows, ["run_key"]).select("run_key", "quote_count", "snapshot_count", "ok")


@query(f"""WITH {sql.TASKS}, s AS (SELECT * FROM tasks WHERE id % 3 <> 0), n AS (SELECT * FROM tasks WHERE id % 3 = 0), rs AS (SELECT *, row_number() OVER (PARTITION BY model_id ORDER BY event_time DESC, id DESC) AS nth FROM s), rn AS (SELECT *, row_number() OVER (PARTITION BY model_id ORDER BY event_time DESC, id DESC) AS nth FROM n),
c AS (SELECT model_id, coalesce(arg_min(event_time, struct_pack(a := CASE WHEN id % 3 = 0 THEN 1 ELSE 0 END, b := event_time, c := id)), '') AS created_at FROM tasks GROUP BY 1)
SELECT coalesce(a.model_id,b.model_id) AS model_id, coalesce(b.id,a.id) AS id, coalesce(b.status,a.status) AS status, created_at FROM (SELECT * FROM rs WHERE nth=1) a FULL JOIN (SELECT * FROM rn WHERE nth=1) b ON a.model_id=b.model_id JOIN c ON c.model_id=coalesce(a.model_id,b.model_id)""")
def upsert_stored(spark, d):
    """Incoming rows over stored ones, whatever their times, with the first time kept."""
    rows = V.tasks(spark, d).select("model_id", "id", "status", F.col("event_time").alias("created_at"), "event_time")
    return state.upsert(rows.where("id % 3 <> 0"), rows.where("id % 3 = 0"), ["model_id"], ["event_time", "id"], ("created_at",)).select("model_id", "id", "status", "created_at")


@query(f"""WITH {sql.QUOTES}, {sql.TASKS}, {sql.EVENTS}, f AS (SELECT brand_title, series_title, model_title, count(*) AS n FROM quotes GROUP BY ALL), m AS (SELECT *, row_number() OVER (PARTITION BY p ORDER BY n DESC, brand_title, series_title, model_title) AS nth FROM f, (VALUES ('red%'),('%widget')) v(p) WHERE model_title LIKE p), k AS (SELECT DISTINCT brand_title, series_title, model_title FROM m WHERE nth=1), q AS (SELECT q.* FROM quotes q JOIN k USING (brand_title, series_title, model_title)),
e AS (SELECT id FROM run_events WHERE task_key IN (SELECT task_key FROM q) ORDER BY id DESC LIMIT 200)
SELECT 'families' AS part, count(*) AS n, sum(n)::BIGINT AS total FROM m WHERE nth=1 UNION ALL SELECT 'quotes', count(*), count(*) FROM q UNION ALL SELECT 'tasks', count(*), coalesce(sum(row_count),0)::BIGINT FROM tasks WHERE (run_key, task_key) IN (SELECT (run_key, task_key) FROM q) UNION ALL SELECT 'events', count(*), coalesce(sum(id),0)::BIGINT FROM e""")
def consistent_parts(spark, d):
    """All four parts of a consistent subset, counted."""
    parts = state.consistent_subset(V.quotes(spark, d), V.tasks(spark, d), V.events(spark, d), ["red%", "%widget"])
    total = {"families": F.sum("n"), "quotes": F.count(F.lit(1)), "tasks": F.coalesce(F.sum("row_count"), F.lit(0)), "events": F.coalesce(F.sum("id"), F.lit(0))}
    out = None
    for (name, how), df in zip(total.items(), parts, strict=True):
        one = df.agg(F.count(F.lit(1)).alias("n"), how.cast("long").alias("total")).select(F.lit(name).alias("part"), "n", "total")
        out = one if out is None else out.unionByName(one)
    return out
