"""Queries that run streams over whole tables to their end and return what they made, and batch twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from pricewell.operators import state
from pricewell.plans import sql
from pricewell.sources import views as V
from pricewell.streaming import jobs, walks

QUERIES, ORACLES = {}, {}


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return add


def _stream(spark, d):
    """The events table as a stream of its files, keyed as in the batch view."""
    path = f"{d}/events.parquet"
    schema = spark.read.parquet(path).schema
    source = spark.readStream.schema(schema).parquet(path) if _is_folder(spark, path) else spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(d)
    return _keyed(source)


def _is_folder(spark, path):
    name = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return name.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(name).isDirectory()


def _restarted(spark, d, run, parts=3):
    """Calls run(stream) again and again while the events' files arrive in `parts` portions by time: every call is a restart
    from the same checkpoint, and a batch of its own."""
    folder = jobs.scratch(spark, "arriving")
    events = spark.read.parquet(f"{d}/events.parquet")
    bounds = events.agg(F.percentile_approx("ts", [k / parts for k in range(1, parts)], 1000).alias("b")).first()["b"] or []
    lows, highs = [None, *bounds], [*bounds, None]
    schema = events.schema
    for low, high in zip(lows, highs, strict=True):
        own = events.where((F.lit(True) if low is None else F.col("ts") > F.lit(low)) & (F.lit(True) if high is None else F.col("ts") <= F.lit(high)))
        own.write.mode("append").parquet(folder)
        run(_keyed(spark.readStream.schema(schema).parquet(folder)))


def _keyed(source):
    key = F.concat_ws("-", F.col("user_id").cast("string"), "event_type")
    return source.select(F.col("event_id").cast("string").alias("message_id"), F.col("user_id").cast("string").alias("user_id"), F.col("ts").cast("timestamp").alias("ts"), "event_type", key.alias("key"))


@query("""SELECT CAST(event_id AS VARCHAR) AS message_id FROM (SELECT event_id, row_number() OVER (PARTITION BY event_id ORDER BY ts) AS n FROM events) WHERE n=1""")
def stream_deduplicated(spark, d):
    """Repeated callbacks dropped within 24 hours; the stream meets every event twice, in three batches with restarts."""
    out, checkpoint = jobs.scratch(spark, "out"), jobs.scratch(spark, "checkpoint")

    def run(stream):
        twice = stream.withColumn("copy", F.explode(F.array(F.lit(0), F.lit(1)))).drop("copy")
        jobs.run_available(jobs.drop_repeated(twice, ["message_id"]), lambda batch, epoch: batch.write.mode("overwrite").parquet(f"{out}/epoch={epoch}"), checkpoint)

    _restarted(spark, d, run)
    return spark.read.parquet(out).select("message_id")


@query("""SELECT CAST(event_id AS VARCHAR) AS message_id FROM events""")
def stream_once(spark, d):
    """Every message id once, by a table of those processed; each batch also brings what earlier ones had."""
    out, checkpoint = jobs.scratch(spark, "once"), jobs.scratch(spark, "checkpoint")
    sink = jobs.process_once(spark, out)

    def again(batch, epoch):
        earlier = spark.read.parquet(out).select(*batch.columns) if epoch else batch.limit(0)
        sink(batch.unionByName(batch).unionByName(earlier), epoch)

    _restarted(spark, d, lambda stream: jobs.run_available(stream, again, checkpoint))
    return spark.read.parquet(out).select("message_id")


@query("""SELECT event_type, count(*) AS n FROM events GROUP BY 1""")
def stream_counters(spark, d):
    """Running counters in update mode, each batch's changes merged into a table, over three batches with restarts."""
    table, checkpoint = jobs.scratch(spark, "counters"), jobs.scratch(spark, "checkpoint")
    sink = jobs.upsert_log(spark, table, ["event_type"], ["n"])
    _restarted(spark, d, lambda stream: jobs.run_available(jobs.count_by(stream, "event_type"), sink, checkpoint, "update"))
    return jobs.current_version(spark, table)


@query("""SELECT CAST(user_id AS VARCHAR) AS user_id, CAST(max(event_id) AS VARCHAR) AS message_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, CAST(event_id AS VARCHAR) DESC) AS n FROM events) WHERE n=1 GROUP BY 1""")
def stream_upserts(spark, d):
    """T5: last record per user by upserts, over three batches with restarts; the last batch is run twice."""
    table, checkpoint = jobs.scratch(spark, "log"), jobs.scratch(spark, "checkpoint")
    sink = jobs.upsert_log(spark, table, ["user_id"], ["ts", "message_id"])

    def twice(batch, epoch):
        sink(batch, epoch)
        if epoch:
            sink(batch, epoch)

    _restarted(spark, d, lambda stream: jobs.run_available(stream, twice, checkpoint))
    return jobs.current_version(spark, table).select("user_id", "message_id")


@query("""SELECT event_type, count(*) AS n, max(event_id) AS newest, 3 AS n_rebuilds FROM events GROUP BY 1""")
def stream_rebuilds(spark, d):
    """The index is rebuilt under a new version when the tables' marker (rows and newest time) differs from that of the
    last rebuild; every batch is run twice, and its second run finds the marker as it was."""
    state_path, stored, index, checkpoint = (jobs.scratch(spark, x) for x in ("state", "stored", "index", "checkpoint"))

    def marker():
        r = spark.read.parquet(stored).agg(F.count(F.lit(1)).alias("n"), F.max("ts").cast("string").alias("at")).first()
        return f"{r['n']}|{r['at']}"

    def rebuild(epoch):
        made = spark.read.parquet(stored).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.max(F.col("message_id").cast("long")).alias("newest"))
        made.write.mode("append").parquet(f"{index}/version={epoch}")

    def sink(batch, epoch):
        for _ in range(2):
            batch.write.mode("overwrite").parquet(f"{stored}/epoch={epoch}")
            jobs.on_change(spark, state_path, marker, rebuild)(batch, epoch)

    _restarted(spark, d, lambda stream: jobs.run_available(stream, sink, checkpoint))
    made = spark.read.parquet(index)
    count = made.groupBy("version", "event_type").agg(F.count(F.lit(1)).alias("k")).groupBy("event_type").agg(F.sum("k").cast("int").alias("n_rebuilds"))
    newest = made.groupBy("event_type").agg(F.max_by(F.struct("n", "newest"), "version").alias("s"))
    return newest.join(count, "event_type").select("event_type", "s.n", "s.newest", "n_rebuilds")


@query("""SELECT CAST(event_id AS VARCHAR) AS message_id FROM (SELECT event_id, ts - lag(ts) OVER (PARTITION BY user_id, event_type ORDER BY ts) AS gap FROM events) WHERE gap IS NULL OR gap > INTERVAL 6 HOUR""")
def stream_renewed(spark, d):
    """Callbacks of one key dropped until six hours pass without any; each sight renews the time to live."""
    out, checkpoint = jobs.scratch(spark, "renewed"), jobs.scratch(spark, "checkpoint")
    sink = jobs.renewed_sink(spark, out, ["key"], 6 * 3600)
    _restarted(spark, d, lambda stream: jobs.run_available(stream, sink, checkpoint))
    return spark.read.parquet(f"{out}/rows").select("message_id")


#: A state machine over each user's events in order; e has user_id, n (from 1), at (epoch microseconds), intent.
_MACHINE = """e AS (SELECT CAST(user_id AS VARCHAR) AS user_id, CAST(event_id AS VARCHAR) AS message_id, epoch_us(ts) AS us, CASE event_type WHEN 'click' THEN 'choice' WHEN 'error' THEN 'reset' WHEN 'purchase' THEN 'image' ELSE 'query' END AS intent, row_number() OVER (PARTITION BY user_id ORDER BY ts, CAST(event_id AS VARCHAR)) AS n FROM events),
s AS (SELECT user_id, 0::BIGINT AS n, 'idle' AS phase, 0::BIGINT AS us FROM e WHERE n=1 UNION ALL SELECT user_id, e.n, CASE intent WHEN 'reset' THEN 'idle' WHEN 'image' THEN 'awaiting_image' WHEN 'choice' THEN CASE WHEN was='awaiting_choice' THEN 'ready' ELSE was END ELSE 'awaiting_choice' END, e.us
 FROM (SELECT s.user_id, s.n, e.n AS m, CASE WHEN s.phase IN ('awaiting_choice','awaiting_image') AND e.us-s.us > 900000000 THEN 'idle' ELSE s.phase END AS was FROM s JOIN e ON e.user_id=s.user_id AND e.n=s.n+1) x JOIN e USING (user_id) WHERE e.n=x.m)"""


@query(f"""WITH RECURSIVE {_MACHINE}, m AS (SELECT s.user_id, s.n, message_id, phase, s.us, lag(phase) OVER w AS was, lag(s.us) OVER w AS before FROM s JOIN e ON e.user_id=s.user_id AND e.n=s.n WINDOW w AS (PARTITION BY s.user_id ORDER BY s.n)) SELECT user_id, message_id, phase, n AS turns, coalesce(was IN ('awaiting_choice','awaiting_image') AND us-before > 900000000, false) AS expired FROM m""")
def stream_sessions(spark, d):
    """The session state machine."""
    out, checkpoint = jobs.scratch(spark, "sessions"), jobs.scratch(spark, "checkpoint")
    jobs.run_available(_session_messages(_stream(spark, d)), walks.sessions_sink(spark, out), checkpoint)
    return spark.read.parquet(f"{out}/rows").where("message_id is not null").drop("at_us", "epoch")


@query(f"""WITH RECURSIVE {_MACHINE}, p AS (SELECT *, lead(us) OVER (PARTITION BY user_id ORDER BY n) AS next_at FROM s WHERE n>0), top AS (SELECT max(us) AS m FROM e) SELECT user_id, n AS turns, (us+900000000)//1000 AS lapsed_ms FROM p, top WHERE phase IN ('awaiting_choice','awaiting_image') AND coalesce(next_at-us > 900000000, us+900000000 < m)""")
def stream_lapses(spark, d):
    """Pending choices that lapse after 15 minutes, as rows of their own, whether or not a message follows."""
    out, checkpoint = jobs.scratch(spark, "sessions"), jobs.scratch(spark, "checkpoint")
    sink = walks.sessions_sink(spark, out)
    _restarted(spark, d, lambda stream: jobs.run_available(_session_messages(stream), sink, checkpoint))
    rows = spark.read.parquet(f"{out}/rows").where("message_id is null")
    return rows.select("user_id", "turns", F.unix_millis(F.timestamp_micros("at_us")).alias("lapsed_ms"))


#: The queue's machine: status, opened, attempts, claimed and claims after each action of a task; out is what leaves.
_QUEUE = """q AS (SELECT CAST(user_id AS VARCHAR) AS task_key, event_id AS id, epoch_us(ts) AS us, CASE event_type WHEN 'click' THEN 'claim' WHEN 'error' THEN 'fail' WHEN 'purchase' THEN 'complete' ELSE 'queue' END AS action, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
w AS (SELECT task_key, 0::BIGINT AS n, NULL::VARCHAR AS status, 0::BIGINT AS opened, 0::BIGINT AS attempts, 0::BIGINT AS claimed, '' AS claims, NULL::VARCHAR AS outcome, 0::BIGINT AS id FROM q WHERE n=1 UNION ALL
 SELECT task_key, n, CASE WHEN action='queue' AND st IS NULL THEN 'queued' WHEN action='claim' AND st='queued' THEN 'processing' WHEN closes THEN NULL WHEN action='fail' AND st IS NOT NULL THEN 'queued' ELSE st END, CASE WHEN action='queue' AND st IS NULL THEN id ELSE opened END, CASE WHEN action='queue' AND st IS NULL THEN 0 WHEN action='claim' AND st='queued' THEN attempts+1 ELSE attempts END,
  CASE WHEN action='claim' AND st='queued' THEN us ELSE claimed END, CASE WHEN action='queue' AND st IS NULL THEN '' WHEN action='claim' AND st='queued' THEN claims||CASE WHEN claims='' THEN '' ELSE ',' END||id ELSE claims END, CASE WHEN closes THEN CASE action WHEN 'complete' THEN 'completed' ELSE 'given_up' END END, id
 FROM (SELECT *, st='processing' AND (action='complete' OR action='fail' AND attempts>=3) AS closes FROM (SELECT w.task_key, q.n, q.id, q.us, q.action, w.opened, w.attempts, w.claimed, w.claims, CASE WHEN w.status='processing' AND q.us-w.claimed > 86400000000 THEN 'queued' ELSE w.status END AS st FROM w JOIN q ON q.task_key=w.task_key AND q.n=w.n+1)))"""


@query(f"""WITH RECURSIVE {_QUEUE} SELECT task_key, opened AS opened_id, id AS closed_id, outcome, attempts, claims FROM w WHERE outcome IS NOT NULL""")
def stream_queue(spark, d):
    """A work queue with claims, leases of a day, attempts, and an archive of what was completed or given up."""
    action = F.when(F.col("event_type") == "click", "claim").when(F.col("event_type") == "error", "fail").when(F.col("event_type") == "purchase", "complete").otherwise("queue")
    out, checkpoint = jobs.scratch(spark, "queue"), jobs.scratch(spark, "checkpoint")
    sink = walks.queue_sink(spark, out, 86400)
    _restarted(spark, d, lambda stream: jobs.run_available(stream.select(F.col("user_id").alias("task_key"), F.col("message_id").cast("long").alias("id"), "ts", action.alias("action")), sink, checkpoint))
    return spark.read.parquet(f"{out}/rows").drop("epoch")


@query(f"""WITH {sql.EVENTS}, g AS (SELECT id, task_key, CASE event_type WHEN 'error' THEN 'gap_detected' WHEN 'click' THEN 'gap_replay' WHEN 'purchase' THEN 'gap_resolved' ELSE 'gap_unresolved' END AS event_type FROM run_events) SELECT task_key, min(CASE WHEN event_type='gap_detected' THEN id END) AS first_detected, count(CASE WHEN event_type='gap_replay' THEN 1 END) AS attempts, arg_max(event_type,id) AS last_event, count(*) AS n_events FROM g GROUP BY 1""")
def stream_gaps(spark, d):
    """T4: the gap lifecycle of every task, kept up to date batch by batch; every batch is run twice."""
    table, checkpoint = jobs.scratch(spark, "gaps"), jobs.scratch(spark, "checkpoint")
    kind = F.when(F.col("event_type") == "error", "gap_detected").when(F.col("event_type") == "click", "gap_replay").when(F.col("event_type") == "purchase", "gap_resolved").otherwise("gap_unresolved")
    sink = jobs.gap_sink(spark, table)

    def twice(batch, epoch):
        rows = batch.select(F.col("message_id").cast("long").alias("id"), F.col("user_id").alias("task_key"), kind.alias("event_type"))
        for _ in range(2):
            sink(rows, epoch)

    _restarted(spark, d, lambda stream: jobs.run_available(stream, twice, checkpoint))
    return jobs.current_version(spark, table).drop("last_id")


def _session_messages(stream):
    return _intents(stream).select("user_id", "message_id", "ts", "intent")


def _intents(df):
    return df.withColumn("intent", F.when(F.col("event_type") == "click", "choice").when(F.col("event_type") == "error", "reset").when(F.col("event_type") == "purchase", "image").otherwise("query"))


@query("""WITH e AS (SELECT CAST(user_id AS VARCHAR) AS user_id, ts, CASE event_type WHEN 'click' THEN 'choice' WHEN 'error' THEN 'reset' WHEN 'purchase' THEN 'image' ELSE 'query' END AS intent, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 15 MINUTE THEN 0 ELSE 1 END AS b FROM events), s AS (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM e) SELECT user_id, min(ts) AS begins, count(*) AS n, arg_max(intent, ts) AS last_intent FROM s GROUP BY user_id, k""")
def session_windows(spark, d):
    """T3 as a batch: sessions by gaps of 15 minutes."""
    events = V.events(spark, d).select(F.col("task_key").alias("user_id"), F.col("ts").cast("timestamp").alias("ts"), "event_type")
    return jobs.session_windows(_intents(events)).withColumn("begins", F.col("begins").cast("timestamp_ntz"))


@query(f"""WITH {sql.EVENTS}, g AS (SELECT id, task_key, CASE event_type WHEN 'error' THEN 'gap_detected' WHEN 'click' THEN 'gap_replay' WHEN 'purchase' THEN 'gap_resolved' ELSE 'gap_unresolved' END AS event_type FROM run_events) SELECT event_type, count(*) AS n FROM (SELECT task_key, arg_max(event_type, id) AS event_type FROM g GROUP BY 1) GROUP BY 1""")
def gap_summary(spark, d):
    """Tasks by how their gap stands."""
    kind = F.when(F.col("event_type") == "error", "gap_detected").when(F.col("event_type") == "click", "gap_replay").when(F.col("event_type") == "purchase", "gap_resolved").otherwise("gap_unresolved")
    return state.gap_lifecycle(V.events(spark, d).select("id", "task_key", kind.alias("event_type"))).groupBy(F.col("last_event").alias("event_type")).agg(F.count(F.lit(1)).alias("n"))
