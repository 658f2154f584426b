"""Stand-in tables over a star schema: quotes, tasks, runs, events, reference rows, catalog, as lazy DataFrames.

They let every operator run over whole, growing tables; the rules document for them (`demo_rules`) puts the same
branches to work that the phone market's rules do."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pricewell.operators import rules as R


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def demo_rules() -> R.Rules:
    return R.Rules(
        out_of_stock=("31",), global_exclude=(), strict_brand_keywords=("brand#2",), strict_allow=("NO", "AO"), strict_exclude=("RF",), open_exclude=("AF",), strict_brand="Brand#2", target_keywords=("NO",), special_model=("ring",),
        positive=(("factory_sealed", "RO"), ("pure_original", "AO")), negative=(("opened", "red"), ("activated", "NF"), ("opened_not_activated", "cold"), ("demo", "SMALL")), sale=(("spot_goods", "bolt"),),
        hard_negative=("activated", "activation_date_present"), noise=("RF",), day_min_samples=12, day_max_labels=30, status_exact=(("NO", 36),), status_contains=(("O", 22),),
    )


def raw_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    line, part, supplier = (table(spark, sf_dir, t) for t in ("lineitem", "part", "supplier"))
    df = line.join(part, line["l_partkey"] == part["p_partkey"]).join(supplier, line["l_suppkey"] == supplier["s_suppkey"])
    key = F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.date_format("l_shipdate", "yyyyMMdd"))
    number = F.conv(F.substring(F.md5(key), 1, 15), 16, 10).cast("bigint")  # 60 bits of the line's whole key, at any size of the tables
    return df.select(
        number.alias("id"), F.concat(F.lit("run_"), F.year("l_shipdate").cast("string"), F.lit("-01-01")).alias("run_key"), F.col("l_orderkey").cast("string").alias("task_key"), F.col("l_partkey").cast("string").alias("model_id"),
        F.col("p_brand").alias("brand_title"), F.col("p_type").alias("series_title"), F.col("p_name").alias("model_title"), F.concat(F.lit("color "), F.col("p_size").cast("string"), F.lit("G")).alias("group_title"),
        F.col("s_name").alias("sname"), F.lit("").alias("sno"), F.concat("l_returnflag", "l_linestatus").alias("dstatus"), F.date_format("l_shipdate", "MM-dd").alias("gprice"), F.lit("").alias("gprice_two"),
        F.floor(F.col("l_extendedprice") / F.col("l_quantity")).cast("bigint").cast("string").alias("price_text"), F.when(F.col("l_discount") >= 0.10, "x").otherwise("").alias("activation"), F.date_format("l_shipdate", "yyyy-MM-dd HH:mm:ss").alias("imported_at"),
    )


def quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quotes as stored: with the classes of the rules."""
    return R.classify(raw_quotes(spark, sf_dir), demo_rules())


def tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, customer = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    line = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(
        F.count(F.lit(1)).alias("row_count"), F.count(F.when(F.col("l_returnflag") == "R", 1)).alias("drop_by_date"), F.count(F.when(F.col("l_linestatus") == "F", 1)).alias("drop_out_of_stock"), F.count(F.when(F.col("l_discount") >= 0.10, 1)).alias("drop_invalid_price"),
    )
    df = orders.join(customer, orders["o_custkey"] == customer["c_custkey"], "left").join(line, orders["o_orderkey"] == line["l_orderkey"], "left")
    count = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    return df.select(
        F.col("o_orderkey").alias("id"), F.concat(F.lit("run_"), F.year("o_orderdate").cast("string"), F.lit("-01-01")).alias("run_key"), F.col("o_orderkey").cast("string").alias("task_key"), F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss").alias("event_time"),
        F.coalesce("c_mktsegment", F.lit("")).alias("brand_title"), F.col("o_orderpriority").alias("series_title"), F.coalesce("c_name", F.lit("")).alias("model_title"), (F.col("o_custkey") % 50).cast("string").alias("model_id"),
        F.when(F.col("o_orderstatus") == "F", "ok").when(F.col("o_orderstatus") == "O", "error").otherwise("exception").alias("status"), F.substring("o_orderpriority", 1, 1).alias("code"), F.substring("o_orderpriority", 3, 20).alias("msg"),
        (F.coalesce("row_count", F.lit(0)) + F.coalesce("drop_by_date", F.lit(0))).alias("total_rows_seen"), count("row_count"), count("drop_by_date"), count("drop_out_of_stock"), count("drop_invalid_price"),
    )


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "events")
    return df.select(F.col("event_id").alias("id"), F.concat(F.lit("run_"), F.date_format("ts", "yyyy-MM-dd")).alias("run_key"), F.when(F.col("event_id") % 3 != 0, F.concat_ws("-", F.col("user_id").cast("string"), "event_type")).alias("event_key"), "ts", "event_type", F.col("user_id").cast("string").alias("task_key"), F.col("value"), F.col("props").alias("details_json"))


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run per year of orders, and one without quotes."""
    df = table(spark, sf_dir, "orders").groupBy(F.year("o_orderdate").alias("y")).agg(F.min("o_orderdate").alias("a"), F.max("o_orderdate").alias("b"), F.count(F.lit(1)).alias("n"))
    stamp = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss")
    return df.select(F.concat(F.lit("run_"), F.col("y").cast("string"), F.lit("-01-01")).alias("run_key"), stamp("a").alias("started_at"), stamp("b").alias("finished_at"), F.when(F.col("n") % 2 == 0, "completed").otherwise("running").alias("status"), stamp("a").alias("created_at"))


def reference_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "part")
    return df.select(F.col("p_partkey").alias("id"), (F.col("p_partkey") % 3).alias("import_id"), F.col("p_type").alias("source_title"), F.concat_ws(" ", "p_name", F.concat(F.col("p_size").cast("string"), F.lit("G"))).alias("raw_title"), F.col("p_brand").alias("brand_title"), F.col("p_type").alias("series_title"), F.col("p_name").alias("model_title"), F.concat(F.lit("color "), F.col("p_size").cast("string"), F.lit("G")).alias("group_title"), F.floor("p_retailprice").cast("bigint").alias("reference_price"), F.lit("2024-01-01 00:00:00").alias("imported_at"))


def catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_brand").alias("brand_id"), F.col("p_brand").alias("brand_title"), F.col("p_type").alias("series_id"), F.col("p_type").alias("series_title"), F.col("p_partkey").cast("string").alias("model_id"), F.col("p_name").alias("model_title"))


def cities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("string").alias("city_id"), F.col("n_name").alias("city_title"))


def blacklist(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "part").where("p_size % 10 = 0")
    return df.select(F.col("p_partkey").cast("string").alias("model_id"), F.when(F.col("p_size") == 30, "0").otherwise("1").alias("enabled"), F.col("p_brand").alias("brand_title"), F.col("p_type").alias("series_title"), F.col("p_name").alias("model_title"), F.lit("listed").alias("reason"), F.lit("batch1").alias("source_batch"), F.lit("").alias("note"))


def artifacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("artifact_id"), F.col("o_orderpriority").alias("class"), F.col("o_orderdate").alias("mtime"), F.floor("o_totalprice").cast("bigint").alias("size"), (F.col("o_orderkey") % 97 == 0).alias("marked"))
