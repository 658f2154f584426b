"""Few bytes of phrases are much work: their readings are many tasks, and a text's tier is worked out token by token."""

from pyspark.sql import functions as F

from pricewell.functions import phrases as X
from pricewell.operators import matching as T


def test_readings_are_spread_over_all_tasks(spark):
    phrases = spark.createDataFrame([(f"brand {k} small ring {k % 50}g",) for k in range(200)], "query string")
    made = X.expand(phrases, X.Terms(known=("small", "ring"))).withColumn("task", F.spark_partition_id())
    assert made.select("task").distinct().count() == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_tier_by_hand():
    family = ("hotring", "small", "\nhotring\nhrg\n", "\nsmallhotring\n", "\nbrand7smallhotring\ncolor12g\n")
    impacts = {}
    of = lambda q, *others: T.tier(q, list(others), *family, impacts)
    assert (of("hotring"), of("ring"), of("hot"), of("otrin"), of("hrg")) == (4200, 3200, 2850, 2250, 3600)
    assert of("smallhotring") == 3400 and of("brand7smallhotring") == 3000 and of("color12g") == 3000 and of("color") == 1650 and of("12g") == 1350
    assert of("hotring12g", "hot", "ring", "12g") == 440 + 440 + 260 + 320
    assert of("hotringred", "hot", "ring", "red") == 440 + 440 - 260 and of("hotredblue", "hot", "red", "blue", "old") == 440 - 3 * 260
    assert of("red", ) == -1 and of("redblue", "red", "blue") == -1 and of("") == -1
    assert impacts["hot"] == 440 and impacts["12g"] == 260 and impacts["red"] == 0
