"""stage_figures reads the quotes once for the sellers' newest rows and once for their count."""

from pricewell.plans import more_queries


def test_quotes_are_not_read_for_every_figure(spark):
    made = more_queries.QUERIES["stage_figures"](spark, "/root/testdata/sf0.001")
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [l_orderkey") == 1
    assert {r["name"] for r in made.collect()} >= {"source_rows", "deduped_rows", "recent_rows", "target_rows"}
