"""The import of runs writes every row to CSV once, and imports all that was written."""

from pyspark.sql import functions as F

from pricewell.plans import file_queries
from pricewell.sources import sinks
from pricewell.sources import views as V

SF = "/root/testdata/sf0.001"


def test_rows_are_written_to_csv_once(spark, monkeypatch):
    written, write = [], sinks.write_csv
    monkeypatch.setattr(sinks, "write_csv", lambda df, path, columns: (written.append(df.count()), write(df, path, columns)))
    got = file_queries.import_runs(spark, SF)
    raw = V.raw_quotes(spark, SF)
    n, early = raw.count(), raw.where("run_key <> 'run_1995-01-01'").count()
    assert 0 < early < n and sum(written) == n
    assert got.agg(F.sum("n")).first()[0] == early + n
