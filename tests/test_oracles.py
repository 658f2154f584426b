"""Every registered query of the reference operators runs; those with SQL twins give the same rows as DuckDB."""

import math

import duckdb
import pytest

from pricewell.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def canon(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])

    def one(v):
        if v is None or isinstance(v, float) and math.isnan(v):
            return "NULL"
        if isinstance(v, bool):
            return str(v)
        return f"{float(v):.6f}" if isinstance(v, (int, float)) or type(v).__name__ == "Decimal" else str(v)

    return sorted(tuple(one(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF)
    rows = [tuple(r) for r in df.collect()]
    if name in catalog.ORACLES:
        got = duck.execute(catalog.ORACLES[name])
        names = [d[0] for d in got.description]
        assert sorted(df.columns) == sorted(names)
        assert canon(rows, df.columns) == canon(got.fetchall(), names)
    else:
        assert rows
