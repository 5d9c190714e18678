"""Every registered query of the dialect against its SQL in DuckDB, on the smallest tables."""

import decimal
import math

import pytest

from dunlin.plans import catalogue

SF = "/root/testdata/sf0.001"
duckdb = pytest.importorskip("duckdb")


def norm(v):
    if isinstance(v, (float, decimal.Decimal)):
        return None if isinstance(v, float) and math.isnan(v) else round(float(v), 6)
    return v


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in catalogue.TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_query(spark, con, name):
    df = catalogue.queries()[name](spark, SF)
    cols = sorted(df.columns, key=str.lower)
    got = sorted((tuple(norm(r[c]) for c in cols) for r in df.collect()), key=repr)
    sql = catalogue.oracle_sql().get(name)
    if sql is None:
        assert got
        return
    res = con.execute(sql)
    names = [d[0] for d in res.description]
    order = sorted(range(len(names)), key=lambda k: names[k].lower())
    assert [c.lower() for c in cols] == [names[k].lower() for k in order]
    assert got == sorted((tuple(norm(r[k]) for k in order) for r in res.fetchall()), key=repr)


def test_entry(spark):
    import __spark_entry__ as e

    out = e.entry(spark)
    assert out.count() > 0 and set(e.oracle_sql()) <= set(e.queries())
