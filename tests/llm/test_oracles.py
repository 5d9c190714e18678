"""The operators' queries against their SQL in DuckDB on the smallest tables."""

import pytest

from dunlin.llm import queries as Q

SF = "/root/testdata/sf0.001"
duckdb = pytest.importorskip("duckdb")


@pytest.mark.parametrize("name", sorted(Q.oracle_sql()))
def test_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = Q.queries()[name](spark, SF)
    cols = sorted(df.columns)
    res = con.execute(Q.oracle_sql()[name])
    names = [d[0] for d in res.description]
    order = [names.index(c) for c in cols]
    assert sorted(names) == cols
    assert sorted((tuple(r[c] for c in cols) for r in df.collect()), key=repr) == sorted((tuple(r[k] for k in order) for r in res.fetchall()), key=repr)


def test_names():
    assert [n for n in Q.queries()] == sorted(Q.queries(), key=lambda n: int(n[2:].split("_")[0])) and len(Q.queries()) == 10
