import datetime as dt
import decimal
import json

from dunlin.operators import stats
from dunlin.session import Session
from dunlin.sources import dbf, export

import pytest


COLUMNS = [("ID", "I", 4, 0), ("NAME", "C", 10, 0), ("AMT", "N", 9, 2), ("CNT", "N", 5, 0), ("D", "D", 8, 0), ("T", "T", 8, 0), ("F", "L", 1, 0), ("Y", "Y", 8, 0), ("B", "B", 8, 0), ("M", "M", 4, 0)]
WHEN = dt.datetime(2020, 5, 6, 7, 8, 9)
ROWS = [
    (1, "Müller", decimal.Decimal("12.50"), 7, dt.date(2020, 1, 2), WHEN, True, decimal.Decimal("1.2345"), 2.5, "first memo"),
    (-2, "", None, None, None, None, False, 0, 0.0, None),
    (3, "gone", decimal.Decimal("-1.00"), 1, dt.date(1999, 12, 31), WHEN, True, 2, -1.5, "x" * 1000),
]


def test_dbf(spark, tmp_path):
    path = str(tmp_path / "t.dbf")
    dbf.write_dbf(path, COLUMNS, ROWS, deleted=frozenset({2}))
    df = dbf.open_dbf(spark, path, rowsPerPartition=2)
    assert df.rdd.getNumPartitions() == 2 and df.schema["AMT"].dataType.simpleString() == "decimal(9,2)"
    got = {r["__recno"]: r for r in df.collect()}
    a, b, c = got[1], got[2], got[3]
    assert (a.ID, a.NAME, a.AMT, a.CNT, a.D, a["T"], a.F, a.Y, a.B, a.M) == ROWS[0][:7] + (decimal.Decimal("1.2345"), 2.5, "first memo")
    assert (b.ID, b.NAME, b.AMT, b.CNT, b.D, b["T"], b.F, b.M) == (-2, "", None, None, None, None, False, None)
    assert c["__deleted"] and c.M == "x" * 1000 and not a["__deleted"]
    s = Session(spark)
    s.register("t", df)
    assert [r.id for r in s.query("SELECT id FROM t ORDER BY id").collect()] == [-2, 1]
    assert dbf.open_dbf(spark, path, includeDeleted="false").count() == 2
    with open(tmp_path / "bad.dbf", "wb") as f:
        f.write(b"short")
    with pytest.raises(Exception):
        dbf.schema_of(str(tmp_path / "bad.dbf"))


def test_csv_and_schema(spark, tmp_path):
    path = str(tmp_path / "t.dbf")
    dbf.write_dbf(path, COLUMNS, ROWS[:2])
    df = dbf.open_dbf(spark, path)
    assert export.export_csv(df.orderBy("__recno"), str(tmp_path / "t.csv")) == 2
    raw = (tmp_path / "t.csv").read_bytes()
    assert raw.startswith(b'\xef\xbb\xbf"ID","NAME"') and raw.count(b"\r\n") == 3
    assert '"1","Müller","12.50","7","2020-01-02","2020-05-06T07:08:09","true"' in raw.decode("utf-8-sig")
    export.write_csv(df, str(tmp_path / "parts"))
    back = spark.read.option("header", True).csv(str(tmp_path / "parts"))
    assert back.count() == 2 and back.columns[0] == "ID"
    d = json.loads(export.schema_json("t", df.schema))
    assert d["columns"][1] == {"name": "NAME", "type": "C", "length": 10, "decimals": 0, "nullable": False} and len(d["columns"]) == 10
    assert "| AMT | N | 9 | 2 |" in export.schema_markdown("t", df.schema)
    ddl = export.schema_ddl("t", df.schema)
    s = Session(spark)
    s.execute(ddl)
    assert [c for c, _, _ in s.columns("t")] == [c[0] for c in COLUMNS]


def test_statistics_and_estimates(spark):
    df = spark.range(1000).selectExpr("cast(id as int) as k", "cast(id % 4 as string) as c", "if(id % 10 = 0, null, id / 2) as v")
    rows, found = stats.analyze(df, exact=True)
    assert rows == 1000 and found["c"].distinct == 4 and found["v"].nulls == 100 and (found["k"].low, found["k"].high) == (0, 999) and found["c"].common["1"] == 250
    est = lambda c: stats.estimate_rows(c, rows, found)
    assert est("c = '1'") == 250 and est("k = 5000") == 0 and abs(est("k < 250") - 250) < 70 and abs(est("BETWEEN(k, 100, 300)") - 200) < 90
    assert abs(est("c = '1' AND k < 500") - 125) < 40 and abs(est("NOT c = '1'") - 750) < 1 and est("nosuch = 1") == 330 and abs(est("INLIST(c, '1', '2')") - 500) < 1


def test_constraints(spark):
    parent = spark.createDataFrame([(1,), (2,)], "k int")
    df = spark.createDataFrame([(1, "a"), (3, "b"), (None, None)], "k int, n string")
    assert [r.k for r in stats.orphans(df, "k", parent, "k").collect()] == [3]
    assert stats.broken(df, "k < 3").count() == 2


def test_streaming_filter(spark, tmp_path):
    from dunlin.streaming import query

    spark.range(20).write.parquet(str(tmp_path / "in"))
    stream = query(spark.readStream.schema("id long").parquet(str(tmp_path / "in")), "id % 5 = 0")
    q = stream.writeStream.format("memory").queryName("dunlin_out").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
    q.awaitTermination(60)
    assert spark.table("dunlin_out").count() == 4
