import datetime as dt
import decimal

import pytest

from dunlin.session import Session
from dunlin.settings import DialectError

D = decimal.Decimal
PERSON = [
    (1, "Smith", "Berlin", "100.00", "2001-01-15", True), (2, "Sm", "Berlin", "200.00", "2002-03-20", False), (3, "Smithson", "Munich", "300.00", "2003-05-10", True), (4, "Jones", "Berlin", "150.00", "2001-07-01", True),
    (5, "Brown", "Munich", "250.00", "2004-09-30", False), (6, "Brown", "Hamburg", "250.00", "2005-11-11", True), (7, "Adams", "Hamburg", "999.99", "2006-02-02", True), (8, "Clark", "Munich", "300.00", "2007-04-04", False),
    (9, "Davis", "Berlin", "50.00", "2008-06-06", True), (10, "Evans", "Hamburg", "400.00", "2009-08-08", False),
]


@pytest.fixture()
def s(spark):
    out = Session(spark)
    rows = [(a, b, c, D(d), dt.date.fromisoformat(e), f) for a, b, c, d, e, f in PERSON]
    out.store.create("person", spark.createDataFrame(rows, "id int, name string, city string, amount decimal(10,2), hired date, active boolean").coalesce(1))
    out.execute("DELETE FROM person WHERE id = 7")
    frames = {
        "company": ([(100, "Acme"), (200, "Globex")], "compid int, cname string"),
        "dept": ([(1, "Sales", 100), (2, "Engineering", 100), (3, "Marketing", 200), (4, "Empty", 200)], "deptid int, dname string, compid int"),
        "emp": ([(1, "Alice", 1, 5000), (2, "Bob", 1, 4000), (3, "Carol", 2, 6000), (4, "Dave", 2, 5500), (5, "Eve", 3, 4500), (6, "Frank", 99, 3000)], "empid int, ename string, deptid int, salary int"),
        "cust": ([(1, "Alice"), (2, "Bob"), (3, "Carol"), (4, "Dave")], "cid int, cname string"),
        "ord": ([(10, 1, 100), (11, 1, 200), (12, 2, 50), (13, None, 300), (14, 3, 999)], "oid int, cid int, amt int"),
    }
    for name, (rows, schema) in frames.items():
        out.register(name, spark.createDataFrame(rows, schema))
    return out


def rows(df):
    return [tuple(r) for r in df.collect()]


def ids(df):
    return sorted(r[0] for r in df.collect())


def test_filters(s):
    assert ids(s.query("SELECT id FROM person WHERE name = 'Smithson'")) == [1, 2, 3]
    assert ids(s.query("SELECT id FROM person WHERE amount >= 250 AND NOT active")) == [5, 8, 10]
    assert ids(s.query("SELECT id FROM person WHERE hired < {^2002-01-01}")) == [1, 4]
    assert ids(s.query("SELECT id FROM person WHERE nosuch = 1")) == []
    assert ids(s.query("SELECT id FROM person WHERE name")) == []
    s.execute("SET DELETED OFF")
    assert ids(s.query("SELECT id FROM person WHERE city = 'Hamburg'")) == [6, 7, 10]
    s.execute("SET ANSI ON")
    assert ids(s.query("SELECT id FROM person WHERE name = 'Sm'")) == [2]


def test_names(s):
    assert s.query("SELECT id, amount*2, COUNT(*) FROM person GROUP BY id").columns == ["id", "EXP_1", "COUNT"]
    assert s.query("SELECT e.deptid, d.deptid, d.dname AS x FROM emp e JOIN dept d ON e.deptid = d.deptid").columns == ["deptid", "D_deptid", "x"]
    assert len(s.query("SELECT * FROM emp e JOIN dept d ON e.deptid = d.deptid").columns) == 7
    assert s.query("SELECT d.* FROM emp e JOIN dept d ON e.deptid = d.deptid").columns == ["deptid", "dname", "compid"]


def test_joins(s):
    assert len(rows(s.query("SELECT e.ename, d.dname FROM emp e INNER JOIN dept d ON e.deptid = d.deptid"))) == 5
    left = rows(s.query("SELECT e.ename, d.dname FROM emp e LEFT JOIN dept d ON e.deptid = d.deptid"))
    assert len(left) == 6 and ("Frank", None) in left
    right = rows(s.query("SELECT e.ename, d.dname FROM emp e RIGHT JOIN dept d ON e.deptid = d.deptid"))
    assert len(right) == 6 and (None, "Empty") in right
    assert len(rows(s.query("SELECT e.ename, d.dname FROM emp e FULL OUTER JOIN dept d ON e.deptid = d.deptid"))) == 7
    assert len(rows(s.query("SELECT e.ename, d.dname FROM emp e, dept d"))) == 24
    three = s.query("SELECT e.ename, c.cname FROM emp e JOIN dept d ON e.deptid = d.deptid JOIN company c ON d.compid = c.compid WHERE c.cname == 'Acme'")
    assert sorted(rows(three)) == [("Alice", "Acme"), ("Bob", "Acme"), ("Carol", "Acme"), ("Dave", "Acme")]
    with pytest.raises(DialectError):
        s.query("SELECT deptid FROM emp e JOIN dept d ON e.deptid = d.deptid")
    with pytest.raises(DialectError):
        s.query("SELECT 1 FROM emp e, dept e")
    with pytest.raises(DialectError):
        s.query("SELECT z.* FROM emp e JOIN dept d ON e.deptid = d.deptid")


def test_subqueries(s):
    assert ids(s.query("SELECT c.cid FROM cust c WHERE c.cid IN (SELECT o.cid FROM ord o)")) == [1, 2, 3]
    assert ids(s.query("SELECT c.cid FROM cust c WHERE c.cid NOT IN (SELECT o.cid FROM ord o)")) == [4]
    assert ids(s.query("SELECT o.oid FROM ord o WHERE o.cid NOT IN (SELECT c.cid FROM cust c WHERE c.cid > 1)")) == [10, 11]
    assert ids(s.query("SELECT c.cid FROM cust c WHERE EXISTS (SELECT * FROM ord o WHERE o.cid = c.cid AND o.amt > 100)")) == [1, 3]
    assert ids(s.query("SELECT c.cid FROM cust c WHERE NOT EXISTS (SELECT * FROM ord o WHERE o.cid = c.cid)")) == [4]
    assert ids(s.query("SELECT o.oid FROM ord o WHERE o.amt = (SELECT MAX(p.amt) FROM ord p)")) == [14]
    assert ids(s.query("SELECT o.oid FROM ord o WHERE o.amt > (SELECT AVG(p.amt) FROM ord p WHERE p.cid = o.cid) OR o.oid = 12")) == [11, 12]
    assert ids(s.query("SELECT o.oid FROM ord o WHERE o.amt > (SELECT p.amt FROM ord p WHERE p.oid = 99)")) == []
    assert ids(s.query("SELECT c.cid FROM cust c WHERE (c.cid = 4 OR c.cid IN (SELECT o.cid FROM ord o WHERE o.amt > 500)) AND NOT (c.cname == 'Zed')")) == [3, 4]
    assert ids(s.query("SELECT c.cid FROM cust c WHERE c.cname IN (SELECT d.cname FROM cust d WHERE d.cid = 1)")) == [1]
    with pytest.raises(DialectError):
        s.query("SELECT COUNT(*) FROM ord GROUP BY cid HAVING COUNT(*) > (SELECT 1 FROM ord)")
    with pytest.raises(Exception):
        s.query("SELECT o.oid FROM ord o WHERE o.amt = (SELECT p.amt FROM ord p)").collect()


def test_aggregates(s):
    got = rows(s.query("SELECT city, COUNT(*), SUM(amount), MIN(name), MAX(hired), name FROM person GROUP BY city ORDER BY city"))
    assert got[0] == ("Berlin", 4, D("500.00"), "Davis", dt.date(2008, 6, 6), "Smith")
    assert rows(s.query("SELECT COUNT(*) AS n, SUM(amount) AS s, AVG(amount) AS a, MAX(id) AS m FROM person WHERE id < 0")) == [(0, D("0.00"), None, None)]
    assert rows(s.query("SELECT COUNT(cid) AS n, COUNT(*) AS m FROM ord")) == [(4, 5)]
    assert rows(s.query("SELECT city FROM person GROUP BY city HAVING COUNT(*) > 3")) == [("Berlin",)]
    assert sorted(rows(s.query("SELECT city FROM person GROUP BY city HAVING COUNT(*) > 2 AND SUM(amount) < 700"))) == [("Berlin",)]
    assert rows(s.query("SELECT ROUND(SUM(amt)/COUNT(*), 1) AS r FROM ord")) == [(329.8,)]
    assert len(rows(s.query("SELECT id FROM person HAVING id > 100"))) == 9
    assert sorted(rows(s.query("SELECT cid, COUNT(*) FROM ord GROUP BY cid")), key=str) == [(1, 2), (2, 1), (3, 1), (None, 1)]
    assert rows(s.query("SELECT YEAR(hired) AS y, COUNT(*) AS n FROM person GROUP BY YEAR(hired) ORDER BY n DESC, 1"))[0] == (2001, 2)


def test_order_top_distinct(s):
    assert [r[0] for r in rows(s.query("SELECT id FROM person ORDER BY amount DESC, id"))] == [10, 3, 8, 5, 6, 2, 4, 1, 9]
    assert ids(s.query("SELECT TOP 2 id FROM person ORDER BY amount DESC")) == [3, 8, 10]
    assert ids(s.query("SELECT TOP 2 id FROM person")) == [1, 2]
    assert ids(s.query("SELECT TOP 30 PERCENT id FROM person ORDER BY amount DESC")) in ([3, 8, 10],)
    assert ids(s.query("SELECT TOP 0 PERCENT id FROM person ORDER BY id")) == [] and len(ids(s.query("SELECT TOP 100 PERCENT id FROM person ORDER BY id"))) == 9
    assert rows(s.query("SELECT DISTINCT city FROM person ORDER BY city DESC")) == [("Munich",), ("Hamburg",), ("Berlin",)]
    assert [r[0] for r in rows(s.query("SELECT cid FROM ord ORDER BY 1"))] == [None, 1, 1, 2, 3]
    s.execute("SET COLLATE TO GENERAL")
    s.register("cv", s.spark.createDataFrame([("Berlin",), ("BERLIN",), ("berlin",), ("Munich",)], "city string"))
    assert s.query("SELECT city, COUNT(*) FROM cv GROUP BY city").count() == 2 and s.query("SELECT DISTINCT city FROM cv").count() == 2


def test_unions(s):
    assert rows(s.query("SELECT cid FROM cust UNION SELECT cid FROM cust ORDER BY 1")) == [(1,), (2,), (3,), (4,)]
    assert s.query("SELECT cid FROM cust UNION ALL SELECT cid FROM cust").count() == 8
    assert s.query("SELECT cid FROM cust UNION ALL SELECT cid FROM cust UNION SELECT cid FROM cust").count() == 4
    assert s.query("SELECT cid FROM cust UNION SELECT cid FROM cust UNION ALL SELECT cid FROM cust").count() == 8
    assert rows(s.query("SELECT TOP 2 cid FROM cust UNION SELECT oid FROM ord ORDER BY cid DESC")) == [(14,), (13,)]
    for bad in ("SELECT cid FROM cust UNION SELECT cid, cname FROM cust", "SELECT cid FROM cust UNION SELECT cname FROM cust", "SELECT cid FROM cust UNION SELECT oid FROM ord ORDER BY nosuch"):
        with pytest.raises(DialectError):
            s.query(bad)


def test_into(s):
    s.execute("SELECT city, COUNT(*) AS n FROM person GROUP BY city INTO CURSOR c READWRITE")
    assert s.query("SELECT SUM(n) AS t FROM c").first().t == 9
    s.execute("SELECT id, name, amount AS a_very_long_name FROM person WHERE id < 3 INTO TABLE out1")
    assert s.query("SELECT * FROM out1").columns == ["id", "name", "a_very_lon"]
    assert s.execute("SELECT cid FROM cust WHERE cid < 3 ORDER BY 1 INTO ARRAY arr") == 2 and s.arrays["arr"] == [[1], [2]]
    assert s.execute("SELECT cid FROM cust WHERE cid > 30 INTO ARRAY arr") == 0 and s.arrays["arr"] == [[1], [2]]


def test_changes(s):
    s.execute("CREATE TABLE t (id I, name C(10) NOT NULL, amt N(8,2), d D, f L, m M, y Y, b B, ts T)")
    assert s.execute("INSERT INTO t (id, name, amt, d, f) VALUES (1, 'a', 12.345, {^2020-01-02}, .T.)") == 1
    s.execute("INSERT INTO t (id, name) VALUES (?, :who)", 2, who="it's ? :x")
    s.arrays["r"] = [[3, "c", 1, None, False, "memo"], [4]]
    assert s.execute("INSERT INTO t FROM ARRAY r") == 2
    s.memory.update(id=5, name="mem", other=1)
    s.execute("INSERT INTO t FROM MEMVAR")
    got = {r.id: r for r in s.query("SELECT * FROM t").collect()}
    assert got[1].amt == D("12.35") and got[1].d == dt.date(2020, 1, 2) and got[2].name == "it's ? :x" and got[3].m == "memo" and got[4].name is None and got[5].name == "mem"
    assert s.execute("UPDATE t SET amt = id * 10, id = id + 100 WHERE id < 3") == 2
    assert sorted((r.id, r.amt) for r in s.query("SELECT id, amt FROM t WHERE id > 100").collect()) == [(101, D("10.00")), (102, D("20.00"))]
    assert s.execute("DELETE FROM t WHERE id > 100") == 2 and s.query("SELECT id FROM t").count() == 3
    assert s.execute("RECALL t FOR id = 101") == 1 and s.query("SELECT id FROM t").count() == 4
    assert s.execute("PACK t") == 1
    s.execute("SET DELETED OFF")
    assert s.query("SELECT id FROM t").count() == 4
    s.execute("ALTER TABLE t ADD COLUMN note C(5)")
    s.execute("ALTER TABLE t ALTER COLUMN amt N(12,1)")
    s.execute("ALTER TABLE t DROP COLUMN m")
    names = [c for c, _, _ in s.columns("t")]
    assert names[-1] == "note" and "m" not in names and dict((c, t) for c, t, _ in s.columns("t"))["amt"] == "decimal(12,1)"
    for bad in ("UPDATE t SET nosuch = 1", "INSERT INTO t (nosuch) VALUES (1)", "INSERT INTO t (id) VALUES (id)", "ALTER TABLE t RENAME COLUMN id TO x", "CREATE TABLE q (a I, A I)", "DROP TABLE nosuch", "SELECT * FROM nosuch"):
        with pytest.raises(DialectError):
            s.execute(bad)
    assert s.execute("ZAP t") == 4 and s.query("SELECT id FROM t").count() == 0
    s.execute("DROP TABLE t")
    s.execute("DROP TABLE IF EXISTS t")
    assert "t" not in s.tables()


def test_transactions(s):
    s.begin()
    s.execute("DELETE FROM person WHERE city = 'Berlin'")
    assert s.query("SELECT id FROM person").count() == 5
    s.rollback()
    assert s.query("SELECT id FROM person").count() == 9
    other = Session(s.spark, s.store.root)
    s.begin()
    s.execute("UPDATE person SET amount = 0")
    other.execute("UPDATE person SET amount = 1")
    with pytest.raises(DialectError):
        s.commit()
    assert s.query("SELECT SUM(amount) AS t FROM person").first().t == 9


def test_areas_scripts_parameters(s):
    s.script("USE person IN 1 ALIAS p; SELECT 1; SELECT p.id FROM p WHERE p.id = 1")
    assert s.used("p") and s.query("SELECT id FROM p").count() == 9
    s.execute("USE cust IN 0")
    assert s.areas["2"] == ("cust", "cust")
    s.execute("SELECT p")
    s.execute("USE")
    assert not s.used("p")
    assert ids(s.query("SELECT cid FROM cust WHERE cname == ? OR cid = ?", "Bob", -1)) == [2]
    with pytest.raises(DialectError):
        s.query("SELECT cid FROM cust WHERE cid = ?")
    assert len(s.batch(["SELECT cid FROM cust", "SELECT oid FROM ord"])) == 2


def test_plan_reaches_the_files(s):
    from dunlin.operators.stats import explain

    df = s.query("SELECT id FROM person WHERE amount > 100 AND city == 'Berlin'")
    e = explain(df)
    assert any("city" in p for p in e["pushed"]) and all("name" not in c for c in e["columns"])


def test_prefix_join_goes_by_hash(spark):
    s = Session(spark)
    texts = ["", "a", "ab", "abc", "abd", "b", "ba", None, "ÄB", "äbc", "ab"]
    s.register("l", spark.createDataFrame(list(enumerate(texts)), "i int, x string"))
    s.register("r", spark.createDataFrame([(k * 10, v) for k, v in enumerate(reversed(texts))], "j int, y string"))
    for collate, fold in (("MACHINE", lambda v: v), ("GENERAL", lambda v: v.upper().replace("Ä", "A"))):
        s.settings.collate = collate
        got = s.query("SELECT l.i, r.j FROM l INNER JOIN r ON l.x = r.y AND r.j <> 20")
        assert "NestedLoop" not in got._jdf.queryExecution().executedPlan().toString()
        pairs = [(i, fold(a), j * 10, fold(b)) for i, a in enumerate(texts) for j, b in enumerate(reversed(texts)) if a is not None and b is not None]
        assert sorted(map(tuple, got.collect())) == sorted((i, j) for i, a, j, b in pairs if (a.startswith(b) or b.startswith(a)) and j != 20)
    s.settings.collate = "MACHINE"
    both = s.query("SELECT l.i, r.j FROM l INNER JOIN r ON l.x = r.y AND l.i == r.j")
    assert sorted(map(tuple, both.collect())) == [(0, 0)]


def test_equal_order_keys_keep_record_order(s):
    s.store.create("many", s.spark.range(2000).selectExpr("id", "id % 3 AS k").orderBy("id"))
    want = sorted(range(2000), key=lambda i: i % 3)
    assert [r.id for r in s.query("SELECT id, k FROM many ORDER BY k").collect()] == want
    assert [r.id for r in s.query("SELECT TOP 2 id, k FROM many ORDER BY k").collect()] == want[:667]


def test_text_functions_equal_their_plain_forms(spark):
    import random

    from dunlin.functions import text_udfs as U

    rng = random.Random(4)
    texts = ["".join(rng.choice("ABCHWSTZLMNRaeiéß1 '-<>") for _ in range(rng.randrange(12))) for _ in range(400)] + [None, "", "  ", "\tPfister ", "İx"]
    s = Session(spark)
    s.register("t", spark.createDataFrame([(k, v) for k, v in enumerate(texts)], "i int, v string"))
    rows = s.query("SELECT i, v, SOUNDEX(v) AS s, DIFFERENCE(v, 'Tymczak') AS d, STREXTRACT(v, '<', '>') AS a, STREXTRACT(v, 'a', 'e', 2) AS b, STREXTRACT(v, 'A', '>', 1, 2) AS c, STREXTRACT(v, '', '-') AS e, STREXTRACT(v, 'A', 'E', 1, 1) AS f, STREXTRACT(v, '<') AS g FROM t").collect()
    for r in rows:
        v = r.v
        want = (U.soundex(v), U.difference(v, "Tymczak"), U.strextract(v, "<", ">"), U.strextract(v, "a", "e", 2), U.strextract(v, "A", ">", 1, 2), U.strextract(v, "", "-"), U.strextract(v, "A", "E", 1, 1), U.strextract(v, "<"))
        assert tuple(r)[2:] == want, v
