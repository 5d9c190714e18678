import pytest

from dunlin.session import Session
from dunlin.settings import DialectError


@pytest.fixture()
def s(spark):
    out = Session(spark)
    out.store.create("mtx", spark.createDataFrame([(10, "A"), (20, "B"), (20, "C"), (30, "A"), (20, "D"), (40, "B")], "n int, c string").coalesce(1))
    out.store.create("sales", spark.createDataFrame([(1, "A", 10.0), (2, "A", 20.0), (3, "B", 5.0), (4, "C", 100.0), (5, "C", 1.0), (6, "A", 7.0)], "id int, grp string, amt double").coalesce(1))
    out.store.create("customer", spark.createDataFrame([(1, "Alice"), (2, "Bob"), (3, "Carol")], "cust_id int, cname string").coalesce(1))
    out.store.create("orders", spark.createDataFrame([(103, 2), (102, 1), (101, 1)], "ord_id int, cust_id int").coalesce(1))
    return out


def test_locate_continue_skip(s):
    a = s.navigate("mtx")
    with pytest.raises(DialectError):
        a.continue_()
    assert a.locate("n = 20").c == "B" and a.found
    assert [a.continue_().c, a.continue_().c] == ["C", "D"] and a.continue_() is None and a.eof()
    assert a.top().c == "A" and a.skip(2).c == "C" and a.skip(-1).c == "B" and a.bottom().n == 40 and a.skip() is None
    assert a.go(4).n == 30
    with pytest.raises(DialectError):
        a.go(99)
    a.go(2)
    assert a.locate("n = 20", while_="n = 20").c == "B" and a.continue_().c == "C" and a.continue_() is None
    a.go(2)
    assert [r.c for r in a.scan(scope="NEXT", n=2)] == ["B", "C"] and [r.n for r in a.scan("c = 'A'")] == [10, 30]
    a.filter = "n = 20"
    assert [r.c for r in a.ordered().collect()] == ["B", "C", "D"]


def test_orders_seek_and_keys(s):
    a = s.navigate("mtx")
    with pytest.raises(DialectError):
        a.seek(20)
    a.index_on("n", "n", desc=True)
    assert [r.n for r in a.ordered().collect()] == [40, 30, 20, 20, 20, 10] and a.top().n == 40 and a.skip().n == 30
    assert a.seek(20).c == "B" and a.seek(25) is None and not a.found
    a.settings.near = True
    assert a.seek(25).n == 20
    a.index_on("u", "c", unique=True)
    assert [r.c for r in a.ordered().collect()] == ["A", "B", "C", "D"]
    a.index_on("f", "n", for_="c = 'A'")
    assert [r.n for r in a.ordered().collect()] == [10, 30]
    a.set_order("n")
    a.set_key(20, 30)
    assert [r.n for r in a.ordered().collect()] == [30, 20, 20, 20]
    a.set_key()
    assert a.visible().count() == 6 and a.lookup("n", "D", "c") == 20
    with pytest.raises(DialectError):
        a.index_on("c", "c", candidate=True)
    with pytest.raises(DialectError):
        a.set_order("nosuch")


def test_relations(s):
    child = s.navigate("orders")
    child.index_on("c", "cust_id")
    first = {r.cust_id: r.ord_id for r in s.navigate("customer").relate(child, "cust_id").collect()}
    assert first == {1: 102, 2: 103, 3: None}
    many = sorted((r.cust_id, r.ord_id) for r in s.navigate("customer").relate(child, "cust_id", many=True).collect() if r.ord_id)
    assert many == [(1, 101), (1, 102), (2, 103)]


def test_sum_and_total(s):
    a = s.navigate("sales")
    assert a.sum("amt", "id", for_="grp = 'A'") == (37.0, 9.0) and a.sum("amt", for_="grp = 'Z'") == (0.0,)
    runs = [(r.id, r.grp, r.amt) for r in a.total("grp", fields=["amt"]).collect()]
    assert runs == [(1, "A", 30.0), (3, "B", 5.0), (4, "C", 101.0), (6, "A", 7.0)]
    a.index_on("g", "grp")
    assert [(r.grp, r.amt) for r in a.total("grp", fields=["amt"]).collect()] == [("A", 37.0), ("B", 5.0), ("C", 101.0)]
    assert a.total("grp", for_="amt > 1000").collect() == []


def test_append_and_copy(s):
    s.register("extra", s.spark.createDataFrame([(7, "D", 1), (8, "E", 2)], "id int, grp string, other int"))
    assert s.append_from("sales", "extra", "grp = 'D'") == 1
    row = s.query("SELECT id, grp, amt FROM sales WHERE id = 7").first()
    assert (row.grp, row.amt) == ("D", None)
    s.copy_to("sales", "part", ["id", "amt"], for_="grp = 'A'")
    assert s.query("SELECT * FROM part").columns == ["id", "amt"] and s.query("SELECT id FROM part").count() == 3
    s.copy_structure("sales", "blank")
    assert s.query("SELECT id FROM blank").count() == 0
