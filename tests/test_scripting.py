import pytest

from dunlin.operators.arrays import Arrays
from dunlin.operators.buffering import Buffer
from dunlin.operators.scripting import Interpreter
from dunlin.session import Session
from dunlin.settings import DialectError


@pytest.fixture()
def s(spark):
    out = Session(spark)
    out.store.create("t", spark.createDataFrame([(1, "a", 10), (2, "b", 20), (3, "c", 30)], "id int, name string, v int").coalesce(1))
    return out


def test_control_flow(s):
    i = Interpreter(s)
    got = i.run("""
    * a comment
    #DEFINE LIMIT 5
    LOCAL n, total
    total = 0
    FOR n = 1 TO 10
        IF n % 2 = 0
            LOOP
        ENDIF
        IF n > LIMIT
            EXIT
        ELSE
            total = total + ;
                n
        ENDIF
    ENDFOR
    DO WHILE total < 20
        total = total + 4
    ENDDO
    DO CASE
    CASE total = 1
        total = -1
    CASE total = 21
        total = Twice(total)
    OTHERWISE
        total = -2
    ENDCASE
    DIMENSION a(2, 2)
    a(2, 1) = 7
    STORE 3 TO x, y
    z = "to"
    &z.tal2 = total + a(2, 1) + x
    ? UPPER("done")
    RETURN total2
    FUNCTION Twice(k)
        IF PCOUNT() = 1
            RETURN k * 2
        ENDIF
    ENDFUNC
    """)
    assert got == 52 and i.output == ["DONE"] and s.arrays["a"] == [[False, False], [7, False]]


def test_tables_errors_and_depth(s):
    i = Interpreter(s)
    got = i.run("""
    USE t
    total = 0
    lim = 15
    SCAN FOR v > 10
        total = total + v
    ENDSCAN
    UPDATE t SET v = m.total WHERE id = 1
    SELECT v FROM t WHERE v > m.lim
    ON ERROR bad = 1
    NoSuch(1)
    DO nosuch
    ON ERROR
    RETURN total
    """)
    assert got == 50 and sorted(r.v for r in i.results[0].collect()) == [20, 30, 50] and i.get("bad") == 1
    i.load("PROCEDURE deep\n RETURN deep()\nENDPROC")
    with pytest.raises(DialectError) as e:
        i.call("deep")
    assert e.value.code == 1809
    with pytest.raises(DialectError):
        i.run("IF .T.\n x = 1")


def test_arrays(s):
    a = Arrays(s.arrays)
    a.dimension("x", 3)
    s.arrays["x"][:] = [3, 1, 2]
    assert a.asort("x") and s.arrays["x"] == [1, 2, 3] and a.asort("x", desc=True) and s.arrays["x"] == [3, 2, 1]
    assert a.alen("x") == 3 and a.ascan("x", 2) == 2 and a.ascan("x", 9) == 0
    a.adel("x", 1)
    assert s.arrays["x"] == [2, 1, False]
    a.ains("x", 2)
    assert s.arrays["x"] == [2, False, 1]
    a.dimension("m", 2, 3)
    assert (a.alen("m"), a.alen("m", 1), a.alen("m", 2)) == (6, 2, 3) and a.aelement("m", 2, 3) == 6 and (a.asubscript("m", 5, 1), a.asubscript("m", 5, 2)) == (2, 2)
    s.arrays["m"] = [["b", 2], ["A", 1]]
    a.asort("m", fold=True)
    assert s.arrays["m"] == [["A", 1], ["b", 2]]
    assert a.acopy("m", "copy") == 4 and s.arrays["copy"] == ["A", 1, "b", 2]
    assert a.afields("f", s.table("t")) == 3 and s.arrays["f"][1][:2] == ["NAME", "C"]
    assert a.alines("l", "a\n\n b \n", 1 | 4) == 2 and s.arrays["l"] == ["a", "b"] and a.alines("l", "1,2;3", 16, ",", ";") == 3 and s.arrays["l"] == ["1,", "2;", "3"]
    assert a.copy_to_array("rows", s.table("t").where("id < 3"), ["id", "name"]) == 2 and sorted(s.arrays["rows"]) == [[1, "a"], [2, "b"]]
    with pytest.raises(DialectError):
        a.alen("nosuch")


def test_buffering(s):
    b = Buffer(s.store, "t")
    b.replace(2, name="z", v=5)
    n = b.append(id=9, name="new")
    b.delete(3)
    assert (b.value(2, "v"), b.oldval(2, "v"), b.curval(2, "v")) == (5, 20, 20) and b.state(2, "name") == 2 and b.state(2, "id") == 1 and b.state(n, "id") == 4 and b.next_modified() == 2 and b.next_modified(2) == 3
    s.execute("UPDATE t SET v = 21 WHERE id = 2")
    assert not b.update() and b.update(force=True)
    assert sorted(tuple(r) for r in s.query("SELECT id, name, v FROM t").collect()) == [(1, "a", 10), (2, "z", 5), (9, "new", None)]
    b.replace(1, v=0)
    assert b.revert() == 1 and b.curval(1, "v") == 10
    b.blank(1, "name")
    assert b.update() and b.curval(1, "name") is None
    with pytest.raises(DialectError):
        b.replace(1, nosuch=1)
