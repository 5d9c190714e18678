"""Record commands: only the current record changes, and nothing that is a command passes in silence."""

import pytest

from dunlin.operators.scripting import Interpreter
from dunlin.session import Session
from dunlin.settings import DialectError


@pytest.fixture()
def s(spark):
    out = Session(spark)
    out.store.create("goods", spark.createDataFrame([(11, "nail", 5), (12, "screw", 7), (13, "bolt", 9), (14, "nut", 11)], "gid int, what string, price int").coalesce(1))
    out.store.create("kinds", spark.createDataFrame([("nail", "iron"), ("bolt", "steel"), ("bolt", "brass")], "k string, metal string").coalesce(1))
    out.execute("USE goods")
    return out


def marks(s):
    return [r["__deleted"] for r in s.store.frame("goods").orderBy("__recno").collect()]


@pytest.mark.parametrize("command", ["DELETE ALL", "DELETE REST", "DELETE NEXT 2", "DELETE RECORD 3", "DELETE FOR gid > 12", "DELETE WHILE gid < 13", "RECALL ALL", "RECALL NEXT 2", "RECALL FOR gid > 12", "RECALL WHILE gid < 13"])
def test_scopes_and_conditions_are_refused_before_any_change(s, command):
    s.execute("GO 2")
    if command.startswith("RECALL"):
        s.execute("DELETE")
    before = marks(s)
    with pytest.raises(DialectError):
        s.execute(command)
    assert marks(s) == before


def test_delete_and_recall_change_the_current_record(s):
    s.execute("GO 3")
    s.execute("DELETE")
    assert marks(s) == [False, False, True, False]
    s.execute("RECALL")
    assert marks(s) == [False] * 4
    s.execute("USE goods IN 0 ALIAS other")
    s.execute("GO 4 IN other")
    s.execute("DELETE IN other")
    assert marks(s) == [False, False, False, True] and s.work_area().recno == 3


def test_error_handler_sees_a_refused_command(s):
    i = Interpreter(s)
    i.run("handled = .F.\nON ERROR handled = .T.\nDELETE ALL")
    assert i.get("handled") is True and not any(marks(s))
    with pytest.raises(DialectError):
        Interpreter(s).run("SCATTER MEMVAR")


def test_rollback_in_a_script_keeps_rows(s):
    Interpreter(s).run("BEGIN TRANSACTION\nDELETE FROM goods WHERE gid = 11\nROLLBACK")
    assert not any(marks(s))
    Interpreter(s).run("BEGIN TRANSACTION\nDELETE FROM goods WHERE gid = 11\nEND TRANSACTION")
    assert marks(s) == [True, False, False, False]


def test_moves_conditions_and_functions(s):
    i = Interpreter(s)
    i.run("least = 6\nLOCATE FOR price > least\na = what\nf = FOUND()\nCONTINUE\nb = what\nGO TOP\nSKIP -1\nbegin = BOF()\nGO BOTTOM\nSKIP\ne = EOF()\nn = RECNO()\nSKIP -1\nlast = what")
    assert [i.get(x) for x in ("a", "f", "b", "begin", "e", "n", "last")] == ["screw", True, "bolt", True, True, 5, "nut"]
    i.run("SET FILTER TO price < 10\nCOUNT TO c\nt = FILTER()\nSET FILTER TO\nCOUNT TO d\nSUM price, gid TO p, g FOR price > 6\nk = LOOKUP(price, 'bolt', what)")
    assert [i.get(x) for x in ("c", "t", "d", "p", "g", "k")] == [3, "price < 10", 4, 27, 39, 9]


def test_orders_and_relations(s):
    i = Interpreter(s)
    i.run("USE kinds IN 2\nSELECT kinds\nINDEX ON k TAG kk\nSELECT goods\nSET RELATION TO what INTO kinds\nGO 3\nm = kinds.metal\nGO 4\nnone = EOF('kinds')\nr = RELATION(1)")
    assert [i.get(x) for x in ("m", "none", "r")] == ["steel", True, "WHAT"]
    i.run("INDEX ON price TAG pr DESCENDING\nGO TOP\na = what\no = ORDER()\nSEEK 7\nb = what\nhit = SEEK(99)\nx = KEYMATCH(9)\ny = RECNO()\nSET ORDER TO\nGO TOP\nc = what\nDELETE TAG pr")
    assert [i.get(x) for x in ("a", "o", "b", "hit", "x", "c")] == ["nut", "PR", "screw", False, True, "nail"]
    with pytest.raises(DialectError):
        i.run("SET ORDER TO pr")


def test_replace_blank_append_copy(s):
    i = Interpreter(s)
    i.run("GO 2\nREPLACE price WITH price * 2, what WITH 'rivet'\nAPPEND BLANK\nREPLACE gid WITH 15\nCOPY TO dear FOR price > 8\nUSE dear\nCOUNT TO n")
    assert i.get("n") == 3 and [(r.gid, r.what, r.price) for r in s.query("SELECT * FROM goods WHERE gid = 12 OR gid = 15 ORDER BY gid").collect()] == [(12, "rivet", 14), (15, None, None)]
    with pytest.raises(DialectError):
        i.run("REPLACE ALL price WITH 1")


def test_scan_stops_with_its_scope(s):
    i = Interpreter(s)
    i.run("seen = ''\nGO 2\nSCAN NEXT 2\nseen = seen + what\nENDSCAN\nGO 2\nSCAN WHILE price < 10\nseen = seen + '/' + what\nENDSCAN")
    assert i.get("seen") == "screwbolt/screw/bolt"


def test_record_functions_in_queries(s):
    s.execute("DELETE FROM goods WHERE RECNO() = 1")
    assert [r.r for r in s.query("SELECT RECNO() AS r FROM goods WHERE RECNO() < 4 ORDER BY r DESC").collect()] == [3, 2]
    assert s.query("SELECT RECCOUNT() AS n FROM goods").first().n == 4
