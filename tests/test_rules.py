import pytest

from dunlin.session import Session
from dunlin.settings import DialectError


@pytest.fixture
def s(spark, tmp_path):
    out = Session(spark, f"file://{tmp_path}/tables")
    out.store.create("shelf", spark.createDataFrame([(1, "oak"), (2, "elm"), (3, "ash")], "sid int, wood string").coalesce(1))
    out.store.create("book", spark.createDataFrame([(1, 1, 10, None), (2, 1, 20, "b"), (3, 2, 30, "c"), (4, None, -5, None)], "bid int, shelf int, pages int, note string").coalesce(1))
    out.store.create("leaf", spark.createDataFrame([(7, 1), (8, 3)], "lid int, bid int").coalesce(1))
    return out


def rows(s, text):
    return sorted((tuple(r) for r in s.query(text).collect()), key=repr)


def refused(s, code, text):
    before = s.store.now()
    with pytest.raises(DialectError) as e:
        s.execute(text)
    assert e.value.code == code and s.store.now() == before


def test_fields_records_defaults(s):
    s.set_rules("book", defaults={"NOTE": "UPPER('new')"}, fields={"pages": "pages > 0"}, required=["bid"], record=["pages < 100 OR note == 'long'"], unique=[["bid"]])
    s.execute("INSERT INTO book (bid, pages) VALUES (5, 50)")
    s.execute("INSERT INTO book (bid, pages, note) VALUES (6, 60, NULL)")
    assert rows(s, "SELECT bid, note FROM book WHERE bid > 4") == [(5, "NEW"), (6, None)]
    refused(s, 1582, "INSERT INTO book (bid, pages) VALUES (7, 0)")
    refused(s, 1583, "INSERT INTO book (bid) VALUES (7)")  # a field that is left out is not judged by its own rule
    refused(s, 1581, "INSERT INTO book (pages) VALUES (7)")
    refused(s, 1583, "UPDATE book SET pages = 200 WHERE bid = 1")
    refused(s, 1884, "INSERT INTO book (bid, pages) VALUES (1, 7)")
    # row 4 breaks its field's rule since before; what does not touch the field is allowed
    assert s.execute("UPDATE book SET note = 'long' WHERE bid = 4") == 1
    assert s.execute("UPDATE book SET pages = 200 WHERE bid = 4") == 1
    s.execute("DELETE FROM book WHERE bid = 1")
    s.execute("INSERT INTO book (bid, pages) VALUES (1, 7)")
    s.execute("PACK book")
    refused(s, 1582, "UPDATE book SET pages = 0 WHERE bid = 1")
    s.set_rules("book", fields={"pages": "NOSUCH("})
    refused(s, 1582, "INSERT INTO book (bid, pages) VALUES (9, 1)")


def test_unknown_rules(s):
    for bad in ({"fields": {"nothing": "1 = 1"}}, {"other": []}, {"parents": [{"key": "shelf", "table": "shelf", "parent": "sid", "delete": "maybe"}]}):
        with pytest.raises(DialectError):
            s.set_rules("book", **bad)


def test_links_restrict(s):
    s.set_rules("book", parents=[{"key": "shelf", "table": "SHELF", "parent": "sid"}])
    refused(s, 1539, "INSERT INTO book (bid, shelf) VALUES (9, 99)")
    refused(s, 1539, "UPDATE book SET shelf = 9 WHERE bid = 1")
    s.execute("INSERT INTO book (bid) VALUES (9)")
    refused(s, 1539, "DELETE FROM shelf WHERE sid = 1")
    refused(s, 1539, "UPDATE shelf SET sid = 11 WHERE sid = 1")
    refused(s, 1539, "ZAP shelf")
    s.execute("DELETE FROM shelf WHERE sid = 3")
    refused(s, 1539, "UPDATE book SET shelf = 3 WHERE bid = 1")
    assert s.execute("UPDATE shelf SET wood = 'fir'") == 2


def test_links_cascade_over_levels_in_one_step(s):
    s.set_rules("book", parents=[{"key": "shelf", "table": "shelf", "parent": "sid", "delete": "cascade", "update": "cascade"}])
    s.set_rules("leaf", parents=[{"key": "bid", "table": "book", "parent": "bid", "delete": "cascade"}])
    s.execute("UPDATE shelf SET sid = sid + 10")
    assert rows(s, "SELECT bid, shelf FROM book") == [(1, 11), (2, 11), (3, 12), (4, None)]
    number = s.store.head()[0]
    s.execute("DELETE FROM shelf WHERE sid = 11")
    assert s.store.head()[0] == number + 1
    assert rows(s, "SELECT bid FROM book") == [(3,), (4,)] and rows(s, "SELECT lid FROM leaf") == [(8,)]
    s.set_rules("leaf", parents=[{"key": "bid", "table": "book", "parent": "bid"}])
    refused(s, 1539, "DELETE FROM shelf WHERE sid = 12")
    s.begin()
    s.execute("DELETE FROM leaf")
    s.execute("DELETE FROM shelf WHERE sid = 12")
    assert rows(s, "SELECT bid FROM book") == [(4,)]
    s.rollback()
    assert rows(s, "SELECT bid FROM book") == [(3,), (4,)]
