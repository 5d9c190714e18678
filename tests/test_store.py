import pytest

from dunlin.settings import DialectError
from dunlin.sources.store import RECNO, Store


@pytest.fixture
def store(spark, tmp_path):
    out = Store(spark, f"file://{tmp_path}/tables")
    out.create("a", spark.createDataFrame([(1,), (2,)], "x int"))
    out.create("b", spark.createDataFrame([(10,)], "y int"))
    return out


def values(store, name):
    return sorted(tuple(r) for r in store.frame(name).drop("__deleted").collect())


def test_append_writes_its_rows_only(store, spark):
    before = store.table("a")["parts"]
    assert store.append("A", spark.createDataFrame([(3,), (4,)], "x int").coalesce(1), few=True) == 2
    assert store.append("a", spark.createDataFrame([(5,)], "X long")) == 1
    parts = store.table("a")["parts"]
    assert parts[: len(before)] == before and len(parts) == len(before) + 2
    assert values(store, "a") == [(k, k) for k in range(1, 6)]


def test_many_parts_are_written_together(store, spark, monkeypatch):
    monkeypatch.setattr("dunlin.sources.store.MOST_PARTS", 2)
    for k in (3, 4, 5):
        store.append("a", spark.createDataFrame([(k,)], "x int"), few=True)
    assert len(store.table("a")["parts"]) <= 2 and values(store, "a") == [(k, k) for k in range(1, 6)]


def test_commit_is_one_step_over_tables(store, spark, monkeypatch):
    store.begin()
    store.append("a", spark.createDataFrame([(3,)], "x int"))
    store.drop("b")
    store.create("c", spark.createDataFrame([(7,)], "z int"))
    other = Store(spark, store.root)
    assert other.tables() == ["a", "b"] and store.tables() == ["a", "c"]

    def killed(*_):
        raise KeyboardInterrupt

    with monkeypatch.context() as m:
        m.setattr(store.files, "claim", killed)
        with pytest.raises(KeyboardInterrupt):
            store.commit()
    assert other.tables() == ["a", "b"] and len(values(other, "a")) == 2
    store.begin()
    store.append("a", spark.createDataFrame([(3,)], "x int"))
    store.drop("b")
    store.commit()
    assert other.tables() == ["a"] and len(values(other, "a")) == 3


def test_second_writer_of_a_number_looks_again(store, spark, monkeypatch):
    other, late = Store(spark, store.root), store.head
    asked = []

    def head():
        found = late()
        if not asked:  # another writer is first, between looking and writing
            asked.append(1)
            other.put("c", spark.createDataFrame([(1, 1)], f"z int, {RECNO} long"))
        return found

    monkeypatch.setattr(store, "head", head)
    store.put("d", spark.createDataFrame([(1, 1)], f"z int, {RECNO} long"))
    assert store.tables() == ["a", "b", "c", "d"]


def test_rollback_and_vacuum_remove_parts(store, spark):
    store.begin()
    with pytest.raises(DialectError):
        store.begin()
    store.append("a", spark.createDataFrame([(3,)], "x int"))
    path = store.table("a")["parts"][-1]
    store.rollback()
    assert not store.files.exists(f"{store.root}/{path}") and len(values(store, "a")) == 2
    store.put("a", store.frame("a").where("x = 1"))
    assert store.vacuum() == 0 and store.vacuum(0) == 1
    assert values(store, "a") == [(1, 1)] and values(store, "b") == [(10, 1)]
    assert len([n for n in store.files.names(f"{store.root}/_log") if n.endswith(".json")]) == 1


def test_bad_names_and_missing_tables(store):
    for f in (store.frame, store.schema):
        with pytest.raises(DialectError):
            f("none")
    with pytest.raises(DialectError):
        store.exists("../a")
