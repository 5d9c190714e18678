"""Tables as Parquet parts with hidden record numbers and deletion marks, under one log of versions.

The file `_log/N.json` with the highest N lists every table's schema and parts. A change writes its parts
first and then the next file of the log, which is never overwritten: readers see all of a change or none
of it, over however many tables it goes, and of two writers of one number the second sees that it must look
again. Appending writes the new rows only; other changes write a table's rows anew. Parts that no version
in force names are removed by `vacuum`. Rows keep `__recno` (from 1, in the order they were added) and
`__deleted`.
"""

from __future__ import annotations

import json
import re
import time
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dunlin.settings import DialectError

RECNO, DELETED = "__recno", "__deleted"
HIDDEN = (RECNO, DELETED)
#: Parts of a table from which an append writes them together.
MOST_PARTS = 256
#: How often a change is tried while others keep taking the next number.
TRIES = 100


class Files:
    """The few file operations needed, by Hadoop's file systems, so any of Spark's stores will do."""

    def __init__(self, spark: SparkSession):
        self.spark, self.jvm = spark, spark._jvm
        self.conf = spark.sparkContext._jsc.hadoopConfiguration()

    def _fs(self, path: str):
        p = self.jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.conf), p

    def exists(self, path: str) -> bool:
        fs, p = self._fs(path)
        return fs.exists(p)

    def delete(self, path: str) -> None:
        fs, p = self._fs(path)
        fs.delete(p, True)

    def names(self, path: str) -> list[str]:
        fs, p = self._fs(path)
        return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []

    def read(self, path: str) -> str:
        fs, p = self._fs(path)
        stream = fs.open(p)
        try:
            return bytes(stream.readAllBytes()).decode("utf-8")
        finally:
            stream.close()

    def claim(self, path: str, text: str) -> bool:
        """Writes a new file whole and at once, to a side file that is then renamed; False if there is one."""
        fs, p = self._fs(f"{path}.{uuid.uuid4().hex}")
        out = fs.create(p, False)
        out.write(bytearray(text.encode("utf-8")))
        out.close()
        target = self.jvm.org.apache.hadoop.fs.Path(path)
        if not fs.exists(target) and fs.rename(p, target):
            return True
        fs.delete(p, False)
        return False

    def age(self, path: str) -> float:
        """Seconds since a folder was last changed."""
        fs, p = self._fs(path)
        return time.time() - fs.getFileStatus(p).getModificationTime() / 1000


def numbered(df: DataFrame, start: int = 0) -> DataFrame:
    """df with consecutive record numbers from start + 1, in its order, without gathering it.

    Rows are counted per partition; a row's number is the count before its partition and its place in it.
    """
    from dunlin.sources.materialize import settled

    place = df.withColumn("__part", F.spark_partition_id()).withColumn("__at", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1))
    return _shifted(settled(place), start)  # written, so that both passes see the same partitions


def _shifted(place: DataFrame, start: int) -> DataFrame:
    spark = place.sparkSession
    sizes = {r[0]: r[1] for r in place.groupBy("__part").count().collect()}  # one row for each partition
    base, total = [], start
    for part in sorted(sizes):
        base.append((part, total))
        total += sizes[part]
    if not base:
        return place.withColumn(RECNO, F.lit(0).cast("long")).drop("__part", "__at")
    bases = spark.createDataFrame(base, "__part int, __base long")
    return place.join(F.broadcast(bases), "__part").withColumn(RECNO, F.col("__base") + F.col("__at") + 1).drop("__part", "__at", "__base")


class Store:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root, self.files = spark, root.rstrip("/"), Files(spark)
        self.base: dict[str, dict] | None = None  # the tables as a transaction found them
        self.pending: dict[str, dict | None] = {}  # and what it has changed

    def key(self, name: str) -> str:
        if not re.fullmatch(r"\w+", name):
            raise DialectError(f"bad table name {name!r}", 10)
        return name.lower()

    # -- versions

    def head(self) -> tuple[int, dict[str, dict]]:
        """The number in force, and its tables."""
        found = [int(n[:-5]) for n in self.files.names(f"{self.root}/_log") if n.endswith(".json") and not n.startswith(".")]
        if not found:
            return 0, {}
        return max(found), json.loads(self.files.read(f"{self.root}/_log/{max(found):012d}.json"))

    def now(self) -> dict[str, dict]:
        """The tables as this session sees them."""
        if self.base is None:
            return self.head()[1]
        return {k: v for k, v in {**self.base, **self.pending}.items() if v is not None}

    def publish(self, changed: dict[str, dict | None], base: dict[str, dict] | None = None) -> None:
        """Puts tables in force (None: dropped) in one step; with a base, only if none has moved on from it."""
        for _ in range(TRIES):
            n, tables = self.head()
            for name in changed if base is not None else ():
                if tables.get(name) != base.get(name):
                    raise DialectError(f"table {name} has been changed", 1585)
            after = {k: v for k, v in {**tables, **changed}.items() if v is not None}
            if self.files.claim(f"{self.root}/_log/{n + 1:012d}.json", json.dumps(after)):
                return
        raise DialectError("the store is changed too often", 1585)

    def settle(self, name: str, table: dict | None, base: dict | None = None) -> None:
        """A table's next version, once its rules hold, with the changes that they make in other tables."""
        from dunlin.operators.rules import enforced

        before = self.now().get(name)
        changed: dict[str, dict | None] = {name: table}
        if before is not None and table is not None:
            try:
                changed |= enforced(self, name, before, table)
            except DialectError:
                for p in set(table["parts"]) - set(before["parts"]):
                    self.files.delete(f"{self.root}/{p}")
                raise
        if self.base is not None:
            self.pending |= changed
        else:
            self.publish(changed, None if base is None else {name: base})

    def part(self, name: str, df: DataFrame) -> str:
        path = f"{name}/{uuid.uuid4().hex}"
        df.write.parquet(f"{self.root}/{path}")
        return path

    # -- tables

    def exists(self, name: str) -> bool:
        return self.key(name) in self.now()

    def tables(self) -> list[str]:
        return sorted(self.now())

    def table(self, name: str) -> dict:
        found = self.now().get(self.key(name))
        if found is None:
            raise DialectError(f"table {name} does not exist", 1)
        return found

    def read(self, table: dict) -> DataFrame:
        schema = T.StructType.fromJson(table["schema"])
        if not table["parts"]:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*(f"{self.root}/{p}" for p in table["parts"]))

    def frame(self, name: str) -> DataFrame:
        """All rows with their hidden columns."""
        return self.read(self.table(name))

    def schema(self, name: str) -> T.StructType:
        return T.StructType([f for f in T.StructType.fromJson(self.table(name)["schema"]) if f.name not in HIDDEN])

    def put(self, name: str, df: DataFrame, keep: bool = True) -> None:
        """A table's rows anew, under its rules unless they are not kept; df has the hidden columns."""
        low = self.key(name)
        old = self.now().get(low, {}) if keep else {}
        kept = {"rules": old["rules"]} if "rules" in old else {}
        self.settle(low, {"schema": df.schema.jsonValue(), "parts": [self.part(low, df)], **kept})

    def clear(self, name: str) -> None:
        table = self.table(name)
        self.settle(self.key(name), {**{k: v for k, v in table.items() if k != "last"}, "parts": []})

    def rule(self, name: str, **rules) -> None:
        """A table's rules, in place of those it had; its rows need not keep them."""
        from dunlin.operators.rules import described

        table = self.table(name)
        after = {**table, "rules": described(self.schema(name).names, **rules)}
        if self.base is not None:
            self.pending[self.key(name)] = after
        else:
            self.publish({self.key(name): after}, {self.key(name): table})

    def create(self, name: str, df: DataFrame, keep: bool = False) -> None:
        """A table of the rows of df, in its order."""
        out = numbered(df).withColumn(DELETED, F.lit(False))
        self.put(name, out.select(*df.columns, RECNO, DELETED), keep)

    def append(self, name: str, df: DataFrame, few: bool = False) -> int:
        """Adds rows with matching columns; missing ones are NULL. Only the new rows are read and written.

        few: the rows came from the driver, so one task may number and write them.
        """
        from dunlin.operators.rules import defaults

        table, low = self.table(name), self.key(name)
        old = self.read(table)
        fields = [f for f in old.schema if f.name not in HIDDEN]
        have = {c.lower(): c for c in df.columns}
        blank = defaults(table.get("rules", {}), set(have))
        cols: list[Column] = [(F.col(f"`{have[f.name.lower()]}`") if f.name.lower() in have else blank.get(f.name, F.lit(None))).cast(f.dataType).alias(f.name) for f in fields]
        last = table["last"] if "last" in table else old.agg(F.max(RECNO)).first()[0] or 0
        if few:
            new = df.select(*cols).coalesce(1).withColumn(RECNO, F.monotonically_increasing_id() + last + 1)
        else:
            new = numbered(df.select(*cols), last)
        new = new.withColumn(DELETED, F.lit(False)).select(old.columns)
        path = self.part(low, new)
        n = self.spark.read.schema(old.schema).parquet(f"{self.root}/{path}").count()
        after = {**table, "parts": [*table["parts"], path], "last": last + n}
        if len(after["parts"]) > MOST_PARTS:
            after["parts"] = [self.part(low, self.read(after))]
        self.settle(low, after, table)
        return n

    def drop(self, name: str) -> None:
        self.settle(self.key(name), None)

    def vacuum(self, seconds: float = 7 * 24 * 3600) -> int:
        """Removes parts that the version in force does not name and that are older than this; their number.

        The age keeps what a running change has written, and what a running query still reads.
        """
        number, tables = self.head()
        named = {p for t in tables.values() for p in t["parts"]}
        gone = 0
        for low in self.files.names(self.root):
            for p in () if low == "_log" else self.files.names(f"{self.root}/{low}"):
                if f"{low}/{p}" not in named and self.files.age(f"{self.root}/{low}/{p}") >= seconds:
                    self.files.delete(f"{self.root}/{low}/{p}")
                    gone += 1
        for n in self.files.names(f"{self.root}/_log"):
            if n.endswith(".json") and int(n[:-5]) < number and self.files.age(f"{self.root}/_log/{n}") >= seconds:
                self.files.delete(f"{self.root}/_log/{n}")
        return gone

    # -- transactions

    def begin(self) -> None:
        if self.base is not None:
            raise DialectError("a transaction is open", 1590)
        self.base, self.pending = self.head()[1], {}

    def commit(self) -> None:
        """Puts all changed tables in force together; fails if one was changed by someone else meanwhile."""
        if self.base is None:
            raise DialectError("no transaction is open", 1591)
        base, pending = self.base, self.pending
        self.base, self.pending = None, {}
        if pending:
            self.publish(pending, base)

    def rollback(self) -> None:
        """Drops what the transaction has written."""
        base, pending = self.base or {}, self.pending
        self.base, self.pending = None, {}
        for name, table in pending.items():
            kept = set(base.get(name, {"parts": []})["parts"])
            for p in (table or {"parts": []})["parts"]:
                if p not in kept:
                    self.files.delete(f"{self.root}/{p}")
