"""Optimistic buffering: changes to rows are held by record number and written together.

A buffer keeps the few rows that a user has edited, with the values they had when first touched. An
update writes them as the table's next version by a join on the record number, after comparing the old
values with what the table holds now.
"""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from dunlin.operators.changes import plain
from dunlin.settings import DialectError
from dunlin.sources.store import DELETED, HIDDEN, RECNO, Store


class Buffer:
    def __init__(self, store: Store, table: str):
        self.store, self.table = store, table
        self.old: dict[int, dict] = {}
        self.new: dict[int, dict] = {}
        self.gone: dict[int, bool] = {}
        self.added: list[dict] = []

    def _fields(self) -> dict[str, T.StructField]:
        return {f.name.lower(): f for f in self.store.frame(self.table).schema if f.name not in HIDDEN}

    def _row(self, recno: int) -> dict:
        row = self.store.frame(self.table).where(F.col(RECNO) == recno).first()
        if row is None:
            raise DialectError("record is out of range", 5)
        return {k.lower(): v for k, v in row.asDict().items()}

    def _touch(self, recno: int) -> None:
        if recno not in self.old:
            self.old[recno] = self._row(recno)
            self.new[recno] = dict(self.old[recno])

    def replace(self, recno: int, **values) -> None:
        """REPLACE: new values for one record. Negative numbers are rows added here."""
        fields = self._fields()
        for name in values:
            if name.lower() not in fields:
                raise DialectError(f"column {name} is not found", 1806)
        clean = {n.lower(): plain(v, fields[n.lower()].dataType) for n, v in values.items()}
        if recno < 0:
            self.added[-recno - 1].update(clean)
            return
        self._touch(recno)
        self.new[recno].update(clean)

    def append(self, **values) -> int:
        self.added.append({})
        self.replace(-len(self.added), **values)
        return -len(self.added)

    def delete(self, recno: int, deleted: bool = True) -> None:
        self._touch(recno)
        self.gone[recno] = deleted

    def blank(self, recno: int, *fields: str) -> None:
        self.replace(recno, **{n: None for n in (fields or self._fields())})

    # -- what is seen

    def value(self, recno: int, field: str):
        return self.new[recno][field.lower()] if recno in self.new else self._row(recno)[field.lower()]

    def oldval(self, recno: int, field: str):
        """The value when the row was first touched."""
        return self.old[recno][field.lower()] if recno in self.old else self._row(recno)[field.lower()]

    def curval(self, recno: int, field: str):
        """The value in the table now."""
        return self._row(recno)[field.lower()]

    def state(self, recno: int, field: str | None = None) -> int:
        """1 as it was, 2 changed, 3 added and empty, 4 added with values; for no field, of the deletion mark."""
        if recno < 0:
            return 3 if field is None or field.lower() not in self.added[-recno - 1] else 4
        if recno not in self.new:
            return 1
        if field is None:
            return 2 if self.gone.get(recno, self.old[recno][DELETED]) != self.old[recno][DELETED] else 1
        return 2 if self.new[recno][field.lower()] != self.old[recno][field.lower()] else 1

    def next_modified(self, recno: int = 0) -> int:
        later = sorted(r for r in self.new if r > recno and (self.new[r] != self.old[r] or r in self.gone))
        return later[0] if later else (-1 if self.added and recno >= 0 else 0)

    # -- writing

    def update(self, force: bool = False) -> bool:
        """TABLEUPDATE: writes all; False if a row has changed meanwhile, unless forced."""
        fields = self._fields()
        df = self.store.frame(self.table)
        changed = [r for r in self.new if self.new[r] != self.old[r] or r in self.gone]
        if changed:
            now = {r[RECNO]: {k.lower(): v for k, v in r.asDict().items()} for r in df.where(F.col(RECNO).isin(changed)).collect()}
            if not force and any(now.get(r) != self.old[r] for r in changed):
                return False
            schema = T.StructType([T.StructField("__at", T.LongType()), *(T.StructField(f"__n{k}", f.dataType) for k, f in enumerate(fields.values())), T.StructField("__gone", T.BooleanType())])
            rows = [(r, *(self.new[r][n] for n in fields), self.gone.get(r, self.old[r][DELETED])) for r in changed]
            edits = self.store.spark.createDataFrame(rows, schema)  # as many rows as were edited by hand
            hit = F.col("__at").isNotNull()
            cols = [F.when(hit, F.col(f"__n{k}")).otherwise(F.col(f"`{f.name}`")).alias(f.name, metadata=f.metadata) for k, f in enumerate(fields.values())]
            out = df.join(edits, F.col(RECNO) == F.col("__at"), "left")
            self.store.put(self.table, out.select(*cols, RECNO, F.when(hit, F.col("__gone")).otherwise(F.col(DELETED)).alias(DELETED)))
        if self.added:
            schema = T.StructType([T.StructField(f.name, f.dataType) for f in fields.values()])
            self.store.append(self.table, self.store.spark.createDataFrame([tuple(a.get(n) for n in fields) for a in self.added], schema))
        self.revert()
        return True

    def revert(self) -> int:
        """TABLEREVERT: forgets all changes."""
        n = len(self.new) + len(self.added)
        self.old, self.new, self.gone, self.added = {}, {}, {}, []
        return n
