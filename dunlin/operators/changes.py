"""DML and DDL on stored tables. INSERT writes its rows only, the others a table's rows anew."""

from __future__ import annotations

import decimal
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dunlin.lang import sql as S
from dunlin.lang.expr import Name, Node, walk
from dunlin.plans.compile import Compiler, frame_resolver
from dunlin.plans.values import Val
from dunlin.settings import DialectError, Settings
from dunlin.sources.store import DELETED, HIDDEN, RECNO, Store


def spark_type(col: S.ColumnDef) -> T.DataType:
    k = col.kind
    if k in "CMV":
        return T.StringType()
    if k in "NF":
        n, d = col.length or 10, col.decimals or 0
        return T.DecimalType(min(max(n, d + 1), 38), d)
    return {"I": T.IntegerType(), "B": T.DoubleType(), "Y": T.DecimalType(19, 4), "D": T.DateType(), "T": T.TimestampNTZType(), "L": T.BooleanType()}.get(k, T.BinaryType())


def field(col: S.ColumnDef, settings: Settings) -> T.StructField:
    nullable = settings.null if col.nullable is None else col.nullable
    meta = {"type": col.kind, "length": col.length or 0, "decimals": col.decimals or 0, "nullable": nullable}
    return T.StructField(col.name, spark_type(col), True, meta)


class Changes:
    def __init__(self, store: Store, settings: Settings, functions: dict | None = None):
        self.store, self.settings, self.functions = store, settings, functions or {}

    def compiler(self, df: DataFrame, hidden: bool = True) -> Compiler:
        base = frame_resolver(df.schema)

        def resolve(name: Name) -> Val | None:
            return None if name.name.startswith("__") else base(name)

        def special(node: Node) -> Val | None:
            from dunlin.lang.expr import Call

            if isinstance(node, Call) and not node.args and node.name in ("RECNO", "DELETED"):
                return Val(F.col(RECNO), "I") if node.name == "RECNO" else Val(F.col(DELETED), "L")
            return None

        return Compiler(resolve, self.settings, self.functions, special)

    def cast(self, v: Val, to: T.DataType):
        """A value as a column's type; what does not fit is NULL."""
        return v.col.try_cast(to) if not isinstance(to, T.StringType) else v.col.cast(to)

    def create(self, stmt: S.Create) -> int:
        names = [c.name.lower() for c in stmt.columns]
        if len(set(names)) < len(names):
            raise DialectError("a column occurs twice", 1156)
        schema = T.StructType([field(c, self.settings) for c in stmt.columns])
        self.store.create(stmt.table, self.store.spark.createDataFrame([], schema))
        return 0

    def alter(self, stmt: S.Alter) -> int:
        df = self.store.frame(stmt.table)
        have = {c.lower(): c for c in df.columns if c not in HIDDEN}
        if stmt.action == "rename":
            raise DialectError("RENAME COLUMN is not supported", 1999)
        name = (stmt.name or stmt.column.name).lower()
        if stmt.action == "add":
            if name in have:
                raise DialectError(f"column {name} exists", 1156)
            f = field(stmt.column, self.settings)
            out = df.withColumn(f.name, F.lit(None).cast(f.dataType)).withMetadata(f.name, f.metadata)
            order = [*have.values(), f.name, *HIDDEN]
            self.store.put(stmt.table, out.select(*order))
            return 0
        if name not in have:
            raise DialectError(f"column {name} is not found", 1806)
        if stmt.action == "drop":
            self.store.put(stmt.table, df.drop(have[name]))
        else:
            f = field(stmt.column, self.settings)
            old = have[name]
            out = df.withColumn(old, F.col(f"`{old}`").try_cast(f.dataType)).withMetadata(old, f.metadata)
            self.store.put(stmt.table, out.select(df.columns))
        return 0

    def drop(self, stmt: S.Drop) -> int:
        if not self.store.exists(stmt.table):
            if stmt.if_exists:
                return 0
            raise DialectError(f"table {stmt.table} does not exist", 1)
        self.store.drop(stmt.table)
        return 0

    def insert(self, stmt: S.Insert, arrays: dict[str, list], memory: dict[str, object]) -> int:
        schema = self.store.schema(stmt.table)
        fields = {f.name.lower(): f for f in schema}
        if stmt.array is not None or stmt.memvar:
            rows = arrays.get(stmt.array.lower(), []) if stmt.array else [[memory.get(f.name.lower()) for f in schema]]
            rows = [r if isinstance(r, (list, tuple)) else [r] for r in rows]
            data = [tuple(list(r)[: len(schema)] + [None] * (len(schema) - len(r))) for r in rows]
            data = [tuple(plain(v, f.dataType) for v, f in zip(r, schema)) for r in data]
            return self.store.append(stmt.table, self.store.spark.createDataFrame(data, T.StructType([T.StructField(f.name, f.dataType) for f in schema])), few=True)
        columns = stmt.columns or [f.name for f in schema]
        if len(columns) != len(stmt.values):
            raise DialectError("columns and values differ in number", 1221)
        for v in stmt.values:
            if any(isinstance(n, Name) for n in walk(v)):
                raise DialectError("VALUES takes constants", 1806)
        comp = Compiler(lambda n: None, self.settings, self.functions)
        cols = []
        for name, node in zip(columns, stmt.values):
            f = fields.get(name.lower())
            if f is None:
                raise DialectError(f"column {name} is not found", 1806)
            cols.append(self.cast(comp.value(node), f.dataType).alias(f.name))
        return self.store.append(stmt.table, self.store.spark.range(1).select(*cols), few=True)

    def update(self, stmt: S.Update) -> int:
        df = self.store.frame(stmt.table)
        comp = self.compiler(df)
        have = {f.name.lower(): f for f in df.schema if f.name not in HIDDEN}
        hit = self.hit(df, comp, stmt.where)
        new = {}
        for name, node in stmt.sets:
            f = have.get(name.lower())
            if f is None:
                raise DialectError(f"column {name} is not found", 1806)
            new[f.name] = F.when(hit, self.cast(comp.value(node), f.dataType)).otherwise(F.col(f"`{f.name}`"))
        n = df.where(hit).count()
        out = df.withColumns(new)
        for f in have.values():
            if f.name in new:
                out = out.withMetadata(f.name, f.metadata)
        self.store.put(stmt.table, out.select(df.columns))
        return n

    def hit(self, df: DataFrame, comp: Compiler, where: Node | None):
        if S.has_subquery(where):
            raise DialectError("a subquery in a change's WHERE", 1814)
        hit = F.lit(True) if where is None else F.coalesce(comp.condition(where), F.lit(False))
        return hit & ~F.col(DELETED) if self.settings.deleted else hit

    def mark(self, table: str, where: Node | None, deleted: bool) -> int:
        """DELETE and RECALL: sets or clears deletion marks."""
        df = self.store.frame(table)
        comp = self.compiler(df)
        cond = F.lit(True) if where is None else F.coalesce(comp.condition(where), F.lit(False))
        hit = cond & (F.col(DELETED) != F.lit(deleted))
        n = df.where(hit).count()
        self.store.put(table, df.withColumn(DELETED, F.when(hit, F.lit(deleted)).otherwise(F.col(DELETED))))
        return n

    def mark_record(self, table: str, recno: int, deleted: bool) -> None:
        """DELETE and RECALL of one record."""
        df = self.store.frame(table)
        self.store.put(table, df.withColumn(DELETED, F.when(F.col(RECNO) == recno, F.lit(deleted)).otherwise(F.col(DELETED))))

    def pack(self, table: str) -> int:
        """Removes marked rows and numbers the rest anew, in order."""
        df = self.store.frame(table)
        n = df.where(F.col(DELETED)).count()
        visible = [c for c in df.columns if c not in HIDDEN]
        kept = df.where(~F.col(DELETED)).repartitionByRange(RECNO).sortWithinPartitions(RECNO).select(*visible)
        self.store.create(table, kept, keep=True)
        return n

    def zap(self, table: str) -> int:
        df = self.store.frame(table)
        n = df.count()
        self.store.clear(table)
        return n

    def into_table(self, name: str, df: DataFrame) -> int:
        """SELECT INTO TABLE: names of at most ten characters, all different."""
        seen: set[str] = set()
        names = []
        for c in df.columns:
            base = re.sub(r"\W", "_", c)[:10] or "EXP"
            name_, k = base, 1
            while name_.lower() in seen:
                name_, k = f"{base[: 10 - len(str(k))]}{k}", k + 1
            seen.add(name_.lower())
            names.append(name_)
        self.store.create(name, df.toDF(*names))
        return -1


def plain(v, t: T.DataType):
    """A Python value for a column of type t."""
    if v is None:
        return None
    if isinstance(t, T.DecimalType):
        return decimal.Decimal(str(v)).quantize(decimal.Decimal(1).scaleb(-t.scale))
    if isinstance(t, T.DoubleType):
        return float(v)
    if isinstance(t, (T.IntegerType, T.LongType, T.ShortType)):
        return int(v)
    if isinstance(t, T.StringType):
        return str(v)
    return v
