"""Work-area navigation: filters, keys, locate, seek, relations, scopes and running totals.

An area is a frame with `__recno`, an order, and conditions that hide rows. Its moves are queries: what
is visited is found by filters and limits on the order's key, never by reading rows one after another on
the driver. Only scan() hands rows to the driver, as they come.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dunlin.lang.expr import Name, parse_expression
from dunlin.plans import compare
from dunlin.plans.compile import Compiler, frame_resolver, record_functions
from dunlin.plans.values import Val, kind_of, literal
from dunlin.settings import DialectError, Settings
from dunlin.sources.store import DELETED, HIDDEN, RECNO

NUMBERS = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)


@dataclass
class Order:
    key: str
    desc: bool = False
    unique: bool = False
    condition: str | None = None
    candidate: bool = False


@dataclass
class Area:
    df: DataFrame
    settings: Settings
    orders: dict[str, Order] = field(default_factory=dict)
    order: str | None = None
    filter: str | None = None
    low: object = None
    high: object = None
    ranged: bool = False
    recno: int | None = None
    found: bool = False
    located: tuple | None = None
    links: list[tuple[str, str]] = field(default_factory=list)  # relations: expression, child's alias
    many: set[str] = field(default_factory=set)
    bof: bool = False
    row: Row | None = None  # the current record, if it has been read
    names: Callable[[Name], Val | None] | None = None  # variables, for what is no field
    extra: dict = field(default_factory=dict)

    # -- what is seen, and in which order

    def value(self, text: str, df: DataFrame | None = None) -> Val:
        fields = frame_resolver((df or self.df).schema)

        def resolve(name: Name) -> Val | None:
            if name.name in self.extra:
                return literal(self.extra[name.name])
            found = None if (name.qualifier or "").lower() == "m" else fields(Name(name.name))
            return found if found is not None else self.names(name) if self.names else None

        return Compiler(resolve, self.settings, record_functions()).value(parse_expression(text))

    def record(self) -> Row | None:
        """The current record; none beyond the end."""
        if self.recno is None:
            return None
        if self.row is None or self.row[RECNO] != self.recno:
            self.row = self.df.where(F.col(RECNO) == self.recno).first()
        return self.row

    def now(self, text: str) -> object:
        """An expression over the current record; NULL beyond the end."""
        row = self.df.where(F.col(RECNO) == self.recno).select(self.value(text).col.alias("v")).first() if self.recno is not None else None
        return row.v if row else None

    def condition(self, text: str) -> Column:
        v = self.value(text)
        return F.coalesce(v.col, F.lit(False)) if v.kind == "L" else F.lit(False)

    def key(self) -> Column | None:
        """The key of the order in force, for sorting."""
        if self.order is None:
            return None
        return compare.sort_key(self.value(self.orders[self.order].key), self.settings)

    def visible(self) -> DataFrame:
        """Rows that are not deleted, in the key range, and pass the filter; the order's own conditions hold."""
        df = self.df
        if DELETED in df.columns and self.settings.deleted:
            df = df.where(~F.col(DELETED))
        if self.order is not None:
            o = self.orders[self.order]
            if o.condition:
                df = df.where(self.condition(o.condition))
            if o.unique:
                least = df.groupBy(self.key().alias("__u")).agg(F.min(RECNO).alias(RECNO)).select(RECNO)
                df = df.join(least, RECNO, "left_semi")
            if self.ranged:
                v = self.value(o.key)
                if self.low is not None:
                    df = df.where(v.col >= literal(self.low).col)
                if self.high is not None:
                    df = df.where(v.col <= literal(self.high).col if not isinstance(self.high, str) else (v.col <= self.high) | F.startswith(v.col, F.lit(self.high)))
        if self.filter:
            df = df.where(self.condition(self.filter))
        return df

    def sorting(self, reverse: bool = False) -> list[Column]:
        k = self.key()
        if k is None:
            return [F.col(RECNO).desc() if reverse else F.col(RECNO).asc()]
        desc = self.orders[self.order].desc != reverse
        return [k.desc_nulls_last() if desc else k.asc_nulls_first(), F.col(RECNO).desc() if reverse else F.col(RECNO).asc()]

    def ordered(self) -> DataFrame:
        return self.visible().orderBy(*self.sorting())

    def after(self, row: Row | None, inclusive: bool = False) -> Column:
        """Whether a row comes after another in the order."""
        if row is None:
            return F.lit(True)
        here = F.col(RECNO) >= row[RECNO] if inclusive else F.col(RECNO) > row[RECNO]
        k = self.key()
        if k is None:
            return here
        now = row["__key"]
        same = k.eqNullSafe(F.lit(now))
        if self.orders[self.order].desc:
            past = k.isNull() & F.lit(now is not None) if now is None else k.isNull() | (k < F.lit(now))
        else:
            past = k.isNotNull() if now is None else k > F.lit(now)
        return F.coalesce(past, F.lit(False)) | (same & here)

    def at(self, recno: int | None) -> Row | None:
        if recno is None:
            return None
        k = self.key()
        return self.df.where(F.col(RECNO) == recno).withColumn("__key", F.lit(0) if k is None else k).first()

    # -- moves

    def first_of(self, df: DataFrame, reverse: bool = False) -> Row | None:
        row = df.orderBy(*self.sorting(reverse)).first()
        self.recno, self.row, self.bof = row[RECNO] if row else None, row, False
        return row

    def top(self) -> Row | None:
        return self.first_of(self.visible())

    def bottom(self) -> Row | None:
        return self.first_of(self.visible(), reverse=True)

    def go(self, recno: int) -> Row | None:
        row = self.df.where(F.col(RECNO) == recno).first()
        if row is None:
            raise DialectError("record is out of range", 5)
        self.recno, self.row, self.bof = recno, row, False
        return row

    def skip(self, n: int = 1) -> Row | None:
        here = self.at(self.recno)
        if here is None and n < 0:  # back from beyond the end: the last record is one step away
            last = self.bottom()
            return last if n == -1 or last is None else self.skip(n + 1)
        if n == 0 or here is None:
            return here
        df = self.visible()
        df = df.where(self.after(here)) if n > 0 else df.where(~self.after(here, inclusive=True))
        rows = df.orderBy(*self.sorting(n < 0)).limit(abs(n)).orderBy(*self.sorting(n > 0)).limit(1).collect() if abs(n) > 1 else df.orderBy(*self.sorting(n < 0)).limit(1).collect()
        if abs(n) > 1 and df.limit(abs(n)).count() < abs(n):
            rows = []
        if not rows and n < 0:  # before the first record: the place is the first one, and BOF() holds
            self.top()
            self.bof = True
            return None
        self.recno, self.row, self.bof = (rows[0][RECNO], rows[0], False) if rows else (None, None, False)
        return rows[0] if rows else None

    def eof(self) -> bool:
        return self.recno is None

    def scoped(self, scope: str = "ALL", n: int = 0, for_: str | None = None, while_: str | None = None) -> DataFrame:
        """Rows of a scope: ALL, REST, NEXT n or RECORD n; WHILE stops at the first row that fails it."""
        df = self.visible()
        if scope == "RECORD":
            df = df.where(F.col(RECNO) == n)
        elif scope in ("REST", "NEXT") or while_:
            df = df.where(self.after(self.at(self.recno), inclusive=True))
        if while_:
            stop = df.where(~self.condition(while_)).withColumn("__key", F.lit(0) if self.key() is None else self.key()).orderBy(*self.sorting()).first()
            if stop is not None:
                df = df.where(~self.after(stop, inclusive=True))
        if scope == "NEXT":
            df = df.orderBy(*self.sorting()).limit(n)
        return df.where(self.condition(for_)) if for_ else df

    def locate(self, for_: str | None = None, while_: str | None = None, scope: str = "ALL", n: int = 0, extra: dict | None = None) -> Row | None:
        self.extra = extra or {}
        row = self.first_of(self.scoped("REST" if while_ and scope == "ALL" else scope, n, for_, while_))
        self.found, self.located = row is not None, (for_, while_)
        return row

    def continue_(self) -> Row | None:
        if self.located is None:
            raise DialectError("CONTINUE needs LOCATE", 42)
        here = self.at(self.recno)
        if here is None:
            return None
        df = self.scoped("REST", for_=self.located[0], while_=self.located[1]).where(self.after(here))
        row = self.first_of(df)
        self.found = row is not None
        return row

    def seek(self, value: object) -> Row | None:
        """The first row with the key, by prefix for texts; else the next one under SET NEAR, or none."""
        if self.order is None:
            raise DialectError("no order is set", 26)
        v = self.value(self.orders[self.order].key)
        lit = literal(value)
        hit = F.startswith(v.col, lit.col) if isinstance(value, str) else compare.equal(v, lit, self.settings, exact=True)
        row = self.first_of(self.visible().where(hit))
        self.found = row is not None
        if row is None and self.settings.near:
            past = v.col < lit.col if self.orders[self.order].desc else v.col > lit.col
            return self.first_of(self.visible().where(past))
        return row

    def lookup(self, result: str, value: object, key: str) -> object:
        v = self.value(key)
        row = self.visible().where(compare.equal(v, literal(value), self.settings, exact=True)).orderBy(RECNO).select(self.value(result).col.alias("r")).first()
        return row.r if row else None

    def set_key(self, low: object = None, high: object = None) -> None:
        self.ranged, self.low, self.high = low is not None or high is not None, low, high if high is not None else low

    def scan(self, for_: str | None = None, while_: str | None = None, scope: str = "ALL", n: int = 0) -> Iterator[Row]:
        for row in self.scoped(scope, n, for_, while_).orderBy(*self.sorting()).toLocalIterator():
            self.recno, self.row = row[RECNO], row
            yield row
        self.recno = self.row = None

    # -- orders

    def index_on(self, tag: str, key: str, desc: bool = False, unique: bool = False, for_: str | None = None, candidate: bool = False) -> None:
        if candidate:
            repeated = self.df.where(~F.col(DELETED)) if DELETED in self.df.columns else self.df
            if repeated.groupBy(self.value(key).col.alias("k")).count().where("count > 1").limit(1).count():
                raise DialectError("the key is not unique", 1884)
        self.orders[tag.upper()] = Order(key, desc, unique, for_, candidate)
        self.order = tag.upper()

    def set_order(self, tag: str | None) -> None:
        if tag and tag.upper() not in self.orders:
            raise DialectError(f"tag {tag} is not found", 1683)
        self.order = tag.upper() if tag else None

    # -- results

    def relate(self, child: Area, on: str, many: bool = False, child_key: str | None = None) -> DataFrame:
        """Rows with their child's: the first child of each in the child's order, or with SET SKIP all of them."""
        parent, kid = self.visible(), child.visible()
        key = child_key or (child.orders[child.order].key if child.order else None)
        if key is None:
            raise DialectError("the child needs an order", 26)
        k, v = child.value(key), self.value(on)
        kid = kid.withColumn("__key", k.col)
        if not many:
            first = kid.groupBy("__key").agg(F.min_by(F.struct(*(c for c in kid.columns if c != "__key")), RECNO).alias("row"))
            kid = first.select("__key", "row.*")
        names = {c: f"{c}_child" if c in parent.columns else c for c in kid.columns}
        kid = kid.select(*(F.col(f"`{c}`").alias(n) for c, n in names.items()))
        cond = v.col == F.col("__key") if kind_of(kid.schema["__key"].dataType) == v.kind else compare.equal(v, Val(F.col("__key"), k.kind), self.settings, exact=True)
        return parent.join(kid, cond, "left").drop("__key")

    def sum(self, *expressions: str, for_: str | None = None, while_: str | None = None, scope: str = "ALL", n: int = 0, average: bool = False) -> tuple:
        df = self.scoped(scope, n, for_=for_, while_=while_)
        cols = [F.coalesce((F.avg if average else F.sum)(self.value(e).col.cast("double")), F.lit(0.0)) for e in expressions]
        return tuple(df.agg(*cols).first())

    def total(self, on: str, fields: list[str] | None = None, for_: str | None = None) -> DataFrame:
        """Runs of equal keys that stand next to each other in the order: numbers summed, the rest of the first row.

        Numbering runs needs the order of all rows. Rows are range-partitioned in it; a partition numbers
        its own runs, and only each partition's edges are compared across partitions.
        """
        df = self.scoped("ALL", for_=for_)
        runs = with_runs(df, self.sorting(), self.value(on).col)
        names = [c for c in df.columns if c not in HIDDEN]
        summed = {f.name for f in df.schema if isinstance(f.dataType, NUMBERS) and f.name in names and (fields is None or f.name.lower() in [x.lower() for x in fields])}
        key = next((n for n in names if n.lower() == on.lower()), None)
        summed.discard(key)
        aggs = [F.sum(f"`{n}`").cast(df.schema[n].dataType).alias(n) if n in summed else F.min_by(f"`{n}`", "__place").alias(n) for n in names]
        return runs.groupBy("__run").agg(*aggs, F.min("__place").alias("__place")).orderBy("__place").select(*names)


def with_runs(df: DataFrame, sorting: list[Column], key: Column) -> DataFrame:
    """df with `__run`, equal for neighbours in the order with equal keys, and `__place` in the order."""
    spark = df.sparkSession
    ranged = df.withColumn("__key", key).repartitionByRange(*sorting).withColumn("__part", F.spark_partition_id())
    from dunlin.sources.materialize import settled

    ranged = settled(ranged)
    w = Window.partitionBy("__part").orderBy(*sorting)
    change = (~F.col("__key").eqNullSafe(F.lag("__key").over(w))) | F.lag(F.lit(1)).over(w).isNull()
    inner = ranged.withColumn("__n", F.row_number().over(w)).withColumn("__new", change.cast("int"))
    inner = inner.withColumn("__local", F.sum("__new").over(w))
    edges = inner.groupBy("__part").agg(F.min_by("__key", "__n").alias("first"), F.max_by("__key", "__n").alias("last"), F.max("__local").alias("runs"), F.max("__n").alias("rows"))
    base, runs, rows, before, any_before = [], 0, 0, None, False
    for e in sorted(edges.collect(), key=lambda e: e["__part"]):  # a row for each partition
        joined = any_before and e["first"] == before
        base.append((e["__part"], runs - (1 if joined else 0), rows))
        runs += e.runs - (1 if joined else 0)
        rows, before, any_before = rows + e.rows, e["last"], True
    if not base:
        return inner.withColumn("__run", F.lit(0).cast("long")).withColumn("__place", F.lit(0).cast("long"))
    bases = spark.createDataFrame(base, "__part int, __base long, __rows long")
    out = inner.join(F.broadcast(bases), "__part")
    return out.withColumn("__run", F.col("__base") + F.col("__local")).withColumn("__place", F.col("__rows") + F.col("__n"))
