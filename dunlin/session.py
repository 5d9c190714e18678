"""A session: work areas, settings, cursors, arrays and the statements that use them."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dunlin.lang import sql as S
from dunlin.lang.expr import Name, Token, parse_expression, tokenize
from dunlin.operators.changes import Changes
from dunlin.operators.commands import Commands
from dunlin.operators.nav import Area
from dunlin.plans.compile import Compiler
from dunlin.plans.select import Planner
from dunlin.plans.values import Val
from dunlin.settings import DialectError, Settings
from dunlin.sources.materialize import settled, shared_folder
from dunlin.sources.store import DELETED, HIDDEN, RECNO, Store, numbered


class Session:
    """`execute` runs a statement: a DataFrame for SELECT, a row count for changes, None for the rest."""

    def __init__(self, spark: SparkSession, root: str | None = None, settings: Settings | None = None):
        self.spark, self.settings = spark, settings or Settings()
        self._root, self._store = root, None
        self.views: dict[str, DataFrame] = {}
        self.areas: dict[str, tuple[str, str]] = {}  # area -> (alias, table)
        self.open_areas: dict[str, Area] = {}
        self.area = "1"
        self.arrays: dict[str, list] = {}
        self.memory: dict[str, object] = {}
        self.functions: dict[str, Callable] = {}
        self.work: dict[str, Area] = {}
        self.commands = Commands(self)
        self.variables: Callable[[], dict] = lambda: self.memory

    @property
    def store(self) -> Store:
        if self._store is None:
            self._store = Store(self.spark, self._root or f"{shared_folder(self.spark)}/dunlin/tables-{id(self):x}")
        return self._store

    # -- names

    def register(self, name: str, df: DataFrame) -> None:
        """A frame under a table's name; read only."""
        self.views[name.lower()] = df

    def register_folder(self, folder: str, names: list[str]) -> None:
        for n in names:
            self.register(n, self.spark.read.parquet(f"{folder}/{n}.parquet"))

    def register_function(self, name: str, build: Callable) -> None:
        """A function for expressions: build(*columns) gives a column of texts, or a pair of column and kind."""

        def make(_, args: list[Val]) -> Val:
            made = build(*(a.col for a in args))
            return Val(*made) if isinstance(made, tuple) else Val(made, "C")

        self.functions[name.upper()] = make

    def table(self, name: str) -> DataFrame:
        """An open area's alias, a view or cursor, or a stored table, in this order."""
        low = name.lower()
        for alias, table in self.areas.values():
            if alias.lower() == low and table.lower() != low:
                return self.table(table)
        if low in self.views:
            return self.views[low]
        if self.store.exists(name):
            return self.store.frame(name)
        raise DialectError(f"table {name} does not exist", 1)

    def planner(self) -> Planner:
        return Planner(self.table, self.settings, self.functions)

    def changes(self) -> Changes:
        return Changes(self.store, self.settings, self.functions)

    # -- statements

    def execute(self, text: str, *args, **named) -> DataFrame | int | None:
        if text.lstrip()[:1] in ("?", "=") and not args:
            return self.value(text.lstrip()[1:])
        if self.commands.run(text):
            return None
        return self.run(self.parse(text, args, named))

    def parse(self, text: str, args: tuple = (), named: dict | None = None):
        tokens = bound(tokenize(text), args, named or {})
        p = S.SqlParser(tokens)
        stmt = p.statement()
        if p.is_op(";"):
            p.at += 1
        if p.now.kind != "end":
            raise DialectError(f"unexpected {p.now.value!r} at {p.now.start}", 10)
        return stmt

    def query(self, text: str, *args, **named) -> DataFrame:
        out = self.execute(text, *args, **named)
        if not isinstance(out, DataFrame):
            raise DialectError("no query", 10)
        return out

    def script(self, text: str) -> list:
        return [self.run(s) for s in S.parse_script(text)]

    def batch(self, texts: list[str]) -> list:
        return [self.execute(t) for t in texts]

    def value(self, expression: str) -> object:
        """One expression's value."""
        v = Compiler(lambda n: self._memory(n), self.settings, self.functions).value(parse_expression(expression))
        return self.spark.range(1).select(v.col.alias("v")).first().v

    def _memory(self, name: Name) -> Val | None:
        from dunlin.plans.values import literal

        known = self.variables()
        return literal(known[name.name.lower()]) if name.name.lower() in known else None

    def run(self, stmt) -> DataFrame | int | None:
        if isinstance(stmt, S.Select):
            return self.select(stmt)
        c = self.changes()
        if isinstance(stmt, S.Insert):
            return c.insert(stmt, self.arrays, self.memory)
        if isinstance(stmt, S.Update):
            return c.update(stmt)
        if isinstance(stmt, S.Delete):
            return c.mark(stmt.table, stmt.where, True)
        if isinstance(stmt, S.Create):
            return c.create(stmt)
        if isinstance(stmt, S.Alter):
            return c.alter(stmt)
        if isinstance(stmt, S.Drop):
            return c.drop(stmt)
        if isinstance(stmt, S.Command):
            table = stmt.table or self.current_table()
            if stmt.word in ("PACK", "ZAP"):
                self.work = {k: a for k, a in self.work.items() if self.areas[k][1].lower() != table.lower()}
                return c.pack(table) if stmt.word == "PACK" else c.zap(table)
            if stmt.table is None:
                raise DialectError(f"{stmt.word} takes no scope and no condition", 10)
            return c.mark(table, stmt.where, stmt.word == "DELETE")
        if isinstance(stmt, S.Use):
            return self.use(stmt)
        if isinstance(stmt, S.Area):
            self.area = next((a for a, (alias, _) in self.areas.items() if alias.lower() == stmt.name.lower()), stmt.name)
            return None
        if isinstance(stmt, S.Set_):
            return self.set(stmt.name, stmt.value)
        raise DialectError(f"{type(stmt).__name__} cannot be run", 10)

    def select(self, stmt: S.Select) -> DataFrame | int:
        df = self.planner().plan(stmt)
        into = stmt.into
        node = stmt
        while node.union is not None:
            node = node.union
            into = node.into or into
        if into is None:
            return df
        if into.kind == "cursor":
            self.views[into.name.lower()] = settled(df)
            return self.views[into.name.lower()]
        if into.kind == "array":
            rows = [list(r) for r in df.collect()]
            if rows:
                self.arrays[into.name.lower()] = rows
            return len(rows)
        self.changes().into_table(into.name, df)
        return self.store.frame(into.name).drop(*HIDDEN)

    def use(self, stmt: S.Use) -> None:
        area = stmt.area or self.area
        if area == "0":
            area = next(str(n) for n in range(1, 32768) if str(n) not in self.areas)
        self.work.pop(area, None)
        if stmt.table is None:
            self.areas.pop(area, None)
            return
        self.table(stmt.table)
        self.areas[area] = (stmt.alias or stmt.table, stmt.table)

    def current_table(self) -> str:
        if self.area not in self.areas:
            raise DialectError("no table is open", 52)
        return self.areas[self.area][1]

    def area_id(self, name: str | None) -> str:
        """The number of an area by its number or alias; the current one for none."""
        found = self.area if name is None else name if name in self.areas else next((k for k, (alias, _) in self.areas.items() if alias.lower() == name.lower()), None)
        if found not in self.areas:
            raise DialectError("no table is open" if name is None else f"alias {name} is not found", 52 if name is None else 13)
        return found

    def table_of(self, name: str | None) -> str:
        return self.areas[self.area_id(name)][1]

    def work_area(self, name: str | None = None) -> Area:
        """An open area with its place; when first used it is at its first record."""
        key = self.area_id(name)
        df = self.table(self.areas[key][1])
        a = self.work.get(key)
        if RECNO not in df.columns:
            df = a.df if a is not None else settled(numbered(df).withColumn(DELETED, F.lit(False)))
        settings = Settings(**{**self.settings.__dict__, "sql": False})
        if a is None:
            a = self.work[key] = Area(df, settings, names=self._memory)
            a.top()
        else:
            a.df, a.settings = df, settings
        return a

    def field_value(self, name: Name) -> tuple[bool, object]:
        """Whether a name is a field of its area, or of the current one, and its value in the current record."""
        if (name.qualifier or "").lower() == "m" or not self.areas:
            return False, None
        if name.qualifier is None and self.area not in self.areas:
            return False, None
        try:
            key = self.area_id(name.qualifier)
        except DialectError:
            return False, None
        df = self.work[key].df if key in self.work else self.table(self.areas[key][1])
        column = next((c for c in df.columns if c.lower() == name.name.lower() and c not in HIDDEN), None)
        if column is None:
            return False, None
        row = self.work_area(key).record()
        return True, None if row is None else row[column]

    def used(self, alias: str) -> bool:
        return any(a.lower() == alias.lower() for a, _ in self.areas.values())

    def set(self, name: str, value: str) -> None:
        s, on = self.settings, value.strip().upper() == "ON"
        if name in ("EXACT", "ANSI", "DELETED", "NULL", "NEAR"):
            setattr(s, name.lower(), on)
        elif name == "COLLATE":
            if value.strip().upper() not in ("MACHINE", "GENERAL"):
                raise DialectError(f"unknown collation {value}", 1915)
            s.collate = value.strip().upper()
        elif name == "MEMOWIDTH":
            s.memowidth = int(value)
        elif name not in ("OPTIMIZE", "DATASESSION", "DATABASE", "EXCLUSIVE", "SAFETY", "TALK", "CENTURY", "MULTILOCKS", "POINT"):
            raise DialectError(f"unknown setting {name}", 231)

    # -- areas for navigation

    def navigate(self, table: str) -> Area:
        """An area over a table for moves; it sees the table as it is now."""
        df = self.table(table)
        if RECNO not in df.columns:
            df = settled(numbered(df).withColumn(DELETED, F.lit(False)))
        settings = Settings(**{**self.settings.__dict__, "sql": False})
        self.open_areas[table.lower()] = Area(df, settings)
        return self.open_areas[table.lower()]

    def append_from(self, table: str, source: str, for_: str | None = None) -> int:
        df = self.table(source)
        if DELETED in df.columns and self.settings.deleted:
            df = df.where(~F.col(DELETED))
        if for_:
            from dunlin.plans.compile import query

            df = query(df, for_, Settings(**{**self.settings.__dict__, "sql": False}))
        return self.store.append(table, df.drop(*HIDDEN))

    def copy_to(self, table: str, target: str, fields: list[str] | None = None, for_: str | None = None) -> None:
        area = self.navigate(table)
        df = area.scoped("ALL", for_=for_).orderBy(RECNO)
        self.store.create(target, df.select(*(fields or [c for c in df.columns if c not in HIDDEN])))

    def copy_structure(self, table: str, target: str) -> None:
        self.store.create(target, self.table(table).drop(*HIDDEN).limit(0))

    # -- catalog

    def tables(self) -> list[str]:
        return sorted({*self.views, *self.store.tables()})

    def columns(self, table: str) -> list[tuple[str, str, bool]]:
        return [(f.name, f.dataType.simpleString(), f.nullable) for f in self.table(table).schema if f.name not in HIDDEN]

    def set_rules(self, table: str, **rules) -> None:
        """What every later change of a stored table must keep; kinds as in operators.rules."""
        self.store.rule(table, **rules)

    def begin(self) -> None:
        self.store.begin()

    def commit(self) -> None:
        self.store.commit()

    def rollback(self) -> None:
        self.store.rollback()


def bound(tokens: list[Token], args: tuple, named: dict) -> list[Token]:
    """Parameters `?`, `:n` and `@n` as literals; strings are never read for them."""
    out, k, at = [], 0, 0
    low = {n.lower(): v for n, v in named.items()}
    while at < len(tokens):
        t = tokens[at]
        if t.kind == "op" and t.value == "?":
            if k >= len(args):
                raise DialectError("a parameter is missing", 1229)
            out += literal_tokens(args[k], t)
            k += 1
        elif t.kind == "op" and t.value in (":", "@") and tokens[at + 1].kind in ("name", "num"):
            name = str(tokens[at + 1].value)
            if name.lower() in low:
                value = low[name.lower()]
            elif name.isdigit() and int(name) <= len(args):
                value = args[int(name) - 1]
            else:
                raise DialectError(f"parameter {name} is missing", 1229)
            out += literal_tokens(value, t)
            at += 1
        else:
            out.append(t)
        at += 1
    return out


def literal_tokens(value: object, t: Token) -> list[Token]:
    def one(kind: str, v: object) -> Token:
        return Token(kind, v, t.start, t.end)

    if value is None or isinstance(value, bool):
        return [one("lit", value)]
    if isinstance(value, (int, float)):
        return [one("num", value)] if value >= 0 else [one("op", "("), one("op", "-"), one("num", -value), one("op", ")")]
    if isinstance(value, dt.datetime):
        return [one("date", value.strftime("{^%Y-%m-%d %H:%M:%S}"))]
    if isinstance(value, dt.date):
        return [one("date", value.strftime("{^%Y-%m-%d}"))]
    return [one("str", str(value))]


