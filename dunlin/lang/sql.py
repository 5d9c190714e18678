"""Statement parser: SELECT with joins, subqueries and unions, DML, DDL and session statements."""

from __future__ import annotations

from dataclasses import dataclass, field

from dunlin.lang.expr import Binary, Call, Lit, Name, Node, Parser, Token, children, tokenize
from dunlin.settings import DialectError


@dataclass
class In(Node):
    arg: Node
    query: Select
    negated: bool = False


@dataclass
class Exists(Node):
    query: Select
    negated: bool = False


@dataclass
class Compare(Node):
    """A comparison with a scalar subquery."""

    op: str
    arg: Node
    query: Select


@dataclass
class Star(Node):
    qualifier: str | None = None


@dataclass
class Item:
    expr: Node
    alias: str | None = None


@dataclass
class Source:
    table: str
    alias: str


@dataclass
class Join:
    kind: str  # inner left right full
    source: Source
    on: Node


@dataclass
class Order:
    expr: Node
    desc: bool = False


@dataclass
class Into:
    kind: str  # cursor table array
    name: str


@dataclass
class Select(Node):
    items: list[Item]
    sources: list[Source]
    joins: list[Join] = field(default_factory=list)
    where: Node | None = None
    group: list[Node] = field(default_factory=list)
    having: Node | None = None
    order: list[Order] = field(default_factory=list)
    distinct: bool = False
    top: float | None = None
    percent: bool = False
    into: Into | None = None
    union: Select | None = None
    union_all: bool = False


@dataclass
class Insert:
    table: str
    columns: list[str] | None
    values: list[Node] | None
    array: str | None = None
    memvar: bool = False


@dataclass
class Update:
    table: str
    sets: list[tuple[str, Node]]
    where: Node | None


@dataclass
class Delete:
    table: str
    where: Node | None


@dataclass
class ColumnDef:
    name: str
    kind: str
    length: int | None = None
    decimals: int | None = None
    nullable: bool | None = None


@dataclass
class Create:
    table: str
    columns: list[ColumnDef]


@dataclass
class Alter:
    table: str
    action: str  # add alter drop rename
    column: ColumnDef | None = None
    name: str | None = None
    new_name: str | None = None


@dataclass
class Drop:
    table: str
    if_exists: bool = False


@dataclass
class Use:
    table: str | None
    area: str | None = None
    alias: str | None = None


@dataclass
class Area:
    name: str


@dataclass
class Set_:
    name: str
    value: str


@dataclass
class Command:
    """RECALL, PACK, ZAP and the like: a word, a table, and conditions."""

    word: str
    table: str | None = None
    where: Node | None = None


CLAUSES = frozenset("FROM WHERE GROUP HAVING ORDER UNION INTO INNER LEFT RIGHT FULL JOIN OUTER ON AS AND OR NOT IN EXISTS ASC DESC TO SET VALUES".split())


class SqlParser(Parser):
    def word(self) -> str:
        return self.now.word()

    def take(self, *words: str) -> bool:
        """Move past the words if all stand here."""
        for k, w in enumerate(words):
            t = self.tokens[min(self.at + k, len(self.tokens) - 1)]
            if t.word() != w:
                return False
        self.at += len(words)
        return True

    def need(self, *words: str) -> None:
        if not self.take(*words):
            raise DialectError(f"{' '.join(words)} expected at {self.now.start}", 10)

    def name(self) -> str:
        t = self.next()
        if t.kind not in ("name", "str"):
            raise DialectError(f"a name expected at {t.start}", 10)
        return str(t.value)

    # -- expressions with subqueries

    def prefix(self) -> Node:
        if self.now.kind == "name" and self.word() == "EXISTS" and self._select_in(1):
            self.at += 1
            return Exists(self.subquery())
        return super().prefix()

    def _select_in(self, ahead: int) -> bool:
        a, b = (self.tokens[min(self.at + ahead + k, len(self.tokens) - 1)] for k in (0, 1))
        return a.kind == "op" and a.value == "(" and b.word() == "SELECT"

    def subquery(self) -> Select:
        self.expect("(")
        q = self.select()
        self.expect(")")
        return q

    def postfix(self, left: Node, power: int) -> Node | None:
        if power >= 40:
            return None
        if self.word() == "IN" and self._select_in(1):
            self.at += 1
            return In(left, self.subquery())
        if self.word() == "NOT" and self.tokens[self.at + 1].word() == "IN" and self._select_in(2):
            self.at += 2
            return In(left, self.subquery(), True)
        if self.now.kind == "op" and self.now.value in ("=", "==", "<>", "!=", "#", "<", "<=", ">", ">=") and self._select_in(1):
            op = self.next().value
            return Compare({"!=": "<>", "#": "<>"}.get(op, op), left, self.subquery())
        return None

    # -- statements

    def statement(self):
        w = self.word()
        if w == "SELECT":
            t = self.tokens[self.at + 1]
            after = self.tokens[min(self.at + 2, len(self.tokens) - 1)]
            if t.kind in ("num", "name") and (after.kind == "end" or after.value == ";"):
                self.at += 2
                return Area(str(t.value))
            return self.select()
        if w == "INSERT":
            return self.insert()
        if w == "UPDATE":
            return self.update()
        if w == "DELETE":
            if self.take("DELETE", "FROM"):
                return Delete(self.name(), self.where())
            self.at += 1
            return Command("DELETE", None, self._for())
        if self.take("CREATE", "TABLE") or self.take("CREATE", "DBF") or self.take("CREATE", "CURSOR"):
            return self.create()
        if self.take("ALTER", "TABLE"):
            return self.alter()
        if self.take("DROP", "TABLE"):
            found = self.take("IF", "EXISTS")
            return Drop(self.name(), found)
        if w == "USE":
            return self.use()
        if w == "SET":
            self.at += 1
            return self.set()
        if w in ("PACK", "ZAP", "RECALL"):
            self.at += 1
            table = self.name() if self.now.kind == "name" and self.word() not in ("FOR", "ALL", "WHERE", "IN") else None
            if self.take("IN"):
                table = self.name()
            self.take("ALL")
            return Command(w, table, self._for())
        raise DialectError(f"unknown statement {self.now.value!r}", 36)

    def _for(self) -> Node | None:
        return self.expression() if self.take("FOR") or self.take("WHERE") else None

    def where(self) -> Node | None:
        return self.expression() if self.take("WHERE") else None

    def select(self) -> Select:
        self.need("SELECT")
        distinct = self.take("DISTINCT")
        if not distinct:
            self.take("ALL")
        top, percent = None, False
        if self.word() == "TOP" and (self.tokens[self.at + 1].kind == "num"):
            self.at += 1
            top = self.next().value
            percent = self.take("PERCENT")
        if not distinct:
            distinct = self.take("DISTINCT")
        items = [self.item()]
        while self.is_op(","):
            self.at += 1
            items.append(self.item())
        into = self.into()
        if not self.take("FROM"):
            raise DialectError("FROM expected", 10)
        sources = [self.source()]
        while self.is_op(","):
            self.at += 1
            sources.append(self.source())
        joins = []
        while True:
            kind = next((k for k in ("INNER", "LEFT", "RIGHT", "FULL") if self.word() == k), None)
            if kind:
                self.at += 1
                self.take("OUTER")
                self.need("JOIN")
            elif self.take("JOIN"):
                kind = "INNER"
            else:
                break
            src = self.source()
            self.need("ON")
            joins.append(Join(kind.lower(), src, self.expression()))
        q = Select(items, sources, joins, distinct=distinct, top=top, percent=percent, into=into)
        q.where = self.where()
        if self.take("GROUP", "BY"):
            q.group = [self.expression()]
            while self.is_op(","):
                self.at += 1
                q.group.append(self.expression())
        if self.take("HAVING"):
            q.having = self.expression()
            if has_subquery(q.having):
                raise DialectError("a subquery in HAVING", 1814)
        self._order(q)
        q.into = self.into() or q.into
        if self.take("UNION"):
            q.union_all = self.take("ALL")
            q.union = self.select()
        self._order(q)
        q.into = self.into() or q.into
        return q

    def _order(self, q: Select) -> None:
        if self.take("ORDER", "BY"):
            while True:
                e = self.expression()
                desc = self.take("DESC")
                if not desc:
                    self.take("ASC")
                q.order.append(Order(e, desc))
                if not self.is_op(","):
                    break
                self.at += 1

    def into(self) -> Into | None:
        if not self.take("INTO"):
            return None
        kind = self.name().lower()
        name = self.name()
        while self.word() in ("READWRITE", "NOFILTER"):
            self.at += 1
        return Into({"dbf": "table"}.get(kind, kind), name)

    def item(self) -> Item:
        if self.is_op("*"):
            self.at += 1
            return Item(Star())
        t, dot = self.now, self.tokens[self.at + 1]
        if t.kind == "name" and dot.kind == "op" and dot.value == "." and self.tokens[self.at + 2].value == "*":
            self.at += 3
            return Item(Star(t.value))
        e = self.expression()
        if self.take("AS"):
            return Item(e, self.name())
        if self.now.kind == "name" and self.word() not in CLAUSES:
            return Item(e, self.name())
        return Item(e)

    def source(self) -> Source:
        t = self.next()
        if t.kind not in ("name", "str"):
            raise DialectError(f"a table expected at {t.start}", 10)
        table = str(t.value)
        self.take("AS")
        alias = self.name() if self.now.kind == "name" and self.word() not in CLAUSES else table.split(".")[-1]
        return Source(table, alias)

    def insert(self) -> Insert:
        self.need("INSERT", "INTO")
        table, columns = self.name(), None
        if self.is_op("("):
            columns = self._names()
        if self.take("FROM", "ARRAY"):
            return Insert(table, columns, None, array=self.name())
        if self.take("FROM", "MEMVAR"):
            return Insert(table, columns, None, memvar=True)
        self.need("VALUES")
        self.expect("(")
        values = [self.expression()]
        while self.is_op(","):
            self.at += 1
            values.append(self.expression())
        self.expect(")")
        return Insert(table, columns, values)

    def _names(self) -> list[str]:
        self.expect("(")
        out = [self.name()]
        while self.is_op(","):
            self.at += 1
            out.append(self.name())
        self.expect(")")
        return out

    def update(self) -> Update:
        self.need("UPDATE")
        table = self.name()
        self.need("SET")
        sets = []
        while True:
            column = self.name().split(".")[-1]
            self.expect("=")
            sets.append((column, self.expression()))
            if not self.is_op(","):
                break
            self.at += 1
        return Update(table, sets, self.where())

    def column(self) -> ColumnDef:
        name, kind = self.name(), self.name().upper()
        kind = {"CHARACTER": "C", "CHAR": "C", "NUMERIC": "N", "NUM": "N", "FLOAT": "F", "INTEGER": "I", "INT": "I", "LONG": "I", "DOUBLE": "B", "CURRENCY": "Y", "MONEY": "Y", "DATE": "D", "DATETIME": "T", "LOGICAL": "L", "MEMO": "M", "VARCHAR": "V", "BLOB": "W", "GENERAL": "G", "VARBINARY": "Q", "PICTURE": "P"}.get(kind, kind)
        if kind not in set("CNFIBYDTLMVWGQP"):
            raise DialectError(f"unknown column type {kind}", 10)
        col = ColumnDef(name, kind)
        if self.is_op("("):
            self.at += 1
            col.length = int(self.next().value)
            if self.is_op(","):
                self.at += 1
                col.decimals = int(self.next().value)
            self.expect(")")
        while self.now.kind == "name" and self.word() not in ("ADD", "DROP", "ALTER"):
            if self.take("NOT", "NULL"):
                col.nullable = False
            elif self.take("NULL"):
                col.nullable = True
            elif self.take("PRIMARY", "KEY") or self.take("UNIQUE") or self.take("AUTOINC") or self.take("NOCPTRANS"):
                pass
            elif self.take("DEFAULT") or self.take("CHECK"):
                self.expression()
            else:
                raise DialectError(f"unexpected {self.now.value!r}", 10)
        return col

    def create(self) -> Create:
        table = self.name()
        self.take("FREE")
        self.expect("(")
        cols = [self.column()]
        while self.is_op(","):
            self.at += 1
            cols.append(self.column())
        self.expect(")")
        return Create(table, cols)

    def alter(self) -> Alter:
        table = self.name()
        if self.take("ADD"):
            self.take("COLUMN")
            return Alter(table, "add", self.column())
        if self.take("ALTER"):
            self.take("COLUMN")
            return Alter(table, "alter", self.column())
        if self.take("DROP"):
            self.take("COLUMN")
            return Alter(table, "drop", name=self.name())
        self.need("RENAME")
        self.take("COLUMN")
        old = self.name()
        self.need("TO")
        return Alter(table, "rename", name=old, new_name=self.name())

    def use(self) -> Use:
        self.need("USE")
        table = alias = area = None
        if self.now.kind in ("name", "str") and self.word() not in ("IN", "ALIAS"):
            table = self.name()
        while self.now.kind == "name":
            if self.take("IN"):
                area = str(self.next().value)
            elif self.take("ALIAS"):
                alias = self.name()
            elif self.word() in ("AGAIN", "EXCLUSIVE", "SHARED", "NOUPDATE"):
                self.at += 1
            else:
                break
        return Use(table, area, alias)

    def set(self) -> Set_:
        name = self.name().upper()
        self.take("TO")
        start = self.at
        while self.now.kind != "end" and not self.is_op(";"):
            self.at += 1
        return Set_(name, " ".join(str(t.value) for t in self.tokens[start : self.at]))


def has_subquery(node: Node | None) -> bool:
    if node is None:
        return False
    return isinstance(node, (In, Exists, Compare)) or any(has_subquery(c) for c in children(node))


def parse(text: str):
    """One statement."""
    p = SqlParser(tokenize(text))
    out = p.statement()
    if p.is_op(";"):
        p.at += 1
    if p.now.kind != "end":
        raise DialectError(f"unexpected {p.now.value!r} at {p.now.start}", 10)
    return out


def parse_script(text: str) -> list:
    """Statements separated by `;`."""
    p, out = SqlParser(tokenize(text)), []
    while p.now.kind != "end":
        if p.is_op(";"):
            p.at += 1
            continue
        out.append(p.statement())
    return out


__all__ = ["Call", "Lit", "Name", "Token", "parse", "parse_script"]
