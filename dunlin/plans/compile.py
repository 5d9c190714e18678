"""Expression trees to Spark columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from dunlin.functions.registry import build
from dunlin.lang.expr import Binary, Call, Lit, Name, Node, Unary, parse_expression
from dunlin.plans import compare
from dunlin.plans.values import NUMERIC, Val, empty_date, guarded, literal, null, number, stamp, text
from dunlin.settings import DialectError, Settings

Resolver = Callable[[Name], Val | None]


class Compiler:
    """Compiles nodes against a name resolver; `functions` are consulted before the built-in ones."""

    def __init__(self, resolve: Resolver, settings: Settings, functions: dict | None = None, special: Callable[[Node], Val | None] | None = None):
        self.resolve, self.settings, self.functions, self.special = resolve, settings, functions or {}, special

    def value(self, node: Node) -> Val:
        if self.special and (found := self.special(node)) is not None:
            return found
        if isinstance(node, Lit):
            return literal(node.value)
        if isinstance(node, Name):
            found = self.resolve(node)
            if found is None:
                if self.settings.strict:
                    raise DialectError(f"unknown name {node.name}", 12)
                return null()
            return found
        if isinstance(node, Unary):
            if node.op == "NOT":
                return Val(~self.logical(node.arg), "L")
            v = self.value(node.arg)
            if v.is_lit and isinstance(v.lit, (int, float)) and not isinstance(v.lit, bool):
                return literal(-v.lit)
            return Val(-number(v), "B")
        if isinstance(node, Binary):
            return self.binary(node)
        if isinstance(node, Call):
            return self.call(node)
        raise DialectError(f"{type(node).__name__} is not supported here", 10)

    def logical(self, node: Node) -> Column:
        """As a condition: what is not logical is NULL."""
        v = self.value(node)
        return v.col if v.kind == "L" else F.lit(None).cast("boolean")

    def condition(self, node: Node) -> Column:
        return self.logical(node)

    def call(self, node: Call) -> Val:
        if node.name in self.functions:
            return self.functions[node.name](self, [self.value(a) for a in node.args])
        return build(self, node)

    def binary(self, node: Binary) -> Val:
        op = node.op
        if op in ("AND", "OR"):
            a, b = self.logical(node.left), self.logical(node.right)
            return Val(a & b if op == "AND" else a | b, "L")
        a, b = self.value(node.left), self.value(node.right)
        if op in ("=", "==", "<>"):
            eq = compare.equal(a, b, self.settings, op == "==")
            return Val(~eq if op == "<>" else eq, "L")
        if op in ("<", "<=", ">", ">="):
            return Val(compare.ordered(op, a, b, self.settings), "L")
        if op == "$":
            if a.kind != "C" or b.kind != "C":
                return Val(compare.unlike(a, b), "L")
            if self.settings.collate == "GENERAL":
                return Val(F.contains(compare.general_head(b.col), compare.general_head(a.col)), "L")
            return Val(F.contains(b.col, a.col), "L")
        if a.kind == "X" or b.kind == "X":
            return null("C" if "C" in (a.kind, b.kind) and op in "+-" else "B")
        if op in "+-":
            return self.plus_minus(op, a, b)
        x, y = number(a), number(b)
        if op == "*":
            return Val(x * y, "B")
        if op == "/":
            return Val(F.try_divide(x, y), "B")
        if op == "%":
            return Val(modulo(x, y), "B")
        if op == "^":
            return Val(F.pow(x, y), "B")
        raise DialectError(f"unknown operator {op}", 10)

    def plus_minus(self, op: str, a: Val, b: Val) -> Val:
        if a.kind == "C" or b.kind == "C":
            x, y = text(a), text(b)
            if op == "+":
                return Val(F.concat(x, y), "C")
            cut = F.rtrim(x)
            return Val(F.concat(cut, y, F.repeat(F.lit(" "), F.length(x) - F.length(cut))), "C")
        sign = 1 if op == "+" else -1
        for p, q, flipped in ((a, b, False), (b, a, True)):
            if p.kind in "DT" and q.kind in NUMERIC and not (flipped and op == "-"):
                if p.kind == "D":
                    n = number(q).cast("int") * sign
                    ok = (n + F.datediff(p.col, empty_date())).between(0, 3652058)
                    return Val(guarded(F.when(ok, F.date_add(p.col, n)).otherwise(empty_date()), p, q), "D")
                return Val(p.col + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), (number(q) * sign).cast("decimal(18,6)")), "T")
        if op == "-" and a.kind in "DT" and b.kind in "DT":
            if a.kind == b.kind == "D":
                return Val(F.datediff(a.col, b.col).cast("double"), "B")
            return Val(seconds_between(stamp(a), stamp(b)), "B")
        return Val(number(a) + number(b) if op == "+" else number(a) - number(b), "B")


def seconds_between(a: Column, b: Column) -> Column:
    return F.timestamp_diff("MICROSECOND", b, a) / F.lit(1_000_000.0)


def modulo(x: Column, y: Column) -> Column:
    """The remainder with the divisor's sign; 0 for divisor 0."""
    return F.when(y == 0, F.when(x.isNotNull(), F.lit(0.0))).otherwise(x - y * F.floor(F.try_divide(x, y)))


def frame_resolver(schema, names: dict[str, str] | None = None) -> Resolver:
    """Resolves the columns of one frame, whatever their case."""
    from dunlin.plans.values import kind_of

    by = {f.name.lower(): f for f in schema}

    def resolve(name: Name) -> Val | None:
        f = by.get((names or {}).get(name.name.lower(), name.name).lower())
        return None if f is None else Val(F.col(f"`{f.name}`"), kind_of(f.dataType))

    return resolve


def record_functions(recno: str = "__recno", deleted: str = "__deleted") -> dict:
    """RECNO() and DELETED() over a frame with these hidden columns."""
    return {"RECNO": lambda c, args: Val(F.col(recno), "I"), "DELETED": lambda c, args: Val(F.col(deleted), "L")}


def compile_on(df, expression: str, settings: Settings | None = None, functions: dict | None = None) -> Val:
    """An expression's text as a column of df; works on streaming frames as well."""
    return Compiler(frame_resolver(df.schema), settings or Settings(sql=False), functions).value(parse_expression(expression))


def query(df, filter_text: str, settings: Settings | None = None):
    """Rows that satisfy a filter text; none if it cannot be read."""
    settings = settings or Settings(sql=False)
    try:
        node = parse_expression(filter_text)
        cond = Compiler(frame_resolver(df.schema), settings, record_functions() if "__recno" in df.columns else None).condition(node)
    except DialectError:
        return df.where(F.lit(False))
    if "__deleted" in df.columns and settings.deleted:
        df = df.where(~F.col("__deleted"))
    return df.where(cond)


def count(df, filter_text: str, settings: Settings | None = None) -> int:
    return query(df, filter_text, settings).count()
