"""SELECT to a DataFrame: sources, joins, subqueries, grouping, order, TOP and UNION."""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dunlin.lang import sql as S
from dunlin.lang.expr import Binary, Call, Lit, Name, Node, Unary, children, walk
from dunlin.plans import compare
from dunlin.plans.compile import Compiler
from dunlin.plans.values import Val, kind_of
from dunlin.settings import DialectError, Settings
from dunlin.sources.store import DELETED, HIDDEN, RECNO, numbered

AGGREGATES = frozenset(("COUNT", "SUM", "AVG", "MIN", "MAX"))
#: Rows of TOP up to which its order keys are sent to all executors.
SMALL_TOP = 10_000


@dataclass
class Scope:
    """The sources of a query: their columns under unique names, and the query around it."""

    sources: dict[str, dict[str, tuple[str, str, str]]] = field(default_factory=dict)  # alias -> column -> (name, kind, as written)
    outer: Scope | None = None
    records: dict[str, tuple[str, str, str]] = field(default_factory=dict)  # alias -> record number, deletion mark, table
    numbers: bool = False  # whether record numbers are asked for

    def find(self, name: Name) -> tuple[str, str] | None:
        low = name.name.lower()
        if name.qualifier:
            cols = self.sources.get(name.qualifier.lower())
            return cols[low][:2] if cols and low in cols else None
        hits = [cols[low][:2] for cols in self.sources.values() if low in cols]
        if len(hits) > 1:
            raise DialectError(f"column {name.name} is ambiguous", 1832)
        return hits[0] if hits else None

    def resolve(self, name: Name) -> Val | None:
        found = self.find(name)
        if found:
            return Val(F.col(found[0]), found[1])
        if name.qualifier and self.outer:  # a bare name never reaches out
            up = self.outer.find(name)
            if up:
                return Val(F.col(up[0]).outer(), up[1])
        return None


def expressions(q: S.Select) -> list[Node]:
    """The expressions of a query, without those of its subqueries."""
    found = [*(i.expr for i in q.items), q.where, *q.group, q.having, *(o.expr for o in q.order), *(j.on for j in q.joins)]
    return [e for e in found if isinstance(e, Node) and not isinstance(e, S.Star)]


class Planner:
    """Plans one session's queries; `tables` gives a name's frame, with hidden columns if the table has them."""

    def __init__(self, tables, settings: Settings, functions: dict | None = None):
        self.tables, self.settings, self.functions, self.count = tables, settings, functions or {}, 0

    # -- sources

    def source(self, src: S.Source, scope: Scope) -> DataFrame:
        if src.alias.lower() in scope.sources:
            raise DialectError(f"alias {src.alias} is used twice", 24)
        df = self.tables(src.table)
        if scope.numbers and RECNO not in df.columns:
            df = numbered(df).withColumn(DELETED, F.lit(False))
        if DELETED in df.columns and self.settings.deleted:
            df = df.where(~F.col(DELETED))
        self.count += 1
        prefix = f"q{self.count}_"
        cols = {f.name.lower(): (f"{prefix}{k}", kind_of(f.dataType), f.name) for k, f in enumerate(f for f in df.schema if f.name not in HIDDEN)}
        scope.sources[src.alias.lower()] = cols
        visible = [F.col(f"`{written}`").alias(name) for name, _, written in cols.values()]
        if RECNO in df.columns:
            hidden = [F.col(RECNO).alias(prefix + RECNO), F.col(DELETED).alias(prefix + DELETED)]
            scope.records[src.alias.lower()] = (prefix + RECNO, prefix + DELETED, src.table)
            return df.select(*visible, *hidden)
        return df.select(*visible)

    def with_order(self, df: DataFrame) -> tuple[DataFrame, Column]:
        """df with the place of every row in scan order."""
        own = [c for c in df.columns if c.endswith(RECNO)]
        if own:
            return df, F.struct(*(F.col(c) for c in own))
        return df.withColumn("__scan", F.monotonically_increasing_id()), F.col("__scan")

    def compiler(self, scope: Scope, special=None) -> Compiler:
        return Compiler(scope.resolve, self.settings, self.known(scope), special or self.subqueries(scope))

    def known(self, scope: Scope) -> dict:
        """The session's functions, and those of records: of the first source, or of the one named."""

        def of(which: int, kind: str):
            def make(_, args: list[Val]) -> Val:
                alias = str(args[0].lit).lower() if args and args[0].is_lit else next(iter(scope.records), None)
                if alias not in scope.records:
                    return Val(F.lit(None).cast("long" if kind == "I" else "boolean"), kind)
                if which == 2:
                    return Val(self.tables(scope.records[alias][2]).agg(F.count("*").alias("n")).scalar(), "I")
                return Val(F.col(scope.records[alias][which]), kind)

            return make

        return {"RECNO": of(0, "I"), "DELETED": of(1, "L"), "RECCOUNT": of(2, "I"), **self.functions}

    # -- subqueries

    def subqueries(self, scope: Scope, sure: bool = False):
        """Subqueries of a condition as columns; if sure, an unknown membership is false."""

        def special(node: Node) -> Val | None:
            if isinstance(node, S.Exists):
                inner, _ = self.inner(node.query, scope)
                found = inner.exists()
                return Val(~found if node.negated else found, "L")
            if isinstance(node, S.In):
                x = Compiler(scope.resolve, self.settings, self.known(scope), special).value(node.arg)
                inner, val = self.inner(node.query, scope)
                held = inner.select(val.col.alias("__member")).where("__member is not null")
                hit = held.where(compare.equal(Val(outer_of(x.col, scope, node.arg, self, special), x.kind), Val(F.col("__member"), val.kind), self.settings)).exists()
                hit = ~hit if node.negated else hit
                return Val(x.col.isNotNull() & hit if sure else F.when(x.col.isNotNull(), hit), "L")
            if isinstance(node, S.Compare):
                x = Compiler(scope.resolve, self.settings, self.known(scope), special).value(node.arg)
                inner, val = self.inner(node.query, scope)
                y = Val(inner.select(val.col.alias("__value")).scalar(), val.kind)
                if node.op in ("=", "==", "<>"):
                    eq = compare.equal(x, y, self.settings, node.op == "==")
                    return Val(~eq if node.op == "<>" else eq, "L")
                return Val(compare.ordered(node.op, x, y, self.settings), "L")
            return None

        return special

    def inner(self, q: S.Select, outer: Scope) -> tuple[DataFrame, Val]:
        """A subquery's frame, and its first column; names of the outer query become outer references."""
        scope = Scope(outer=outer)
        df = self.rows(q, scope)
        exprs = [i.expr for i in q.items]
        first = exprs[0]
        if isinstance(first, S.Star):
            cols = next(iter(scope.sources.values()))
            name, kind, _ = next(iter(cols.values()))
            return df, Val(F.col(name), kind)
        if q.group or any(aggregates(e) for e in exprs):
            out = self.grouped(q, df, scope)
            name, kind = self._outputs[0]
            return out, Val(F.col(f"`{name}`"), kind)
        v = self.compiler(scope).value(first)
        if q.top is not None or q.distinct:
            out = self.plain(q, df, scope)
            return out, Val(F.col(f"`{out.columns[0]}`"), v.kind)
        return df, v

    # -- rows before projection

    def rows(self, q: S.Select, scope: Scope) -> DataFrame:
        scope.numbers = any(isinstance(n, Call) and n.name in ("RECNO", "DELETED", "RECCOUNT") for e in expressions(q) for n in walk(e))
        df = self.source(q.sources[0], scope)
        for src in q.sources[1:]:
            df = df.crossJoin(self.source(src, scope))
        for j in q.joins:
            right = self.source(j.source, scope)
            comp = Compiler(scope.resolve, self.settings, self.known(scope))
            cond, pair = comp.condition(j.on), self.prefixes(j, df, right, scope, comp)
            df = prefix_join(df, right, *pair).where(cond) if pair else df.join(right, cond, {"full": "full_outer"}.get(j.kind, j.kind))
        for part in conjuncts(q.where):
            df = df.where(self.member(part, scope) if isinstance(part, S.In) else self.compiler(scope).condition(part))
        return df

    def prefixes(self, j: S.Join, df: DataFrame, right: DataFrame, scope: Scope, comp: Compiler) -> tuple[Column, Column] | None:
        """The two sides of a prefix equality that an inner join has for its only key; None if another part can be hashed."""

        def side(node: Node) -> DataFrame | None:
            found = [scope.find(n) for n in walk(node) if isinstance(n, Name)]
            if not found or None in found or not all(isinstance(n, (Name, Lit, Call, Unary, Binary)) for n in walk(node)):
                return None
            return next((d for d in (df, right) if all(c in d.columns for c, _ in found)), None)

        pair = None
        for part in conjuncts(j.on):
            if not isinstance(part, Binary) or part.op not in ("=", "=="):
                continue
            sides = side(part.left), side(part.right)
            if None in sides or sides[0] is sides[1]:
                continue
            x, y = comp.value(part.left), comp.value(part.right)
            if part.op == "==" or x.kind != "C" or y.kind != "C" or self.settings.ansi or not self.settings.sql:
                return None
            x, y = (compare.general_head(v.col) if self.settings.collate == "GENERAL" else v.col for v in (x, y))
            pair = pair or ((x, y) if sides[0] is df else (y, x))
        return pair if j.kind == "inner" else None

    def member(self, node: S.In, scope: Scope) -> Column:
        """IN as a condition of its own: unknown counts as false, which makes it a plain semi or anti join."""
        found = self.subqueries(scope, sure=True)(node)
        return found.col

    # -- output

    def names(self, items: list[tuple[Node, str | None, str | None]], several: bool) -> list[str]:
        """Output names: alias, field name, aggregate's name, or EXP_n; repeated ones of joins get their source's."""
        out, n = [], 0
        for e, alias, source in items:
            if alias:
                name = alias
            elif isinstance(e, Name):
                name = e.name
            elif isinstance(e, Call) and e.name in AGGREGATES and len(e.args) == 1:
                name = e.name
            else:
                n += 1
                name = f"EXP_{n}"
            out.append(name)
        if not several:
            return out
        seen: dict[str, int] = {}
        final = []
        for name, (e, alias, source) in zip(out, items):
            if name.lower() in seen and not alias and isinstance(e, Name):
                name = f"{(e.qualifier or source or 'EXP').upper()}_{name}" if f"{(e.qualifier or source or 'EXP')}_{name}".lower() not in seen else name
            base, k = name, 2
            while name.lower() in seen:
                name, k = f"{base}_{k}", k + 1
            seen[name.lower()] = 1
            final.append(name)
        return final

    def expand(self, q: S.Select, scope: Scope) -> list[tuple[Node, str | None, str | None]]:
        out: list[tuple[Node, str | None, str | None]] = []
        for item in q.items:
            if isinstance(item.expr, S.Star):
                if item.expr.qualifier and item.expr.qualifier.lower() not in scope.sources:
                    raise DialectError(f"alias {item.expr.qualifier} is not found", 13)
                for alias, cols in scope.sources.items():
                    if not item.expr.qualifier or item.expr.qualifier.lower() == alias:
                        out += [(Name(written, alias), None, alias) for _, _, written in cols.values()]
            else:
                out.append((item.expr, item.alias, None))
        return out

    def plan(self, q: S.Select) -> DataFrame:
        return self.union(q) if q.union is not None else self.single(q)

    def single(self, q: S.Select) -> DataFrame:
        scope = Scope()
        df = self.rows(q, scope)
        if q.group or any(not isinstance(i.expr, S.Star) and aggregates(i.expr) for i in q.items):
            return self.finish(q, self.grouped(q, df, scope), ordered_by_output=True)
        return self.plain(q, df, scope)

    def plain(self, q: S.Select, df: DataFrame, scope: Scope) -> DataFrame:
        items = self.expand(q, scope)
        names = self.names(items, len(scope.sources) > 1)
        comp = self.compiler(scope)
        cols = [comp.value(e).col.alias(n) for (e, _, _), n in zip(items, names)]
        keys: list[tuple[Column, bool]] = []
        for o in q.order:
            if isinstance(o.expr, Lit) and isinstance(o.expr.value, int) and 1 <= o.expr.value <= len(items):
                v = comp.value(items[o.expr.value - 1][0])
            else:
                v = comp.value(self.aliased(o.expr, items, scope))
            keys.append((compare.sort_key(v, self.settings), o.desc))
        if not keys and q.top is None and not q.distinct:
            return df.select(*cols)
        # equal keys keep scan order, and TOP without keys takes it
        needs_scan = not q.distinct and scope.outer is None or q.top is not None and (not keys or q.percent)
        if needs_scan:
            df, place = self.with_order(df)
            cols_extra = [place.alias("__place")]
        else:
            cols_extra = []
        key_names = [f"__k{k}" for k in range(len(keys))]
        out = df.select(*cols, *(k.alias(n) for (k, _), n in zip(keys, key_names)), *cols_extra)
        return self.shaped(q, out, names, key_names, [d for _, d in keys], needs_scan)

    @staticmethod
    def aliased(e: Node, items: list[tuple[Node, str | None, str | None]], scope: Scope) -> Node:
        """The item that a name in ORDER BY stands for, if it is an alias and no column."""
        if isinstance(e, Name) and not e.qualifier and scope.find(e) is None:
            return next((x for x, alias, _ in items if alias and alias.lower() == e.name.lower()), e)
        return e

    def shaped(self, q: S.Select, out: DataFrame, names: list[str], keys: list[str], desc: list[bool], scan: bool) -> DataFrame:
        """DISTINCT, ORDER BY and TOP over columns and their order keys."""
        if q.distinct:
            group = [self.general(out, n) for n in names]
            best = [(F.max if d else F.min)(k).alias(k) for k, d in zip(keys, desc)]
            more = [F.min("__place").alias("__place")] if scan else []
            plain_names = [f"__g{i}" for i in range(len(names))]
            grouped = out.groupBy(*(g.alias(p) for g, p in zip(group, plain_names))).agg(*(F.first(f"`{n}`").alias(f"__o{i}") for i, n in enumerate(names)), *best, *more)
            out = grouped.select(*(F.col(f"__o{i}").alias(n) for i, n in enumerate(names)), *keys, *(["__place"] if scan else []))
        order = [F.col(k).desc_nulls_last() if d else F.col(k).asc_nulls_first() for k, d in zip(keys, desc)]
        tie = [F.col("__place")] if scan else []
        if q.top is None:
            return out.orderBy(*order, *tie).select(*(f"`{n}`" for n in names)) if order else out.select(*(f"`{n}`" for n in names))
        n = int(q.top) if not q.percent else None
        if q.percent:
            n = 0 if q.top <= 0 else math.ceil(min(q.top, 100) / 100 * out.count())
            return out.orderBy(*order, *tie).limit(n).select(*(f"`{x}`" for x in names))
        if not order:
            return out.orderBy(*tie).limit(max(n, 0)).select(*(f"`{x}`" for x in names))
        # ties of the last row stay: rows whose keys are among the first n rows' keys
        first = out.orderBy(*order).limit(max(n, 0)).select(*(F.col(k).alias(f"{k}_t") for k in keys)).distinct()
        if n <= SMALL_TOP:
            first = F.broadcast(first)
        cond = None
        for k in keys:
            c = F.col(k).eqNullSafe(F.col(f"{k}_t"))
            cond = c if cond is None else cond & c
        return out.join(first, cond, "left_semi").orderBy(*order, *tie).select(*(f"`{x}`" for x in names))

    def general(self, df: DataFrame, name: str) -> Column:
        c = F.col(f"`{name}`")
        return compare.general_key(c) if self.settings.collate == "GENERAL" and isinstance(df.schema[name].dataType, T.StringType) else c

    # -- grouping

    def grouped(self, q: S.Select, df: DataFrame, scope: Scope) -> DataFrame:
        if any(isinstance(i.expr, S.Star) for i in q.items):
            items = self.expand(q, scope)
        else:
            items = [(i.expr, i.alias, None) for i in q.items]
        names = self.names(items, len(scope.sources) > 1)
        base = self.compiler(scope)
        groups = [base.value(g) for g in q.group]
        group_cols = [compare.sort_key(v, self.settings) if self.settings.collate == "GENERAL" and v.kind == "C" else v.col for v in groups]
        texts = [shape(g) for g in q.group]
        general = self.settings.collate == "GENERAL"
        place: list[Column] = []
        aggs: dict[str, tuple[Column, str]] = {}

        def first_value(v: Val) -> Column:
            nonlocal df
            if not place:
                df, p = self.with_order(df)
                place.append(p)
            return F.min_by(v.col, place[0])

        def over(node: Node) -> Val | None:
            """Aggregates, grouping expressions and first members as columns of the grouped frame."""
            key = shape(node)
            if key in texts and not (general and groups[texts.index(key)].kind == "C"):
                return Val(F.col(f"__g{texts.index(key)}"), groups[texts.index(key)].kind)
            if isinstance(node, Call) and node.name in AGGREGATES and len(node.args) == 1:
                v = base.value(node.args[0])
                if key not in aggs:
                    aggs[key] = aggregate(node.name, v)
                return Val(F.col(f"__a{list(aggs).index(key)}"), aggs[key][1])
            if isinstance(node, Name):
                v = base.value(node)
                if key not in aggs:
                    aggs[key] = (first_value(v), v.kind)
                return Val(F.col(f"__a{list(aggs).index(key)}"), v.kind)
            return None

        comp = Compiler(lambda n: None, self.settings, self.functions, over)
        vals = [comp.value(e) for e, _, _ in items]
        cols = [v.col.alias(n) for v, n in zip(vals, names)]
        self._outputs = [(n, v.kind) for v, n in zip(vals, names)]
        having = comp.condition(q.having) if q.having is not None else None
        keys = []
        for o in q.order:
            target = None
            if isinstance(o.expr, Lit) and isinstance(o.expr.value, int) and 1 <= o.expr.value <= len(names):
                target = comp.value(items[o.expr.value - 1][0])
            elif isinstance(o.expr, Name) and o.expr.name.lower() in [n.lower() for n in names]:
                target = comp.value(items[[n.lower() for n in names].index(o.expr.name.lower())][0])
            keys.append((compare.sort_key(target or comp.value(o.expr), self.settings), o.desc))
        agg_cols = [c.alias(f"__a{k}") for k, (c, _) in enumerate(aggs.values())] or [F.count(F.lit(1)).alias("__n")]
        if groups:
            out = df.groupBy(*(c.alias(f"__g{k}") for k, c in enumerate(group_cols))).agg(*agg_cols)
        else:
            out = df.select(*agg_cols)  # not agg(), which would resolve outer references too early
        if having is not None:
            out = out.where(having)
        self._order_keys = [(f"__k{k}", d) for k, (_, d) in enumerate(keys)]
        return out.select(*cols, *(c.alias(f"__k{k}") for k, (c, _) in enumerate(keys)))

    def finish(self, q: S.Select, out: DataFrame, ordered_by_output: bool = True) -> DataFrame:
        keys = [k for k, _ in self._order_keys]
        names = [c for c in out.columns if c not in keys]
        scan = q.top is not None and (not keys or q.percent)
        if scan:
            out = out.withColumn("__place", F.monotonically_increasing_id())
        return self.shaped(q, out, names, keys, [d for _, d in self._order_keys], scan)

    # -- unions

    def union(self, q: S.Select) -> DataFrame:
        chain, node = [], q
        while node is not None:
            chain.append(node)
            node = node.union
        parts = []
        for s in chain:
            bare = S.Select(**{**s.__dict__, "union": None, "order": [], "top": None, "percent": False, "into": None})
            parts.append(self.single(bare))
        width = len(parts[0].columns)
        if any(len(p.columns) != width for p in parts):
            raise DialectError("the queries have different numbers of columns", 1851)
        out = parts[0]
        for s, p in zip(chain, parts[1:]):
            out = widened_union(out, p)
            if not s.union_all:
                out = self.distinct(out)
        last, first = chain[-1], chain[0]
        order = []
        for o in last.order:
            if isinstance(o.expr, Lit) and isinstance(o.expr.value, int) and 1 <= o.expr.value <= width:
                c = out.columns[o.expr.value - 1]
            elif isinstance(o.expr, Name) and o.expr.name.lower() in [x.lower() for x in out.columns]:
                c = out.columns[[x.lower() for x in out.columns].index(o.expr.name.lower())]
            else:
                raise DialectError("ORDER BY of a UNION takes column numbers or names", 1808)
            key = self.general(out, c)
            order.append(key.desc_nulls_last() if o.desc else key.asc_nulls_first())
        if first.top is None:
            return out.orderBy(*order) if order else out
        n = int(first.top) if not first.percent else (0 if first.top <= 0 else math.ceil(min(first.top, 100) / 100 * out.count()))
        return (out.orderBy(*order) if order else out).limit(max(n, 0))

    def distinct(self, df: DataFrame) -> DataFrame:
        if self.settings.collate != "GENERAL":
            return df.distinct()
        keys = [self.general(df, c).alias(f"__g{k}") for k, c in enumerate(df.columns)]
        out = df.groupBy(*keys).agg(*(F.first(f"`{c}`").alias(f"__o{k}") for k, c in enumerate(df.columns)))
        return out.select(*(F.col(f"__o{k}").alias(c) for k, c in enumerate(df.columns)))


def outer_of(col: Column, scope: Scope, node: Node, planner: Planner, special) -> Column:
    """An operand of the outer query, seen from inside its subquery."""

    def resolve(name: Name) -> Val | None:
        found = scope.find(name)
        if found:
            return Val(F.col(found[0]).outer(), found[1])
        return scope.resolve(name)

    return Compiler(resolve, planner.settings, planner.functions, special).value(node).col


def prefix_join(left: DataFrame, right: DataFrame, x: Column, y: Column) -> DataFrame:
    """Rows of which one text begins with the other, by hash: each side's beginnings meet the other side's whole texts.

    A pair is found in one of the two joins only, as equal texts count in the first. A row is dealt once for
    each of its beginnings, so the cost is the texts' length and not the product of the sides.
    """

    def beginnings(df: DataFrame, text: Column, least: int) -> DataFrame:
        most = F.length("__text") - least
        every = F.when(most >= 0, F.transform(F.sequence(F.lit(0), F.greatest(most, F.lit(0))), lambda k: F.substring(F.col("__text"), F.lit(1), k)))
        return df.withColumn("__text", text).withColumn("__key", F.explode(every)).drop("__text")

    a = left.withColumn("__whole", x).join(beginnings(right, y, 0), F.col("__whole") == F.col("__key"))
    b = beginnings(left, x, 1).join(right.withColumn("__whole", y), F.col("__whole") == F.col("__key"))
    return a.drop("__whole", "__key").unionByName(b.drop("__whole", "__key"))


def conjuncts(node: Node | None) -> list[Node]:
    """The parts of a condition that must all hold."""
    if node is None:
        return []
    if isinstance(node, Binary) and node.op == "AND":
        return conjuncts(node.left) + conjuncts(node.right)
    return [node]


def aggregates(node: Node) -> bool:
    return any(isinstance(n, Call) and n.name in AGGREGATES and len(n.args) == 1 for n in walk(node))


def aggregate(name: str, v: Val) -> tuple[Column, str]:
    if name == "COUNT":
        return F.count(v.col if v.kind != "X" else F.lit(None)), "I"
    if name in ("MIN", "MAX"):
        return (F.min if name == "MIN" else F.max)(v.col), v.kind
    x = v.col if v.kind in "NIY" else v.col.cast("double") if v.kind in "BFX" else F.lit(None).cast("double")
    if v.kind == "I":
        x = v.col.cast("decimal(20,0)")
    kind = "N" if v.kind in "NIY" else "B"
    if name == "SUM":
        return F.coalesce(F.sum(x), F.lit(0)), kind
    return F.avg(x), kind


def shape(node: Node) -> str:
    """A node's text for comparison, whatever the case of its names."""
    if isinstance(node, Name):
        return f"{(node.qualifier or '').lower()}.{node.name.lower()}"
    if isinstance(node, Lit):
        return f"{node.kind}:{node.value!r}"
    inside = ",".join(map(shape, children(node)))
    label = node.op if isinstance(node, (Unary, Binary)) else node.name if isinstance(node, Call) else type(node).__name__
    return f"{label}({inside})"


def widened(a: T.DataType, b: T.DataType) -> T.DataType:
    """The type of a UNION's column."""
    ka, kb = kind_of(a), kind_of(b)
    if a == b or kb == "X":
        return a
    if ka == "X":
        return b
    if ka in "NIB" and kb in "NIB":
        if ka == kb == "B":
            return T.DoubleType()
        if ka == kb == "I":
            return T.LongType()
        if "B" in (ka, kb):
            return T.DecimalType(38, 10)
        scale = max((x.scale for x in (a, b) if isinstance(x, T.DecimalType)), default=0)
        digits = max((x.precision - x.scale if isinstance(x, T.DecimalType) else 19) for x in (a, b))
        return T.DecimalType(min(digits + scale, 38), scale)
    if {ka, kb} == {"D", "T"}:
        return T.TimestampNTZType()
    if ka == kb:
        return a
    raise DialectError("the queries' columns have different types", 1851)


def widened_union(a: DataFrame, b: DataFrame) -> DataFrame:
    types = [widened(x.dataType, y.dataType) for x, y in zip(a.schema, b.schema)]
    left = a.select(*(F.col(f"`{f.name}`").cast(t).alias(f.name) for f, t in zip(a.schema, types)))
    names = [f"c{k}" for k in range(len(types))]
    right = b.toDF(*names).select(*(F.col(n).cast(t).alias(f.name) for n, f, t in zip(names, a.schema, types)))
    return left.union(right)


