"""Column statistics, estimates from them, plan reports and constraint checks."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dunlin.lang.expr import Binary, Call, Lit, Name, Node, Unary, parse_expression
from dunlin.plans.compile import Compiler, frame_resolver
from dunlin.settings import Settings
from dunlin.sources.store import HIDDEN

BUCKETS = TOP_VALUES = 16
UNKNOWN = 0.33


@dataclass
class ColumnStats:
    distinct: int
    nulls: int
    low: object
    high: object
    bounds: list
    common: dict


def analyze(df: DataFrame, columns: list[str] | None = None, exact: bool = False) -> tuple[int, dict[str, ColumnStats]]:
    """Rows, and of each column: distinct values, NULLs, least, largest, histogram bounds and most common values.

    One pass for all of the first; the most common values take one aggregation a column.
    """
    fields = [f for f in df.schema if f.name not in HIDDEN and (columns is None or f.name.lower() in [c.lower() for c in columns])]
    aggs = [F.count(F.lit(1)).alias("n")]
    for k, f in enumerate(fields):
        c = F.col(f"`{f.name}`")
        aggs += [(F.count_distinct(c) if exact else F.approx_count_distinct(c)).alias(f"d{k}"), F.sum(c.isNull().cast("long")).alias(f"u{k}"), F.min(c).alias(f"a{k}"), F.max(c).alias(f"b{k}")]
        if isinstance(f.dataType, T.NumericType):
            aggs.append(F.percentile_approx(c.cast("double"), [x / BUCKETS for x in range(BUCKETS + 1)]).alias(f"h{k}"))
    row = df.agg(*aggs).first()
    out = {}
    for k, f in enumerate(fields):
        common = {r[0]: r[1] for r in df.where(F.col(f"`{f.name}`").isNotNull()).groupBy(f"`{f.name}`").count().orderBy(F.desc("count"), F.col(f"`{f.name}`")).limit(TOP_VALUES).collect()}
        out[f.name.lower()] = ColumnStats(row[f"d{k}"], row[f"u{k}"] or 0, row[f"a{k}"], row[f"b{k}"], row[f"h{k}"] if f"h{k}" in row else [], common)
    return row.n, out


def selectivity(node: Node, rows: int, stats: dict[str, ColumnStats]) -> float:
    """The share of rows a condition keeps: histogram and common values for leaves; AND multiplies, OR adds."""
    if isinstance(node, Binary) and node.op in ("AND", "OR"):
        a, b = (selectivity(x, rows, stats) for x in (node.left, node.right))
        return a * b if node.op == "AND" else a + b - a * b
    if isinstance(node, Unary) and node.op == "NOT":
        return 1 - selectivity(node.arg, rows, stats)
    if isinstance(node, Call) and node.name == "BETWEEN" and len(node.args) == 3:
        low, high = (Binary(op, node.args[0], x) for op, x in ((">=", node.args[1]), ("<=", node.args[2])))
        return max(selectivity(low, rows, stats) + selectivity(high, rows, stats) - 1, 0.0)
    if isinstance(node, Call) and node.name == "INLIST":
        return min(sum(selectivity(Binary("=", node.args[0], x), rows, stats) for x in node.args[1:]), 1.0)
    if not (isinstance(node, Binary) and isinstance(node.left, Name) and isinstance(node.right, Lit)):
        return UNKNOWN
    s, v = stats.get(node.left.name.lower()), node.right.value
    if s is None or not rows or v is None:
        return UNKNOWN
    filled = 1 - s.nulls / rows
    try:
        if node.op in ("=", "=="):
            if s.low is None or v < s.low or v > s.high:
                return 0.0
            return s.common[v] / rows if v in s.common else filled / max(s.distinct, 1)
        if node.op == "<>":
            return filled - selectivity(Binary("=", node.left, node.right), rows, stats)
        if s.bounds:
            below = sum(b < v for b in s.bounds) / len(s.bounds)
        elif isinstance(v, str) or s.low is None:
            return UNKNOWN
        else:
            below = min(max((v - s.low) / ((s.high - s.low) or 1), 0), 1)
    except TypeError:
        return UNKNOWN
    return filled * (below if node.op in ("<", "<=") else 1 - below)


def estimate_rows(condition: str, rows: int, stats: dict[str, ColumnStats]) -> float:
    return rows * selectivity(parse_expression(condition), rows, stats)


def explain(df: DataFrame) -> dict[str, object]:
    """The plan's text, the filters that reach the files, and the columns read."""
    text = df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    return {
        "plan": text,
        "pushed": [x for m in re.findall(r"PushedFilters: \[([^\]]*)\]", text) for x in m.split(", ") if x],
        "columns": re.findall(r"ReadSchema: struct<([^>]*)>", text),
    }


# -- constraints


def orphans(child: DataFrame, key: str, parent: DataFrame, parent_key: str) -> DataFrame:
    """Rows whose key is not NULL and in no row of the parent."""
    return child.where(F.col(key).isNotNull()).join(parent.select(F.col(parent_key).alias("__parent")).distinct(), F.col(key) == F.col("__parent"), "left_anti")


def repeated(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).count().where("count > 1")


def broken(df: DataFrame, rule: str, settings: Settings | None = None) -> DataFrame:
    """Rows for which a rule's text is not true."""
    cond = Compiler(frame_resolver(df.schema), settings or Settings(sql=False)).condition(parse_expression(rule))
    return df.where(~F.coalesce(cond, F.lit(False)))
