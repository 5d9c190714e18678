"""Comparison by the session's rules: prefix equality, exactness and collation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from dunlin.plans.values import NUMERIC, TEMPORAL, Val, any_null, number, stamp
from dunlin.settings import Settings

# Letters with marks, the letters they stand for, and their marks by kind.
MARKED = "ÀÁÂÃÄÅÇÈÉÊËÌÍÎÏÑÒÓÔÕÖØÙÚÛÜÝŸŠŽ"
PLAIN = "AAAAAACEEEEIIIINOOOOOOUUUUYYSZ"
MARKS = "123456712351235412345812356556"[: len(MARKED)]


def general_head(c: Column) -> Column:
    """The letters of a text, folded: case, marks and joined letters."""
    s = F.upper(F.replace(F.rtrim(c), F.lit("ß"), F.lit("ss")))
    for a, b in (("Æ", "AE"), ("Œ", "OE"), ("Þ", "TH")):
        s = F.replace(s, F.lit(a), F.lit(b))
    return F.translate(s, MARKED, PLAIN)


def general_key(c: Column) -> Column:
    """Head and, behind a separator, the marks; equal keys mean equal texts."""
    up = F.upper(F.replace(F.rtrim(c), F.lit("ß"), F.lit("ss")))
    marks = F.rtrim(F.regexp_replace(F.translate(up, MARKED, MARKS), "[^1-8]", " "))
    tail = F.when(F.translate(up, MARKED, PLAIN) == up, F.lit("")).otherwise(marks)
    return F.concat(general_head(c), F.lit("\u0000"), tail)


def sort_key(v: Val, settings: Settings) -> Column:
    return general_key(v.col) if v.kind == "C" and settings.collate == "GENERAL" else v.col


def strings_equal(a: Val, b: Val, settings: Settings, exact: bool = False) -> Column:
    """Equality of two texts: `==`, or `=` by EXACT in expressions and by ANSI in SQL."""
    general = settings.collate == "GENERAL"
    x, y = a.col, b.col
    if exact:
        return general_key(x) == general_key(y) if general else x == y
    if settings.ansi if settings.sql else settings.exact:
        return general_key(x) == general_key(y) if general else F.rtrim(x) == F.rtrim(y)
    if general:
        x, y = general_head(x), general_head(y)
    if not settings.sql:
        return F.startswith(x, y)
    both = F.startswith(x, y) | F.startswith(y, x)
    if not general:
        # a constant's first letter lets the reader skip row groups
        for const, other in ((a, b), (b, a)):
            if const.is_lit and const.lit:
                first = const.lit[0]
                return both & ((other.col == "") | ((other.col >= first) & (other.col < first + chr(0x10FFFF))))
    return both


def equal(a: Val, b: Val, settings: Settings, exact: bool = False) -> Column:
    if a.kind == "X" or b.kind == "X":
        return F.lit(None).cast("boolean")
    if a.kind == "C" and b.kind == "C":
        return strings_equal(a, b, settings, exact)
    if a.kind in NUMERIC and b.kind in NUMERIC:
        return a.col == b.col if a.kind == b.kind else number(a) == number(b)
    if a.kind in TEMPORAL and b.kind in TEMPORAL:
        return a.col == b.col if a.kind == b.kind else stamp(a) == stamp(b)
    if a.kind == b.kind:
        return a.col == b.col
    return unlike(a, b)


def unlike(a: Val, b: Val) -> Column:
    """False, or NULL if a side is: what comparing different kinds gives."""
    cond = any_null(a, b)
    return F.lit(False) if cond is None else F.when(~cond, F.lit(False))


def ordered(op: str, a: Val, b: Val, settings: Settings) -> Column:
    if a.kind == "X" or b.kind == "X":
        return F.lit(None).cast("boolean")
    if a.kind == "C" and b.kind == "C":
        x, y = sort_key(a, settings), sort_key(b, settings)
    elif a.kind in NUMERIC and a.kind == b.kind or a.kind == b.kind:
        x, y = a.col, b.col
    elif a.kind in TEMPORAL and b.kind in TEMPORAL:
        x, y = stamp(a), stamp(b)
    else:
        x, y = number(a), number(b)
    return {"<": x < y, "<=": x <= y, ">": x > y, ">=": x >= y}[op]
