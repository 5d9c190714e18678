"""Typed columns: what the compiler carries for each expression."""

from __future__ import annotations

import datetime as dt
import decimal
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dunlin.lang.expr import EMPTY_DATE

#: Kinds: C text, N decimal, I integer, B double, Y currency, D date, T datetime, L logical, Q bytes, X null.
NUMERIC = frozenset("NIBYF")
TEMPORAL = frozenset("DT")


@dataclass
class Val:
    col: Column
    kind: str
    lit: object = None
    is_lit: bool = False


def kind_of(t: T.DataType) -> str:
    if isinstance(t, (T.StringType, T.VarcharType, T.CharType)):
        return "C"
    if isinstance(t, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return "I"
    if isinstance(t, T.DecimalType):
        return "N"
    if isinstance(t, (T.FloatType, T.DoubleType)):
        return "B"
    if isinstance(t, T.DateType):
        return "D"
    if isinstance(t, (T.TimestampType, T.TimestampNTZType)):
        return "T"
    if isinstance(t, T.BooleanType):
        return "L"
    if isinstance(t, T.BinaryType):
        return "Q"
    return "X"


def literal(value: object) -> Val:
    if value is None:
        return Val(F.lit(None), "X", None, True)
    if isinstance(value, bool):
        return Val(F.lit(value), "L", value, True)
    if isinstance(value, int):
        return Val(F.lit(value), "I", value, True)
    if isinstance(value, decimal.Decimal):
        return Val(F.lit(value), "N", value, True)
    if isinstance(value, float):
        return Val(F.lit(value), "B", value, True)
    if isinstance(value, dt.datetime):
        return Val(F.lit(value.strftime("%Y-%m-%d %H:%M:%S")).cast("timestamp_ntz"), "T", value, True)
    if isinstance(value, dt.date):
        return Val(F.lit(f"{value.year:04d}-{value.month:02d}-{value.day:02d}").cast("date"), "D", value, True)
    if isinstance(value, (bytes, bytearray)):
        return Val(F.lit(bytes(value)), "Q", value, True)
    return Val(F.lit(str(value)), "C", str(value), True)


def null(kind: str = "X") -> Val:
    types = {"C": "string", "I": "int", "B": "double", "D": "date", "T": "timestamp_ntz", "L": "boolean", "Q": "binary", "N": "double", "Y": "decimal(19,4)"}
    return Val(F.lit(None).cast(types[kind]) if kind in types else F.lit(None), kind)


def number(v: Val) -> Column:
    """As a double, which arithmetic uses."""
    if v.kind == "B":
        return v.col
    if v.kind in NUMERIC:
        return v.col.cast("double")
    if v.kind == "L":
        return v.col.cast("int").cast("double")
    if v.kind == "X":
        return v.col.cast("double")
    return F.when(v.col.isNotNull(), F.lit(0.0))


def text(v: Val) -> Column:
    return v.col if v.kind == "C" else v.col.cast("string") if v.kind == "X" else F.when(v.col.isNotNull(), F.lit(""))


def whole(v: Val) -> Column:
    """As an int, cut towards zero."""
    return v.col.cast("int") if v.kind == "I" else number(v).cast("int")


def stamp(v: Val) -> Column:
    return v.col if v.kind == "T" else v.col.cast("timestamp_ntz")


def empty_date() -> Column:
    return F.lit(f"{EMPTY_DATE.year:04d}-01-01").cast("date")


def any_null(*vals: Val) -> Column | None:
    """Whether one of the values is null; None if none can be."""
    out = None
    for v in vals:
        if v.is_lit and v.lit is not None:
            continue
        c = v.col.isNull()
        out = c if out is None else out | c
    return out


def guarded(result: Column, *vals: Val) -> Column:
    """NULL if one of the values is, else result."""
    cond = any_null(*vals)
    return result if cond is None else F.when(~cond, result)
