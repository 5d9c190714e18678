"""Sinks: CSV, and a schema as JSON, Markdown or SQL DDL."""

from __future__ import annotations

import json
import os

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dunlin.sources.store import HIDDEN

BOM = b"\xef\xbb\xbf"


def as_text(df: DataFrame) -> DataFrame:
    """Columns as CSV shows them: true/false, ISO dates and times, bytes and NULL empty."""
    cols = []
    for f in df.schema:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.BinaryType):
            c = F.lit(None).cast("string")
        elif isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType)):
            c = F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss")
        else:
            c = c.cast("string")
        cols.append(F.coalesce(c, F.lit("")).alias(f.name))
    return df.select(*cols)


def write_csv(df: DataFrame, path: str, separator: str = ",", header: bool = True, quote_all: bool = True) -> None:
    """A folder of part files, each with the header; as many as df has partitions."""
    out = as_text(df.drop(*HIDDEN))
    out.write.mode("overwrite").option("sep", separator).option("header", header).option("quoteAll", quote_all).option("escape", '"').option("emptyValue", "").csv(path)


def export_csv(df: DataFrame, path: str, separator: str = ",", header: bool = True, quote_all: bool = True, bom: bool = True) -> int:
    """One local file with CRLF line ends, rows as they come from the executors; the count of rows."""

    def cell(v: str) -> str:
        if quote_all or any(c in v for c in (separator, '"', "\r", "\n")):
            return '"' + v.replace('"', '""') + '"'
        return v

    shown, n = as_text(df.drop(*HIDDEN)), 0
    with open(path, "wb") as f:
        if bom:
            f.write(BOM)
        if header:
            f.write((separator.join(map(cell, shown.columns)) + "\r\n").encode())
        for row in shown.toLocalIterator(prefetchPartitions=True):
            f.write((separator.join(map(cell, row)) + "\r\n").encode())
            n += 1
    return n


def export_all(session, folder: str) -> list[str]:
    os.makedirs(folder, exist_ok=True)
    out = []
    for name in session.tables():
        export_csv(session.table(name), f"{folder}/{name}.csv")
        out.append(f"{folder}/{name}.csv")
    return out


def described(schema: T.StructType) -> list[dict]:
    """Name, type letter, length, decimals and nullability of each column."""
    out = []
    for f in schema:
        if f.name in HIDDEN:
            continue
        t, m = f.dataType, f.metadata
        kind, length, decimals = "C", 254, 0
        if isinstance(t, T.DecimalType):
            kind, length, decimals = "N", t.precision, t.scale
        elif isinstance(t, (T.IntegerType, T.ShortType, T.ByteType)):
            kind, length = "I", 4
        elif isinstance(t, T.LongType):
            kind, length = "N", 20
        elif isinstance(t, (T.DoubleType, T.FloatType)):
            kind, length = "B", 8
        elif isinstance(t, T.DateType):
            kind, length = "D", 8
        elif isinstance(t, (T.TimestampType, T.TimestampNTZType)):
            kind, length = "T", 8
        elif isinstance(t, T.BooleanType):
            kind, length = "L", 1
        elif isinstance(t, T.BinaryType):
            kind, length = "W", 4
        out.append({"name": f.name, "type": m.get("type", kind), "length": m.get("length") or length, "decimals": m.get("decimals") or decimals, "nullable": m.get("nullable", f.nullable)})
    return out


def schema_json(name: str, schema: T.StructType) -> str:
    return json.dumps({"table": name, "columns": described(schema)}, indent=2)


def schema_markdown(name: str, schema: T.StructType) -> str:
    lines = [f"## {name}", "", "| column | type | length | decimals | nullable |", "|---|---|---|---|---|"]
    return "\n".join(lines + [f"| {c['name']} | {c['type']} | {c['length']} | {c['decimals']} | {'yes' if c['nullable'] else 'no'} |" for c in described(schema)])


def schema_ddl(name: str, schema: T.StructType) -> str:
    def column(c: dict) -> str:
        size = f"({c['length']},{c['decimals']})" if c["type"] in "NF" else f"({c['length']})" if c["type"] in "CV" else ""
        return f"    {c['name']} {c['type']}{size} {'NULL' if c['nullable'] else 'NOT NULL'}"

    return f"CREATE TABLE {name} (\n" + ",\n".join(map(column, described(schema))) + "\n)"
