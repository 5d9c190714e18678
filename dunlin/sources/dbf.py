"""Legacy table files as a data source: `spark.read.format("dbf")`.

A file is a header, column descriptors and fixed-width records; memo texts stand in a side file. A
partition is a range of records, of which only its own bytes are read, and gives Arrow batches. Options:
`path`, `encoding` (else from the header's code page), `includeDeleted`, `rowsPerPartition`.
Result columns are the file's, then `__recno` and `__deleted`.
"""

from __future__ import annotations

import datetime as dt
import decimal
import os
import struct
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from dunlin.settings import DialectError
from dunlin.sources.store import DELETED, RECNO

# Code page bytes of the header and their encodings.
PAGES = {
    0x01: "cp437", 0x02: "cp850", 0x03: "cp1252", 0x08: "cp865", 0x09: "cp437", 0x0A: "cp850", 0x0B: "cp437", 0x0D: "cp437", 0x0E: "cp850", 0x0F: "cp437", 0x10: "cp850", 0x11: "cp437", 0x12: "cp850", 0x13: "cp932",
    0x14: "cp850", 0x15: "cp437", 0x16: "cp850", 0x17: "cp865", 0x18: "cp437", 0x19: "cp437", 0x1A: "cp850", 0x1B: "cp437", 0x1C: "cp863", 0x1D: "cp850", 0x1F: "cp852", 0x22: "cp852", 0x23: "cp852", 0x24: "cp860",
    0x25: "cp850", 0x26: "cp866", 0x37: "cp850", 0x40: "cp852", 0x4D: "cp936", 0x4E: "cp949", 0x4F: "cp950", 0x50: "cp874", 0x57: "cp1252", 0x58: "cp1252", 0x59: "cp1252", 0x64: "cp852", 0x65: "cp866", 0x66: "cp865",
    0x67: "cp861", 0x6A: "cp737", 0x6B: "cp857", 0x6C: "cp863", 0x78: "cp950", 0x79: "cp949", 0x7A: "cp936", 0x7B: "cp932", 0x7C: "cp874", 0x7D: "cp1255", 0x7E: "cp1256", 0x86: "cp737", 0x87: "cp852", 0x88: "cp857",
    0xC8: "cp1250", 0xC9: "cp1251", 0xCA: "cp1254", 0xCB: "cp1253", 0xCC: "cp1257",
}
#: Versions whose columns carry flags.
FLAGGED = (0x30, 0x31, 0x32)
EPOCH = dt.date(1970, 1, 1).toordinal()
JULIAN = 1721425


@dataclass
class Column:
    name: str
    kind: str
    offset: int
    length: int
    decimals: int
    flags: int

    def field(self) -> T.StructField:
        binary = bool(self.flags & 4)
        t: T.DataType = T.BinaryType()
        if self.kind in "CV" or self.kind == "M" and not binary:
            t = T.StringType()
        elif self.kind == "N":
            t = T.LongType() if not self.decimals else T.DecimalType(min(max(self.length, self.decimals + 1), 38), self.decimals)
        elif self.kind in "FB":
            t = T.DoubleType()
        elif self.kind in "I+":
            t = T.IntegerType()
        elif self.kind == "Y":
            t = T.DecimalType(19, 4)
        elif self.kind == "D":
            t = T.DateType()
        elif self.kind in "T@":
            t = T.TimestampNTZType()
        elif self.kind == "L":
            t = T.BooleanType()
        return T.StructField(self.name, t, True, {"type": self.kind, "length": self.length, "decimals": self.decimals, "nullable": bool(self.flags & 2), "binary": binary})


@dataclass
class Header:
    version: int
    records: int
    start: int
    width: int
    encoding: str
    columns: list[Column]
    nulls: Column | None


def read_header(f, encoding: str | None = None) -> Header:
    f.seek(0, os.SEEK_END)
    size = f.tell()
    f.seek(0)
    head = f.read(32)
    if len(head) < 32:
        raise DialectError("not a table file", 15)
    version, records, start, width = head[0], *struct.unpack("<IHH", head[4:12])
    step = 48 if version & 7 == 4 and version != 0x8C else 32
    columns, nulls, offset = [], None, 1
    if step == 48:
        f.seek(68)
    while True:
        d = f.read(step)
        if len(d) < step or d[0] in (0x0D, 0x00):
            break
        if step == 48:
            name, kind, length, decimals, flags = d[:32], chr(d[32]), d[33], d[34], 0
        else:
            name, kind, length, decimals, flags = d[:11], chr(d[11]), d[16], d[17], d[18]
        if kind == "C" and decimals and version not in FLAGGED:
            length, decimals = length + 256 * decimals, 0
        c = Column(name.split(b"\0")[0].decode("latin-1").strip(), kind, offset, length, decimals, flags)
        offset += length
        if kind == "0" or flags & 1:
            nulls = c
        else:
            columns.append(c)
    if not columns or width < 1:
        raise DialectError("the header is damaged", 15)
    page = encoding or PAGES.get(head[29], "cp1252")
    there = max(size - start, 0) // width
    return Header(version, min(records, there), start, width, page, columns, nulls)


class Memo:
    """The side file of memo texts: blocks with a length (.fpt), or with a marked length or an end mark (.dbt)."""

    def __init__(self, path: str, version: int):
        base = os.path.splitext(path)[0]
        self.f = None
        for end in (".fpt", ".FPT", ".dbt", ".DBT"):
            if os.path.exists(base + end):
                self.f = open(base + end, "rb")
                self.sized = end.lower() == ".fpt"
                break
        self.version = version
        if self.f:
            head = self.f.read(32)
            self.block = struct.unpack(">H", head[6:8])[0] or 512 if self.sized else (struct.unpack("<H", head[20:22])[0] or 512 if version in (0x8B, 0xCB) else 512)

    def read(self, at: int) -> bytes | None:
        if not at or self.f is None:
            return None
        self.f.seek(at * self.block)
        if self.sized:
            head = self.f.read(8)
            return self.f.read(struct.unpack(">I", head[4:])[0]) if len(head) == 8 else None
        head = self.f.read(8)
        if head[:4] == b"\xff\xff\x08\x00":
            return self.f.read(max(struct.unpack("<I", head[4:])[0] - 8, 0))
        out = head
        while b"\x1a" not in out:
            more = self.f.read(512)
            if not more:
                break
            out += more
        return out.split(b"\x1a")[0]


def text(raw: bytes, encoding: str) -> str:
    raw = raw.strip(b"\0 \t\r\n\v\f")
    if not raw.isascii():
        try:
            return raw.decode("utf-8")
        except UnicodeDecodeError:
            pass
    return raw.decode(encoding, "replace")


def decode(c: Column, raw: bytes, encoding: str, memo: Memo | None):
    k = c.kind
    if k in "CV":
        return text(raw, encoding)
    if k in "NF":
        s = raw.decode("ascii", "ignore").strip().replace(",", ".")
        if not s:
            return None
        try:
            if k == "F":
                return float(s)
            return int(decimal.Decimal(s)) if not c.decimals else decimal.Decimal(s).quantize(decimal.Decimal(1).scaleb(-c.decimals))
        except (ArithmeticError, ValueError):
            return None
    if k in "I+":
        return struct.unpack("<i", raw)[0]
    if k == "Y":
        return decimal.Decimal(struct.unpack("<q", raw)[0]).scaleb(-4)
    if k == "B" and len(raw) == 8:
        return struct.unpack("<d", raw)[0]
    if k == "D":
        try:
            return dt.datetime.strptime(raw.decode("ascii", "ignore"), "%Y%m%d").date()
        except ValueError:
            return None
    if k in "T@":
        day, ms = struct.unpack("<ii", raw)
        if day <= 0:
            return None
        try:
            return dt.datetime.fromordinal(day - JULIAN + 1) + dt.timedelta(seconds=round(ms / 1000))
        except (ValueError, OverflowError):
            return None
    if k == "L":
        return raw in (b"Y", b"y", b"T", b"t")
    if k in "MWGP" or k == "B":
        at = struct.unpack("<I", raw)[0] if len(raw) == 4 else int(raw.decode("ascii", "ignore").strip() or 0)
        body = memo.read(at) if memo else None
        if body is None:
            return None
        return text(body, encoding) if k == "M" and not c.flags & 4 else body
    return bytes(raw)


@dataclass
class Records(InputPartition):
    first: int
    last: int

    def __init__(self, first: int, last: int):
        self.value, self.first, self.last = (first, last), first, last


def schema_of(path: str, encoding: str | None = None) -> T.StructType:
    with open(path, "rb") as f:
        h = read_header(f, encoding)
    return T.StructType([*(c.field() for c in h.columns), T.StructField(RECNO, T.LongType()), T.StructField(DELETED, T.BooleanType())])


class DbfReader(DataSourceReader):
    def __init__(self, path: str, options: dict, schema: T.StructType):
        self.path, self.encoding = path, options.get("encoding")
        self.deleted = str(options.get("includedeleted", "true")).lower() == "true"
        self.rows, self.wanted = int(options.get("rowsperpartition", 200_000)), schema

    def partitions(self) -> list[InputPartition]:
        with open(self.path, "rb") as f:
            n = read_header(f, self.encoding).records
        return [Records(a, min(a + self.rows, n)) for a in range(0, max(n, 1), self.rows)]

    def read(self, part: Records) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(self.wanted)
        with open(self.path, "rb") as f:
            h = read_header(f, self.encoding)
            memo = Memo(self.path, h.version)
            bits = null_bits(h)
            for a in range(part.first, part.last, 10_000):
                b = min(a + 10_000, part.last)
                f.seek(h.start + a * h.width)
                raw = f.read((b - a) * h.width)
                cols: list[list] = [[] for _ in arrow]
                for k in range(len(raw) // h.width):
                    rec = raw[k * h.width : (k + 1) * h.width]
                    gone = rec[:1] == b"*"
                    if gone and not self.deleted:
                        continue
                    flags = int.from_bytes(rec[h.nulls.offset : h.nulls.offset + h.nulls.length], "little") if h.nulls else 0
                    for j, c in enumerate(h.columns):
                        cell = rec[c.offset : c.offset + c.length]
                        isnull, varying = bits.get(c.name, (None, None))
                        if isnull is not None and flags >> isnull & 1:
                            cols[j].append(None)
                            continue
                        if varying is not None and flags >> varying & 1:
                            cell = cell[: cell[-1]]
                        cols[j].append(decode(c, cell, h.encoding, memo))
                    cols[-2].append(a + k + 1)
                    cols[-1].append(gone)
                yield pa.RecordBatch.from_arrays([pa.array(v, x.type) for v, x in zip(cols, arrow)], schema=arrow)


def null_bits(h: Header) -> dict[str, tuple[int | None, int | None]]:
    """Each column's bits in the system column: null, and shorter than its width."""
    out, bit = {}, 0
    for c in h.columns:
        varying = isnull = None
        if c.kind in "VQ":
            varying, bit = bit, bit + 1
        if c.flags & 2:
            isnull, bit = bit, bit + 1
        if varying is not None or isnull is not None:
            out[c.name] = (isnull, varying)
    return out


class DbfSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "dbf"

    def path(self) -> str:
        return self.options["path"].removeprefix("file://")

    def schema(self) -> T.StructType:
        return schema_of(self.path(), self.options.get("encoding"))

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return DbfReader(self.path(), dict(self.options), schema)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(DbfSource)


def open_dbf(spark: SparkSession, path: str, **options):
    register(spark)
    return spark.read.format("dbf").options(**options).load(path)


def write_dbf(path: str, columns: list[tuple[str, str, int, int]], rows: list[tuple], deleted: frozenset[int] = frozenset(), page: int = 0x03) -> None:
    """A small table file from Python values; (name, kind, length, decimals) each. Memo texts go to the side file."""
    width = 1 + sum(c[2] for c in columns)
    memos: list[bytes] = []
    with open(path, "wb") as f:
        f.write(struct.pack("<BBBBIHH", 0x30, 24, 1, 1, len(rows), 32 + 32 * len(columns) + 1, width) + bytes(17) + bytes([page, 0, 0]))
        for name, kind, length, decimals in columns:
            f.write(name.encode("latin-1")[:10].ljust(11, b"\0") + kind.encode() + bytes(4) + bytes([length, decimals]) + bytes(14))
        f.write(b"\x0d")
        for n, row in enumerate(rows):
            f.write(b"*" if n in deleted else b" ")
            for (_, kind, length, decimals), v in zip(columns, row):
                f.write(encode(kind, length, decimals, v, memos))
        f.write(b"\x1a")
    if memos:
        with open(os.path.splitext(path)[0] + ".fpt", "wb") as f:
            f.write(struct.pack(">IHH", 0, 0, 64).ljust(512, b"\0"))
            for m in memos:
                f.write((struct.pack(">II", 1, len(m)) + m).ljust(-(-(8 + len(m)) // 64) * 64, b"\0"))


def encode(kind: str, length: int, decimals: int, v, memos: list[bytes]) -> bytes:
    if kind == "M":
        if v is None:
            return bytes(4)
        at = 8 + sum(-(-(8 + len(m)) // 64) for m in memos)
        memos.append(v.encode("cp1252", "replace"))
        return struct.pack("<I", at)
    if kind == "T":
        return struct.pack("<ii", v.toordinal() + JULIAN - 1, ((v.hour * 60 + v.minute) * 60 + v.second) * 1000) if v else bytes(8)
    if kind == "I":
        return struct.pack("<i", v or 0)
    if kind == "Y":
        return struct.pack("<q", int(decimal.Decimal(str(v or 0)) * 10000))
    if kind == "B":
        return struct.pack("<d", v or 0.0)
    if v is None:
        return b" " * length
    if kind == "D":
        return v.strftime("%Y%m%d").encode()
    if kind == "L":
        return b"T" if v else b"F"
    if kind in "NF":
        return f"{v:.{decimals}f}".rjust(length)[:length].encode()
    return str(v).encode("cp1252", "replace")[:length].ljust(length)
