"""Shared helpers: scratch tables in the cluster's shared folder, vectorised text hashing, components."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text handled at once by the vectorised helpers; bounds a Python worker's memory.
CHUNK_BYTES = 4 << 20

_R = np.uint64(0x9E3779B97F4A7C15 | 1)
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: For words of letters and digits only: all other ASCII separates.
PUNCTUATION = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir of the session.

    Only where that is unset (tests on one machine) a temporary folder is made and set.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        base = "file://" + tempfile.mkdtemp(prefix="dunlin-")
        spark.sparkContext.setCheckpointDir(base)
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/dunlin/{name}-{uuid.uuid4().hex[:12]}"


#: Rows that Spark hands to a Python worker at once, where a row may hold a long text.
BATCH_ROWS = 500


def bounded_batches(spark: SparkSession) -> None:
    """Lowers the session's Arrow batches to BATCH_ROWS rows; Spark bounds them by rows only, not by bytes."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, BATCH_ROWS)


#: Documents for each file of a small table, see file_count().
FILE_ROWS = 4096


def file_count(spark: SparkSession, rows: int) -> int:
    """Files that a table of so many documents is written to at most: two a core, more only by its size.

    A local file costs three chmod processes (its folder, it and its checksum), which Hadoop starts from the
    executor without its native library, and each shows the executor's memory a second time until it runs.
    """
    return max(2 * spark.sparkContext.defaultParallelism, -(-rows // FILE_ROWS))


def materialize(df: DataFrame, name: str, compression: str = "zstd", files: int | None = None) -> DataFrame:
    """Write to the shared folder, to so many files at most, and read again: cuts lineage, survives lost executors.

    Spark removes the shuffle files of the write when it is done; nothing reads them later.
    """
    if files:
        df = df.coalesce(files)
    path, conf, clean = scratch_path(df.sparkSession, name), df.sparkSession.conf, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = conf.get(clean, "false")
    conf.set(clean, "true")
    try:
        df.write.option("compression", compression).parquet(path)
    finally:
        conf.set(clean, before)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def discard(df: DataFrame) -> None:
    """Delete a table of materialize() that no later plan reads."""
    path = getattr(df, "_scratch", None)
    if path:
        jvm, sc = df.sparkSession._jvm, df.sparkSession.sparkContext
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(sc._jsc.hadoopConfiguration()).delete(p, True)


def text_slices(batch: pa.RecordBatch, column: str, limit: int = CHUNK_BYTES):
    """Slices of a batch with at most about limit bytes of text each (one row at least)."""
    n = batch.num_rows
    if not n:
        return
    import pyarrow.compute as pc

    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes)
    start = 0
    while start < n:
        base = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, base + limit, "right")))
        yield batch.slice(start, stop - start)
        start = stop


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column and the rows' offsets in them; null counts as empty."""
    import pyarrow.compute as pc

    arr = pc.fill_null(column, "").cast(pa.large_string())
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks()
    off = np.frombuffer(arr.buffers()[1], np.int64)[arr.offset : arr.offset + len(arr) + 1]
    data = arr.buffers()[2]
    buf = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None and off[-1] > off[0] else np.zeros(0, np.uint8)
    return buf, off - off[0]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer."""
    x = x ^ (x >> np.uint64(30))
    x = x * _M1
    x = x ^ (x >> np.uint64(27))
    x = x * _M2
    return x ^ (x >> np.uint64(31))


_powers: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """R**j and R**-j modulo 2**64 for j below n, kept between calls up to a few chunks' length."""
    have = _powers.get("p")
    if have is None or len(have) < n:
        size = max(n, 1 << 16)
        inv = np.uint64(pow(int(_R), -1, 1 << 64))
        made = []
        for r in (_R, inv):
            p = np.full(size, r, np.uint64)
            p[0] = 1
            made.append(np.cumprod(p))
        if size > 4 * CHUNK_BYTES:
            return made[0][:n], made[1][:n]
        _powers["p"], _powers["i"] = made
    return _powers["p"][:n], _powers["i"][:n]


def span_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte spans [start, end) of buf, equal for equal bytes wherever they stand."""
    p, inv = powers(len(buf) + 1)
    total = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum((buf.astype(np.uint64) + np.uint64(1)) * p[: len(buf)], out=total[1:])
    raw = (total[ends] - total[starts]) * inv[starts]
    return mix(raw + (ends - starts).astype(np.uint64) * _M2)


def words(buf: np.ndarray, offsets: np.ndarray, blank: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words split at the bytes marked in blank, never across rows: starts, ends, and each row's first word."""
    n = len(buf)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    word = ~blank[buf]
    start = word.copy()
    start[1:] &= ~word[:-1]
    first = offsets[:-1][offsets[:-1] < n]
    start[first] = word[first]
    end = np.zeros(n + 1, bool)
    end[1:] = word
    end[1:n] &= ~word[1:]
    cut = offsets[1:][offsets[1:] > 0]
    end[cut] = word[cut - 1]
    starts, ends = np.flatnonzero(start), np.flatnonzero(end)
    return starts, ends, np.searchsorted(starts, offsets)


def components(edges: DataFrame, name: str = "cc", files: int | None = None) -> DataFrame:
    """(id, component): the smallest id reachable over edges (a, b), for every id that has an edge.

    Alternates linking each id's larger neighbours to its smallest and its smaller ones to its
    smallest (Kiveris and others, 2014) with hash-partitioned aggregations only; a hub's neighbours
    are joined, never gathered in one row. Each round is a table of so many files at most in the shared folder.
    """
    cur = materialize(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), name, files=files)
    while True:
        both = cur.select("u", "v").union(cur.select(F.col("v"), F.col("u")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        large = materialize(large.distinct(), name, files=files)
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select("u", "v", "m")
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").union(low.select("u", F.col("m").alias("v")))
        nxt = materialize(small.distinct(), name, files=files)
        discard(large)
        a = cur.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        b = nxt.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        discard(cur)
        cur = nxt
        if tuple(a) == tuple(b):
            break
    up = cur.select(F.col("u").alias("id"), F.col("v").alias("component"))
    return up.union(cur.select(F.col("v").alias("id"), F.col("v").alias("component"))).distinct()
