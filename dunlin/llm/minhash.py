"""MinHash near-duplicates with HyperMinHash registers.

A document's set holds its distinct word shingles. One hash of each shingle picks a bucket and gives
a value; a bucket keeps the least value, compressed to its leading-zero count and mantissa bits (Yu
and Weber, 2017). Empty buckets borrow a full one's register by a fixed random order, so short
documents band as well. Bands of registers give candidates, a Jaccard estimate corrected for chance
collisions of registers thins them out, and the full sets decide.

Equal sets fall together first and go on as their smallest id. Candidates need no list of all pairs of
a group: each band's member that shares most buckets leads it; members are compared with their
leaders, and where some are not linked to theirs, the rest of that leader's group is compared in blocks
of bounded size that give out only promising pairs. Groups however large are split and none is capped.

Null, empty and blank texts have an empty set and link with nothing. Inside, a row goes by its id and a hash of its
text: rows that share both are one document, rows that share only the id are documents of their own, and
a null id comes after all others, so a group has a null component only if none of its rows has an id. Words are lower-cased in A-Z only
and split at blanks and controls 9-13. Shingles count as equal when their 64-bit hashes are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dunlin.llm.common import LOWER, bounded_batches, components, discard, file_count, materialize, mix, span_hashes, text_slices, utf8, words

WORDS = 5
PERCENT = 80
REGISTERS = 240
MANTISSA = 10
#: Below this size of a set, estimates are too rough to exclude much.
SMALL = 64
#: So much below the wanted similarity an estimate still lets a pair through: over six standard deviations.
SLACK, SLACK_SMALL = 0.18, 0.4
BLOCK = 256

_G = np.uint64(0x9E3779B97F4A7C15)
_ORDER = np.stack([np.random.default_rng(k).permutation(REGISTERS) for k in range(REGISTERS)])


def shingle_sets(buf: np.ndarray, offsets: np.ndarray, size: int) -> list[np.ndarray]:
    """Each row's sorted distinct 64-bit shingle hashes."""
    low = LOWER[buf]
    starts, ends, first = words(low, offsets)
    h = span_hashes(low, starts, ends)
    n = len(h)
    run = np.zeros(n, np.uint64)
    grams = max(n - size + 1, 0)
    for k in range(size):
        run[:grams] = mix(run[:grams] * _G + h[k : k + grams] + np.uint64(k + 1))
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        if b - a >= size:
            out.append(np.unique(run[a : b - size + 1]))
        elif b > a:
            x = np.zeros(1, np.uint64)
            for k in range(b - a):
                x = mix(x * _G + h[a + k] + np.uint64(k + 1))
            out.append(mix(x + np.uint64(b - a)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def registers(shingles: np.ndarray) -> np.ndarray:
    """HyperMinHash registers of a set: leading zeros of the bucket's least value, then its mantissa."""
    bucket = ((shingles >> np.uint64(32)) * np.uint64(REGISTERS) >> np.uint64(32)).astype(np.int64)  # ascends with the sorted hashes
    first = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))
    least = np.minimum.reduceat(mix(shingles ^ _G), first)
    zeros = 63 - np.frexp(least.astype(np.float64))[1].astype(np.int64) + 1
    zeros = np.clip(zeros, 0, 63)
    top = least << zeros.astype(np.uint64)
    # a value that rounds up to the next power of two in a double
    low = top >> np.uint64(63) == 0
    zeros[low] += 1
    top[low] = least[low] << np.minimum(zeros[low], 63).astype(np.uint64)
    mantissa = (top << np.uint64(1)) >> np.uint64(64 - MANTISSA)
    out = np.zeros(REGISTERS, np.uint16)
    full = np.zeros(REGISTERS, bool)
    full[bucket[first]] = True
    out[bucket[first]] = (np.minimum(zeros, 63) << MANTISSA).astype(np.uint16) | mantissa.astype(np.uint16)
    empty = np.flatnonzero(~full)
    if len(empty):
        order = _ORDER[empty]
        out[empty] = out[order[np.arange(len(empty)), full[order].argmax(1)]]
    return out


def estimate(equal: np.ndarray) -> np.ndarray:
    """Jaccard from the share of equal registers, less what unlike sets share by chance.

    Two different values meet with probability near 2**-mantissa / 3: their leading-zero counts agree in
    a third of all cases, their mantissas then in one of 2**mantissa.
    """
    chance = 2.0**-MANTISSA / 3
    return np.maximum(equal - chance, 0.0) / (1.0 - chance)


def band_rows(percent: int) -> int:
    """Registers of a band: so many that a pair at the threshold shares each band with a chance of about a quarter."""
    return max(1, round(np.log(0.26) / np.log(min(max(percent, 1), 99) / 100)))


def promising(est: np.ndarray, least: np.ndarray, percent: int) -> np.ndarray:
    """Whether estimates allow a link, by the sizes of the smaller sets."""
    return est >= percent / 100 - np.where(least < SMALL, SLACK_SMALL, SLACK)


def sketches(docs: DataFrame, size: int, id_col: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in text_slices(whole, "text"):
                n, a, b, regs = [], [], [], []
                for s in shingle_sets(*utf8(batch.column("text")), size):
                    n.append(len(s))
                    a.append(int(mix(s).sum(dtype=np.uint64)) - (1 << 63))
                    b.append(int(mix(s ^ _G).sum(dtype=np.uint64)) - (1 << 63))
                    regs.append(registers(s).tobytes() if len(s) else None)
                yield pa.RecordBatch.from_arrays([batch.column(id_col), pa.array(n, pa.int64()), pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(regs, pa.binary())], names=["id", "n", "h1", "h2", "regs"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, "text").mapInArrow(run, f"id {kind}, n bigint, h1 bigint, h2 bigint, regs binary")


def _promising(pairs: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) whose sizes and estimate allow a link, with leader."""
    kind = pairs.schema["a"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint16).reshape(-1, REGISTERS) for c in ("ra", "rb"))
            na, nb = (batch.column(c).to_numpy() for c in ("na", "nb"))
            est = estimate((x == y).mean(1))
            ok = promising(est, np.minimum(na, nb), percent)
            yield batch.select(["a", "b"]).filter(pa.array(ok))

    sized = pairs.where(f"100 * least(na, nb) >= {percent} * greatest(na, nb)")
    return sized.select("a", "b", "na", "nb", "ra", "rb").mapInArrow(run, f"a {kind}, b {kind}")


def _verified(pairs: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """Pairs (a, b) that pass on the full sets of their texts."""
    kind = pairs.schema["a"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for half in text_slices(whole, "ta"):
                for batch in text_slices(half, "tb"):
                    sa, sb = (shingle_sets(*utf8(batch.column(c)), size) for c in ("ta", "tb"))
                    ok = []
                    for x, y in zip(sa, sb):
                        both = len(np.intersect1d(x, y, assume_unique=True))
                        ok.append(100 * both >= percent * (len(x) + len(y) - both))
                    yield batch.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    wide = pairs.join(texts.select(F.col("id").alias("a"), F.col("text").alias("ta")), "a").join(texts.select(F.col("id").alias("b"), F.col("text").alias("tb")), "b")
    return wide.select("a", "b", "ta", "tb").mapInArrow(run, f"a {kind}, b {kind}")


def _in_blocks(groups: DataFrame, size: int, percent: int) -> DataFrame:
    """Links (a, b) that join what is not yet joined within groups (leader, id, n, regs, text, linked, size).

    A group's members are dealt into blocks of about BLOCK rows and each two blocks meet in one task, which
    checks promising pairs on the full sets, best first, unless they are joined already. So a task gives
    fewer rows than it gets, whatever the number of pairs.
    """
    kind = groups.schema["id"].dataType.simpleString()
    many = F.ceil(F.col("size") / BLOCK).cast("int")
    dealt = groups.withColumn("own", F.pmod(F.xxhash64("id"), many).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), many - 1)))
    dealt = dealt.select("leader", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "id", "n", "regs", "text", "linked")

    def meet(t: pa.Table) -> pa.Table:
        t = t.combine_chunks()
        regs = np.frombuffer(b"".join(t.column("regs").to_pylist()), np.uint16).reshape(-1, REGISTERS)
        n, linked, own = (t.column(c).to_numpy() for c in ("n", "linked", "own"))
        i, j = t.column("i")[0].as_py(), t.column("j")[0].as_py()
        left = np.flatnonzero(own == i)
        right = left if i == j else np.flatnonzero(own == j)
        xs, ys, es = [], [], []
        for x in left:
            y = right[right > x] if i == j else right
            y = y[(100 * np.minimum(n[y], n[x]) >= percent * np.maximum(n[y], n[x])) & ~(linked[y] & linked[x])]
            if len(y):
                est = estimate((regs[y] == regs[x]).mean(1))
                ok = promising(est, np.minimum(n[y], n[x]), percent)
                xs.append(np.full(int(ok.sum()), x))
                ys.append(y[ok])
                es.append(est[ok])
        a, b = [], []
        if xs:
            xs, ys, es = map(np.concatenate, (xs, ys, es))
            top = list(range(len(n)))

            def find(v: int) -> int:
                while top[v] != v:
                    top[v] = top[top[v]]
                    v = top[v]
                return v

            joined = np.flatnonzero(linked)
            for v in joined[1:].tolist():
                top[v] = int(joined[0])
            sets: dict[int, np.ndarray] = {}
            texts = t.column("text").chunk(0)
            for x, y in zip(xs[(order := np.argsort(-es, kind="stable"))].tolist(), ys[order].tolist()):
                u, v = find(x), find(y)
                if u == v:
                    continue
                for k in (x, y):
                    if k not in sets:
                        sets[k] = shingle_sets(*utf8(texts.slice(k, 1)), size)[0]
                both = len(np.intersect1d(sets[x], sets[y], assume_unique=True))
                if 100 * both >= percent * (len(sets[x]) + len(sets[y]) - both):
                    top[u] = v
                    a.append(x)
                    b.append(y)
        ids = t.column("id")
        return pa.table({"a": ids.take(pa.array(a, pa.int64())), "b": ids.take(pa.array(b, pa.int64()))})

    return dealt.groupBy("leader", "i", "j").applyInArrow(meet, f"a {kind}, b {kind}")


def row_key(id_col: str) -> Column:
    """What tells rows apart, in the order of their ids: null ids last, then by a hash of the text."""
    own = F.col(f"`{id_col}`")
    return F.struct(own.isNull().alias("none"), own.alias("id"), F.xxhash64("text").alias("text"))


def near_duplicates(docs: DataFrame, size: int = WORDS, percent: int = PERCENT, id_col: str = "doc_id") -> DataFrame:
    """id, n_shingles, component_id and kept of every row."""
    out = grouped(docs, size, percent, id_col)
    found = out.select(F.col("id.id").alias(id_col), F.col("n").alias("n_shingles"), F.col("component.id").alias("component_id"), "id", "component")
    return found.withColumn("kept", F.coalesce(F.col(id_col) == F.col("component_id"), F.col("id") == F.col("component"))).drop("id", "component")


def grouped(docs: DataFrame, size: int, percent: int, id_col: str) -> DataFrame:
    """(id, n, component) of every row, where id and component are row keys."""
    bounded_batches(docs.sparkSession)
    source = docs.select(row_key(id_col).alias("id"), "text")
    drawn = materialize(sketches(source, size, "id"), "sketch", "lz4")
    files = file_count(docs.sparkSession, drawn.count())
    sets = materialize(drawn.where("n > 0").groupBy("h1", "h2", "n").agg(F.min("id").alias("id"), F.min_by("regs", "id").alias("regs")), "sets", files=files)

    rows = band_rows(percent)
    width = 2 * rows
    band = F.explode(F.transform(F.sequence(F.lit(0), F.lit(REGISTERS // rows - 1)), lambda i: F.xxhash64(i, F.substring(F.col("regs"), i * width + 1, F.lit(width)))))
    bands = sets.select(band.alias("bucket"), "id")
    shared = bands.groupBy("bucket").agg(F.count("*").alias("size")).where("size > 1")
    members = materialize(bands.join(shared, "bucket"), "members", files=files)
    weight = members.groupBy("id").agg(F.sum("size").alias("weight"))
    leaders = members.join(weight, "id").groupBy("bucket").agg(F.min(F.struct((-F.col("weight")).alias("weight"), "id")).alias("top")).select("bucket", F.col("top.id").alias("leader"))
    groups = materialize(members.select("bucket", "id").join(leaders, "bucket").select("leader", "id").where("leader <> id").distinct(), "groups", files=files)

    own = sets.select("id", "n", "regs")
    first = groups.join(own, "id").select(F.col("id").alias("a"), F.col("leader").alias("b"), F.col("n").alias("na"), F.col("regs").alias("ra"))
    first = first.join(own.select(F.col("id").alias("b"), F.col("n").alias("nb"), F.col("regs").alias("rb")), "b")
    first = materialize(_promising(first, percent), "pairs", files=files)
    needed = groups.select("id").union(groups.select("leader")).distinct()
    # merged at every size, so that the plan does not change with the number of candidates
    texts = materialize(source.join(needed.hint("merge"), "id", "left_semi").dropDuplicates(["id"]), "texts", files=files)
    linked = materialize(_verified(first, texts, size, percent), "linked", files=files)

    state = groups.join(linked.select(F.col("a").alias("id"), F.col("b").alias("leader"), F.lit(True).alias("linked")), ["leader", "id"], "left").na.fill({"linked": False})
    open_ = state.groupBy("leader").agg(F.count("*").alias("size"), F.min(F.col("linked").cast("int")).alias("all")).where("all = 0 and size > 1").select("leader", "size")
    rest = state.join(open_, "leader").join(own, "id").join(texts, "id")
    more = _in_blocks(rest, size, percent)
    found = components(linked.union(more), "near", files)
    discard(members)

    reps = sets.select("h1", "h2", "n", F.col("id").alias("rep"))
    out = drawn.select("id", "n", "h1", "h2").join(reps, ["h1", "h2", "n"], "left").join(found.withColumnRenamed("id", "rep"), "rep", "left")
    return out.select("id", "n", F.when(F.col("n") > 0, F.coalesce("component", "rep")).otherwise(F.col("id")).alias("component")).coalesce(files)


def first_of_each(docs: DataFrame, size: int = WORDS, percent: int = PERCENT, id_col: str = "doc_id") -> DataFrame:
    """One row, with all columns, of each group of linked rows: that with the smallest key. Rows without words all stay."""
    key = "__dunlin_key"
    found = materialize(grouped(docs, size, percent, id_col).select(F.col("id").alias(key), "n", "component"), "groups")
    spare = found.where(f"{key} <> component").select(key).distinct()
    again = materialize(found.where(f"{key} = component and n > 0").groupBy(key).count().where("count > 1").select(key), "again")
    keyed = docs.withColumn(key, row_key(id_col))
    out = keyed.join(spare.union(again).hint("merge"), key, "left_anti")
    if not again.isEmpty():  # the same text under the same id, of which any row will do
        out = out.union(keyed.join(again, key, "left_semi").dropDuplicates([key]))
    return out.drop(key)
