"""Exact substring removal with a column-wise suffix order of many documents.

A byte goes if a string of `WIDTH` bytes that covers it also starts in a document with a smaller id.

The transform of whole documents would need as many rounds as the longest document has bytes, each over
all of the data, so the collection is first cut where equal strings must agree: of a string's grams of
`GRAM` bytes the one with the least hash is its anchor, and equal strings have equal anchors. Strings that
start next to each other mostly share theirs and make up one short piece. Anchors that occur in one
document only need no more work. The pieces of the others, each different piece once with its smallest
id, are dealt into shards by anchor, and there the column-wise construction (dunlin.llm.bwt) puts their
suffixes in order and finds the equal strings. Of any string of 50 bytes around an anchor of 20, the 16 bytes
before the anchor or the 15 after it belong to the string, so a piece that has neither of these longer
cores in common with another of its anchor shares no string and needs no order.

An anchor with more than `PIECES_MOST` different pieces is split, however many they are: a string that
starts far before its anchor shares more with its like on the left, any other more on the right, so
each piece becomes at most two, of the strings of one kind, under a core that is longer than the anchor.
Equal strings stay together. Cores that are still too common are split again; after five splits
a core is a whole string and has one piece. So a task's work is bounded by size, and all strings are put
in order by the same construction.

Texts are their UTF-8 bytes; null counts as empty. Rows with a null id neither lose bytes nor make others
lose any; rows that share an id do not take from each other and are told apart by a 64-bit hash of their
texts. An anchor's pieces are told apart by their bytes when put in order, and are found again by 64-bit
hashes of anchor and piece: of an anchor's n pieces two are confused with a chance of n * n / 2**65.
Matches never cross documents.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dunlin.llm.bwt import equal_windows
from dunlin.llm.common import bounded_batches, discard, materialize, mix, powers, span_hashes, text_slices, utf8

WIDTH, GRAM = 50, 20
#: Bytes of one step of the anchor search, which stay in a core's cache; longer documents take several, which overlap by a string.
STEP = 1 << 16
#: Bytes that make up a symbol of the column-wise construction; it divides WIDTH.
SYMBOL = 10
#: Different pieces of one anchor that are put in order together, and pieces of a shard on average.
PIECES_MOST, SHARD = 2048, 4096
#: Parts, by anchor, in which the pieces are handled one after another; more of them need less disk at once.
PARTS = 2


def gram_hashes(buf: np.ndarray, gram: int) -> np.ndarray:
    n = max(len(buf) - gram + 1, 0)
    p, inv = powers(len(buf) + 1)
    total = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum((buf.astype(np.uint64) + np.uint64(1)) * p[: len(buf)], out=total[1:])
    return mix((total[gram:] - total[:-gram]) * inv[:n]) if n else np.zeros(0, np.uint64)


def pieces(buf: np.ndarray, offsets: np.ndarray, width: int = WIDTH, gram: int = GRAM, step: int = STEP):
    """(row, start, end, anchor hash, anchor's place) of the pieces: runs of strings of one row with the same anchor."""
    rows, starts, ends, anchors, places = [], [], [], [], []
    wide = width - gram + 1
    mask = np.uint64(0xFFFFFF)
    sizes = np.diff(offsets)
    rows_at = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
    ends_at = np.repeat(offsets[1:], sizes)
    for lo in range(0, max(len(buf) - width + 1, 0), step):
        part = buf[lo : lo + step + width - 1]
        g = gram_hashes(part, gram)
        # the least hash, and of equal ones the first: a place in the low bits decides
        key = (g & ~mask) | np.arange(len(g), dtype=np.uint64)
        reach = 1
        while reach * 2 <= wide:
            key = np.minimum(key[:-reach], key[reach:])
            reach *= 2
        if reach < wide:
            key = np.minimum(key[: len(key) - (wide - reach)], key[wide - reach :])
        row = rows_at[lo : lo + len(key)]
        place = (key & mask).astype(np.int32)
        good = np.arange(lo + width, lo + width + len(key)) <= ends_at[lo : lo + len(key)]
        fresh = good.copy()
        fresh[1:] &= ~good[:-1] | (place[1:] != place[:-1]) | (row[1:] != row[:-1])
        first = np.flatnonzero(fresh)
        last = np.append(np.flatnonzero(good[:-1] & (fresh[1:] | ~good[1:])), np.flatnonzero(good[-1:]) + len(good) - 1)
        rows.append(row[first].astype(np.int64))
        starts.append(first + lo)
        ends.append(last + lo + width)
        anchors.append(g[place[first]])
        places.append(place[first].astype(np.int64) + lo)
    if not rows:
        z = np.zeros(0, np.int64)
        return z, z, z, np.zeros(0, np.uint64), z
    return tuple(map(np.concatenate, (rows, starts, ends, anchors, places)))


def _anchors(docs: DataFrame) -> DataFrame:
    """(id, hs): the anchors of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in text_slices(whole, "text"):
                row, _, _, h, _ = pieces(*utf8(batch.column("text")))
                ends = np.searchsorted(row, np.arange(batch.num_rows + 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([batch.column("id"), pa.ListArray.from_arrays(pa.array(ends), pa.array(h.view(np.int64)))], names=["id", "hs"])

    kind = docs.schema["id"].dataType.simpleString()
    return docs.select("id", "text").mapInArrow(run, f"id {kind}, hs array<bigint>")


def _cut(wanted: DataFrame) -> DataFrame:
    """(h, s, piece, at, id, key, start) of the pieces whose anchors a row wants: (id, key, text, hs); at: the anchor's place in the piece."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in text_slices(whole, "text"):
                buf, offsets = utf8(batch.column("text"))
                row, start, end, h, place = pieces(buf, offsets)
                lists = batch.column("hs")
                want_row = np.repeat(np.arange(batch.num_rows), np.diff(lists.offsets.to_numpy()))
                want = lists.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
                pair = mix(want ^ mix(want_row.astype(np.uint64)))
                ok = np.isin(mix(h ^ mix(row.astype(np.uint64))), pair)
                row, start, end, h, place = row[ok], start[ok], end[ok], h[ok], place[ok]
                raw = buf.tobytes()
                texts = [raw[a:b] for a, b in zip(start.tolist(), end.tolist())]
                take = pa.array(row)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(h.view(np.int64)), pa.array(texts, pa.binary()), pa.array((place - start).astype(np.int32)),
                        batch.column("id").take(take), batch.column("key").take(take), pa.array((start - offsets[row]).astype(np.int64)),
                    ],
                    names=["h", "piece", "at", "id", "key", "start"],
                )

    kind = wanted.schema["id"].dataType.simpleString()
    found = wanted.select("id", "key", "text", "hs").mapInArrow(run, f"h bigint, piece binary, at int, id {kind}, key bigint, start bigint")
    return found.withColumn("s", F.xxhash64("piece"))


def _ordered(distinct: DataFrame, shards: int, chunk: int) -> DataFrame:
    """(h, s, offset, length, least): the runs of the pieces' strings with their smallest ids."""
    kind = distinct.schema["id"].dataType.simpleString()

    def order(t: pa.Table) -> pa.Table:
        h = t.column("h").to_numpy()
        t = t.take(pa.array(np.argsort(h, kind="stable"))).combine_chunks()
        h, s, ids, last, at, k = (t.column(c).to_numpy() for c in ("h", "s", "id", "last", "at", "k"))
        piece = t.column("piece").chunk(0)
        ends = piece_ends(piece)
        size = np.diff(ends)
        edge = np.flatnonzero(np.append(True, h[1:] != h[:-1]))
        count = np.diff(np.append(edge, len(h)))
        both = np.minimum.reduceat(ids, edge) < np.maximum.reduceat(last, edge)  # in several documents
        group = np.repeat(np.arange(len(edge)), count)
        like = np.repeat(both & (count > 1), count)
        like[like] = alike(piece, ends, group, at, k, np.flatnonzero(like))
        # a piece that shares no string with others is one run if it stands in several documents
        alone = np.flatnonzero(~like & (ids < last))
        out = [(alone, np.zeros(len(alone), np.int64), size[alone] - (WIDTH - 1), ids[alone])]
        several = np.flatnonzero(like)
        begin = np.flatnonzero(np.append(True, group[several][1:] != group[several][:-1])) if len(several) else np.zeros(0, np.int64)
        lo = 0
        while lo < len(several):  # so many whole anchors as make up a chunk
            n = int(np.searchsorted(begin, lo + chunk))
            hi = int(begin[n]) if n < len(begin) else len(several)
            out.append(_runs(piece, several[lo:hi], ids))
            lo = hi
        row, offset, length, low = map(np.concatenate, zip(*out))
        return pa.table({"h": pa.array(h[row]), "s": pa.array(s[row]), "offset": pa.array(offset.astype(np.int32)), "length": pa.array(length.astype(np.int32)), "least": pa.array(low, t.schema.field("id").type)})

    dealt = distinct.withColumn("shard", F.pmod(F.xxhash64("h"), F.lit(shards))).select("shard", "h", "s", "piece", "id", "last", "at", "k")
    return dealt.groupBy("shard").applyInArrow(order, f"h bigint, s bigint, offset int, length int, least {kind}")


def alike(piece: pa.Array, ends: np.ndarray, group: np.ndarray, at: np.ndarray, k: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Which of the rows' pieces may share a string with another of their anchor: those that share one of the two longer cores."""
    data = piece.buffers()[2]
    buf = np.frombuffer(data, np.uint8)[ends[0] : ends[-1]] if data is not None else np.zeros(0, np.uint8)
    begin, size = ends[rows] - ends[0], ends[rows + 1] - ends[rows]
    right = (k[rows] + 1) // 2
    out = np.zeros(len(rows), bool)
    for lead, length in ((np.zeros(len(rows), np.int64), WIDTH + 1 - right), (right, WIDTH + 1 - (k[rows] - right))):
        first = at[rows] - lead
        has = np.flatnonzero((first >= 0) & (first + length <= size))
        a = begin[has] + first[has]
        core = mix(span_hashes(buf, a, a + length[has]) ^ mix(group[rows[has]].astype(np.uint64)))
        _, which, n = np.unique(core, return_inverse=True, return_counts=True)
        out[has[n[which] > 1]] = True
    return out


def piece_ends(arr: pa.Array) -> np.ndarray:
    wide = np.int64 if pa.types.is_large_binary(arr.type) else np.int32
    return np.frombuffer(arr.buffers()[1], wide)[arr.offset : arr.offset + len(arr) + 1].astype(np.int64)


def _runs(piece: pa.Array, rows: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, ...]:
    """(row, offset, length, smallest id) of the runs of strings with one smallest id."""
    owner, start, group = equal_windows(piece.take(pa.array(rows)).to_pylist(), WIDTH, SYMBOL)
    ids = ids[rows]
    bound = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
    low = np.repeat(np.minimum.reduceat(ids[owner], bound), np.diff(np.append(bound, len(group))))
    o = np.lexsort((start, owner))
    owner, start, low = owner[o], start[o], low[o]
    at = np.flatnonzero(np.append(True, (owner[1:] != owner[:-1]) | (low[1:] != low[:-1]) | (start[1:] != start[:-1] + 1)))
    return rows[owner[at]], start[at], np.diff(np.append(at, len(owner))), low[at]


def _halves(pieces_: DataFrame, keep: list[str]) -> DataFrame:
    """Pieces (h, piece, at, k) as at most two each, of the strings that start before and after half of the k places.

    k: the number of places before the core at which a string may start. `moved` is where a part begins in its piece.
    """
    n, right = f"(length(piece) - {WIDTH - 1})", "((k + 1) div 2)"
    low, top = f"greatest(0, at - {right} + 1)", f"least({n} - 1, at - {right})"
    later = f"struct(0 as side, substring(piece, int({low}) + 1) as piece, int(at - {low}) as at, int({right}) as k, int({low}) as moved, substring(piece, at + 1, int({WIDTH + 1} - {right})) as core)"
    earlier = f"struct(1 as side, substring(piece, 1, int({top} + {WIDTH})) as piece, int(at - {right}) as at, int(k - {right}) as k, 0 as moved, substring(piece, int(at - {right}) + 1, int({WIDTH + 1} - (k - {right}))) as core)"
    both = f"filter(array(if({low} < {n}, {later}, null), if({top} >= 0, {earlier}, null)), x -> x is not null)"
    parts = pieces_.select("h", *keep, F.explode(F.expr(both)).alias("x"))
    return parts.select(F.xxhash64("h", "x.side", "x.core").alias("h"), F.xxhash64("x.piece").alias("s"), "x.piece", "x.at", "x.k", "x.moved", *keep)


def removed_spans(docs: DataFrame, most: int = PIECES_MOST, shard: int = SHARD) -> DataFrame:
    """(id, key, spans): the starts and ends of the strings that go, for rows (id, key, text) that lose any.

    A hash join is asked for where one side is much larger than the other, which saves sorting it; each
    step is written, and its shuffle files go before the next.
    """
    docs = docs.where("id is not null and text is not null")
    anchors = materialize(_anchors(docs), "anchors", "lz4")
    each = anchors.select("id", F.explode("hs").alias("h"))
    shared = materialize(each.groupBy("h").agg(F.min("id").alias("a"), F.max("id").alias("b")).where("a < b").select("h"), "shared")
    # of one document; dealt before they are gathered, as gathering twice would cost more than it saves
    wanted = each.join(shared.hint("shuffle_hash"), "h").repartition("id").groupBy("id").agg(F.collect_list("h").alias("hs"))
    wanted = materialize(wanted, "wanted", "lz4")
    discard(anchors)
    discard(shared)
    cut = materialize(_cut(docs.join(wanted.hint("shuffle_hash"), "id")), "pieces")
    discard(wanted)

    hits = [_hits(cut.where(F.pmod("h", F.lit(PARTS)) == part), most, shard) for part in range(PARTS)]
    discard(cut)
    found = hits[0]
    for more in hits[1:]:
        found = found.union(more)
    spans = materialize(found.repartition("id", "key").groupBy("id", "key").agg(F.collect_list(F.struct("a", "b")).alias("spans")), "spans")  # of one document
    for t in hits:
        discard(t)
    return spans


def _hits(cut: DataFrame, most: int, shard: int) -> DataFrame:
    """(id, key, a, b): the runs of strings of pieces that also start in a document with a smaller id."""
    level = cut.withColumn("k", F.lit(WIDTH - GRAM + 1))
    pieces_ = level.withColumn("last", F.col("id"))
    where, runs, used = None, None, []
    while True:
        distinct = materialize(pieces_.groupBy("h", "s", "piece").agg(F.min("id").alias("id"), F.max("last").alias("last"), F.min("at").alias("at"), F.min("k").alias("k")), "distinct")
        # written, so that Spark knows its size and moves the pieces only if it is too large to send to all
        hot = materialize(distinct.groupBy("h").agg(F.count("*").alias("n"), F.min("id").alias("a"), F.max("last").alias("b")).where(f"n > {most} and a < b").select("h"), "hot")
        ordered = materialize(_ordered(distinct.join(hot, "h", "left_anti"), max(distinct.count() // shard, 1), shard), "runs")
        here = level.select("h", "s", "id", "key", "start")
        where, runs = (here, ordered) if runs is None else (where.union(here), runs.union(ordered))
        used += [hot, ordered]
        if hot.isEmpty():
            discard(distinct)
            break
        pieces_ = materialize(_halves(distinct.join(hot, "h"), ["id", "last"]).drop("moved"), "halves")
        split = _halves(level.join(hot, "h"), ["id", "key", "start"])
        level = materialize(split.withColumn("start", F.col("start") + F.col("moved")).drop("moved"), "halves")
        discard(distinct)
        used += [pieces_, level]
    begin = F.col("start") + F.col("offset")
    hits = where.join(runs.hint("shuffle_hash"), ["h", "s"]).where("least < id")
    out = materialize(hits.select("id", "key", begin.alias("a"), (begin + F.col("length") + (WIDTH - 1)).alias("b")), "hits")
    for t in used:
        discard(t)
    return out


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", digests: bool = False, most: int = PIECES_MOST) -> DataFrame:
    """id, n_bytes, n_removed, n_spans and the remaining bytes (kept), or their SHA-256 (kept_sha256), of every row."""
    bounded_batches(docs.sparkSession)
    # rows that share an id are told apart by a hash of their texts
    source = docs.select(F.col(f"`{id_col}`").alias("id"), F.xxhash64("text").alias("key"), "text")
    spans = removed_spans(source, most)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in text_slices(whole, "text"):
                sizes, gone, count, kept = [], [], [], []
                spans_ = batch.column("spans")
                for text, ab in zip(batch.column("text").to_pylist(), spans_):
                    raw = (text or "").encode("utf-8")
                    n = k = 0
                    if ab.is_valid:
                        a, b = (ab.values.field(c).to_numpy() for c in (0, 1))
                        o = np.argsort(a, kind="stable")
                        a, top = a[o], np.maximum.accumulate(b[o])
                        new = np.append(True, a[1:] > top[:-1])
                        lo, hi = a[new], top[np.append(np.flatnonzero(new)[1:] - 1, len(top) - 1)]
                        n, k = int((hi - lo).sum()), len(lo)
                        cuts = [0, *np.stack([lo, hi], 1).ravel().tolist(), len(raw)]
                        left = b"".join(raw[p:q] for p, q in zip(cuts[::2], cuts[1::2]))
                    else:
                        left = raw
                    sizes.append(len(raw))
                    gone.append(n)
                    count.append(k)
                    kept.append(hashlib.sha256(left).hexdigest() if digests else left)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id"), *(pa.array(x, pa.int64()) for x in (sizes, gone, count)), pa.array(kept, pa.string() if digests else pa.binary())], names=[id_col, "n_bytes", "n_removed", "n_spans", last]
                )

    last = "kept_sha256" if digests else "kept"
    kind = source.schema["id"].dataType.simpleString()
    joined = source.join(spans.hint("shuffle_hash"), ["id", "key"], "left").select("id", "text", "spans")
    return joined.mapInArrow(run, f"`{id_col}` {kind}, n_bytes bigint, n_removed bigint, n_spans bigint, {last} {'string' if digests else 'binary'}")
