"""Benchmark decontamination: a BM25 inverted index of the test items, searched with block-max WAND.

Every training document is cut into overlapping passages that are long enough to hold any item whole,
and each passage is a query. Postings are grouped into blocks of items; a term's largest contribution in
each block that it occurs in is its block-max. A block whose summed block-maxima stay below the threshold
is skipped with all its postings. In the others the terms' cursors move by pivots: terms are ordered by
the items they stand at, the first at which the summed maxima reach the threshold is the pivot, and
cursors before it skip to it; only items at which a pivot holds are scored. So everything above the
threshold is retrieved. BM25 scores are divided by the item's score against its own text, so 1 is a full match.

Hits are then verified: an item's answer is its last sentence (its last quarter, three words at least,
if that is shorter), the question is what stands before; enough word n-grams of both must stand in the
passage. Of an item's passages the one with the best score, then the best overlaps counts.

Words are runs of letters and digits, A-Z lower-cased. Null and empty texts match nothing, items without
words are not searched for, and items with a null id still make a document contaminated. The test set is
indexed by Spark in shards of about `SHARD_ITEMS` items and `SHARD_WORDS` words, each a row of a table in the
shared folder, with statistics of the whole test set. One shard at a time is read and sent to the tasks, so
neither the driver nor a worker ever holds more; with several shards each is a pass over the documents.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dunlin.llm.common import LOWER, PUNCTUATION, bounded_batches, discard, materialize, mix, span_hashes, text_slices, utf8, words

K1, B = 1.2, 0.75
#: Share of an item's own score that a passage must reach.
THRESHOLD = 0.5
QUESTION, ANSWER = 0.6, 0.5
GRAM = 4
BLOCK = 4
SHARD_ITEMS, SHARD_WORDS = 20_000, 2_000_000

#: Up to so many places (terms times blocks) the block-maxima lie in a full table too, which is quicker to sum.
TABLE_PLACES = 4 << 20

_G = np.uint64(0x9E3779B97F4A7C15)
_WIDE = np.int64(1) << np.int64(40)


def grams(h: np.ndarray, size: int) -> np.ndarray:
    """Hashes of the runs of `size` words."""
    n = max(len(h) - size + 1, 0)
    run = np.zeros(n, np.uint64)
    for k in range(size):
        run = mix(run * _G + h[k : k + n])
    return run


class Item(NamedTuple):
    id: object
    question: np.ndarray  # sorted gram hashes
    answer: np.ndarray
    question_size: int
    answer_size: int


def split_item(text: str, h: np.ndarray, starts: np.ndarray) -> int:
    """How many of an item's words are the question."""
    raw = text.rstrip().encode("utf-8")
    cut = max((raw.rfind(c, 0, max(len(raw) - 1, 0)) for c in (b". ", b".\n", b"? ", b"?\n", b"! ", b"!\n", b"\n")), default=-1)
    at = int(np.searchsorted(starts, cut)) if cut >= 0 else 0
    least = max(3, len(h) // 4)
    return max(min(at if at else len(h), len(h) - least), 0)


class Index:
    """An inverted index of one shard of items, with block-maxima."""

    def __init__(self, items: list[tuple[object, str]], counts: dict[int, int], total: int, mean: float):
        parsed = []
        for key, text in items:
            buf = LOWER[np.frombuffer((text or "").encode("utf-8"), np.uint8)]
            starts, ends, _ = words(buf, np.array([0, len(buf)]), PUNCTUATION)
            if len(starts):
                parsed.append((key, text, span_hashes(buf, starts, ends), starts))
        parsed.sort(key=lambda p: (len(p[2]), int(p[2].min())))  # alike lengths give tight maxima
        self.items: list[Item] = []
        self.longest = max((len(p[2]) for p in parsed), default=0)
        terms, owners, values = [], [], []
        for k, (key, text, h, starts) in enumerate(parsed):
            uniq, tf = np.unique(h, return_counts=True)
            df = np.array([counts[int(x)] for x in uniq])
            idf = np.log1p((total - df + 0.5) / (df + 0.5))
            value = idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * len(h) / mean))
            terms.append(uniq)
            owners.append(np.full(len(uniq), k))
            values.append(value / value.sum())
            q = split_item(text, h, starts)
            size = [max(min(GRAM, n), 1) for n in (q, len(h) - q)]
            self.items.append(Item(key, np.unique(grams(h[:q], size[0])) if q else np.zeros(0, np.uint64), np.unique(grams(h[q:], size[1])), size[0], size[1]))
        if not parsed:
            self.terms = np.zeros(0, np.uint64)
            return
        term, owner, value = map(np.concatenate, (terms, owners, values))
        order = np.lexsort((owner, term))
        self.terms, start = np.unique(term[order], return_index=True)
        self.start = np.append(start, len(term))
        self.owner, self.value = owner[order], value[order]
        self.blocks = -(-len(parsed) // BLOCK)
        # each posting's place in the order of (term, item), and the block-maxima of the blocks that a term occurs in
        self.place = np.repeat(np.arange(len(self.terms)), np.diff(self.start)) * len(parsed) + self.owner
        entry = np.repeat(np.arange(len(self.terms)), np.diff(self.start)) * self.blocks + self.owner // BLOCK
        first = np.flatnonzero(np.append(True, entry[1:] != entry[:-1]))
        self.block_of, self.maximum = entry[first] % self.blocks, np.maximum.reduceat(self.value, first)
        self.entries = np.searchsorted(entry[first] // self.blocks, np.arange(len(self.terms) + 1))
        self.full = None
        if len(self.terms) * self.blocks <= TABLE_PLACES:
            self.full = np.zeros((len(self.terms), self.blocks), np.float32)
            self.full.ravel()[entry[first]] = self.maximum

    def bounds(self, term: np.ndarray, row: np.ndarray, rows: int) -> np.ndarray:
        """Summed block-maxima of each row's terms, for every block."""
        count = self.entries[term + 1] - self.entries[term]
        at = np.repeat(self.entries[term] - np.cumsum(count) + count, count) + np.arange(int(count.sum()))
        return np.bincount(np.repeat(row, count) * self.blocks + self.block_of[at], weights=self.maximum[at], minlength=rows * self.blocks).reshape(rows, self.blocks)

    def wand(self, terms: np.ndarray, block: int, threshold: float) -> Iterator[tuple[int, float]]:
        """(item, score) of a block's items that reach the threshold, by pivots over the terms' cursors."""
        n = len(self.items)
        low = np.searchsorted(self.place, terms * n + block * BLOCK)
        high = np.searchsorted(self.place, terms * n + min((block + 1) * BLOCK, n))
        live = low < high
        terms, cursor, high = terms[live], low[live], high[live]
        maximum = np.maximum.reduceat(np.append(self.value, 0.0), np.stack([cursor, high], 1).ravel())[::2]
        while len(terms):
            item = self.owner[cursor]
            order = np.argsort(item, kind="stable")
            reach = np.cumsum(maximum[order])
            k = int(np.searchsorted(reach, threshold - 1e-9))
            if k == len(order):
                return
            pivot = item[order[k]]
            if item[order[0]] == pivot:
                here = item == pivot
                score = float(self.value[cursor[here]].sum())
                if score >= threshold:
                    yield int(pivot), score
                cursor = cursor + here
            else:
                cursor = np.where(item < pivot, np.searchsorted(self.place, terms * n + pivot), cursor)
            live = cursor < high
            terms, cursor, high, maximum = terms[live], cursor[live], high[live], maximum[live]

    def search(self, h: np.ndarray, first: np.ndarray, threshold: float) -> Iterator[tuple[int, int, float, float, float]]:
        """(row, item, score, question overlap, answer overlap) of every verified hit, passage by passage."""
        if not len(self.terms) or not len(h):
            return
        at = np.minimum(np.searchsorted(self.terms, h), len(self.terms) - 1)
        known = np.flatnonzero(self.terms[at] == h)
        if not len(known):
            return
        # a passage is two strides, each as long as the longest item, so every item lies whole in one
        stride = self.longest
        row = np.searchsorted(first, known, "right") - 1
        stride_of = row * _WIDE + (known - first[row]) // stride
        fresh = np.append(True, stride_of[1:] != stride_of[:-1])
        strides, group = stride_of[fresh], np.cumsum(fresh) - 1
        distinct = np.unique(group * np.int64(len(self.terms)) + at[known])
        group, term = distinct // len(self.terms), distinct % len(self.terms)
        begin = np.searchsorted(group, np.arange(len(strides) + 1))
        step = max(1, (4 << 20) // self.blocks)
        done = 0
        while done < len(strides):
            stop = min(max(done + 1, int(np.searchsorted(begin, begin[done] + step, "right")) - 1), len(strides))
            reach = min(stop + 1, len(strides))  # the next stride ends the last passage
            part = slice(begin[done], begin[reach])
            if self.full is None:
                bound = self.bounds(term[part], group[part] - done, reach - done)
            else:
                bound = np.add.reduceat(self.full[term[part]], begin[done:reach] - begin[done], axis=0)
            follows = strides[done + 1 : reach] == strides[done : reach - 1] + 1
            bound[:-1][follows] += bound[1:][follows]
            near, blocks = np.nonzero(bound[: stop - done] >= threshold - 1e-5)
            last = -1
            for p, block in zip((near + done).tolist(), blocks.tolist()):
                if p != last:
                    last, two = p, p + 1 < len(strides) and strides[p + 1] == strides[p] + 1
                    mine = np.unique(term[begin[p] : begin[p + 1 + two]])
                    r, k = int(strides[p] // _WIDE), int(strides[p] % _WIDE)
                    text = h[first[r] + k * stride : min(first[r] + (k + 2) * stride, first[r + 1])]
                if self.full is not None and self.full[mine, block].sum() < threshold - 1e-5:
                    continue  # the strides' bounds count a word that stands in both twice
                for i, score in self.wand(mine, block, threshold):
                    item = self.items[i]
                    q = np.isin(item.question, grams(text, item.question_size)).mean() if len(item.question) else 1.0
                    yield r, i, score, float(q), float(np.isin(item.answer, grams(text, item.answer_size)).mean())
            done = stop


def test_set(benchmark: DataFrame, id_col: str = "item_id") -> tuple[DataFrame, int]:
    """(shard, index) of the test set in the shared folder, and the number of shards; nothing of its size is on the driver."""
    kind = benchmark.schema[id_col].dataType.simpleString()

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h, first = hashed_words(batch, "text")
            lists = [np.unique(h[a:b]).view(np.int64) for a, b in zip(first, first[1:])]
            ends = np.append(0, np.cumsum([len(x) for x in lists])).astype(np.int32)
            distinct = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(lists)))
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("text"), pa.array(np.diff(first)), distinct], names=["id", "text", "n", "words"])

    rows = benchmark.select(F.col(f"`{id_col}`").alias("id"), "text").where("text is not null")
    rows = rows.mapInArrow(parse, f"id {kind}, text string, n bigint, words array<bigint>").where("n > 0")
    rows = materialize(rows.withColumn("row", F.monotonically_increasing_id()), "items")
    total, size = rows.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    if not total:
        return rows.select(F.lit(0).alias("shard"), F.lit(b"").alias("index")), 0
    shards = max(-(-total // SHARD_ITEMS), -(-size // SHARD_WORDS))
    each = rows.select("row", F.explode("words").alias("word"))
    known = each.join(each.groupBy("word").agg(F.count("*").alias("df")), "word").groupBy("row").agg(F.collect_list(F.struct("word", "df")).alias("known"))  # of one item
    dealt = rows.select("row", "id", "text", F.pmod(F.xxhash64("row"), F.lit(shards)).cast("int").alias("shard")).join(known, "row")

    def build(t: pa.Table) -> pa.Table:
        counts = {k["word"] & (1 << 64) - 1: k["df"] for known in t.column("known").to_pylist() for k in known}
        made = Index(list(zip(t.column("id").to_pylist(), t.column("text").to_pylist())), counts, total, size / total)
        return pa.table({"shard": pa.array([t.column("shard")[0].as_py()], pa.int32()), "index": pa.array([pickle.dumps(made)], pa.binary())})

    out = materialize(dealt.groupBy("shard").applyInArrow(build, "shard int, index binary"), "index")
    discard(rows)
    return out, shards


def shard_of(indexes: DataFrame, shard: int) -> Index | None:
    """One shard's index, which is of bounded size; none if no item fell into it."""
    row = indexes.where(F.col("shard") == shard).first()
    return pickle.loads(bytes(row["index"])) if row else None


def hashed_words(batch: pa.RecordBatch, text_col: str) -> tuple[np.ndarray, np.ndarray]:
    buf, offsets = utf8(batch.column(text_col))
    low = LOWER[buf]
    starts, ends, first = words(low, offsets, PUNCTUATION)
    return span_hashes(low, starts, ends), first


def hits(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", item_col: str = "item_id") -> DataFrame:
    """id, item id, score, question_overlap and answer_overlap: a row for each verified pair of row and item, with its best passage."""
    from pyspark.sql.pandas.types import to_arrow_type

    bounded_batches(docs.sparkSession)
    indexes, shards = test_set(benchmark, item_col)
    kinds = [docs.schema[id_col].dataType.simpleString(), benchmark.schema[item_col].dataType.simpleString()]
    item_type = to_arrow_type(benchmark.schema[item_col].dataType)
    names = [id_col, item_col, "score", "question_overlap", "answer_overlap"]

    def of(index: Index) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                for batch in text_slices(whole, "text"):
                    best: dict[tuple[int, int], tuple[float, float, float]] = {}
                    for r, i, *found in index.search(*hashed_words(batch, "text"), threshold):
                        if found[1] >= QUESTION and found[2] >= ANSWER:
                            best[r, i] = max(best.get((r, i), (0.0, 0.0, 0.0)), tuple(found))
                    keys = list(best)
                    ids = batch.column(id_col).take(pa.array([r for r, _ in keys], pa.int64()))
                    items = pa.array([index.items[i].id for _, i in keys], type=item_type)
                    yield pa.RecordBatch.from_arrays([ids, items, *(pa.array([best[k][c] for k in keys], pa.float64()) for c in range(3))], names=names)

        return docs.select(id_col, "text").mapInArrow(run, f"`{id_col}` {kinds[0]}, `{item_col}` {kinds[1]}, score double, question_overlap double, answer_overlap double")

    if shards <= 1:
        return of(shard_of(indexes, 0) or Index([], {}, 0, 1.0))
    out = None
    for k in range(shards):
        index = shard_of(indexes, k)
        if index is not None:
            part = materialize(of(index), "hits")
            out = part if out is None else out.union(part)
    return out


def clean(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs, all columns, that hold no item of the test set; a narrow map for each shard, no shuffle."""
    bounded_batches(docs.sparkSession)
    indexes, shards = test_set(benchmark, benchmark.columns[0] if "item_id" not in benchmark.columns else "item_id")

    def of(rows: DataFrame, index: Index) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                for batch in text_slices(whole, "text"):
                    keep = np.ones(batch.num_rows, bool)
                    for r, _, _, q, a in index.search(*hashed_words(batch, "text"), threshold):
                        if q >= QUESTION and a >= ANSWER:
                            keep[r] = False
                    yield batch.filter(pa.array(keep))

        return rows.mapInArrow(run, docs.schema)

    for k in range(shards):
        index = shard_of(indexes, k)
        if index is not None:
            docs = of(docs, index) if shards == 1 else materialize(of(docs, index), "clean")
    return docs
