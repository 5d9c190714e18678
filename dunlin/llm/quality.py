"""Quality classifier: a linear-chain conditional random field over the lines of a document.

Each line is labelled good or bad from features of itself and of its neighbouring lines;
forward-backward gives every line's marginal probability of being good, and the document's score is
their mean weighted by line length. Training gives all lines of a document its label and weighs
documents alike, on a bounded sample of labelled rows (`TRAIN_ROWS`), taken whole in the order of a hash of
their id as long as they have at most `TRAIN_LINES` lines together. As neighbouring lines of training
documents never differ in label, the fitted chain favours documents of one label; scoring reads every
whole text.

Only the text goes into a score. A null or empty text, or one of line ends only, counts as a single
empty line and gets a score like any other row. Repeated rows are scored each. Without both labels in
the sample every score is the share of label 1 (0.5 without rows).
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dunlin.llm.common import LOWER, bounded_batches, discard, materialize, span_hashes, text_slices, utf8, words

#: Labelled rows that a model is fitted on at most, chosen by a hash of their id.
TRAIN_ROWS = 2000
#: Lines of all training rows together at most; a row takes part with all its lines or not at all.
TRAIN_LINES = 400_000
#: Lines of a chain in training; longer documents make up several, of which all lines count.
CHAIN = 64
THRESHOLD = 0.7
STEPS = 120

_SYMBOLS = b"#$%&*|{}<>[]\\^~_=+@/"
_CLASSES = {
    "upper": range(65, 91),
    "lower": [*range(97, 123), *range(0xC3, 0xF5)],
    "digit": range(48, 58),
    "symbol": _SYMBOLS,
    "shout": b"!?",
    "stop": b".,;:",
}
NAMES = ("length", "upper", "digit", "symbol", "shout", "stop", "word length", "repeated words", "distinct words", "repeated line", "symbol words", "empty", "bias")
WIDTH = len(NAMES)


class Lines(NamedTuple):
    features: np.ndarray  # a row for each line, own and neighbours' columns
    weights: np.ndarray  # its length in bytes
    first: np.ndarray  # the first line of each document, and the end


def line_features(buf: np.ndarray, offsets: np.ndarray) -> Lines:
    """Features of the lines of the documents that offsets mark in buf."""
    n, docs = len(buf), len(offsets) - 1
    breaks = np.flatnonzero(buf == 10)
    own = np.searchsorted(offsets, breaks, "right") - 1
    inner = breaks + 1 < offsets[own + 1]  # a line end at a document's end starts no line
    starts = np.concatenate([offsets[:-1], (breaks + 1)[inner]])
    doc = np.concatenate([np.arange(docs), own[inner]])
    order = np.lexsort((starts, doc))
    starts, doc = starts[order], doc[order]
    ends = np.append(starts[1:], n)
    last = np.append(doc[1:] != doc[:-1], True) if len(doc) else np.zeros(0, bool)
    ends = np.where(last, offsets[doc + 1], ends - 1)
    ends -= last & (ends > starts) & (buf[np.maximum(ends - 1, 0)] == 10) if n else 0
    length = ends - starts
    full = length > 0
    some = np.zeros(docs, bool)
    some[doc[full]] = True
    first_of = np.append(True, doc[1:] != doc[:-1]) if len(doc) else np.zeros(0, bool)
    keep = full | (first_of & ~some[doc])
    starts, ends, doc, length = starts[keep], ends[keep], doc[keep], length[keep]
    lines = len(starts)
    first = np.searchsorted(doc, np.arange(docs + 1))

    counts = {}
    for name, members in _CLASSES.items():
        mark = np.zeros(256, np.uint8)
        mark[list(members)] = 1
        total = np.zeros(n + 1, np.int32)
        np.cumsum(mark[buf], out=total[1:])
        counts[name] = (total[ends] - total[starts]).astype(float)

    ws, we, _ = words(buf, offsets)
    low = LOWER[buf]
    wh = span_hashes(low, ws, we)
    wl = np.searchsorted(starts, ws, "right") - 1
    per = np.bincount(wl, minlength=lines).astype(float) if len(ws) else np.zeros(lines)
    again = np.zeros(len(ws), bool)
    again[1:] = (wh[1:] == wh[:-1]) & (wl[1:] == wl[:-1])
    repeats = np.bincount(wl[again], minlength=lines) if len(ws) else np.zeros(lines)
    if len(ws):
        o = np.lexsort((wh, wl))
        fresh = np.append(True, (wh[o][1:] != wh[o][:-1]) | (wl[o][1:] != wl[o][:-1]))
        distinct = np.bincount(wl[o][fresh], minlength=lines)
        total = np.zeros(n + 1, np.int32)
        mark = np.zeros(256, np.uint8)
        mark[list(_SYMBOLS + b"!")] = 1
        np.cumsum(mark[buf], out=total[1:])
        odd = np.bincount(wl[(total[we] - total[ws]) >= 1], minlength=lines)
    else:
        distinct = odd = np.zeros(lines)
    lh = span_hashes(buf, starts, ends)
    o = np.lexsort((lh, doc))
    same = np.zeros(lines, bool)
    same[1:] = (lh[o][1:] == lh[o][:-1]) & (doc[o][1:] == doc[o][:-1])
    twice = np.zeros(lines, bool)
    twice[o[same]] = True
    if lines > 1:
        twice[o[:-1][same[1:]]] = True

    size, w = np.maximum(length, 1).astype(float), np.maximum(per, 1.0)
    letters = np.maximum(counts["upper"] + counts["lower"], 1.0)
    x = np.stack(
        [
            np.log1p(length) / 6,
            counts["upper"] / letters,
            counts["digit"] / size * 4,
            np.minimum(counts["symbol"] / size * 8, 2),
            np.minimum(counts["shout"] / size * 8, 2),
            counts["stop"] / w,
            np.minimum(size / w / 10, 3),
            repeats / w * 2,
            distinct / w * np.minimum(np.log1p(w) / 3, 1.5),
            twice.astype(float),
            odd / w,
            (length == 0).astype(float),
            np.ones(lines),
        ],
        axis=1,
    )
    around = np.zeros_like(x)
    joined = doc[1:] == doc[:-1]
    around[1:][joined] += x[:-1][joined] / 2
    around[:-1][joined] += x[1:][joined] / 2
    return Lines(np.concatenate([x, around], axis=1), np.maximum(length, 1).astype(float), first)


def forward_backward(logit: np.ndarray, first: np.ndarray, trans: np.ndarray, pairs: bool = False):
    """Each line's marginal of label 1 in its document's chain; with pairs also those of neighbours' labels."""
    count = np.diff(first)
    order = np.argsort(-count, kind="stable")
    start, count = first[:-1][order], count[order]
    top = int(count[0]) if len(count) else 0
    active = np.searchsorted(-count, -np.arange(top), "left")  # documents with more than t lines
    good = 1.0 / (1.0 + np.exp(-np.clip(logit, -30, 30)))
    emit = np.stack([1.0 - good, good], axis=1)
    move = np.exp(trans - trans.max())
    fore, back = np.ones_like(emit), np.ones_like(emit)
    for t in range(top):
        at = start[: active[t]] + t
        f = emit[at] if not t else (fore[at - 1] @ move) * emit[at]
        fore[at] = f / f.sum(1, keepdims=True)
    for t in range(top - 2, -1, -1):
        at = start[: active[t + 1]] + t
        b = (back[at + 1] * emit[at + 1]) @ move.T
        back[at] = b / b.sum(1, keepdims=True)
    both = fore * back
    marginal = both[:, 1] / np.maximum(both.sum(1), 1e-300)
    if not pairs:
        return marginal
    inner = np.ones(len(logit), bool)
    inner[first[:-1][np.diff(first) > 0]] = False
    at = np.flatnonzero(inner)
    joint = fore[at - 1][:, :, None] * move[None] * (emit[at] * back[at])[:, None, :]
    return marginal, at, joint / joint.sum((1, 2), keepdims=True)


class Model(NamedTuple):
    weights: np.ndarray
    trans: np.ndarray
    prior: float

    def score(self, lines: Lines) -> np.ndarray:
        p = forward_backward(lines.features @ self.weights, lines.first, self.trans)
        total = np.add.reduceat(p * lines.weights, lines.first[:-1]) / np.add.reduceat(lines.weights, lines.first[:-1]) if len(lines.first) > 1 else np.zeros(0)
        return np.full(len(total), self.prior) if self.prior >= 0 else np.clip(total, 0.0, 1.0)


def fit(x: np.ndarray, first: np.ndarray, label: np.ndarray, steps: int = STEPS) -> Model:
    """The field's weights by Adam on the mean negative log-likelihood of documents, each counted alike."""
    if not len(label) or label.min() == label.max():
        return Model(np.zeros(2 * WIDTH), np.zeros((2, 2)), float(label.mean()) if len(label) else 0.5)
    count = np.diff(first)
    doc = np.repeat(np.arange(len(count)), count)
    chains = np.unique(np.concatenate([first, *(np.arange(a, b, CHAIN) for a, b in zip(first[:-1], first[1:]))]))
    y, share = label[doc].astype(float), (1.0 / count)[doc] / len(count)
    theta, m, v = np.zeros(x.shape[1] + 4), np.zeros(x.shape[1] + 4), np.zeros(x.shape[1] + 4)
    for step in range(1, steps + 1):
        w, trans = theta[:-4], theta[-4:].reshape(2, 2)
        p, at, joint = forward_backward(x @ w, chains, trans, pairs=True)
        g = np.concatenate([x.T @ ((p - y) * share), (joint * share[at][:, None, None]).sum(0).ravel()])
        seen = np.zeros(4)
        np.add.at(seen, (y[at] * 3).astype(int), share[at])
        g[-4:] -= seen
        g += 1e-4 * theta
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        theta = theta - 0.15 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-9)
    return Model(theta[:-4], np.clip(theta[-4:].reshape(2, 2), -4, 4), -1.0)


def held_out(id_col: str = "doc_id"):
    """Rows kept from training: crc32 of the id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, lines: int = TRAIN_LINES, id_col: str = "doc_id") -> Model:
    """A model from at most `rows` labelled rows that are not held out, with at most `lines` lines together."""
    bounded_batches(docs.sparkSession)
    known = labels.where(F.col("quality").isin(0, 1) & F.col(id_col).isNotNull() & ~held_out(id_col)).groupBy(id_col).agg(F.max("quality").alias("quality"))
    chosen = known.orderBy(F.xxhash64(F.col(id_col)), id_col).limit(rows)
    picked = docs.select(id_col, "text").join(F.broadcast(chosen), id_col)  # at most `rows` short rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in text_slices(whole, "text"):
                found = line_features(*utf8(batch.column("text")))
                made = [found.features[a:b].astype("<f4").tobytes() for a, b in zip(found.first, found.first[1:])]
                count = pa.array(np.diff(found.first).astype(np.int64))
                yield pa.RecordBatch.from_arrays([batch.column(id_col), batch.column("quality").cast(pa.int32()), count, pa.array(made, pa.binary())], names=["id", "quality", "n", "lines"])

    kind = docs.schema[id_col].dataType.simpleString()
    order = F.xxhash64("id")
    sample = materialize(picked.mapInArrow(run, f"id {kind}, quality int, n bigint, lines binary"), "training")
    sizes = sample.select(order.alias("at"), "n").orderBy("at", "n").limit(2 * rows).collect()
    keep, total = set(), 0
    for r in sizes:  # a document that does not fit is left out whole
        if total + r.n <= lines:
            keep.add(r["at"])
            total += r.n
    taken = sample.where(order.isin(list(keep)) & (F.col("n") <= lines)).orderBy(order, "n").limit(2 * rows).collect() if keep else []
    discard(sample)
    if not taken:
        return fit(np.zeros((0, 2 * WIDTH)), np.zeros(1, int), np.zeros(0))
    parts = [np.frombuffer(r.lines, "<f4").reshape(-1, 2 * WIDTH) for r in taken]
    first = np.concatenate([[0], np.cumsum([len(p) for p in parts])])
    return fit(np.concatenate(parts).astype(float), first, np.array([r.quality for r in taken]))


def score_documents(docs: DataFrame, model: Model, id_col: str = "doc_id", threshold: float = THRESHOLD, keep: tuple[str, ...] = ()) -> DataFrame:
    """id, score and predicted of every row, with the columns named in keep; a narrow map, no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in text_slices(whole, "text"):
                s = model.score(line_features(*utf8(batch.column("text"))))
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in (id_col, *keep)), pa.array(s), pa.array((s >= threshold).astype(np.int32))], names=[id_col, *keep, "score", "predicted"])

    bounded_batches(docs.sparkSession)
    cols = dict.fromkeys((id_col, *keep, "text"))
    kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in (id_col, *keep))
    return docs.select(*cols).mapInArrow(run, f"{kinds}, score double, predicted int")


def accepted(docs: DataFrame, model: Model, least: float = 0.5) -> DataFrame:
    """The rows of docs, all columns, whose score is at least `least`; a narrow map, no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in text_slices(whole, "text"):
                yield batch.filter(pa.array(model.score(line_features(*utf8(batch.column("text")))) >= least))

    bounded_batches(docs.sparkSession)
    return docs.mapInArrow(run, docs.schema)
