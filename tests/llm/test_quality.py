import math
import random
import zlib

import numpy as np
import pyarrow as pa

from dunlin.llm import quality as Q
from dunlin.llm.common import utf8


def features(*texts):
    return Q.line_features(*utf8(pa.array(list(texts), pa.string())))


def test_lines_of_documents():
    f = features("a b\n\nc d e", "", None, "\n\n", "x\n")
    assert np.diff(f.first).tolist() == [2, 1, 1, 1, 1]
    assert f.weights[:2].tolist() == [3, 5] and f.weights[-1] == 1


def test_marginals_equal_enumeration():
    rng = np.random.default_rng(1)
    logit, trans = rng.normal(size=5), rng.normal(size=(2, 2))
    first = np.array([0, 3, 5])
    p = Q.forward_backward(logit, first, trans)
    for a, b in ((0, 3), (3, 5)):
        n, total, good = b - a, 0.0, np.zeros(b - a)
        for bits in range(1 << n):
            y = [bits >> k & 1 for k in range(n)]
            s = math.exp(sum(logit[a + k] * y[k] for k in range(n)) + sum(trans[y[k], y[k + 1]] for k in range(n - 1)))
            total += s
            good += s * np.array(y)
        assert np.allclose(p[a:b], good / total)


def test_learns_and_ignores_held_out(spark):
    rnd = random.Random(5)
    words = [f"w{k}" for k in range(300)]

    def text(good):
        line = lambda: " ".join(rnd.choice(words) + ("" if good else rnd.choice(["###", "$$$", "!!"])) for _ in range(12)) + "."
        return "\n".join(line() for _ in range(rnd.randint(1, 6)))

    rows = [(k, text(k % 3 > 0), int(k % 3 > 0)) for k in range(240)]
    docs = spark.createDataFrame([(k, t, "extra") for k, t, _ in rows], "doc_id long, text string, score string")
    wrong = lambda k, q: 1 - q if zlib.crc32(str(k).encode()) % 4 == 2 else q  # noqa: E731  labels of held-out rows must not matter
    labels = spark.createDataFrame([(k, wrong(k, q)) for k, _, q in rows] + [(None, 1), (5000, 1), (3, None)], "doc_id long, quality int")
    model = Q.train(docs, labels)
    out = {r.doc_id: r for r in Q.score_documents(docs, model).collect()}
    hits = [out[k].predicted == q for k, _, q in rows if zlib.crc32(str(k).encode()) % 4 == 2]
    assert np.mean(hits) > 0.95
    assert all(0 <= r.score <= 1 for r in out.values())
    flags = {r.doc_id: r.h for r in docs.select("doc_id", Q.held_out().alias("h")).collect()}
    assert all(flags[k] == (zlib.crc32(str(k).encode()) % 4 == 2) for k, _, _ in rows)
    kept = Q.accepted(docs, model)
    assert kept.columns == docs.columns and 100 < kept.count() < 220


def test_without_labels_and_rows(spark):
    docs = spark.createDataFrame([(1, "a"), (2, None), (2, None)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int")
    model = Q.train(docs, none)
    assert [r.score for r in Q.score_documents(docs, model).collect()] == [0.5] * 3
    one = spark.createDataFrame([(1, 1)], "doc_id long, quality int")
    assert Q.score_documents(docs, Q.train(docs, one)).count() == 3
    assert Q.score_documents(docs.limit(0), model).count() == 0


def test_training_reads_whole_texts_and_bounds_all_lines(spark):
    # the first lines of all documents are alike; only later ones tell
    rnd = random.Random(8)
    text = lambda good: "\n".join([f"plain words stand here {k}." for k in range(80)] + [("good words and more of them." if good else "### $$$ !!! ###") for _ in range(rnd.randint(90, 200))])
    rows = [(k, text(k % 2), k % 2) for k in range(40)]
    docs = spark.createDataFrame([r[:2] for r in rows] + [(900, "x\n" * 50_000)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, q) for k, _, q in rows] + [(900, 1)], "doc_id long, quality int")
    out = {r.doc_id: r.score for r in Q.score_documents(docs, Q.train(docs, labels, lines=20_000)).collect()}
    assert all((out[k] > 0.5) == q for k, _, q in rows)
    x = np.random.default_rng(0).normal(size=(300, 2 * Q.WIDTH))
    first, label = np.array([0, 150, 300]), np.array([0, 1])
    whole = Q.fit(x, first, label, steps=5)
    assert np.isfinite(whole.weights).all() and np.abs(whole.weights).max() > 0
    assert [r.score for r in Q.score_documents(docs.limit(2), Q.train(docs, labels, lines=10)).collect()] == [0.5] * 2


def test_score_is_the_weighted_mean_of_line_marginals():
    rng = np.random.default_rng(3)
    model = Q.Model(rng.normal(size=2 * Q.WIDTH), rng.normal(size=(2, 2)), -1.0)
    texts = ["one line\nanother one!\nthird", "", "word " * 50 + "\nx"]
    got = model.score(features(*texts))
    for t, g in zip(texts, got):
        lines = [x for x in t.split("\n") if x] or [""]
        f = features(t)
        logit = f.features @ model.weights
        total, good = 0.0, np.zeros(len(lines))
        for bits in range(1 << len(lines)):
            y = [bits >> k & 1 for k in range(len(lines))]
            e = math.exp(sum(logit[k] * y[k] for k in range(len(y))) + sum(model.trans[y[k], y[k + 1]] for k in range(len(y) - 1)))
            total, good = total + e, good + e * np.array(y)
        weight = np.array([max(len(x.encode()), 1) for x in lines])
        assert abs(g - (good / total * weight).sum() / weight.sum()) < 1e-9


def test_very_long_text_and_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "word " * 200_000, 5, "a"), (2, "line\n" * 100_000, 6, "b")], "doc_id long, text string, predicted int, quality string")
    model = Q.Model(np.zeros(2 * Q.WIDTH), np.zeros((2, 2)), -1.0)
    assert [abs(r.score - 0.5) < 1e-9 for r in Q.score_documents(docs, model).collect()] == [True, True]
    assert Q.accepted(docs, model, 0.6).count() == 0 and Q.accepted(docs, model, 0.4).columns == docs.columns
