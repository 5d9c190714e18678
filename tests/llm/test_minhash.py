import random
import re
from collections import defaultdict
from pathlib import Path

import numpy as np

from dunlin.llm import minhash as M
from dunlin.llm.common import shared_dir

WORD = re.compile(r"[^\x20\x09-\x0D]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text, k):
    w = WORD.findall((text or "").translate(FOLD))
    return frozenset(tuple(w[j : j + k]) for j in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])


def brute(rows, k, percent):
    sets = {d: shingles(t, k) for d, t in rows}
    top = {d: d for d in sets}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[:n]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                top[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), find(d)) for d in ids}


def changed(rnd, words, share):
    return [rnd.choice(VOCABULARY) if rnd.random() < share else w for w in words]


VOCABULARY = [f"w{k}" for k in range(400)]


def corpus(seed):
    rnd = random.Random(seed)
    rows, n = [], 0
    for _ in range(25):
        base = [rnd.choice(VOCABULARY) for _ in range(rnd.choice([3, 5, 8, 30, 120, 300]))]
        for share in (0, 0, 0.01, 0.02, 0.03, 0.04, 0.05, 0.06, 0.08, 0.3):
            rows.append((n, " ".join(changed(rnd, base, share))))
            n += 1
    rows += [(n, None), (n + 1, ""), (n + 2, " \t\n"), (n + 3, "A b"), (n + 4, "a  B"), (n + 5, "a b"), (n + 6, "x " * 20000)]
    rnd.shuffle(rows)
    return rows


def test_equals_brute_force(spark):
    for k, percent in ((4, 80), (5, 80), (2, 60)):
        rows = corpus(k)
        df = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, n int, regs string")
        out = {r.doc_id: (r.n_shingles, r.component_id) for r in M.near_duplicates(df, k, percent).collect()}
        assert out == brute(rows, k, percent)


def test_hub_with_unlike_copies(spark):
    """Copies that are linked with one text only, and more of them than a block holds."""
    rnd = random.Random(1)
    base = [rnd.choice(VOCABULARY) for _ in range(200)]
    rows = [(1000 + k, " ".join(changed(rnd, base, 0.03))) for k in range(150)] + [(5000, " ".join(base))]
    old, M.BLOCK = M.BLOCK, 32
    try:
        out = {r.doc_id: (r.n_shingles, r.component_id) for r in M.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 4).collect()}
    finally:
        M.BLOCK = old
    assert out == brute(rows, 4, 80)


def test_repeated_ids_and_nulls(spark):
    df = spark.createDataFrame([(1, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f"), (None, None), (None, "g h i j k"), (None, "G h i j k")], "doc_id long, text string")
    out = sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in M.near_duplicates(df).collect()), key=str)
    assert out == [(1, 2, 1, True), (1, 2, 1, True), (None, 0, None, True), (None, 1, None, False), (None, 1, None, True), (None, 2, 1, False)]
    left = M.first_of_each(df.selectExpr("*", "1 AS n")).collect()
    assert sorted(((r.doc_id, (r.text or "").lower()) for r in left), key=str) == [(1, "a b c d e f"), (None, ""), (None, "g h i j k")]
    # one id with two texts: only the one that copies a smaller id goes
    two = spark.createDataFrame([(1, "a b c d e f"), (2, "a b c d e f"), (2, "something else that stands alone")], "doc_id long, text string")
    assert sorted((r.doc_id, r.text[0]) for r in M.first_of_each(two).collect()) == [(1, "a"), (2, "s")]
    assert M.near_duplicates(df.limit(0)).count() == 0
    kept = M.first_of_each(spark.createDataFrame([(1, "a b c d e f", 7), (2, "a b c d e f", 8), (3, None, 9)], "doc_id long, text string, kept int"))
    assert sorted((r.doc_id, r.kept) for r in kept.collect()) == [(1, 7), (3, 9)]


def test_registers_estimate_jaccard():
    rng = np.random.default_rng(2)
    for n, same in ((2000, 0.8), (300, 0.5), (1000, 0.0)):
        x = rng.integers(0, 1 << 63, n, dtype=np.uint64)
        y = x.copy()
        fresh = int(n * (1 - same))
        y[:fresh] = rng.integers(0, 1 << 63, fresh, dtype=np.uint64)
        real = len(np.intersect1d(x, y)) / len(np.union1d(x, y))
        got = M.estimate((M.registers(np.unique(M.mix(x))) == M.registers(np.unique(M.mix(y)))).mean())
        assert abs(got - real) < 0.12
    zeros = M.registers(np.array([5], np.uint64))
    assert len(set(zeros.tolist())) == 1
    groups = defaultdict(int)
    for r in M.registers(np.unique(M.mix(np.arange(100000, dtype=np.uint64)))).tolist():
        groups[r] += 1
    assert len(groups) > 150


def test_small_tables_go_to_few_files(spark):
    """However many partitions a shuffle has: each file of a small table costs processes in its executor."""
    rows = corpus(4)
    scratch = Path(shared_dir(spark).removeprefix("file://"), "dunlin")
    before = set(scratch.glob("*"))
    kept = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    try:
        for k, v in zip(kept, ("64", "false")):
            spark.conf.set(k, v)
        out = M.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 4)
        found = {r.doc_id: (r.n_shingles, r.component_id) for r in out.collect()}
        parts = out.rdd.getNumPartitions()
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)
    written = {d.name.rpartition("-")[0]: len(list(d.glob("*.parquet"))) for d in set(scratch.glob("*")) - before}
    assert found == brute(rows, 4, 80)
    assert {"sets", "groups", "pairs", "texts", "linked", "near"} <= set(written)
    most = 2 * spark.sparkContext.defaultParallelism
    assert max(written.values()) <= most and parts <= most, (written, parts)
