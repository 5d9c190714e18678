import hashlib
import random

import numpy as np

from dunlin.llm import substrings as S
from dunlin.llm.bwt import equal_windows


def brute(rows, width=50):
    first: dict[bytes, int] = {}
    for d, t in rows:
        b = (t or "").encode()
        if d is not None:
            for i in range(len(b) - width + 1):
                first[b[i : i + width]] = min(first.get(b[i : i + width], d), d)
    out = []
    for d, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        if d is not None:
            for i in range(len(b) - width + 1):
                if first[b[i : i + width]] < d:
                    gone[i : i + width] = b"\1" * width
        kept = bytes(x for x, g in zip(b, gone) if not g)
        spans = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        out.append((d, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def corpus(seed):
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice(["th", "er", "é", "an", "ß", "on"]) for _ in range(rnd.randint(1, 4)))
    say = lambda n: " ".join(word() for _ in range(n))
    passages = [say(rnd.randint(5, 60)) for _ in range(6)]
    rows = []
    for d in range(60):
        text = say(rnd.randint(0, 80))
        for _ in range(rnd.randint(0, 2)):
            p = rnd.choice(passages)
            text += rnd.choice(["", " "]) + p[rnd.randint(0, 10) :] + say(rnd.randint(0, 9))
        rows.append((rnd.randint(0, 10**6), text))
    rows += [(-5, rows[3][1]), (2 * 10**6, rows[4][1]), (3, None), (4, ""), (None, rows[5][1]), (7, "a" * 300), (8, "b" + "a" * 120), (9, "a" * 49), (10, "a" * 50)]
    rows += [rows[6]]
    return rows


def test_equals_brute_force(spark):
    for seed in (1, 2):
        rows = corpus(seed)
        df = spark.createDataFrame([(*r, "k", 1) for r in rows], "doc_id long, text string, key string, h int")
        out = sorted((tuple(r) for r in S.remove_repeats(df, digests=True).collect()), key=str)
        assert out == brute(rows)


def test_hot_anchors_are_split_and_kept_bytes(spark):
    rnd = random.Random(4)
    line = "Licensed under the Some License, Version 2.0. "
    rows = [(k, f"{rnd.random()} {line}{rnd.random()} tail") for k in range(40)] + [(100 + k, line * 3) for k in range(3)]
    rows += [(200 + k, f"{k % 5} more {line}and {k % 7} ends so") for k in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for most in (1, 3, 1000):  # down to whole strings, some splits, none
        assert sorted((tuple(r) for r in S.remove_repeats(df, digests=True, most=most).collect()), key=str) == brute(rows)
    full = {r.doc_id: r for r in S.remove_repeats(df).collect()}
    assert full[0].kept == rows[0][1].encode() and full[102].n_removed == len(line) * 3


def test_every_split_equals_brute_force(spark):
    rows = corpus(5)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted((tuple(r) for r in S.remove_repeats(df, digests=True, most=1).collect()), key=str) == brute(rows)


def test_steps_and_empty(spark):
    rng = np.random.default_rng(0)
    text = rng.integers(97, 101, 5000, dtype=np.uint8)
    off = np.array([0, 1200, 1200, 1240, 5000])

    def strings(step):
        row, a, b, h, _ = S.pieces(text, off, step=step)
        return {(r, p, int(x)) for r, s, e, x in zip(row.tolist(), a.tolist(), b.tolist(), h) for p in range(s, e - 49)}

    assert strings(1 << 20) == strings(64)
    assert {(r, p) for r, p, _ in strings(100)} == {(r, p) for r in range(4) for p in range(off[r], off[r + 1] - 49)}
    assert S.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_bwt_equals_brute_force():
    for seed in range(60):
        rnd = random.Random(seed)
        alphabet = rnd.choice(["ab", "abc", "abcdefghij"])
        strings = ["".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 30))).encode() for _ in range(rnd.randint(1, 40))]
        strings += strings[:2]
        width = rnd.randint(1, 6)
        got, want = {}, {}
        for s, k, g in zip(*(x.tolist() for x in equal_windows(strings, width))):
            got.setdefault(g, set()).add((s, k))
        for i, s in enumerate(strings):
            for k in range(len(s) - width + 1):
                want.setdefault(s[k : k + width], set()).add((i, k))
        assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))
