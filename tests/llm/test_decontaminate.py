import random

import pytest

from dunlin.llm import decontaminate as D

V = [f"term{k}" for k in range(800)] + ["the", "of", "and"] * 100


@pytest.fixture(scope="module")
def data():
    rnd = random.Random(9)
    say = lambda n: " ".join(rnd.choice(V) for _ in range(n))
    items = [(k, f"{say(rnd.randint(8, 40)).capitalize()}. {say(5).capitalize()}?") for k in range(60)]
    docs, truth = [], {}
    for d in range(200):
        text = say(rnd.randint(0, 300))
        if d % 10 == 0:
            k = rnd.randrange(60)
            text = f"{say(rnd.randint(0, 90))} {items[k][1].upper() if d % 20 else items[k][1]}%%% {text}"
            truth[d] = k
        if d % 10 == 1:  # a question alone is no leak
            text += " " + items[d % 60][1].split(".")[0]
        docs.append((d, text))
    return items, docs, truth


def test_finds_all_leaks_and_only_them(spark, data):
    items, docs, truth = data
    bench = spark.createDataFrame(items + [(100, None), (101, ""), (102, "?!")], "item_id int, text string")
    table = spark.createDataFrame([(*d, "x") for d in docs] + [(900, None, "x"), (901, "", "x"), (0, docs[0][1], "x")], "doc_id long, text string, item_id string")
    out = D.hits(table, bench).collect()  # the extra column has the items' name
    assert {(r.doc_id, r.item_id) for r in out} == set(truth.items())
    assert sum(r.doc_id == 0 for r in out) == 2 and all(r.score > 0.9 for r in out)
    kept = D.clean(table, bench)
    assert kept.columns == table.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted({d for d, _ in docs} - set(truth)) + [900, 901]


@pytest.mark.parametrize("places", [0, 4 << 20])
def test_search_equals_scoring_everything(data, monkeypatch, places):
    """Block-max skipping loses no passage that reaches the threshold."""
    import numpy as np
    import pyarrow as pa

    monkeypatch.setattr(D, "TABLE_PLACES", places)
    items, docs, _ = data
    from collections import Counter

    counts, total, size = Counter(), 0, 0
    hashed = {}
    for k, t in items:
        h, _ = D.hashed_words(pa.RecordBatch.from_arrays([pa.array([t])], names=["text"]), "text")
        hashed[k] = h
        counts.update(set(h.tolist()))
        total, size = total + 1, size + len(h)
    index = D.Index(items, counts, total, size / total)
    h, first = D.hashed_words(pa.RecordBatch.from_arrays([pa.array([t for _, t in docs])], names=["text"]), "text")
    for threshold in (0.2, 0.35):
        got = {(r, index.items[i].id, round(s, 6)) for r, i, s, *_ in index.search(h, first, threshold)}
        want = set()
        for r in range(len(docs)):
            words = h[first[r] : first[r + 1]]
            for k in range(max(-(-len(words) // index.longest), 1)):
                part = set(words[k * index.longest : (k + 2) * index.longest].tolist())
                for i in range(len(index.items)):
                    s = 0.0
                    for t in np.flatnonzero(np.isin(index.terms, np.array(sorted(part), np.uint64))):
                        a, b = index.start[t], index.start[t + 1]
                        s += float(index.value[a:b][index.owner[a:b] == i].sum())
                    if s >= threshold:
                        want.add((r, index.items[i].id, round(s, 6)))
        assert got == want and want


def test_shards_and_empty_tables(spark, data, monkeypatch):
    items, docs, truth = data
    monkeypatch.setattr(D, "SHARD_ITEMS", 7)
    monkeypatch.setattr(D, "TABLE_PLACES", 0)
    bench, table = spark.createDataFrame(items, "item_id int, text string"), spark.createDataFrame(docs, "doc_id long, text string")
    assert {(r.doc_id, r.item_id) for r in D.hits(table, bench).collect()} == set(truth.items())
    indexes, shards = D.test_set(bench)
    assert shards == 9 and 60 == sum(len(D.shard_of(indexes, k).items) for k in range(9) if D.shard_of(indexes, k))
    assert sorted(r.doc_id for r in D.clean(table, bench).collect()) == sorted({d for d, _ in docs} - set(truth))
    assert D.hits(table, bench.limit(0)).count() == 0 and D.hits(table.limit(0), bench).count() == 0
    assert D.clean(table, bench.limit(0)).count() == len(docs)


def plain_hits(items, docs, threshold=0.5):
    """BM25, passages and overlaps written out over words, without any of the index's numbers."""
    import math
    import re
    from collections import Counter

    split = lambda t: re.findall(r"[0-9a-z\u0080-\U0010ffff]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    known = {k: split(t) for k, t in items if split(t)}
    df = Counter(w for ws in known.values() for w in set(ws))
    mean, total = sum(map(len, known.values())) / len(known), len(known)
    weight = {}
    for k, ws in known.items():
        tf = Counter(ws)
        one = {w: math.log(1 + (total - df[w] + 0.5) / (df[w] + 0.5)) * n * 2.2 / (n + 1.2 * (0.25 + 0.75 * len(ws) / mean)) for w, n in tf.items()}
        weight[k] = {w: v / sum(one.values()) for w, v in one.items()}
    longest = max(map(len, known.values()))
    runs = lambda ws, n: {tuple(ws[i : i + n]) for i in range(len(ws) - n + 1)}
    out = {}
    for d, text in docs:
        ws = split(text)
        for a in range(0, len(ws), longest):
            passage = ws[a : a + 2 * longest]
            for k, w in weight.items():
                s = sum(v for x, v in w.items() if x in set(passage))
                if s >= threshold - 1e-12:
                    full = dict(items)[k].rstrip()
                    ends = [m.start() for m in re.finditer(r"[.?!][ \n]|\n", full[:-1])]
                    q = len(split(full[: ends[-1] + 1])) if ends else len(known[k])
                    q = max(min(q or len(known[k]), len(known[k]) - max(3, len(known[k]) // 4)), 0)
                    shares = []
                    for part in (known[k][:q], known[k][q:]):
                        n = max(min(4, len(part)), 1)
                        grams = runs(part, n)
                        shares.append(len(grams & runs(passage, n)) / len(grams) if grams else 1.0)
                    if shares[0] >= 0.6 and shares[1] >= 0.5:
                        out[d, k] = max(out.get((d, k), (0.0,)), (round(s, 9), *(round(x, 9) for x in shares)))
    return out


def test_equals_a_plain_version(spark, data):
    items, docs, _ = data
    rnd = random.Random(2)
    near = [(2000 + n, " ".join(w if rnd.random() < 0.85 else rnd.choice(V) for w in items[n % 60][1].split()) + " tail " * (n % 40)) for n in range(120)]
    docs = docs + near + [(3000, " ".join(t for _, t in items) * 3)]  # a long text that holds every item
    out = D.hits(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id int, text string")).collect()
    got = {(r.doc_id, r.item_id): (round(r.score, 9), round(r.question_overlap, 9), round(r.answer_overlap, 9)) for r in out}
    want = plain_hits(items, docs)
    assert set(got) == set(want) and sum(d == 3000 for d, _ in got) == 60
    assert all(max(abs(x - y) for x, y in zip(got[k], want[k])) < 1e-6 for k in want)
