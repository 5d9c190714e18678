import numpy as np

from dunlin.llm import embeddings as E


def brute(rows, cosine=0.98):
    ok = [(i, label, np.array(v, float)) for i, label, v in rows if label is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    deg, top = {i: 0 for i, _, _ in rows}, {i: i for i, _, _ in rows}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for label in {o[1] for o in ok}:
        mine = [o for o in ok if o[1] == label]
        x = np.array([o[2] / np.linalg.norm(o[2]) for o in mine])
        near = x @ x.T >= cosine
        for a, b in zip(*np.nonzero(np.triu(near, 1))):
            p, q = mine[a][0], mine[b][0]
            deg[p] += 1
            deg[q] += 1
            u, v = find(p), find(q)
            top[max(u, v)] = min(u, v)
    return {i: (deg[i], find(i)) for i in deg}


def table(spark, rows):
    return spark.createDataFrame([(i, label, v, "k") for i, label, v in rows], "vec_id long, label int, embedding array<float>, key string")


def result(df):
    return {r.vec_id: (r.n_links, r.component_id) for r in E.near_vectors(df).collect()}


def make(seed, n=900, d=24):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, d))
    x[100:160] = x[100] + rng.normal(size=(60, d)) * 0.06 * np.linalg.norm(x[100]) / np.sqrt(d)  # a ball
    x[300:340] = x[300]  # copies
    for k in range(400, 480, 2):
        x[k + 1] = x[k] * 3 + rng.normal(size=d) * 0.1
    labels = rng.integers(0, 3, n)
    labels[100:160] = 1
    labels[300:340] = 2
    labels[400:480] = np.repeat(rng.integers(0, 3, 40), 2)
    x = x.astype(np.float32)
    rows = [(int(k), int(a), [float(y) for y in v]) for k, a, v in zip(rng.permutation(n), labels, x)]
    bad = x[300].tolist()
    return rows + [(5000, None, bad), (5001, 2, None), (5002, 2, []), (5003, 2, [0.0] * d), (5004, 2, [float("nan"), *bad[1:]]), (5005, 2, [float("inf"), *bad[1:]]), (5006, 2, [None, *bad[1:]]), (5007, 9, bad)]


def test_equals_brute_force(spark):
    rows = make(3)
    assert result(table(spark, rows)) == brute(rows)


def test_split_shards(spark, monkeypatch):
    monkeypatch.setattr(E, "SHARD_MOST", 60)
    monkeypatch.setattr(E, "SHARD", 80)
    rows = make(4, n=500)
    got, want = result(table(spark, rows)), brute(rows)
    links = sum(n for n, _ in want.values())
    assert sum(n for n, _ in got.values()) >= 0.98 * links and all(got[i][0] <= want[i][0] for i in want)


def test_recall_of_the_graph():
    rng = np.random.default_rng(1)
    x = E.unit(rng.normal(size=(700, 32)))
    x[200:320] = E.unit(x[200] + rng.normal(size=(120, 32)) * 0.012)
    a, b = E.prune(x)
    q, found = E.search(x, E.lists_of(len(x), a, b), E.medoids(x), x, 0.98)
    want = (x @ x.T >= 0.98).sum()
    assert len(q) >= 0.99 * want and ((x[q] * x[found]).sum(1) >= 0.98 - 1e-12).all()


def test_small_tables(spark):
    assert result(table(spark, []).limit(0)) == {}
    one = [(1, 0, [1.0, 0.0]), (2, 0, [1.0, 0.0]), (3, 0, [1.0, 0.0, 0.0])]
    assert result(table(spark, one)) == {1: (1, 1), 2: (1, 1), 3: (0, 3)}


def test_links_across_homes(spark, monkeypatch):
    """Two linked rows that share a shard, though neither's nearest centre is among the other's three."""
    at = lambda *angles: np.array([[np.cos(a), np.sin(a)] for a in angles])
    monkeypatch.setattr(E, "fit", lambda *_: (at(-0.01, -0.05, 0.09, 0.2, 0.24), np.zeros((0, 2))))
    rows = [(k, 0, v.tolist()) for k, v in enumerate(at(0, 0.19))]
    assert result(table(spark, rows)) == brute(rows) == {0: (1, 0), 1: (1, 0)}


def test_every_ball_in_reach(spark):
    """A row between two balls, linked with a member of the one that is not its closest."""
    at = lambda *angles: np.array([[np.cos(a), np.sin(a)] for a in angles])
    model = {(0, 2): (at(0.14, 0.15, 0.16, 0.25, -0.02, -0.1, -0.11), at(0, 0.25))}
    rows = spark.createDataFrame([(k, 0, k, v.tolist()) for k, v in enumerate(at(0.14, -0.05))], "vec_id long, label int, key long, embedding array<double>")
    shards = {k: {r.shard for r in E.assign(rows, model, 0.98).where(f"key = {k}").collect()} for k in (0, 1)}
    assert shards[0] & shards[1]


def test_audit_counts_all_rows_and_widens(spark, monkeypatch):
    rows = make(5)
    report = {}
    out = E.near_vectors(table(spark, rows), report=report)
    assert {r.vec_id: (r.n_links, r.component_id) for r in out.collect()} == brute(rows) and report == {"recall": 1.0, "shards": 3}
    df = table(spark, rows).where("label = 1").selectExpr("vec_id", "label", "cast(embedding as array<double>) AS embedding", "vec_id AS key")
    real = brute([r for r in rows if r[1] == 1])
    half = spark.createDataFrame([(i, n // 2) for i, (n, _) in real.items()], "key long, links long")
    asked = sorted(real)  # fewer than the audit's bound, so all are asked
    monkeypatch.setattr(E, "AUDIT", len(asked))
    want = sum(real[i][0] // 2 for i in asked) / sum(real[i][0] for i in asked)
    assert abs(E.audit(df, half, 0.98) - want) < 1e-12
    # shards that miss links are noticed, and more of them are searched
    monkeypatch.setattr(E, "SHARD", 40)
    found = []
    real_audit = E.audit
    monkeypatch.setattr(E, "audit", lambda *a: found.append(real_audit(*a)) or (0.5 if len(found) == 1 else found[-1]))
    E.near_vectors(table(spark, rows), overlap=1, report=report)
    assert len(found) == 2 and report["shards"] == 2


def test_forest_and_first_shared():
    assert E.forest(6, np.array([5, 1, 3]), np.array([1, 2, 4])).tolist() == [0, 1, 1, 3, 3, 1]
    every = np.array([[2, 5, -1], [5, 7, 2], [7, -1, -1], [-1, 9, 5]])
    assert E.first_shared(every, np.array([0, 0, 1, 0]), np.array([1, 2, 2, 3])).tolist() == [2, 2**31 - 1, 7, 5]
