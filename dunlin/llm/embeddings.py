"""Embedding near-duplicates over a robust-pruned flat graph.

Vectors with equal labels are compared by cosine in double precision. Per label a bounded sample gives
cluster centres; every vector is stored in the shards of its nearest centres, so shards overlap. In each
shard every vector's neighbours are pruned robustly (Vamana; Subramanya and others, 2019): of candidates
in order of distance, one is kept unless a kept one is nearer to it by the factor alpha. The shards'
adjacency lists of a vector are united. A search starts at a shard's medoids, moves greedily over a list
of bounded length, and then expands every vector in range until no more are reached; what it finds is
verified in double precision. A vector is searched for in every shard that it is stored in, along the united
lists as far as they lead to vectors that are stored there too.

Recall is audited: a stated query set (ids divisible by 100, at most `AUDIT` of them by hash) is compared
with all rows; below `RECALL` the search is done again with twice as many shards for each vector, and a
recall below `LEAST_RECALL` in the end is an error. The last one is logged and put into `report`.

No pairs are listed. A pair counts in the first shard that both are stored in, where each vector's links
are counted and a forest of the found pairs is given out, so a task gives no more rows than it gets.
Dense groups, copies included, need not even be searched: vectors within half the linking distance
of one centre (found in the sample, a ball) are all linked with each other by the triangle inequality.
They are counted as a whole; only their links with others are searched for. Shards larger than the
bound are dealt into blocks, each with its own graph, and compared with the other blocks by product.

Null labels, null or empty vectors, zero vectors and such with null or non-finite components link with
nothing. Rows that share an id count as one vector each; a vector is not linked with itself.
"""

from __future__ import annotations

import logging
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dunlin.llm.common import components, discard, materialize

COSINE = 0.98
#: Rows sampled to fit the centres and balls, for all labels together.
SAMPLE = 20_000
#: Wanted and largest number of vectors in a shard.
SHARD, SHARD_MOST = 300, 2000
OVERLAP = 3
#: Queries of the audit at most; recall that ends the widening, how often it may double, and what must be reached.
AUDIT, RECALL, WIDENINGS, LEAST_RECALL = 256, 0.97, 3, 0.9
DEGREE, LONG_DEGREE, CANDIDATES, ALPHA, LIST = 20, 6, 48, 1.2, 32
#: Rows of a search's list that are opened at once.
BEAM = 4
#: Rows of a shard from which the longer edges are chosen.
PART = 200
BACK = 4
#: Sample members that make a ball.
BALL_LEAST = 24


def usable() -> Column:
    """Whether a row can link: a label, and a vector that is finite and not zero."""
    v = F.col("embedding")
    ok = F.col("label").isNotNull() & v.isNotNull() & (F.size(v) > 0)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(ok & finite & F.exists(v, lambda x: x != 0), F.lit(False))


def unit(vectors: np.ndarray) -> np.ndarray:
    scaled = vectors / np.abs(vectors).max(1, keepdims=True)
    return scaled / np.linalg.norm(scaled, axis=1, keepdims=True)


def matrix(column: pa.Array) -> np.ndarray:
    """A list column with equal lengths as unit rows."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return unit(flat.reshape(len(column), -1))


def fit(x: np.ndarray, share: float, cosine: float, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """(shard centres, ball centres) for one label from its sample; share: sample rows over all rows."""
    rng = np.random.default_rng(seed)
    near = np.sqrt(2 - 2 * cosine)
    balls, free = [], np.ones(len(x), bool)
    degree = np.concatenate([(x[a : a + 1024] @ x.T >= cosine).sum(1) for a in range(0, len(x), 1024)]) if len(x) else np.zeros(0)
    for p in np.argsort(-degree, kind="stable"):
        if degree[p] < BALL_LEAST:
            break
        if not free[p]:
            continue
        c = x[p]
        for _ in range(4):
            mine = x @ c >= 1 - (near * 0.75) ** 2 / 2
            if not mine.any():
                break
            c = x[mine].mean(0)
            c /= np.linalg.norm(c)
        inside = x @ c >= 1 - (near / 2) ** 2 / 2
        if (inside & free).sum() >= BALL_LEAST:
            balls.append(c)
        free &= ~inside
        free[p] = False
    rest = x
    for c in balls:
        rest = rest[rest @ c < 1 - (near / 2) ** 2 / 2]
    k = int(np.clip(len(rest) / max(share, 1e-12) // SHARD, 1, max(len(rest) // 8, 1))) if len(rest) else 1
    centres = rest[rng.choice(len(rest), k, replace=False)] if len(rest) else x[:1]
    for _ in range(6 if k > 1 else 1):
        own = np.concatenate([(rest[a : a + 4096] @ centres.T).argmax(1) for a in range(0, len(rest), 4096)]) if len(rest) else np.zeros(0, int)
        for j in range(k):
            m = rest[own == j]
            if len(m):
                c = m.sum(0)
                n = np.linalg.norm(c)
                centres[j] = c / n if n else m[0]
    return centres, np.array(balls).reshape(-1, x.shape[1])


def prune(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges (from, to) of a shard's robust-pruned graph over its unit rows.

    Candidates are each row's nearest rows, and besides them the nearest rows of a random part of the
    shard, whose longer edges lead into groups that only know themselves. The first edges of a row go
    both ways, so every row can be reached.
    """
    n = len(x)
    part = np.sort(np.random.default_rng(n).permutation(n)[:PART])
    close, far = _pruned(x, np.arange(n), DEGREE, CANDIDATES), _pruned(x, part, LONG_DEGREE, CANDIDATES)
    graph = np.concatenate([close, far], 1)
    r, c = np.nonzero(graph >= 0)
    to = graph[r, c]
    back = close[:, :BACK]
    rb, cb = np.nonzero(back >= 0)
    both = np.unique(np.concatenate([r * n + to, back[rb, cb] * n + rb]))
    return both // n, both % n


def medoids(x: np.ndarray) -> np.ndarray:
    """Rows nearest to the shard's centre and to the centres of its parts."""
    rng = np.random.default_rng(len(x))
    centres = x[rng.permutation(len(x))[: max(1, int(np.sqrt(len(x))))]]
    for _ in range(3):
        own = (x @ centres.T).argmax(1)
        total = np.zeros_like(centres)
        np.add.at(total, own, x)
        size = np.linalg.norm(total, axis=1, keepdims=True)
        centres = np.where(size > 0, total / np.maximum(size, 1e-300), centres)
    return np.unique(np.append((x @ centres.T).argmax(0), (x @ x.mean(0)).argmax()))


def _pruned(x: np.ndarray, among: np.ndarray, degree: int, candidates: int) -> np.ndarray:
    n = len(x)
    out = np.full((n, degree), -1, np.int64)
    m = min(candidates, len(among) - 1)
    if m <= 0:
        return out
    for a in range(0, n, 256):
        q = x[a : a + 256]
        d = np.maximum(2 - 2 * (q @ x[among].T), 0)
        d[among[None, :] == np.arange(a, a + len(q))[:, None]] = np.inf
        c = np.argpartition(d, m - 1, axis=1)[:, :m]
        dc = np.take_along_axis(d, c, 1)
        order = np.argsort(dc, axis=1, kind="stable")
        c, dc = among[np.take_along_axis(c, order, 1)], np.take_along_axis(dc, order, 1)
        g = x[c]
        between = np.maximum(2 - 2 * (g @ g.transpose(0, 2, 1)), 0)
        live = np.isfinite(dc)
        rows = np.arange(len(q))
        for k in range(degree):
            some = live.any(1)
            if not some.any():
                break
            best = live.argmax(1)
            out[a + rows[some], k] = c[rows, best][some]
            live &= ALPHA * ALPHA * between[rows, best] > dc
            live[rows, best] = False
    return out


def lists_of(n: int, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Adjacency lists of n rows from edges (a, b): where each row's list starts, and all lists behind each other."""
    order = np.argsort(a, kind="stable")
    return np.append(0, np.cumsum(np.bincount(a, minlength=n))), b[order]


def search(x: np.ndarray, graph: tuple[np.ndarray, np.ndarray], entry: np.ndarray, queries: np.ndarray, cosine: float) -> tuple[np.ndarray, np.ndarray]:
    """(query, row) pairs in range: greedy from the nearest medoids, then expanding what lies in range.

    Lists are followed as they are, without filling up, so a row that many lead to costs only its own length.
    """
    n, q = len(x), len(queries)
    start, to = graph
    near = queries @ x[entry].T
    take = min(LIST // 4, len(entry))
    best = np.argsort(-near, axis=1, kind="stable")[:, :take]
    wide = max(min(LIST, n), take)
    ids, sims, done = np.full((q, wide), -1, np.int64), np.full((q, wide), -np.inf), np.zeros((q, wide), bool)
    ids[:, :take], sims[:, :take] = entry[best], np.take_along_axis(near, best, 1)
    seen, hit = np.zeros((q, n), bool), np.zeros((q, n), bool)
    seen[:, entry] = True
    hit[:, entry] = near >= cosine

    def reach(who: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """What queries newly see in the lists of rows, sorted by query, and how near it is."""
        size = start[row + 1] - start[row]
        ends = np.cumsum(size)
        at = np.arange(ends[-1] if len(ends) else 0) + np.repeat(start[row] - ends + size, size)
        cell = np.repeat(who, size) * n + to[at]
        cell = np.unique(cell[~seen.ravel()[cell]])
        seen.ravel()[cell] = True
        w, r = cell // n, cell % n
        s = np.concatenate([np.einsum("nd,nd->n", queries[w[lo : lo + 8192]], x[r[lo : lo + 8192]]) for lo in range(0, len(cell), 8192)]) if len(cell) else np.zeros(0)
        hit.ravel()[cell[s >= cosine]] = True
        return w, r, s

    while True:
        # the nearest unopened rows of every query's list, which is in order
        go = ~done & (ids >= 0)
        go &= np.cumsum(go, 1) <= BEAM
        who, at = np.nonzero(go)
        if not len(who):
            break
        done[who, at] = True
        w, r, s = reach(who, ids[who, at])
        better = s > sims[w, -1]
        w, r, s = w[better], r[better], s[better]
        some, first, count = np.unique(w, return_index=True, return_counts=True)
        if not len(some):
            continue
        more = (np.repeat(np.arange(len(some)), count), np.arange(len(w)) - np.repeat(first, count) + wide)
        all_ids = np.concatenate([ids[some], np.full((len(some), count.max()), -1)], 1)
        all_sims = np.concatenate([sims[some], np.full((len(some), count.max()), -np.inf)], 1)
        all_done = np.concatenate([done[some], np.zeros((len(some), count.max()), bool)], 1)
        all_ids[more], all_sims[more] = r, s
        order = np.argsort(-all_sims, axis=1, kind="stable")[:, :wide]
        ids[some], sims[some], done[some] = (np.take_along_axis(v, order, 1) for v in (all_ids, all_sims, all_done))
    # range expansion: every row in range gives its neighbours, until none is new
    opened = np.zeros((q, n), bool)
    while True:
        qs, rows = np.nonzero(hit & ~opened)
        if not len(qs):
            break
        opened[qs, rows] = True
        for lo in range(0, len(qs), 8192):
            reach(qs[lo : lo + 8192], rows[lo : lo + 8192])
    return np.nonzero(hit)


def assign(rows: DataFrame, model: dict, cosine: float, overlap: int = OVERLAP) -> DataFrame:
    """vec_id, label, key, unit vector, ball, shard and all its shards of every usable row, one row for each of its shards.

    They are those of its nearest centres and of every ball in reach; it is stored and searched for in all.
    """
    near = np.sqrt(2 - 2 * cosine)
    inner = 1 - (near / 2) ** 2 / 2 + 1e-9

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            labels = batch.column("label").to_numpy(zero_copy_only=False)
            sizes = np.diff(batch.column("embedding").offsets.to_numpy())
            for label in np.unique(labels):
                for size in np.unique(sizes[labels == label]):
                    part = batch.filter(pa.array((labels == label) & (sizes == size)))
                    x = matrix(part.column("embedding"))
                    centres, balls = model.get((label.item(), int(size)), (x[:1] * 0, x[:0]))
                    ball = np.full(len(x), -1, np.int64)
                    if len(balls):
                        s = x @ balls.T
                        ball = np.where(s.max(1) >= inner, s.argmax(1), -1)
                    s = x @ centres.T
                    take = min(overlap, len(centres))
                    shard = np.argpartition(-s, take - 1, axis=1)[:, :take] if take < len(centres) else np.tile(np.arange(take), (len(x), 1))
                    who, shard = np.repeat(np.arange(len(x)), take), shard.ravel()
                    if len(balls):
                        # whatever may be linked with a ball's members meets them in the shard of its centre
                        more, of = np.nonzero(x @ balls.T >= 1 - (1.5 * near) ** 2 / 2 - 1e-9)
                        home = (balls @ centres.T).argmax(1)
                        both = np.unique(np.stack([np.concatenate([who, more]), np.concatenate([shard, home[of]])], 1), axis=0)
                        who, shard = both[:, 0], both[:, 1]
                    else:
                        o = np.lexsort((shard, who))
                        who, shard = who[o], shard[o]
                    count = np.bincount(who, minlength=len(x))
                    first = np.cumsum(count) - count
                    ends = np.append(0, np.cumsum(count[who]))
                    every = shard[np.repeat(first[who] - ends[:-1], count[who]) + np.arange(ends[-1])]
                    every = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(every.astype(np.int32)))
                    unit_rows = pa.FixedSizeListArray.from_arrays(pa.array(x[who].ravel()), int(size)).cast(pa.list_(pa.float64()))
                    columns = [part.column(c).take(pa.array(who)) for c in ("vec_id", "label", "key")]
                    yield pa.RecordBatch.from_arrays([*columns, pa.array(np.full(len(who), size, np.int32)), pa.array(ball[who]), pa.array(shard.astype(np.int32)), every, unit_rows], names=["vec_id", "label", "key", "size", "ball", "shard", "every", "x"])

    kinds = {c: rows.schema[c].dataType.simpleString() for c in ("vec_id", "label")}
    return rows.select("vec_id", "label", "key", "embedding").mapInArrow(run, f"vec_id {kinds['vec_id']}, label {kinds['label']}, key bigint, size int, ball bigint, shard int, every array<int>, x array<double>")


def forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest row that each of n rows is joined with by the pairs (a, b)."""
    low = np.arange(n)
    while True:
        new = low.copy()
        np.minimum.at(new, a, low[b])
        np.minimum.at(new, b, low[a])
        new = new[new]
        if (new == low).all():
            return low
        low = new


def first_shared(every: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The first shard that rows a and b both lie in; every: each row's shards, filled up with -1."""
    out = np.full(len(a), np.iinfo(np.int32).max, np.int64)
    for k in range(every.shape[1]):
        mine = every[a, k]
        both = (mine >= 0) & (every[b] == mine[:, None]).any(1)
        out[both] = np.minimum(out[both], mine[both])
    return out


def audit(rows: DataFrame, links: DataFrame, cosine: float) -> float:
    """Recall of links (key, links) over the query set, compared with all rows; 1 if the set has no links."""
    own = F.col("vec_id").cast("decimal(38,0)")
    asked = rows.orderBy(F.coalesce(own % 100 != 0, F.lit(True)), F.xxhash64("vec_id", "key")).limit(AUDIT).select("key", "label", "embedding").collect()
    by: dict[tuple, list] = {}
    for r in asked:
        by.setdefault((r.label, len(r.embedding)), []).append(r)
    queries = {k: (np.array([r.key for r in v]), unit(np.array([r.embedding for r in v], float))) for k, v in by.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            labels = batch.column("label").to_numpy(zero_copy_only=False)
            sizes = np.diff(batch.column("embedding").offsets.to_numpy())
            for (label, size), (key, q) in queries.items():
                part = batch.filter(pa.array((labels == label) & (sizes == size)))
                if part.num_rows:
                    near = q @ matrix(part.column("embedding")).T >= cosine
                    near &= key[:, None] != part.column("key").to_numpy()[None, :]
                    yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(near.sum(1))], names=["key", "real"])

    real = rows.select("key", "label", "embedding").mapInArrow(run, "key bigint, real bigint").groupBy("key").agg(F.sum("real").alias("real"))
    got = real.join(links, "key", "left").agg(F.sum("real").alias("real"), F.sum(F.least("real", F.coalesce("links", F.lit(0)))).alias("found")).first()
    return 1.0 if not got.real else got.found / got.real


def near_vectors(vectors: DataFrame, cosine: float = COSINE, overlap: int = OVERLAP, report: dict | None = None) -> DataFrame:
    """vec_id, n_links, component_id and kept of every row; report, if given, gets the audited recall."""
    marked = materialize(vectors.select("vec_id", "label", F.col("embedding").cast("array<double>").alias("embedding")).withColumn("usable", usable()).withColumn("key", F.monotonically_increasing_id()), "vectors")
    rows = marked.where("usable and vec_id is not null")
    total = max(rows.count(), 1)
    sample = rows.orderBy(F.xxhash64("vec_id", "key")).limit(SAMPLE).select("label", "embedding").collect()
    by: dict[tuple, list] = {}
    for r in sample:
        by.setdefault((r.label, len(r.embedding)), []).append(r.embedding)
    share = min(1.0, len(sample) / total)
    model = {k: fit(unit(np.array(v, float)), share, cosine) for k, v in by.items()}
    most = max((len(centres) for centres, _ in model.values()), default=1)

    for n in range(WIDENINGS + 1):
        named, joined = linked(rows, model, cosine, overlap << n)
        recall = audit(rows, named.select("key", "links"), cosine)
        logging.getLogger(__name__).info("recall %.4f over the audited queries, with %d shards a vector", recall, overlap << n)
        if recall >= RECALL or overlap << n >= most or n == WIDENINGS:
            break
        discard(named)
        discard(joined)
    if recall < LEAST_RECALL:
        raise RuntimeError(f"audited recall {recall:.3f} is below {LEAST_RECALL}")
    if report is not None:
        report |= {"recall": recall, "shards": overlap << n}

    ids = named.select("key", "vec_id")
    edges = joined.join(ids.select("key", F.col("vec_id").alias("a")), "key").join(ids.select(F.col("key").alias("root"), F.col("vec_id").alias("b")), "root").select("a", "b")
    edges = edges.union(named.where("least is not null").select(F.col("vec_id").alias("a"), F.col("least").alias("b")))
    found = components(edges, "vec")
    out = marked.select("key", "vec_id").join(named.select("key", "links"), "key", "left").join(found.withColumnRenamed("id", "vec_id"), "vec_id", "left")
    out = out.select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def linked(rows: DataFrame, model: dict, cosine: float, overlap: int) -> tuple[DataFrame, DataFrame]:
    """(key, vec_id, links, least) of every row, least that of its ball; and a forest (key, root) of the found pairs."""
    placed = materialize(assign(rows, model, cosine, overlap), "placed")
    # a ball's members are one group; they stay in the graph for the links of others with them
    shards = placed.groupBy("label", "size", "shard").agg(F.count("*").alias("rows"))
    blocks = F.ceil(F.col("rows") / SHARD_MOST).cast("int")
    dealt = placed.join(shards, ["label", "size", "shard"]).withColumn("block", F.pmod(F.xxhash64("key"), blocks).cast("int")).withColumn("blocks", blocks).drop("rows")
    dealt = materialize(dealt, "shards")

    def build(t: pa.Table) -> pa.Table:
        t = t.combine_chunks()
        a, b = prune(matrix(t.column("x").chunk(0)))
        key = t.column("key").to_numpy()
        return pa.table({"key": pa.array(key[a]), "near": pa.array(key[b])})

    edges = dealt.groupBy("label", "size", "shard", "block").applyInArrow(build, "key bigint, near bigint")
    lists = materialize(edges.groupBy("key").agg(F.collect_set("near").alias("near")), "graph")  # a shard's, of which none is over SHARD_MOST
    stored = dealt.select("label", "size", "shard", "block", F.lit(True).alias("stored"), "key", "ball", "every", "x").join(lists, "key", "left")
    # a shard of several blocks is compared with each of them
    queries = dealt.where("blocks > 1").withColumn("to", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).where("to <> block")
    queries = queries.select("label", "size", "shard", F.col("to").alias("block"), F.lit(False).alias("stored"), "key", "ball", "every", "x", F.lit(None).cast("array<bigint>").alias("near"))

    def look(t: pa.Table) -> pa.Table:
        t = t.combine_chunks()
        t = t.take(pa.array(np.argsort(t.column("key").to_numpy(), kind="stable"))).combine_chunks()
        x = matrix(t.column("x").chunk(0))
        key, ball, stored = (t.column(c).to_numpy() for c in ("key", "ball", "stored"))
        lists_ = t.column("every").to_pylist()
        every = np.full((len(x), max(map(len, lists_))), -1, np.int64)
        for k, v in enumerate(lists_):
            every[k, : len(v)] = v
        own, other = np.flatnonzero(stored), np.flatnonzero(~stored)
        a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        if len(own):
            near = t.column("near").take(pa.array(own)).combine_chunks()
            near = near.chunk(0) if isinstance(near, pa.ChunkedArray) else near
            from_ = np.repeat(np.arange(len(own)), near.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
            near = near.flatten().to_numpy()
            at = np.minimum(np.searchsorted(key[own], near), len(own) - 1)
            here = key[own][at] == near  # neighbours in other shards are searched there
            graph = lists_of(len(own), from_[here], at[here])
            entry = medoids(x[own])
            for lo in range(0, len(own), 256):
                q, found = search(x[own], graph, entry, x[own[lo : lo + 256]], cosine)
                a.append(own[lo + q])
                b.append(own[found])
        i, j = np.concatenate(a), np.concatenate(b)
        both = np.unique(np.concatenate([i * len(x) + j, j * len(x) + i]))  # what one of two has found the other has too
        i, j = both // len(x), both % len(x)
        for lo in range(0, len(other), 256):
            q, found = np.nonzero(x[other[lo : lo + 256]] @ x[own].T >= cosine)
            i, j = np.append(i, other[lo + q]), np.append(j, own[found])
        ok = (i != j) & ~((ball[i] == ball[j]) & (ball[i] >= 0))
        i, j = i[ok], j[ok]
        here = first_shared(every, i, j) == t.column("shard")[0].as_py()
        count = np.bincount(i[here], minlength=len(x))
        root = forest(len(x), i, j)
        some = np.flatnonzero((count > 0) | (root != np.arange(len(x))))
        return pa.table({"key": pa.array(key[some]), "n": pa.array(count[some]), "root": pa.array(key[root[some]])})

    names = ("label", "size", "shard", "block", "stored", "key", "ball", "every", "x", "near")
    found = stored.select(*names).union(queries).groupBy("label", "size", "shard", "block").applyInArrow(look, "key bigint, n bigint, root bigint")
    found = materialize(found, "links")
    ids = placed.select("key", "vec_id", "label", "size", "ball").distinct()
    balls = placed.where("ball >= 0").select("key", "vec_id", "label", "size", "ball").distinct().groupBy("label", "size", "ball").agg(F.count("*").alias("members"), F.min("vec_id").alias("least"))
    degree = found.groupBy("key").agg(F.sum("n").alias("n"))
    named = ids.join(F.broadcast(balls), ["label", "size", "ball"], "left").join(degree, "key", "left")  # a ball takes BALL_LEAST rows of the bounded sample, so there are few
    links = F.coalesce("n", F.lit(0)) + F.coalesce(F.col("members") - 1, F.lit(0))
    named = materialize(named.select("key", "vec_id", links.alias("links"), "least"), "named")
    joined = materialize(found.where("key <> root").select("key", "root").distinct(), "forest")
    for t in (placed, dealt, lists, found):
        discard(t)
    return named, joined
