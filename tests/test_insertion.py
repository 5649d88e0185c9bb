"""Graphs by insertion: their links one by one, connectivity within the degree, and recall on clustered vectors."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from vectorloom.operators import exact, graph, insertion, topk
from vectorloom.operators.arrow_walk import Adjacency, LocalIndex, Marks, beam
from vectorloom.plans.index import Config, StagedIndex
from vectorloom.plans.scratch import written
from vectorloom.plans.sharded import ShardedIndex


def frame(spark, x, key="id"):
    return spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], f"{key} long, vec array<float>")


def clusters(seed=0, n=40, size=100, dims=16):
    rng = np.random.default_rng(seed)
    centres = rng.normal(0, 10, (n, dims))
    x = centres[np.repeat(np.arange(n), size)] + rng.normal(0, 1, (n * size, dims))
    return x.astype(np.float32), (x[rng.integers(0, len(x), 100)] + rng.normal(0, 0.5, (100, dims))).astype(np.float32)


@pytest.fixture(scope="module")
def clustered(spark):
    x, q = clusters()
    base, queries = written(frame(spark, x)), written(frame(spark, q, "qid"))
    return base, queries, written(exact.exact_knn_blocks(queries, base, 10))


def mean(found, truth):
    return topk.mean_recall(found, truth).first().recall


def plain_links(dist, x, me, most, fill):
    """From the nearest on, one by one; dist: (distance, place) in order."""
    kept, rest = [], []
    for d, i in dist:
        if len(kept) < most and all(((x[i] - x[j]) ** 2).sum() >= d for j in kept):
            kept.append(i)
        else:
            rest.append(i)
    return sorted(kept + (rest[: most - len(kept)] if fill else []))


@pytest.mark.parametrize("fill", [True, False])
def test_links_equal_plain(fill):
    rng = np.random.default_rng(2)
    x = rng.uniform(-1, 1, (60, 5))
    near, dist = np.full((10, 30), -1), np.zeros((10, 30))
    want = []
    for me in range(10):
        own = sorted((float(((x[me] - x[i]) ** 2).sum()), i) for i in range(60) if i != me)[: 30 - me]
        near[me, : len(own)], dist[me, : len(own)] = [i for _, i in own], [d for d, _ in own]
        want.append(plain_links(own, x, me, 8, fill))
    found = insertion.linked(near, dist, x, 8, fill)
    assert [sorted(r[r >= 0].tolist()) for r in found] == want


def test_thinned_keeps_what_fits():
    x = np.random.default_rng(3).uniform(-1, 1, (50, 4))
    src, dst = np.repeat([3, 7, 9], [5, 40, 1]), np.concatenate([np.arange(10, 15), [i for i in range(41) if i != 7], [1]])
    dist = ((x[src] - x[dst]) ** 2).sum(1)
    order = np.lexsort((dst, dist, src))
    src, dst, dist = src[order], dst[order], dist[order]
    stay = insertion.thinned(src, dst, dist, x, 6)
    assert np.bincount(src[stay], minlength=10)[[3, 7, 9]].tolist() == [5, 6, 1]
    own = src == 7
    assert sorted(dst[stay][src[stay] == 7].tolist()) == plain_links(list(zip(dist[own], dst[own], strict=True)), x, 7, 6, True)


def reach(rows, start=0, back=False):
    src, c = np.nonzero(rows >= 0)
    dst = rows[src, c]
    a, b = (dst, src) if back else (src, dst)
    seen, front = {start}, [start]
    out = {}
    for s, d in zip(a.tolist(), b.tolist(), strict=True):
        out.setdefault(s, []).append(d)
    while front:
        front = [d for s in front for d in out.get(s, []) if d not in seen and not seen.add(d)]
    return len(seen)


@pytest.mark.parametrize("make", ["clusters", "copies", "few", "one", "none"])
def test_grown_graphs_are_connected_within_their_degree(make):
    x = {"clusters": clusters()[0], "copies": np.concatenate([np.zeros((700, 4)), np.random.default_rng(1).normal(5, 1, (300, 4))]), "few": np.eye(5), "one": np.ones((1, 3)), "none": np.zeros((0, 3))}[make]
    rows = insertion.grown(x, 16)
    assert rows.shape == (len(x), 16) and not len(x) or reach(rows) == reach(rows, back=True) == len(x)
    assert all(len(set(r[r >= 0].tolist())) == (r >= 0).sum() and i not in r for i, r in enumerate(rows))


def test_recall_on_clusters(spark, clustered):
    base, queries, truth = clustered
    edges = written(insertion.insert_graph(base, 32, 16, base=500))
    stats = graph.degree_stats(edges).first()
    assert stats.max_degree <= 32 and stats.n_nodes == 4000
    assert graph.unreached(edges, base.select("id"), 0).count() == 0
    rows = edges.collect()
    ids, x = np.arange(4000), np.array([r.vec for r in base.orderBy("id").collect()])
    held = LocalIndex(ids, x, Adjacency.of(ids, *(np.array([r[c] for r in rows]) for c in ("src", "dst", "rank"))), None, 0, np.arange(0, 4000, 250, dtype=np.int32)[None, :], None)
    q = np.array([r.vec for r in queries.orderBy("qid").collect()], np.float64)
    found, _ = held.search(q, 10, 64)
    want = {}
    for r in truth.collect():
        want.setdefault(r.qid, set()).add(r.id)
    assert np.mean([len(want[i] & set(f.tolist())) / 10 for i, f in enumerate(found)]) >= 0.95


def test_staged_and_sharded_recall_on_clusters(spark, clustered, tmp_path):
    base, queries, truth = clustered
    config = Config(16, 8, 0.25, "nsw32", "random16")
    held = StagedIndex.build(base, config, f"{tmp_path}/i")
    assert mean(held.search(queries, 10, 64), truth) >= 0.95
    shards = ShardedIndex.build(base, config, 8, f"{tmp_path}/s")
    assert mean(shards.search(queries, 10, 64, probes=3), truth) >= 0.95


def test_nsg_from_search_paths(spark, clustered):
    base, queries, truth = clustered
    edges = written(graph.nsg_graph(base, 32, 16, mode="insert"))
    start = graph.medoid(base, 16)
    assert graph.unreached(edges, base.select("id"), start).count() == 0 and graph.degree_stats(edges).first().max_degree <= 32
    rows = edges.collect()
    ids, x = np.arange(4000), np.array([r.vec for r in base.orderBy("id").collect()])
    g = Adjacency.of(ids, *(np.array([r[c] for r in rows]) for c in ("src", "dst", "rank")))
    held = LocalIndex(ids, x, g, None, 0, np.array([[start]], np.int32), None)
    found, _ = held.search(np.array([r.vec for r in queries.orderBy("qid").collect()], np.float64), 10, 64)
    want = {}
    for r in truth.collect():
        want.setdefault(r.qid, set()).add(r.id)
    assert np.mean([len(want[i] & set(f.tolist())) / 10 for i, f in enumerate(found)]) >= 0.95


def test_repair_stays_within_the_degree(spark):
    rng = np.random.default_rng(4)
    x = np.concatenate([rng.normal(c, 0.1, (30, 3)) for c in (0, 50, 100, 150)])
    df = written(frame(spark, x))
    bare = written(graph.knn_graph(df, insertion.room(6), 3))
    assert graph.unreached(bare, df.select("id"), 0).count() >= 90
    fixed = written(insertion.connected(bare, df, 6))
    assert graph.unreached(fixed, df.select("id"), 0).count() == 0 and graph.unreached(fixed, df.select("id"), 119).count() == 0
    assert graph.degree_stats(fixed.withColumn("rank", F.lit(0))).first().max_degree <= 6


def test_too_many_vectors_are_refused(spark, clustered, monkeypatch):
    from vectorloom.operators import arrow_walk

    monkeypatch.setattr(arrow_walk, "MAX_BYTES", 1000)
    with pytest.raises(ValueError, match="ShardedIndex"):
        insertion.insert_graph(clustered[0], 16, 16)


def test_counts_and_bounds_of_the_kernel(spark, clustered, tmp_path):
    base, queries, _ = clustered
    held = StagedIndex.build(base, Config(16, 8, 0.25, "nsw16", "random8"), f"{tmp_path}/i")
    full = {(r.qid, r.stage): r for r in held.counts(queries, 16).collect()}
    assert len(full) == 300 and all(full[q, 1].n_visited == full[q, 1].n_computed + 8 for q in range(100))
    few = held.counts(queries, 16, max_iter=3).groupBy("stage").agg(F.max("n_steps").alias("n")).collect()
    assert {r.stage: r.n for r in few} == {1: 3, 2: 2, 3: 3}
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(held.search(queries, 5, 16, chunk_size=7)) == rows(held.search(queries, 5, 16))
    assert rows(held.search(queries, 5, 16, max_iter=1)) != rows(held.search(queries, 5, 16))


def test_counts_of_one_by_one_steps():
    x = np.array([[0.0], [1.0], [2.0], [3.0]])
    g = Adjacency.of(np.arange(4), np.array([0, 1, 2]), np.array([1, 2, 3]), np.zeros(3, int))
    from vectorloom.operators.arrow_walk import Counts

    counts, trace = Counts(1), []
    ids, _, taken = beam(np.array([[3.0]]), x, g, np.array([[0]], np.int32), 2, Marks(1, 4).fresh(), width=1, counts=counts, trace=trace)
    assert ids[0].tolist() == [3, 2] and taken == 4 and (counts.steps[0], counts.visited[0], counts.computed[0]) == (4, 4, 3)
    assert np.concatenate([n for _, n, _ in trace]).tolist() == [0, 1, 2, 3]
