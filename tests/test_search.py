"""Graphs, entries, walks and indexes: invariants and recall floors."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from vectorloom.operators import entry, exact, graph, topk
from vectorloom.operators.arrow_walk import Adjacency, LocalIndex, Marks, beam
from vectorloom.operators.walk import walk
from vectorloom.plans.index import Config, StagedIndex, oracle_search, prefix_then_full, single_search
from vectorloom.plans.scratch import written
from vectorloom.plans.sharded import ShardedIndex

D = 12
CONFIG = Config(D, 6, 0.25, "nsw32", "random16", 1)


def frame(spark, x, key="id", first=0):
    return spark.createDataFrame([(first + i, [float(v) for v in r]) for i, r in enumerate(x)], f"{key} long, vec array<float>")


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(5)
    base, queries = written(frame(spark, rng.uniform(-1, 1, (400, D)))), written(frame(spark, rng.uniform(-1, 1, (15, D)), "qid"))
    return base, queries, written(exact.exact_knn(queries, base, 10, D))


@pytest.fixture(scope="module")
def edges(data):
    return written(graph.nsw_graph(data[0], 32, D))


def mean(found, truth):
    return topk.mean_recall(found, truth).first().recall


def test_graph_degrees_and_ranks(spark, data, edges):
    r = graph.degree_stats(edges).first()
    assert r.n_nodes == 400 and r.max_degree <= 32
    knn = graph.knn_graph(data[0], 5, D)
    assert knn.where("src = dst").count() == 0 and knn.count() == 2000


@pytest.mark.parametrize("part_rows", [4096, 32])
def test_cluster_graph_agrees_with_exact(data, part_rows):
    """Also where clusters are dealt into parts, whose pairs are all compared."""
    whole = {(r.src, r.dst) for r in graph.knn_graph(data[0], 8, D).collect()}
    found = {(r.src, r.dst) for r in graph.cluster_knn_graph(data[0], 8, D, per_cluster=80, probes=4, part_rows=part_rows).collect()}
    assert len(whole & found) / len(whole) > 0.9
    one = {(r.src, r.dst) for r in graph.cluster_knn_graph(data[0], 8, D, per_cluster=400, probes=1, part_rows=part_rows).collect()}
    assert one == whole  # one cluster: exact, however it is dealt
    with pytest.raises(ValueError):
        graph.knn_graph(data[0], 8, D, mode="guess")


@pytest.mark.parametrize("part_rows", [4096, 16])
def test_clusters_reach_the_recall_asked_for(spark, data, part_rows):
    """Without a number of probes, however small the clusters are; all centres are exact, an empty table has no edges."""
    whole = {(r.src, r.dst) for r in graph.knn_graph(data[0], 8, D).collect()}
    shares = []
    for recall in (0.5, 0.95, 1.0):
        found = {(r.src, r.dst) for r in graph.cluster_knn_graph(data[0], 8, D, per_cluster=20, part_rows=part_rows, recall=recall).collect()}
        shares.append(len(whole & found) / len(whole))
    assert shares[0] >= 0.45 and shares[1] >= 0.92 and shares[2] >= 0.99
    assert shares[0] < shares[1]
    few = {(r.src, r.dst) for r in graph.cluster_knn_graph(data[0], 8, D, per_cluster=20, probes=1).collect()}
    assert len(whole & few) / len(whole) < 0.5  # so one probe would not have been enough
    assert graph.cluster_knn_graph(data[0].limit(0), 8, D).count() == 0
    assert graph.knn_graph(data[0], 8, D, mode="clusters").count() == 400 * 8


def test_long_paths_are_reached(spark):
    edges = written(spark.createDataFrame([(i, i + 1) for i in range(67)] + [(200, 201)], "src long, dst long").coalesce(1))
    nodes = written(spark.createDataFrame([(i,) for i in [*range(68), 200, 201]], "id long").coalesce(1))
    assert sorted(r.id for r in graph.unreached(edges, nodes, 0).collect()) == [200, 201]


def test_diverse_edges_match_plain(spark, data):
    cand = written(graph.knn_graph(data[0], 20, D))
    x = {r.id: np.array(r.vec) for r in data[0].collect()}
    want = set()
    rows = {}
    for r in cand.collect():
        rows.setdefault(r.src, []).append((r.dist, r.dst))
    for u, found in rows.items():
        kept, rest = [], []
        for d, v in sorted(found):
            if len(kept) < 6:
                (kept if all(((x[v] - x[w]) ** 2).sum() >= d for w in kept) else rest).append(v)
        want |= {(u, v) for v in kept + rest[: 6 - len(kept)]}
    assert {(r.src, r.dst) for r in graph.diverse(cand, data[0], 6).collect()} == want


def test_pruned_edges_match_plain(spark, data):
    """Also where vectors are repeated, whose equal distances hide nothing."""
    x = np.array([r.vec for r in data[0].orderBy("id").limit(60).collect()])
    x = np.concatenate([x, x[:20]])
    df = written(frame(spark, x))
    cand = written(graph.knn_graph(df, 15, D))
    rows = {}
    for r in cand.collect():
        rows.setdefault(r.src, []).append((r.dist, r.dst))
    far = lambda a, b: ((x[a] - x[b]) ** 2).sum()
    want = {(u, v) for u, found in rows.items() for d, v in found if not any(e < d and far(v, w) < d * (1 - 1e-12) for e, w in found)}
    assert {(r.src, r.dst) for r in graph.prune(cand, df, D).collect()} == want and len(want) < cand.count()


def test_many_queries_do_not_pass_the_driver(data, monkeypatch):
    """Blocks of queries against parts of the base give what the relational form gives."""
    base, q, truth = data
    monkeypatch.setattr(exact, "DRIVER_BLOCKS", 0)
    monkeypatch.setattr(exact, "BLOCK_VALUES", 7 * D)  # blocks of 7 queries, parts of 7 vectors
    monkeypatch.setattr(exact, "BLOCK", 4)
    monkeypatch.setattr(q.__class__, "toLocalIterator", None)
    rows = lambda df: sorted((r.qid, r["rank"], r.id, round(r.dist, 9)) for r in df.collect())
    assert rows(exact.exact_knn_blocks(q, base, 10)) == rows(truth)
    assert exact.exact_knn_blocks(q, base.where("id < 3"), 10).count() == 45
    assert exact.exact_knn_blocks(q, base.where("id < 0"), 10).count() == 0


def test_walk_finds_the_same_without_broadcasts(data, edges, monkeypatch):
    from vectorloom.operators import walk as module

    base, q, _ = data
    init = written(q.select("qid").crossJoin(entry.random_entries(base, 8, 1).select("id")))
    rows = lambda w: sorted((r.qid, r["rank"], r.id) for r in w.result(10).collect())
    small = walk(q, base, edges, init, 16, D)
    monkeypatch.setattr(module, "FRONT_ROWS", 0)
    monkeypatch.setattr(module, "BLOCK_VALUES", 0)
    large = walk(q, base, edges, init, 16, D)
    assert rows(small) == rows(large) and small.rounds == large.rounds


def test_shards_are_bounded(data, tmp_path, monkeypatch):
    from vectorloom.plans import sharded as module

    base, q, truth = data
    monkeypatch.setattr(module, "SHARD_ROWS", 64)
    held = ShardedIndex.build(base, CONFIG, 1, f"{tmp_path}/s", moves=0)
    assert held.shards.count() >= 7 and held.shards.agg(F.max("n")).first()[0] <= 64 * 1.5 and held.shards.agg(F.sum("n")).first()[0] == 400
    assert mean(held.search(q, 10, 64), truth) > 0.9


def test_entries_of_each_query(spark, data):
    base, q, _ = data
    found = entry.query_entries(q, base, 8, 3).collect()
    by = {r.qid: {x.id for x in found if x.qid == r.qid} for r in found}
    assert len(by) == 15 and all(5 <= len(v) <= 8 for v in by.values()) and len(set(map(frozenset, by.values()))) == 15
    assert single_search(q, base, graph.nsw_graph(base, 16, D), entry.query_entries(q, base, 8, 3), 10, 32, D).count() == 150


def test_random_order_is_not_that_of_ids(spark):
    ids = [r.id for r in entry.random_entries(spark.range(100_000), 50, 1).collect()]
    assert max(ids) > 80_000 and len(set(ids)) == 50


def test_short_vectors_are_refused(spark, data, tmp_path):
    base, q, _ = data
    short = frame(spark, [[1.0] * (D - 1)], "qid")
    held = StagedIndex.build(base, Config(D, 6, 0.25, "nsw16", "random16", 1), f"{tmp_path}/d")
    for go in (lambda: exact.exact_knn(short, base, 3, D), lambda: held.search(short, 3, 8), lambda: StagedIndex.build(base, Config(D + 1, 6, 0.25, "nsw16", "random16", 1), f"{tmp_path}/e")):
        with pytest.raises(Exception, match="vector length"):
            go().collect()


def test_nsg_reaches_all_from_two_parts(spark):
    x = np.concatenate([np.random.default_rng(0).normal(0, 1, (40, 3)), np.random.default_rng(1).normal(500, 1, (40, 3))])
    df = frame(spark, x)
    bare = graph.nsg_graph(df, 6, 3, ef=10, repair=False)
    start = graph.medoid(df, 3)
    assert graph.unreached(written(bare), df.select("id"), start).count() > 0
    for mode in ("exact", "insert"):
        fixed = written(graph.nsg_graph(df, 6, 3, ef=10, mode=mode))
        assert graph.unreached(fixed, df.select("id"), start).count() == 0
        assert graph.degree_stats(fixed).first().max_degree <= 6


def test_build_graph_rejects_unknown(data):
    with pytest.raises(ValueError):
        graph.build_graph(data[0], "hnsw", 8, D)


def test_sample_is_closed_and_large_enough(data, edges):
    ids = data[0].select("id")
    s = written(graph.sample_nodes(edges, ids, 100, 1, 3))
    assert s.count() >= 100 and s.count() == s.distinct().count()
    assert {r.id for r in s.collect()} == {r.id for r in graph.sample_nodes(edges, ids, 100, 1, 3).collect()}
    sub = graph.subgraph(data[0], s, "nsw", 16, D)
    assert sub.join(s, sub.src == s.id, "left_anti").count() == 0


@pytest.mark.parametrize("hops", [1, 2, 3])
def test_sample_of_more_hops_equals_plain(spark, hops):
    import hashlib

    rng = np.random.default_rng(hops)
    links = {i: sorted({int(j) for j in rng.integers(0, 60, 2)} - {i}) for i in range(60)}
    edges = written(spark.createDataFrame([(i, j, 1) for i, own in links.items() for j in own], "src long, dst long, rank int"))
    found = {r.id for r in graph.sample_nodes(edges, spark.range(60), 20, hops, 5).collect()}
    want = set()
    for seed in sorted(range(60), key=lambda i: (int(hashlib.md5(f"{i}:5".encode()).hexdigest()[:8], 16), i)):
        if len(want) >= 20:
            break
        front = near = {seed}
        for _ in range(hops):
            front = {j for i in front for j in links[i]}
            near = near | front
        want |= near
    assert found == want


def test_router_guard_and_leaves(data):
    with pytest.raises(ValueError):
        entry.router_entries(data[0], 16, 16, D)
    routers, entries = entry.router_entries(data[0], 4, 8, D)
    assert routers.count() == 4 and entries.count() == 32
    x = {r.id: np.array(r.vec, np.float64) for r in data[0].collect()}
    rv = {r.router: np.array(r.vec) for r in routers.collect()}
    sums = {r: {s: sum(((x[e.id] - rv[s]) ** 2).sum() for e in entries.where(F.col("router") == r).collect()) for s in rv} for r in rv}
    assert all(min(v, key=v.get) == r for r, v in sums.items())
    with pytest.raises(ValueError):
        entry.parse_method("grid4")


def test_walk_recall_and_exhaustive(data, edges):
    base, q, truth = data
    found = single_search(q, base, edges, entry.random_entries(base, 16, 1), 10, 32, D)
    assert mean(found, truth) >= 0.6
    x = {r.id: np.array(r.vec) for r in base.collect()}
    y = {r.qid: np.array(r.vec) for r in q.collect()}
    assert all(abs(((x[r.id] - y[r.qid]) ** 2).sum() - r.dist) < 1e-3 for r in found.collect())
    init = q.select("qid").crossJoin(entry.random_entries(base, 16, 1).select("id"))
    assert mean(walk(q, base, edges, init, 400, D).result(10), truth) == 1.0


def test_walk_edge_cases(spark):
    x = frame(spark, [[0.0], [1.0], [5.0], [9.0]])
    links = spark.createDataFrame([(0, 1), (1, 0), (3, 2)], "src long, dst long")
    q = frame(spark, [[0.2]], "qid")
    init = spark.createDataFrame([(0, 0), (0, 0)], "qid long, id long")  # duplicate entries
    w = walk(q, x, links, init, 4, 1)
    assert sorted(r.id for r in w.result(4).collect()) == [0, 1]  # the other component is out of reach
    assert walk(q.where("qid < 0"), x, links, init.where("qid < 0"), 4, 1).result(4).count() == 0
    seen = spark.createDataFrame([(0, 1)], "qid long, id long")
    assert [r.id for r in walk(q, x, links, init, 4, 1, visited=seen).result(4).collect()] == [0]


def test_other_walks(data, edges):
    base, q, truth = data
    entries = entry.random_entries(base, 16, 1)
    assert mean(prefix_then_full(q, base, edges, entries, 10, 16, D, 6), truth) >= 0.5
    wide = exact.exact_knn(q, base, 16, D)
    assert mean(oracle_search(q, base, edges, wide, 10, 16, D, 0.5), truth) >= 0.5


@pytest.mark.parametrize("method", ["random16", "router4x8"])
def test_staged_index_round_trip(spark, data, tmp_path, method):
    base, q, truth = data
    held = StagedIndex.build(base, Config(D, 6, 0.25, "nsw32", method, 1), f"{tmp_path}/a")
    assert mean(held.search(q, 10, 64), truth) > 0.9
    assert mean(held.search(q, 10, 400), truth) == 1.0
    held.save(f"{tmp_path}/b")
    again = StagedIndex.load(spark, f"{tmp_path}/b")
    key = lambda df: sorted((r.qid, r["rank"], r.id) for r in df.collect())
    assert again.config == held.config and key(again.search(q, 10, 32)) == key(held.search(q, 10, 32))
    assert mean(held.search(q, 10, 400, tier="exact"), truth) == 1.0
    with pytest.raises(ValueError):
        held.search(q, 10, 9)


def test_a_stopped_build_goes_on(spark, data, tmp_path, monkeypatch):
    import os
    import shutil

    base, q, _ = data
    whole = StagedIndex.build(base, CONFIG, f"{tmp_path}/whole")
    rows = lambda df: sorted(map(str, df.collect()))
    want = rows(whole.search(q, 10, 32))
    for name in ("edges", "sub_edges", "entries"):
        at = f"{tmp_path}/{name}"
        shutil.copytree(f"{tmp_path}/whole", at)
        os.remove(f"{at}/{name}/_SUCCESS")
        os.remove(f"{at}/config/_SUCCESS")
        with pytest.raises(ValueError, match="no whole index"):
            StagedIndex.load(spark, at)
        before = os.stat(f"{at}/vectors/_SUCCESS").st_mtime_ns
        again = StagedIndex.build(base, CONFIG, at)
        assert os.stat(f"{at}/vectors/_SUCCESS").st_mtime_ns == before
        assert rows(again.tables[name]) == rows(whole.tables[name]) and rows(again.search(q, 10, 32)) == want
    with pytest.raises(ValueError, match="other vectors"):
        StagedIndex.build(base.where("id < 100"), CONFIG, f"{tmp_path}/whole")


def test_whole_sample_and_width(data, tmp_path):
    base, q, truth = data
    held = StagedIndex.build(base, Config(D, D, 1.0, "nsw32", "random16", 1), f"{tmp_path}/c")
    assert mean(held.search(q, 10, 64), truth) > 0.9


def test_sharded(spark, data, tmp_path):
    base, q, truth = data
    held = ShardedIndex.build(base, CONFIG, 5, f"{tmp_path}/s")
    assert mean(held.search(q, 10, 64), truth) > 0.95
    again = ShardedIndex.load(spark, f"{tmp_path}/s")
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(again.search(q, 10, 32)) == rows(held.search(q, 10, 32))
    few = [mean(held.search(q, 10, 64, probes=p), truth) for p in (1, 3, 5)]
    assert few[0] < few[1] <= few[2] and few[1] > 0.7
    assert held.search(q.where("false"), 3, 8).collect() == []


def test_a_search_of_shards_shuffles_no_vectors(data, tmp_path):
    base, q, _ = data
    held = ShardedIndex.build(base, CONFIG, 3, f"{tmp_path}/s")
    plan = held.search(q, 10, 32, probes=2)._jdf.queryExecution().executedPlan().toString()
    below = plan.split("Exchange hashpartitioning(qid")
    assert len(below) == 2 and "Exchange" not in below[1] and "MapInArrow" in below[1]


def test_sharded_searches_more_queries_than_a_block(data, tmp_path, monkeypatch):
    from vectorloom.plans import sharded as module

    base, q, truth = data
    held = ShardedIndex.build(base, CONFIG, 3, f"{tmp_path}/s")
    monkeypatch.setattr(module, "QUERY_VALUES", 6 * D)
    found = held.search(q, 10, 64)
    assert found.count() == 150 and mean(found, truth) > 0.9


def test_beam_single_node_and_duplicates():
    x = np.array([[0.0, 1.0]])
    g = Adjacency.of(np.array([7]), np.zeros(0, int), np.zeros(0, int), np.zeros(0, int))
    ids, d, _ = beam(np.zeros((2, 2)), x, g, np.array([[0, -1], [0, 0]], np.int32)[:, :1], 4, Marks(2, 1).fresh())
    assert ids[:, 0].tolist() == [0, 0] and d[0, 0] == 1.0


def test_sweeps(spark, data, edges, tmp_path):
    from vectorloom.plans import sweeps
    from vectorloom.sources import vector_files as files

    base, q, _ = data
    rows = sweeps.oracle_ablation(q, base, edges, (0.25, 1.0), (16,), D).collect()
    assert [(r.known, r.ef) for r in rows] == [(0.25, 16), (1.0, 16)] and rows[1].recall >= rows[0].recall > 0.5
    files.write_bins(base, f"{tmp_path}/deep-64k/base.fbin")
    files.write_bins(q, f"{tmp_path}/deep-64k/query.fbin", "qid")
    made = files.write_truth(files.Dataset(base, q, None), f"{tmp_path}/deep-64k", n_queries=30, k=10)
    index = sweeps.build_job(spark, "deep-64k", str(tmp_path), Config(D, 6, 0.25, "nsw32", "random16", 1), f"{tmp_path}/index")
    found = sweeps.sweep_saved(spark, f"{tmp_path}/index", files.load_dataset(spark, "deep-64k", str(tmp_path)), (16, 64), n_queries=20).collect()
    assert made.queries.count() == 30 and [r.ef for r in found] == [16, 64] and found[1].recall > 0.95 and all(r.milliseconds > 0 for r in found)
    both = {r["mode"]: r.recall for r in sweeps.single_or_staged(index, q, base, (32,)).collect()}
    assert set(both) == {"single", "staged"} and min(both.values()) > 0.6


def test_kernel_finds_the_same_as_walking_one_by_one(data, edges):
    """A plain best-first search, one node at a time, finds no more than the kernel."""
    import heapq

    x = np.array([r.vec for r in data[0].orderBy("id").collect()])
    q = np.array([r.vec for r in data[1].orderBy("qid").collect()])
    e = edges.toPandas()
    g = Adjacency.of(np.arange(400), e.src.to_numpy(), e.dst.to_numpy(), e["rank"].to_numpy())
    start = np.arange(0, 400, 25, dtype=np.int32)
    local = LocalIndex(np.arange(400), x, g, None, 0, start[None], None)
    truth = np.argsort(((q[:, None] - x[None]) ** 2).sum(2), 1)[:, :10]
    for ef in (16, 48):
        found, dist = local.search(q, 10, ef)
        assert np.allclose(dist, ((x[found].astype(np.float32) - q[:, None]) ** 2).sum(2), atol=1e-5)
        plain = []
        for v in q:
            d = lambda i: float(((x[i] - v) ** 2).sum())  # noqa: B023, E731
            seen = set(start.tolist())
            pool = sorted((d(i), i) for i in seen)[:ef]
            todo = list(pool)
            heapq.heapify(todo)
            while todo:
                far, i = heapq.heappop(todo)
                if len(pool) == ef and far > pool[-1][0]:
                    break
                for j in g.rows[i]:
                    if j >= 0 and j not in seen:
                        seen.add(j)
                        heapq.heappush(todo, (d(j), j))
                        pool = sorted([*pool, (d(j), j)])[:ef]
            plain.append([i for _, i in pool[:10]])
        hits = lambda ids: sum(len(set(a) & set(b)) for a, b in zip(ids, truth))
        assert hits(found) >= hits(plain) - 2
