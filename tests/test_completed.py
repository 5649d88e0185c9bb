"""The exact check after a search, and the walk that drops nothing."""

import numpy as np
import pytest

from vectorloom.operators import exact, graph
from vectorloom.operators.walk import walk, walk_all
from vectorloom.plans.index import Config
from vectorloom.plans.scratch import written
from vectorloom.plans.sharded import ShardedIndex
from vectorloom.queries import SQL


def frame(spark, x, key="id"):
    return spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], f"{key} long, vec array<float>")


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(6)
    return written(frame(spark, rng.uniform(-1, 1, (300, 6)))), written(frame(spark, rng.uniform(-1, 1, (12, 6)), "qid"))


def rows(df):
    return sorted((r.qid, r["rank"], r.id, round(r.dist, 9)) for r in df.collect())


@pytest.mark.parametrize("found", ["id % 3 = 0", "id < 4", "false", "true"])
def test_check_adds_what_a_search_missed(data, found):
    base, q = data
    truth = exact.exact_knn(q, base, 10, 6)
    part = exact.exact_knn(q, base.where(found), 10, 6)
    assert rows(exact.completed(q, base, part, 10, 6)) == rows(truth)


def test_check_keeps_ties_by_id(spark):
    base, q = written(frame(spark, np.ones((40, 3)))), written(frame(spark, np.zeros((2, 3)), "qid"))
    part = exact.exact_knn(q, base.where("id > 20"), 5, 3)
    assert [r[2] for r in rows(exact.completed(q, base, part, 5, 3))] == [0, 1, 2, 3, 4] * 2


def test_walk_that_drops_nothing(spark, data):
    """Also where the graph has parts that no entry reaches."""
    base, q = data
    edges = written(graph.knn_graph(base, 2, 6))
    entries = base.where("id < 2").select("id")
    old = walk(q, base, edges, q.select("qid").crossJoin(entries), 300, 6)
    assert rows(walk_all(q, base, edges, entries, 10)) == rows(old.result(10)) and old.visited.count() < 12 * 300


def test_no_queries_for_shards(data, tmp_path):
    base, q = data
    held = ShardedIndex.build(base, Config(6, 3, 0.25, "nsw16", "random8", 1), 2, f"{tmp_path}/s")
    assert held.search(q.where("false"), 3, 8).collect() == []


def test_sharded_search_gives_distances():
    assert SQL["sharded_search"] == SQL["exact_knn"]
