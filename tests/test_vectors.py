"""Distances, top-k, recall, rotation: against numpy, with the edge cases of the fixtures."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from vectorloom.functions.vectors import checked, ef_bucket, l2sq
from vectorloom.operators import exact, linalg, topk


def frame(spark, x, key="id", first=0):
    return spark.createDataFrame([(first + i, [float(v) for v in r]) for i, r in enumerate(x)], f"{key} long, vec array<float>")


def brute(q, x, k):
    d = ((q[:, None, :].astype(np.float32).astype(np.float64) - x[None].astype(np.float32).astype(np.float64)) ** 2).sum(2)
    return np.argsort(d, axis=1, kind="stable")[:, :k], np.sort(d, axis=1)[:, :k]


@pytest.mark.parametrize("dims", [5, 20, 130])
def test_exact_matches_numpy(spark, dims):
    rng = np.random.default_rng(dims)
    x, q = rng.normal(0, 3, (200, dims)), rng.normal(0, 3, (7, dims))  # not unit vectors: L2 differs from cosine
    ids, dist = brute(q, x, 5)
    for found in (exact.exact_knn(frame(spark, q, "qid"), frame(spark, x), 5, dims), exact.exact_knn_blocks(frame(spark, q, "qid"), frame(spark, x), 5)):
        rows = sorted(found.collect(), key=lambda r: (r.qid, r["rank"]))
        assert [r.id for r in rows] == ids.ravel().tolist()
        assert np.allclose([r.dist for r in rows], dist.ravel(), atol=1e-3)


def test_edges_of_exact(spark):
    x = np.array([[1, 2], [1, 2], [0, 0]])
    base = frame(spark, x)
    assert exact.exact_knn(frame(spark, x[:0], "qid"), base, 3, 2).count() == 0
    assert exact.exact_knn_blocks(frame(spark, x[:0], "qid"), base, 3).count() == 0
    assert exact.exact_knn(frame(spark, x[:1], "qid"), base, 10, 2).count() == 3  # k > N
    tie = exact.exact_knn_blocks(frame(spark, x[:1], "qid"), base, 1).first()
    assert (tie.id, tie.dist) == (0, 0.0)
    assert exact.exact_knn_blocks(frame(spark, x[:1], "qid"), base.where("id < 0"), 2).count() == 0


def test_residual_completes_prefix(spark):
    rng = np.random.default_rng(1)
    df = spark.createDataFrame([(rng.normal(size=20).tolist(), rng.normal(size=20).tolist())], "a array<double>, b array<double>")
    r = df.select(l2sq("a", "b", 20).alias("all"), (l2sq("a", "b", 7) + l2sq("a", "b", 20, 7)).alias("parts")).first()
    assert abs(r["all"] - r.parts) < 1e-9


def test_checked_and_buckets(spark):
    with pytest.raises(Exception, match="vector length"):
        frame(spark, np.zeros((1, 3))).select(checked("vec", 4)).collect()
    assert [ef_bucket(e) for e in (1, 16, 17, 200, 2048)] == [16, 16, 32, 256, 2048]
    with pytest.raises(ValueError):
        ef_bucket(2049)


def test_plan_limits_before_shuffle(spark):
    q, b = frame(spark, np.zeros((2, 4)), "qid"), frame(spark, np.zeros((9, 4)))
    plan = exact.exact_knn(q, b, 2, 4)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Python" not in plan and "InArrow" not in plan


def test_recall_and_heap(spark):
    rows = lambda pairs: spark.createDataFrame(pairs, "qid long, id long")
    r = topk.mean_recall(rows([(1, 1), (1, 1), (1, 9)]), rows([(1, 1), (1, 2), (2, 5)])).first()
    assert (r.recall, r.n_queries) == (0.25, 2)
    heap = lambda v: spark.createDataFrame([(0, float(k), i) for i, k in v], "heap long, key double, value long")
    kept = topk.heap_pushpop(heap([(1, 5), (2, 1)]), heap([(3, 3), (4, 0)]), 2)
    assert sorted(r.value for r in kept.collect()) == [2, 4]
    assert topk.heap_pop(heap([(1, 5), (2, 1)])).first().value == 2
    mask = topk.bitmask_put(spark.createDataFrame([(k,) for k in (0, 7, 7, 40000, -1)], "key long"))
    assert topk.bitmask_keys(mask).first().n_keys == 3


@pytest.mark.parametrize("size", [None, 50])
def test_svd_is_a_rotation(spark, size):
    x = np.random.default_rng(2).normal(size=(300, 9)) * np.arange(1, 10)
    df = frame(spark, x)
    v, s = linalg.svd(df, 9, max_size=size, seed=3)
    assert np.allclose(v.T @ v, np.eye(9), atol=1e-9) and (np.diff(s) <= 1e-9).all()
    back = np.array([r.vec for r in linalg.rotate(linalg.rotate(df, v), v.T).orderBy("id").collect()])
    assert np.allclose(back, x.astype(np.float32), atol=1e-3)
    if size is None:
        assert np.allclose(s, np.linalg.svd(x.astype(np.float32), compute_uv=False), rtol=1e-4)


def test_draw_is_with_replacement(spark):
    df = spark.range(5)
    drawn = linalg.draw(df, 40, 1)
    assert drawn.count() == 40 and drawn.select("id").distinct().count() <= 5
    assert linalg.draw(df.where("id < 0"), 4).count() == 0
    assert drawn.agg(F.countDistinct("draw")).first()[0] == 40
