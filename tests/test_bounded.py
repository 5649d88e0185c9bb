"""Exact neighbours by bounds against brute force, and vectors that no caller may pass."""

import numpy as np
import pyarrow as pa
import pytest

from vectorloom.operators import bounded, exact, linalg
from vectorloom.operators.graph import knn_graph


def frame(spark, x, key="id"):
    return spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], f"{key} long, vec array<double>")


def brute(q, x, k):
    d = ((q[:, None, :] - x[None, :, :]) ** 2).sum(2)
    order = np.lexsort((np.broadcast_to(np.arange(len(x)), d.shape), d))[:, :k]
    return sorted((i, int(j), round(float(d[i, j]), 9), r + 1) for i in range(len(q)) for r, j in enumerate(order[i]))


@pytest.mark.parametrize("kind", ["clusters", "uniform", "copies"])
def test_equals_brute_force(spark, kind, monkeypatch):
    rng = np.random.default_rng(1)
    x = {"clusters": rng.normal(0, 20, (25, 6))[rng.integers(0, 25, 1500)] + rng.normal(0, 0.3, (1500, 6)), "uniform": rng.uniform(-1, 1, (300, 6)), "copies": np.concatenate([np.zeros((300, 6)), rng.normal(0, 1, (100, 6))])}[kind]
    q = x[:60] + rng.normal(0, 0.1, (60, 6))
    monkeypatch.setattr(bounded, "LOT", 64)
    monkeypatch.setattr(bounded, "BLOCK", 16)
    found, pairs = bounded.bounded_knn(frame(spark, q, "qid"), frame(spark, x), 10)
    assert sorted((r.qid, r.id, round(r.dist, 9), r.rank) for r in found.collect()) == brute(q, x, 10)
    n = pairs.first()
    assert n.n_all == len(q) * len(x) and n.n_pairs <= n.n_all
    if kind == "clusters":
        assert n.n_pairs < n.n_all / 8


def test_few_and_no_vectors(spark):
    x, q = np.eye(4), np.ones((3, 4))
    found, _ = bounded.bounded_knn(frame(spark, q, "qid"), frame(spark, x), 10)
    assert sorted((r.qid, r.id, round(r.dist, 9), r.rank) for r in found.collect()) == brute(q, x, 4)
    none = frame(spark, x).where("false")
    for a, b in ((frame(spark, q, "qid"), none), (frame(spark, q, "qid").where("false"), frame(spark, x))):
        found, pairs = bounded.bounded_knn(a, b, 3)
        assert found.collect() == [] and pairs.first().n_pairs == 0


RAGGED, NULL, HOLE = [[1.0, 2.0, 3.0], [1.0]], [[1.0, 2.0], None], [[1.0, 2.0], [1.0, None]]


@pytest.mark.parametrize("rows", [RAGGED, NULL, HOLE])
def test_ragged_and_null_vectors_are_refused(spark, rows):
    with pytest.raises(ValueError, match="null|coordinates"):
        exact.matrix(pa.array(rows, pa.list_(pa.float64())))
    df = spark.createDataFrame(list(enumerate(rows)), "id long, vec array<double>").coalesce(1)
    good = frame(spark, np.ones((2, 2)), "qid")
    asked = df.withColumnRenamed("id", "qid")
    for go in (
        lambda: exact.exact_knn_blocks(good, df, 1), lambda: exact.exact_knn_blocks(asked, frame(spark, np.ones((2, 2))), 1), lambda: bounded.bounded_knn(good, df, 1)[0],
        lambda: linalg.gram(df, 2), lambda: linalg.rotate(df, np.eye(2)), lambda: knn_graph(df, 1, 2, mode="clusters"),
    ):
        with pytest.raises(Exception, match="null|coordinates|length|dimension|shape"):
            go().collect()
