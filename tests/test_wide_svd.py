"""SVD and rotation beyond the width whose d x d sums are gathered."""

from __future__ import annotations

import numpy as np
import pytest
from vectorloom.operators import linalg
from vectorloom.plans.index import Config, StagedIndex


def table(spark, x: np.ndarray):
    return spark.createDataFrame([(i, row.tolist()) for i, row in enumerate(x)], "id long, vec array<double>").repartition(3)


def back(df) -> np.ndarray:
    return np.array([r.vec for r in df.orderBy("id").collect()])


def decaying(n: int, dims: int, seed: int = 0) -> np.ndarray:
    rng = np.random.default_rng(seed)
    left, right = np.linalg.qr(rng.normal(size=(n, 60)))[0], np.linalg.qr(rng.normal(size=(dims, 60)))[0]
    return left * (100 * 0.8 ** np.arange(60)) @ right.T


def test_4096_dimensions_keep_distances_and_lead_with_the_largest_directions(spark):
    x = decaying(120, 4096)
    df = table(spark, x)
    v, values = linalg.svd(df, 4096, rank=16)
    assert v.shape == (4096, 16) and np.allclose(v.T @ v, np.eye(16), atol=1e-10)
    assert np.allclose(values, np.linalg.svd(x, compute_uv=False)[:16], rtol=1e-6)
    y = back(linalg.rotate(df, v))
    assert y.shape == x.shape and np.allclose(y @ y.T, x @ x.T, atol=1e-8)
    assert np.allclose(y[:, :16], x @ v, atol=1e-9)


@pytest.mark.parametrize("rank", [1, 5, 11, 12])
def test_completed_is_a_rotation_with_these_first_columns(rank):
    for seed in range(5):
        v = np.linalg.qr(np.random.default_rng(seed).normal(size=(12, rank)))[0] * (-1) ** seed
        full = linalg.completed(v)(np.eye(12))
        assert np.allclose(full @ full.T, np.eye(12)) and np.allclose(full[:, :rank], v)
    for v in (np.eye(12)[:, :rank], -np.eye(12)[:, :rank], np.eye(12)[:, ::-1][:, :rank]):  # upper blocks that are whole, turned, singular
        full = linalg.completed(v)(np.eye(12))
        assert np.allclose(full @ full.T, np.eye(12)) and np.allclose(full[:, :rank], v)


def test_few_rows_and_none(spark):
    v, values = linalg.range_svd(table(spark, np.random.default_rng(1).normal(size=(3, 40))), 40, 8)
    assert np.allclose(v.T @ v, np.eye(8), atol=1e-9) and (values[:3] > 1).all() and np.allclose(values[3:], 0, atol=1e-5)
    v, values = linalg.range_svd(table(spark, np.zeros((0, 40))), 40, 8)
    assert np.allclose(v.T @ v, np.eye(8), atol=1e-9) and not values.any()


def test_limits(spark):
    df = table(spark, np.ones((2, 4)))
    for rank in (0, 5):
        with pytest.raises(ValueError):
            linalg.range_svd(df, 4, rank)
    with pytest.raises(ValueError):
        linalg.svd(df, 2000)
    with pytest.raises(ValueError):
        linalg.range_svd(df, 1 << 20, 100)


def test_a_wide_index_finds_its_neighbours(spark, tmp_path):
    x = np.random.default_rng(3).normal(size=(200, 1100)) * 0.97 ** np.arange(1100)
    df = table(spark, x)
    path = str(tmp_path / "wide")
    StagedIndex.build(df, Config(1100, 16, 0.5, "nsw16", "random8"), path)
    held = StagedIndex.load(spark, path)
    assert held.rotation().shape == (1100, 16)
    found = held.search(df.where("id < 20").selectExpr("id qid", "vec"), 5, 64).collect()
    d = ((x[:20, None] - x[None]) ** 2).sum(2)
    truth = {(i, int(j)) for i in range(20) for j in np.argsort(d[i])[:5]}
    assert len({(r.qid, r.id) for r in found} & truth) / len(truth) >= 0.95
