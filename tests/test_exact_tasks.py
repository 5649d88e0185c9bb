"""Exact neighbours in tasks of bounded size."""

import tracemalloc

import numpy as np

from vectorloom.operators import exact


def frame(spark, x, key="id"):
    return spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], f"{key} long, vec array<float>")


def test_each_pair_of_blocks_has_a_task(spark, monkeypatch):
    monkeypatch.setattr(exact, "DRIVER_BLOCKS", 0)
    monkeypatch.setattr(exact, "LEAST_PART", 16)
    rng = np.random.default_rng(3)
    q, x = rng.integers(0, 3, (90, 4)), rng.integers(0, 3, (200, 4))  # many equal distances
    cells = exact._grid(frame(spark, q, "qid"), frame(spark, x), 5, 30, 100)
    assert cells.rdd.getNumPartitions() == 3 * 4  # three tasks a core, where two parts would do for the size
    d = ((q[:, None] - x[None]) ** 2).sum(2)
    want = {(i, int(j), float(d[i, j])) for i in range(90) for j in np.argsort(d[i], kind="stable")[:5]}
    assert {(r.qid, r.id, r.dist) for r in exact.exact_knn_blocks(frame(spark, q, "qid"), frame(spark, x), 5).collect()} == want


def test_memory_of_a_task_is_that_of_a_tile():
    rng = np.random.default_rng(4)
    q, x, ids = rng.normal(size=(4096, 16)), rng.normal(size=(6000, 16)), np.arange(6000)
    tracemalloc.start()
    exact._best(np.arange(4096), q, [(ids, x)], 20)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 100e6  # 4,096 x 2,048 distances alone are 67 MB


def test_equal_vectors_go_by_id():
    x, ids = np.ones((5000, 3)), np.random.default_rng(5).permutation(5000)
    found = exact._best(np.arange(3), np.ones((3, 3)), [(ids[:2500], x[:2500]), (ids[2500:], x[2500:])], 4).to_pydict()
    assert found["id"] == [0, 1, 2, 3] * 3 and set(found["dist"]) == {0.0}


def test_all_pairs_go_by_blocks(spark, monkeypatch):
    monkeypatch.setattr(exact, "PAIR_QUERIES", 20)
    monkeypatch.setattr(exact, "PAIR_PART", 25)
    monkeypatch.setattr(exact, "DIFF_VALUES", 64)  # several tiles a task
    rng = np.random.default_rng(6)
    q, x = rng.normal(size=(50, 5)).astype(np.float32), rng.normal(size=(120, 5)).astype(np.float32)
    pairs = exact.block_distances(frame(spark, q, "qid"), frame(spark, x), 4, 1)
    assert pairs.rdd.getNumPartitions() == 3 * 5 and "BroadcastNestedLoopJoin" not in pairs._jdf.queryExecution().toString()
    d = (q[:, None].astype(float) - x[None]) ** 2
    found = {(r.qid, r.id): (r.head, r.rest) for r in pairs.collect()}
    assert len(found) == pairs.count() == 50 * 120
    for (i, j), pair in found.items():
        np.testing.assert_allclose(pair, (d[i, j, 0], d[i, j, 1:4].sum()), rtol=1e-12)


def test_a_null_vector_gives_null_distances(spark):
    q = spark.createDataFrame([(1, [1.0, 2.0]), (2, None)], "qid long, vec array<float>")
    b = spark.createDataFrame([(7, [1.0, 4.0]), (8, None)], "id long, vec array<float>")
    assert sorted(map(tuple, exact.block_distances(q, b, 2).collect()), key=str) == [(1, 7, 4.0), (1, 8, None), (2, 7, None), (2, 8, None)]
    assert exact.block_distances(q.where("false"), b, 2).count() == exact.block_distances(q, b.where("false"), 2).count() == 0


def test_queries_of_all_pairs_send_no_table_through_the_driver(spark, tmp_path):
    from vectorloom.queries import prefix_dist, residual_dist, square_dist_nodelist

    rows = [(i, [float(v) for v in np.random.default_rng(i).normal(size=64)], 0) for i in range(100)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    for query, n in ((prefix_dist, 4 * 96), (residual_dist, 4 * 96), (square_dist_nodelist, 4 * sum(i % 25 > 0 and i % 7 == 1 for i in range(100)))):
        df = query(spark, str(tmp_path))
        assert df.count() == n and "Broadcast" not in df._jdf.queryExecution().toString()
