"""A round of a walk compares its pairs in tasks that get the queries, with the distances of the relational form."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from vectorloom.operators import graph, walk
from vectorloom.plans.scratch import written


def frame(spark, x, key="id"):
    return spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], f"{key} long, vec array<float>")


@pytest.mark.parametrize("dims", [12, 5])
def test_pairs_have_the_bits_of_joins(spark, dims):
    rng = np.random.default_rng(3)
    base, q = written(frame(spark, rng.normal(size=(150, 12)))), written(frame(spark, rng.normal(size=(9, 12)), "qid"))
    pairs = written(q.select("qid").crossJoin(base.select("id")).where("(qid + id) % 3 <> 0").union(spark.range(9).select(F.col("id").alias("qid"), F.lit(999).cast("long"))))
    asked = q.withColumn("far", F.when(F.col("qid") == 4, F.lit(float("inf"))).otherwise(F.lit(float(dims))))
    found = walk._measured(pairs, pairs.count(), asked, base, dims).collect()
    true = [r for r in walk.with_distance(pairs, q, base, dims).collect() if r.qid == 4 or r.dist <= dims]
    assert sorted(map(tuple, found)) == sorted(map(tuple, true)) and len(found) > 100


def test_rounds_do_not_join_vectors_to_pairs(spark, monkeypatch):
    """Only the first pool, of the entries, is measured by joins; a walk visits each pair once."""
    calls = []
    joined = walk.with_distance
    monkeypatch.setattr(walk, "with_distance", lambda *a, **k: calls.append(1) or joined(*a, **k))
    base, q = written(frame(spark, np.random.default_rng(4).normal(size=(200, 6)))), written(frame(spark, np.random.default_rng(5).normal(size=(6, 6)), "qid"))
    edges = written(graph.nsw_graph(base, 8, 6))
    found = walk.walk(q, base, edges, q.select("qid").crossJoin(base.where("id < 4").select("id")), 12, 6)
    assert len(calls) == 1 and found.rounds > 1
    assert found.visited.count() == found.visited.distinct().count() and found.pool.count() == 72
