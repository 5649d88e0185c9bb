"""The table function gives what the index gives."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from vectorloom.plans import sql
from vectorloom.plans.index import Config, StagedIndex
from vectorloom.plans.scratch import new_path, written

D = 12


@pytest.fixture(scope="module")
def held(spark):
    rng = np.random.default_rng(8)
    rows = lambda n: [(i, [float(v) for v in rng.uniform(-1, 1, D)]) for i in range(n)]
    base = written(spark.createDataFrame(rows(200), "id long, vec array<float>"))
    queries = written(spark.createDataFrame(rows(30), "qid long, vec array<float>"))
    index = StagedIndex.build(base, Config(D, 6, 0.25, "nsw16", "random8"), new_path(spark, "index"))
    sql.register(spark, "nearest_rows", index)
    queries.createOrReplaceTempView("asked")
    return index, queries


def _rows(df):
    return sorted((r.qid, r["rank"], r.id, round(r.dist, 9)) for r in df.collect())


def test_same_as_search(spark, held):
    index, queries = held
    got = spark.sql("SELECT * FROM nearest_rows(TABLE(SELECT 'more' AS note, vec, qid FROM asked), 5, 32)")
    assert _rows(got) == _rows(index.search(queries, 5, 32)) and got.count() == 150


def test_lots_of_queries(spark, held):
    """More queries than a lot, in one partition, joined to a table afterwards."""
    index, queries = held
    many = queries.crossJoin(spark.range(100).withColumnRenamed("id", "copy")).select((F.col("qid") + 1000 * F.col("copy")).alias("qid"), "vec").coalesce(1)
    written(many).createOrReplaceTempView("many")
    got = spark.sql("SELECT n.qid % 1000 AS qid, n.rank, n.id, n.dist FROM nearest_rows(TABLE(many), 3, 16) n JOIN many m ON m.qid = n.qid")
    assert got.count() == 9000
    assert _rows(got.distinct()) == _rows(index.search(queries, 3, 16))


def test_empty_and_wrong_vectors(spark, held):
    assert spark.sql("SELECT * FROM nearest_rows(TABLE(SELECT * FROM asked WHERE qid < 0), 5, 32)").count() == 0
    with pytest.raises(Exception, match="12 coordinates"):
        spark.sql("SELECT * FROM nearest_rows(TABLE(SELECT qid, slice(vec, 1, 5) AS vec FROM asked), 5, 32)").collect()


def test_scalar_functions(spark):
    sql.register_functions(spark)
    a, b = [1.0, 2.0, 4.0], [0.0, 5.0, 2.0]
    df = spark.createDataFrame([(a, b), (a, [1.0]), (None, b)], "a array<double>, b array<double>").createOrReplaceTempView("scalar_pairs")
    found = spark.sql("SELECT vec_l2sq(a, b) AS d, vec_prefix_l2sq(a, b, 1) AS p, vec_residual_l2sq(a, b, 1) AS r FROM scalar_pairs")
    assert df is None and [tuple(r) for r in found.collect()][0] == (14.0, 1.0, 13.0) and [r.d for r in found.collect()][1:] == [None, None]
    assert "Python" not in found._jdf.queryExecution().executedPlan().toString()
    assert spark.sql("SELECT vec_recall(array(1L, 2L, 2L, 9L), array(1L, 2L, 3L, 4L)) AS r").first().r == 0.5
