"""sql_functions compares no pair of vectors by a row of its own; long sums are not unrolled."""

from pyspark.sql import functions as F

from vectorloom import queries
from vectorloom.functions.vectors import l2sq


def test_no_join_of_all_pairs(spark):
    plan = queries.sql_functions(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "Join Cross" not in plan and "MapInArrow" in plan


def test_wide_distances_stay_in_small_code(spark):
    df = spark.createDataFrame([([1.0] * 64, [3.0] * 64)], "a array<double>, b array<double>")
    found = df.select(l2sq("a", "b", 64).alias("d"), l2sq("a", "b", 64, 60).alias("r"))
    assert tuple(found.first()) == (256.0, 16.0)
    assert len(found._jdf.queryExecution().executedPlan().toString()) < 5000
    assert df.select(F.col("a")[0]).first()[0] == 1.0
