"""An index and its build reach the tasks by the shuffle, not through the driver."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark import SparkContext
from pyspark.sql import functions as F

from vectorloom.operators import insertion
from vectorloom.operators.arrow_walk import laid_out
from vectorloom.operators.whole import dealt, with_whole
from vectorloom.plans.index import Config, StagedIndex
from vectorloom.plans.scratch import written


def frame(spark, x, key="id"):
    return spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], f"{key} long, vec array<float>")


@pytest.fixture
def closed(spark, monkeypatch):
    """Neither tables of many rows nor broadcasts pass the driver; the rotation does."""
    frames = type(spark.range(1))

    def few(df, gathered=frames.toArrow):
        assert len(table := gathered(df)) < 100
        return table

    def refuse(*_):
        raise AssertionError("passes the driver")

    monkeypatch.setattr(frames, "toArrow", few)
    monkeypatch.setattr(SparkContext, "broadcast", refuse)
    return monkeypatch


@pytest.mark.parametrize("entries", ["random8", "router4x2"])
def test_index_does_not_pass_the_driver(spark, tmp_path, closed, entries):
    rng = np.random.default_rng(8)
    base, q = written(frame(spark, rng.normal(size=(500, 8)))), written(frame(spark, rng.normal(size=(20, 8)), "qid"))
    held = StagedIndex.build(base, Config(8, 4, 0.25, "nsw16", entries, 1), f"{tmp_path}/i")
    rows = lambda df: sorted(map(tuple, df.collect()))
    found = rows(held.search(q, 5, 32))
    assert len(found) == 100 and held.search(q.where("false"), 5, 32).collect() == []
    closed.undo()
    assert rows(held.deploy().search(q, 5, 32)) == found


def test_insertion_does_not_pass_the_driver(spark, closed):
    base = written(frame(spark, np.random.default_rng(9).normal(size=(700, 6))))
    edges = written(insertion.insert_graph(base, 12, 6, base=128))
    assert edges.groupBy("src").count().agg(F.max("count")).first()[0] <= 12
    assert insertion.reached(edges, base.where("id = 0").select("id")).count() == 700


def test_every_task_sees_all(spark):
    def run(share, rows):
        yield pa.RecordBatch.from_arrays([share.column("id").combine_chunks(), pa.array([len(rows)] * len(share)), pa.array([len(share)] * len(share))], ["id", "n", "own"])

    found = with_whole(spark.range(90), spark.range(40).select("id", F.lit("x").alias("more")), run, "id long, n long, own long", "id", 3).collect()
    assert sorted(r.id for r in found) == list(range(90)) and {r.n for r in found} == {40} and len({r.own for r in found}) > 1
    none = with_whole(spark.range(5), spark.range(0), run, "id long, n long, own long", "id", 2).collect()
    assert len(none) == 5 and {r.n for r in none} == {0}


def test_lists_with_nulls_and_many_batches():
    part = lambda ids, links: pa.table({"id": ids, "vec": pa.array([[float(i), 1.0] for i in ids], pa.list_(pa.float32())), "links": pa.array(links, pa.list_(pa.int64()))})
    ids, x, graph = laid_out(pa.concat_tables([part([9, 2], [[2, 5], None]), part([5], [[9]])]), "links")
    assert ids.tolist() == [2, 5, 9] and x[:, 0].tolist() == [2, 5, 9]
    assert graph.rows.tolist() == [[-1, -1], [2, -1], [0, 1]]


def test_no_null_lists_are_dealt(spark):
    """Rows without vectors beside rows with them: null lists made a batch cost the square of its rows."""
    base = written(frame(spark, np.ones((6, 3))))
    for asked, whole in ((spark.range(40).select("id"), base), (base, spark.range(40).select("id"))):
        cells = dealt(asked, whole, "id", 3)
        side = "all" if whole is base else "share"
        assert cells.count() == asked.count() + 3 * whole.count()
        assert cells.where(f"{side}.vec IS NULL").count() == 0 and cells.where("asks").count() == asked.count()
