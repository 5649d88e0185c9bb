"""The pipeline on a small fixture, stage by stage."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as p
from vectorloom.llm import common

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(0)
    line = lambda n: " ".join(f"w{rng.randrange(3000)}" for _ in range(n))
    texts = [line(rng.randrange(100, 300)) for _ in range(150)]
    near = texts[0].split()
    near[5] = "other"
    texts += [texts[1], texts[2] + " ", " ".join(near), None, ""] + [" ".join(x.upper() + "!!" for x in line(80).split()) for _ in range(40)]
    rows = [(i, t, ["en", "de"][i % 2], f"s{i % 3}", len(t or "")) for i, t in enumerate(texts)]
    at = str(tmp_path_factory.mktemp("corpus"))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(i, int(i < 150), 0) for i in range(len(rows)) if i < 150 or i > 154], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    return at


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    q = p.quality(spark, docs, folder)
    ids = {r.doc_id for r in q.collect()}
    assert q.columns == COLUMNS and len(ids & set(range(150))) >= 148 and len(ids & set(range(155, 195))) <= 2
    e = p.exact(spark, docs, folder)
    ids = {r.doc_id for r in e.collect()}
    assert e.columns == COLUMNS and 150 not in ids and 1 in ids and 151 in ids and 2 not in ids and len(ids & {153, 154}) == 1
    n = p.near(spark, e, folder)
    assert n.columns == COLUMNS and 152 not in {r.doc_id for r in n.collect()} and {0, 1, 3} <= {r.doc_id for r in n.collect()}
    m = p.mixing(spark, docs, folder)
    assert m.columns == COLUMNS and 0 < m.count() <= docs.count()


@pytest.mark.parametrize("most", [8192, 0])
def test_awkward_rows(spark, folder, monkeypatch, most):
    """Equal and null ids, nulls in all columns, no words, a long text, and columns named like those of the stages; by bitmaps and by a join."""
    monkeypatch.setattr(common.rows_among, "__defaults__", (True, most))
    long = " ".join(f"v{i % 9973}" for i in range(120_000))
    rows = [(1, "a b"), (1, "a  b"), (None, "c d e"), (None, "c d e"), (None, None), (2, ""), (3, " "), (4, long), (5, long + " more"), (6, "x y z"), (6, "p q r")]
    docs = spark.createDataFrame([(i, t, None, None, None) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(2)
    for c in ("kept_doc_id", "kept", "row_number", "rid", "word", "bits", "fold", "node", "label", "probability", "chosen"):
        docs = docs.withColumn(c, F.lit("clash"))
    docs.write.mode("overwrite").parquet(f"{folder}/awkward.parquet")
    docs = spark.read.parquet(f"{folder}/awkward.parquet")
    pairs = lambda df: sorted((r.doc_id or 0, r.text) for r in df.collect())
    e = p.exact(spark, docs, folder)
    assert e.columns == docs.columns and pairs(e.where("text is not null and text <> ''")) == [(0, "c d e"), (1, "a  b"), (3, " "), (4, long), (5, long + " more"), (6, "p q r"), (6, "x y z")]
    n = p.near(spark, docs, folder)
    assert n.columns == docs.columns and pairs(n.where("length(text) > 1")) == [(0, "c d e"), (1, n.where("doc_id = 1").first().text), (4, long), (6, "p q r"), (6, "x y z")]
    assert n.where("trim(coalesce(text, '')) = ''").count() == 1
    for stage in (p.quality, p.mixing):
        found = stage(spark, docs, folder)
        assert found.columns == docs.columns and set(pairs(found.fillna("", ["text"]))) <= set(pairs(docs.fillna("", ["text"])))
    assert p.packing(spark, docs, folder).where("piece = 0").count() == len(rows)


def test_run(spark, folder):
    rows = p.run(spark, folder).collect()
    assert rows and {"doc_id", "piece", "sequence_id", "offset"} <= set(rows[0].asDict())


def test_no_rows(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").where("doc_id < 0")
    assert [stage(spark, docs, folder).count() for _, stage in p.STAGES] == [0] * 5
