"""Near copies against all pairs compared."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpus_pipeline import near
from vectorloom.llm import near_copies as nc
from vectorloom.llm import simhash
from vectorloom.llm.common import stored

SCHEMA = "doc_id long, text string"


def shingled(text):
    w = (text or "").lower().split()
    return {" ".join(w[i : i + 5]) for i in range(len(w) - 4)} or ({" ".join(w)} if w else set())


def families(rng):
    """Texts with copies of which one word in 40 to 200 is another: similarities on both sides of 0.8."""
    texts = []
    for _ in range(40):
        base = [f"w{rng.randrange(5000)}" for _ in range(rng.randrange(60, 400))]
        texts.append(" ".join(base))
        for _ in range(6):
            every = rng.randrange(40, 200)
            texts.append(" ".join("other" + w if rng.randrange(every) == 0 else w for w in base))
    return texts


@pytest.mark.parametrize("bucket,block", [(128, 256), (2, 3)])
def test_components_are_those_of_all_similar_pairs(spark, bucket, block):
    texts = families(random.Random(1)) + [None, "", "One two", "one  TWO", "three"]
    sets, low = [shingled(t) for t in texts], list(range(len(texts)))
    find = lambda x: x if low[x] == x else find(low[x])
    linked = 0
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a == b or len(a & b) >= 0.8 * len(a | b):
                linked += 1
                low[max(find(i), find(j))] = min(find(i), find(j))
    found = nc.near_copies(stored(spark.createDataFrame(list(enumerate(texts)), SCHEMA).repartition(3), "texts"), bucket=bucket, block=block).collect()
    assert linked > 100 and len(found) == len(texts)
    assert {r.doc_id: r.component_id for r in found} == {i: find(i) for i in range(len(texts))}
    assert {r.doc_id for r in found if r.kept} == {find(i) for i in range(len(texts))}


def test_blocks_alone_find_the_links(spark, monkeypatch):
    monkeypatch.setattr(nc, "simhash_pairs", lambda known: known.select(F.col("n").alias("place"), F.col("node").alias("a"), F.col("node").alias("b")).where("a <> b"))
    test_components_are_those_of_all_similar_pairs(spark, 2, 3)


def test_fingerprints_are_those_of_operator_one(spark):
    texts = ["One two three four five six seven", "a b", "", None] + families(random.Random(3))[:9]
    df = spark.createDataFrame(list(enumerate(texts)), SCHEMA)
    rows = nc._sets(df.select("doc_id", F.lit(0).cast("long").alias("rid"), F.col("text").cast("binary").alias("text"))).collect()
    assert {r.doc_id: r.fp % (1 << 64) for r in rows} == {i: simhash.fingerprint((t or "").encode(), 5) for i, t in enumerate(texts)}


def test_null_ids_repeated_rows_and_no_rows(spark):
    text = " ".join(f"w{i}" for i in range(50))
    rows = nc.near_copies(spark.createDataFrame([(None, text), (3, text), (3, text), (5, text + " more")], SCHEMA)).collect()
    assert len(rows) == 4 and {r.component_id for r in rows} == {3} and [r.doc_id for r in rows if r.kept] == [3]
    assert nc.near_copies(spark.createDataFrame([], SCHEMA)).count() == 0


def test_blocks_do_not_change_bands():
    found = np.unique(np.random.default_rng(0).integers(0, 1 << 62, 9000).astype(np.uint64))
    whole, nc._BLOCK = nc._BLOCK, 700
    try:
        parts = nc.bands(found)
    finally:
        nc._BLOCK = whole
    assert parts.tolist() == nc.bands(found).tolist() and len(set(parts.tolist())) == nc.BANDS


def test_the_pipeline_drops_copies_at_080_and_keeps_the_others(spark):
    rng = random.Random(2)
    rows, gone = [], set()
    for i in range(0, 200, 2):
        base = [f"w{rng.randrange(5000)}" for _ in range(300)]
        every = 54 if i % 4 == 0 else 36  # similarity 0.83 and 0.74
        rows += [(i, " ".join(base)), (i + 1, " ".join("other" if k % every == every - 1 else w for k, w in enumerate(base)))]
        gone |= {i + 1} if i % 4 == 0 else set()
    found = near(spark, stored(spark.createDataFrame(rows, SCHEMA).repartition(3), "texts"), "")
    assert {r.doc_id for r in found.collect()} == set(range(200)) - gone


def test_buckets_do_not_store_their_pairs(spark, monkeypatch):
    rng = random.Random(4)
    shared = [f"w{rng.randrange(5000)}" for _ in range(150)]
    texts = [" ".join(shared + [f"own{i}x{j}" for j in range(60)]) for i in range(100)]  # similarity 0.56: many common keys, no link
    docs = stored(spark.createDataFrame(list(enumerate(texts)), SCHEMA).repartition(3), "texts")
    rows, kept = [], nc._kept

    def counted(df, name, n):
        rows.append((kept(df, name, n), name))
        return rows[-1][0]

    monkeypatch.setattr(nc, "_kept", counted)
    found = nc.near_copies(docs).collect()
    assert all(r.kept for r in found) and len(found) == 100
    assert max(df.count() for df, name in rows) <= 100 * nc.BANDS
