"""Vector files: round trips on files written here."""

import struct

import numpy as np
import pytest

from vectorloom.sources import vector_files as files


def test_bins(spark, tmp_path):
    x = np.random.default_rng(0).normal(size=(250, 7)).astype("<f4")
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "id long, vec array<float>")
    path = f"{tmp_path}/base.fbin"
    files.write_bins(df, path)
    assert struct.unpack("<ii", open(path, "rb").read(8)) == (250, 7)
    back = files.read_bins(spark, path, rows=60)
    assert back.rdd.getNumPartitions() == 5
    assert np.array_equal(np.array([r.vec for r in back.orderBy("id").collect()], "<f4"), x)
    with open(path, "r+b") as f:
        f.truncate(100)
    with pytest.raises(Exception, match="cut short"):
        files.read_bins(spark, path).collect()


def test_npy_shards_and_dataset(spark, tmp_path):
    at = tmp_path / "wiki-64k"
    (at / "base").mkdir(parents=True)
    x = np.random.default_rng(0).normal(size=(30, 4)).astype(np.float32)
    np.save(at / "base" / "b.npy", x[20:])
    np.save(at / "base" / "a.npy", x[:20])
    np.save(at / "query.npy", x[:3])
    np.save(at / "groundtruth.npy", np.array([[0, 1], [1, 0], [2, 0]], np.int64))
    data = files.load_dataset(spark, "wiki-64k", f"file://{tmp_path}")
    assert np.array_equal(np.array([r.vec for r in data.storage.orderBy("id").collect()], np.float32), x)
    assert data.d_model == 4 and data.n_storage() == 30 and data.truth.count() == 6
    q, truth = data.load_query(5, 1)
    assert q.count() == 5 and truth.count() == 5
    with pytest.raises(ValueError):
        data.load_query(5, 3)
    small = files.shrink(data, 10, k=2)
    assert small.n_storage() == 10 and small.truth.count() == 6


def test_npy_keeps_ids_and_reads_row_ranges(spark, tmp_path):
    ids = np.array([[16_777_217, 1], [2**40 + 1, 3], [5, 6]], np.int64)
    np.save(tmp_path / "truth.npy", ids)
    back = files.read_npy(spark, f"{tmp_path}/truth.npy", rows=2)
    assert back.rdd.getNumPartitions() == 2 and [r.vec for r in back.orderBy("id").collect()] == ids.tolist()
    np.save(tmp_path / "cut.npy", np.zeros((100, 8)))
    with open(tmp_path / "cut.npy", "r+b") as f:
        f.truncate(1000)
    with pytest.raises(Exception, match="cut short"):
        files.read_npy(spark, f"{tmp_path}/cut.npy").collect()
    x = np.random.default_rng(1).normal(size=(25, 3)).astype(np.float32)
    files.write_npy(spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "id long, vec array<float>"), f"file:{tmp_path}/out", rows=10)
    assert np.array_equal(np.array([r.vec for r in files.read_npy(spark, f"{tmp_path}/out/*.npy", rows=4).orderBy("id").collect()], np.float32), x)


def test_truth_is_written_and_read(spark, tmp_path):
    data = files.fuzz(spark, 60, 3, dims=64, seed=4, k=3)
    made = files.write_truth(data, f"{tmp_path}/deep-64k", n_queries=20, k=5, seed=2)
    files.write_bins(data.storage, f"{tmp_path}/deep-64k/base.fbin")
    back = files.load_dataset(spark, "deep-64k", str(tmp_path))
    key = lambda t: sorted((r.qid, r["rank"], r.id) for r in t.collect())
    assert back.queries.count() == 20 and key(back.truth) == key(made.truth) and back.truth.count() == 100


def test_bin_dataset_without_base(spark, tmp_path):
    (tmp_path / "deep-1m").mkdir()
    vec = lambda rows, kind: spark.createDataFrame([(i, r) for i, r in enumerate(rows)], f"id long, vec array<{kind}>")
    files.write_bins(vec([[1.0, 2.0]], "float"), f"{tmp_path}/deep-1m/query.fbin")
    files.write_bins(vec([[3, 4]], "int"), f"{tmp_path}/deep-1m/groundtruth.ibin", ints=True)
    data = files.load_dataset(spark, "deep-1m", str(tmp_path))
    assert data.storage is None and [r.id for r in data.truth.orderBy("rank").collect()] == [3, 4]
    with pytest.raises(ValueError):
        files.load_dataset(spark, "other-1m", str(tmp_path))


def test_fuzz(spark):
    data = files.fuzz(spark, 60, 5, seed=4, k=3)
    assert data.d_model in files.FUZZ_DIMS and 30 <= data.n_storage() <= 120 and data.truth.count() == 15


@pytest.mark.parametrize("kind", ["npy", "fbin", "ibin"])
def test_shards_are_written_by_tasks(spark, tmp_path, kind):
    rng = np.random.default_rng(3)
    x = rng.integers(-(2**31), 2**31, (230, 5)) if kind == "ibin" else rng.normal(size=(230, 5)).astype(np.float32)
    df = spark.createDataFrame([(int(i), x[i].tolist()) for i in rng.permutation(230)], f"id long, vec array<{'int' if kind == 'ibin' else 'float'}>").repartition(5)
    at = f"{tmp_path}/out"
    if kind == "npy":
        files.write_npy(df, at, rows=40)
        back = files.read_npy(spark, f"{at}/*.npy", rows=30)
    else:
        files.write_bin_shards(df, at, rows=40, ints=kind == "ibin")
        back = files.read_bins(spark, f"{at}/*.{kind}", rows=30) if kind == "fbin" else spark.read.format("vector_bin").option("dtype", "ibin").load(f"{at}/*.ibin")
    assert np.array_equal(np.array([r.vec for r in back.orderBy("id").collect()]), x) and len(list((tmp_path / "out").iterdir())) > 5
    with pytest.raises(Exception, match="already"):
        files.write_npy(df, at) if kind == "npy" else files.write_bin_shards(df, at, ints=kind == "ibin")


def test_a_failed_write_leaves_nothing(spark, tmp_path):
    df = spark.createDataFrame([(i, [1.0] * (2 if i < 90 else 3)) for i in range(100)], "id long, vec array<float>").repartition(4)
    with pytest.raises(Exception, match="coordinates"):
        files.write_npy(df, f"{tmp_path}/out")
    assert list(tmp_path.iterdir()) == []
