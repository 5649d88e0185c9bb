"""Vector files: .fbin and .ibin as a Python data source, .npy shards, and named datasets."""

from __future__ import annotations

import fnmatch
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from ..operators.exact import exact_knn_blocks, matrix
from ..operators.linalg import draw


def _fs(path: str):
    """(file system, path in it); file:/a and plain paths are local."""
    from pyarrow import fs

    if "://" not in path:
        path = f"file://{path.removeprefix('file:')}"
    return fs.FileSystem.from_uri(path)


def _open(path: str):
    files, at = _fs(path)
    return files.open_input_file(at)


def _lists(x: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, max(1, x.shape[1]), dtype=np.int32)), pa.array(np.ascontiguousarray(x).ravel()))


def _matching(pattern: str) -> list[str]:
    """Files whose names match the last part of the pattern, sorted by name."""
    from pyarrow import fs

    folder, _, names = pattern.rpartition("/")
    files, at = _fs(folder)
    found = [i.base_name for i in files.get_file_info(fs.FileSelector(at)) if i.type == fs.FileType.File and fnmatch.fnmatchcase(i.base_name, names)]
    return [f"{folder}/{name}" for name in sorted(found)]


@dataclass
class _Shard(InputPartition):
    path: str
    start: int
    end: int
    first: int


def _ranges(heads: list[tuple[str, int]], rows: int) -> list[_Shard]:
    """Row ranges of files (path, rows); ids go on from file to file."""
    out, first = [], 0
    for path, n in heads:
        out += [_Shard(path, at, min(n, at + rows), first) for at in range(0, n, rows)]
        first += n
    return out or [_Shard("", 0, 0, 0)]


@dataclass
class _Written(WriterCommitMessage):
    part: int
    files: list[tuple[str, int]]  # name, coordinates


class _ShardWriter(DataSourceArrowWriter):
    """Each task writes its rows as shards into a folder beside the target; commit numbers them by partition and renames the folder, so a failed write leaves nothing that is read.

    Rows stay in the order of the partitions: a table that is ordered before is read back in that order.
    """

    def __init__(self, options: dict, suffix: str):
        self.path, self.rows, self.suffix = options["path"].rstrip("/"), int(options.get("rows", 1 << 20)), suffix
        self.dtype = options.get("dtype", "int32" if suffix == "ibin" else "float32")
        self.work = f"{self.path}._writing-{uuid.uuid4().hex}"

    def _put(self, name: str, x: np.ndarray) -> None:
        files, at = _fs(self.work)
        files.create_dir(at, recursive=True)
        with files.open_output_stream(f"{at}/{name}") as f:
            if self.suffix == "npy":
                np.lib.format.write_array(f, x)
            else:
                f.write(struct.pack("<ii", *x.shape) + x.astype("<i4" if self.suffix == "ibin" else "<f4").tobytes())

    def write(self, iterator) -> _Written:
        from pyspark import TaskContext

        task = TaskContext.get()
        done, held, size = [], [], 0

        def flush(x: np.ndarray) -> None:
            done.append((f"{task.partitionId():06d}-{len(done):06d}-{task.taskAttemptId()}", x.shape[1]))
            self._put(done[-1][0], x)

        for b in iterator:
            if b.num_rows:
                column = b.column(b.schema.get_field_index("vec"))
                held.append(matrix(column).astype(self.dtype) if not self.dtype.startswith("int") else np.asarray(column.flatten(), self.dtype).reshape(matrix(column).shape))
                size += b.num_rows
            while size >= self.rows:
                x = np.concatenate(held)
                flush(x[: self.rows])
                held, size = [x[self.rows :]], len(x) - self.rows
        if size:
            flush(np.concatenate(held))
        return _Written(task.partitionId(), done)

    def commit(self, messages) -> None:
        from pyarrow import fs

        names = [f for m in sorted((m for m in messages if m is not None), key=lambda m: m.part) for f in m.files]
        if len({d for _, d in names}) > 1:
            self.abort(messages)
            raise ValueError(f"vectors have {min(d for _, d in names)} to {max(d for _, d in names)} coordinates")
        files, work = _fs(self.work)
        _, at = _fs(self.path)
        files.create_dir(work, recursive=True)
        for i, (name, _) in enumerate(names):
            files.move(f"{work}/{name}", f"{work}/shard-{i:06d}.{self.suffix}")
        kept = {f"shard-{i:06d}.{self.suffix}" for i in range(len(names))}
        for info in files.get_file_info(fs.FileSelector(work)):  # of attempts that did not count
            if info.base_name not in kept:
                files.delete_file(info.path)
        files.move(work, at)

    def abort(self, messages) -> None:
        from pyarrow import fs

        files, work = _fs(self.work)
        if files.get_file_info(work).type == fs.FileType.Directory:
            files.delete_dir(work)


def _writer(options: dict, suffix: str) -> _ShardWriter:
    from pyarrow import fs

    files, at = _fs(options["path"].rstrip("/"))
    if files.get_file_info(at).type != fs.FileType.NotFound:
        raise ValueError(f"{options['path']} is there already")
    return _ShardWriter(options, suffix)


class _BinReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.rows = options["path"], int(options.get("rows", 65536))
        self.kind = "<i4" if _is_ints(options) else "<f4"

    def _head(self, path: str) -> tuple[int, int]:
        with _open(path) as f:
            return struct.unpack("<ii", f.read(8))

    def partitions(self):
        paths = _matching(self.path) if "*" in self.path else [self.path]
        return _ranges([(p, self._head(p)[0]) for p in paths], self.rows)

    def read(self, part: _Shard) -> Iterator[pa.RecordBatch]:
        if not part.path:
            return
        n, d = self._head(part.path)
        with _open(part.path) as f:
            for at in range(part.start, part.end, 4096):
                m = min(4096, part.end - at)
                f.seek(8 + 4 * d * at)
                x = np.frombuffer(f.read(4 * d * m), self.kind)
                if len(x) != d * m:
                    raise ValueError(f"{part.path} is cut short: {n} x {d} values are announced")
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(part.first + at, part.first + at + m)), _lists(x.reshape(m, d))], ["id", "vec"])


def _is_ints(options: dict) -> bool:
    return options.get("dtype", "ibin" if options["path"].endswith(".ibin") else "fbin") in ("ibin", "int32")


class BinSource(DataSource):
    """spark.read.format("vector_bin").load(path or pattern): (id, vec), ids going on from file to file in order of their names. Options: rows per partition, dtype (fbin or ibin).

    df.write.format("vector_bin").mode("append").save(folder): the column vec as shards, written by the tasks; the folder must not be there. Options: rows of a shard at most, dtype.
    """

    @classmethod
    def name(cls) -> str:
        return "vector_bin"

    def schema(self) -> str:
        ints = _is_ints(dict(self.options))
        return f"id long, vec array<{'int' if ints else 'float'}>"

    def reader(self, schema):
        return _BinReader(dict(self.options))

    def writer(self, schema, overwrite):
        return _writer({k: v for k, v in self.options.items() if k != "dtype"}, "ibin" if _is_ints(dict(self.options)) else "fbin")


def read_bins(spark: SparkSession, path: str, rows: int = 65536) -> DataFrame:
    spark.dataSource.register(BinSource)
    return spark.read.format("vector_bin").option("rows", rows).load(path)


def write_bins(df: DataFrame, path: str, order: str = "id", ints: bool = False) -> None:
    """One .fbin or .ibin file on any file system that Arrow opens; rows are streamed to the driver a partition at a time."""
    n, (files, at) = df.count(), _fs(path)
    files.create_dir(at.rpartition("/")[0], recursive=True)
    with files.open_output_stream(at) as f:
        for i, r in enumerate(df.orderBy(order).toLocalIterator()):
            if not i:
                f.write(struct.pack("<ii", n, len(r.vec)))
            f.write(np.array(r.vec, "<i4" if ints else "<f4").tobytes())
        if not n:
            f.write(struct.pack("<ii", 0, 0))


class _NpyReader(DataSourceReader):
    """Row ranges of .npy shards, in order of their names."""

    def __init__(self, options: dict):
        self.pattern, self.rows = options["path"], int(options.get("rows", 65536))

    def _head(self, path: str) -> tuple[tuple[int, ...], np.dtype, int]:
        """(shape, type, where the values start)."""
        with _open(path) as f:
            version = np.lib.format.read_magic(f)
            shape, fortran, kind = (np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0)(f)
            if fortran and len(shape) > 1 and min(shape) > 1:
                raise ValueError(f"{path} is stored by columns")
            return shape, kind, f.tell()

    def shards(self) -> list[str]:
        return _matching(self.pattern)

    def partitions(self):
        return _ranges([(path, self._head(path)[0][0]) for path in self.shards()], self.rows)

    def read(self, part: _Shard) -> Iterator[pa.RecordBatch]:
        if not part.path:
            return
        shape, kind, offset = self._head(part.path)
        d = shape[1] if len(shape) > 1 else 1
        with _open(part.path) as f:
            for at in range(part.start, part.end, 4096):
                m = min(4096, part.end - at)
                f.seek(offset + kind.itemsize * d * at)
                raw = f.read(kind.itemsize * d * m)
                if len(raw) != kind.itemsize * d * m:
                    raise ValueError(f"{part.path} is cut short: {shape[0]} x {d} values are announced")
                x = np.frombuffer(raw, kind).reshape(m, d)
                x = x.astype(np.int64) if kind.kind in "iu" else x.astype(np.float32)  # ids stay whole numbers
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(part.first + at, part.first + at + m)), _lists(x)], ["id", "vec"])


class NpySource(DataSource):
    """spark.read.format("vector_npy").load(pattern): (id, vec) of all shards that match; id is the rows of earlier shards plus the row. Option: rows per partition.

    df.write.format("vector_npy").mode("append").save(folder): the column vec as shards, written by the tasks; the folder must not be there. Options: rows of a shard at most, dtype.
    """

    @classmethod
    def name(cls) -> str:
        return "vector_npy"

    def schema(self) -> str:
        reader = _NpyReader(dict(self.options))
        shards = reader.shards()
        if not shards:
            raise FileNotFoundError(reader.pattern)
        return f"id long, vec array<{'long' if reader._head(shards[0])[1].kind in 'iu' else 'float'}>"

    def reader(self, schema):
        return _NpyReader(dict(self.options))

    def writer(self, schema, overwrite):
        return _writer(dict(self.options), "npy")


def read_npy(spark: SparkSession, pattern: str, rows: int = 65536) -> DataFrame:
    """(id, vec) of all .npy shards that match the last part of the pattern; integers stay integers, floats become float32."""
    spark.dataSource.register(NpySource)
    return spark.read.format("vector_npy").option("rows", rows).load(pattern)


def write_npy(df: DataFrame, folder: str, rows: int = 1 << 20, order: str = "id", dtype=np.float32) -> None:
    """Shards of at most `rows` vectors in a new folder, in that order; the tasks write them."""
    df.sparkSession.dataSource.register(NpySource)
    df.orderBy(order).select("vec").write.format("vector_npy").mode("append").option("rows", rows).option("dtype", np.dtype(dtype).name).save(folder)


def write_bin_shards(df: DataFrame, folder: str, rows: int = 1 << 20, order: str = "id", ints: bool = False) -> None:
    """The same as .fbin or .ibin files, to be read by read_bins(f"{folder}/*.fbin")."""
    df.sparkSession.dataSource.register(BinSource)
    df.orderBy(order).select("vec").write.format("vector_bin").mode("append").option("rows", rows).option("dtype", "ibin" if ints else "fbin").save(folder)


@dataclass
class Dataset:
    """Base vectors (id, vec), queries (qid, vec) and truth (qid, rank, id)."""

    storage: DataFrame | None
    queries: DataFrame
    truth: DataFrame

    @property
    def d_model(self) -> int:
        return len(self.queries.first().vec)

    def n_storage(self) -> int:
        return 0 if self.storage is None else self.storage.count()

    def load_query(self, n: int, k: int, seed: int = 0) -> tuple[DataFrame, DataFrame]:
        """n queries drawn with replacement (qid is the draw) and their k nearest."""
        if k > self.truth.agg(F.max("rank")).first()[0]:
            raise ValueError("k is larger than the stored truth")
        drawn = draw(self.queries.select("qid", "vec"), n, seed)
        picks = drawn.select(F.col("draw").alias("new"), "qid", "vec")
        truth = picks.select("new", "qid").join(self.truth.where(F.col("rank") <= k), "qid").select(F.col("new").alias("qid"), "rank", "id")
        return picks.select(F.col("new").alias("qid"), "vec"), truth


def ground_truth(queries: DataFrame, base: DataFrame, k: int = 100) -> DataFrame:
    return exact_knn_blocks(queries, base, k).select("qid", "rank", "id", "dist")


def shrink(data: Dataset, n: int, k: int = 100, seed: int = 0) -> Dataset:
    """n base rows drawn with replacement, with new ids, and the truth computed again."""
    base = draw(data.storage.select("id", "vec"), n, seed).select(F.col("draw").alias("id"), "vec")
    return Dataset(base, data.queries, ground_truth(data.queries, base, k))


def write_truth(data: Dataset, folder: str, n_queries: int = 65_536, k: int = 100, seed: int = 0) -> Dataset:
    """Draw n_queries rows of the base with replacement, find their k nearest, and write query.fbin and groundtruth.ibin."""
    drawn = draw(data.storage.select("id", "vec"), n_queries, seed).select(F.col("draw").alias("qid"), "vec")
    truth = ground_truth(drawn, data.storage, k)
    write_bins(drawn, f"{folder}/query.fbin", "qid")
    write_bins(truth.groupBy("qid").agg(F.sort_array(F.collect_list(F.struct("rank", "id"))).alias("found")).select("qid", F.col("found.id").alias("vec")), f"{folder}/groundtruth.ibin", "qid", ints=True)  # k ids a query
    return Dataset(data.storage, drawn, truth.select("qid", "rank", "id"))


#: Dimensions of the random datasets.
FUZZ_DIMS = (64, 96, 128, 200, 512, 768)
#: Rows of a size name.
SIZES = {"16k": 16_384, "64k": 65_536, "1m": 1_000_000, "10m": 10_000_000, "100m": 100_000_000}


def fuzz(spark: SparkSession, size: str | int = "16k", n_queries: int = 4096, dims: int | None = None, seed: int = 0, k: int = 100) -> Dataset:
    """Uniform vectors in [-1, 1]; the number of rows is between half and twice the size, dimensions from FUZZ_DIMS."""
    rng = np.random.default_rng(seed)
    n = SIZES[size] if isinstance(size, str) else size
    d, rows = dims or int(rng.choice(FUZZ_DIMS)), int(rng.integers(n // 2, 2 * n + 1))

    def uniform(count: int, key: str, shift: int) -> DataFrame:
        def run(batches):
            for b in batches:
                ids = np.asarray(b.column(0))
                x = np.stack([np.random.default_rng((seed, shift, int(i))).uniform(-1, 1, d) for i in ids]).astype(np.float32) if len(ids) else np.zeros((0, d), np.float32)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, d, dtype=np.int32)), pa.array(x.ravel()))], [key, "vec"])

        return spark.range(count).mapInArrow(run, f"{key} long, vec array<float>")

    base, queries = uniform(rows, "id", 1), uniform(n_queries, "qid", 2)
    return Dataset(base, queries, ground_truth(queries, base, k))


def load_dataset(spark: SparkSession, name: str, root: str, k: int = 100) -> Dataset:
    """By name: fuzz-<size>; deep- and text2img-<size> from .fbin/.ibin; wiki- and laion-<size> from .npy, under root/name."""
    family, _, size = name.partition("-")
    at = f"{root}/{name}"
    if family == "fuzz":
        return fuzz(spark, size, k=k)
    if family in ("deep", "text2img"):
        queries, truth = read_bins(spark, f"{at}/query.fbin"), read_bins(spark, f"{at}/groundtruth.ibin")
        try:
            _open(f"{at}/base.fbin").close()
            storage = read_bins(spark, f"{at}/base.fbin")
        except FileNotFoundError:
            storage = None  # queries and truth alone are of use
    elif family in ("wiki", "laion"):
        queries, truth = read_npy(spark, f"{at}/query.npy"), read_npy(spark, f"{at}/groundtruth.npy")
        storage = read_npy(spark, f"{at}/base/*.npy")
    else:
        raise ValueError(f"unknown dataset {name!r}")
    truth = truth.select(F.col("id").alias("qid"), F.posexplode("vec").alias("p", "found")).select("qid", (F.col("p") + 1).alias("rank"), F.col("found").cast("long").alias("id"))
    return Dataset(storage, queries.withColumnRenamed("id", "qid"), truth)
