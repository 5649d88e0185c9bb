"""Rotation by the right singular vectors, without centring.

Up to MAX_DIMS dimensions the d x d sums are gathered and V is square. Wider vectors take a
randomised range finder (Halko et al., 2011): only d x rank numbers are held, and V has
`rank` columns. rotate() completes such a V to a rotation of the whole space, so lengths and
distances stay as they are and the first coordinates are those along V.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.scratch import written
from .exact import matrix

#: Widest vectors whose d x d sums are gathered (8 MB at 1024).
MAX_DIMS = 1024
#: Directions that the range finder carries beyond the rank, and its passes over the vectors.
OVERSAMPLE, ROUNDS = 16, 6
#: Most numbers that V may have: 64 MiB.
MAX_VALUES = 1 << 23


def gram(vectors: DataFrame, dims: int) -> DataFrame:
    """(i, j, v): sums of products of coordinates. A task adds its rows up before the shuffle."""
    if dims > MAX_DIMS:
        raise ValueError(f"at most {MAX_DIMS} dimensions")

    def run(batches):
        total = np.zeros((dims, dims))
        for b in batches:
            if b.num_rows:
                x = matrix(b.column(0))
                total += x.T @ x
        i, j = np.divmod(np.arange(dims * dims), dims)
        yield pa.RecordBatch.from_arrays([pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(total.ravel())], ["i", "j", "v"])

    return vectors.select("vec").mapInArrow(run, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v"))


def numbered(df: DataFrame) -> tuple[DataFrame, int]:
    """df with a column at, the place of a row by (id mod 64, id) from 0, and the number of rows. The first column is the id, a long."""
    key = df.columns[0]
    parts = df.withColumn("part", F.pmod(F.col(key), F.lit(64)))
    sizes = {r.part: r["count"] for r in parts.groupBy("part").count().collect()}
    # Numbers without one global window: the rows before a part, then the place in it.
    before, at = [F.lit(-1).cast("long"), F.lit(0).cast("long")], 0
    for p in sorted(sizes):
        before += [F.lit(p).cast("long"), F.lit(at).cast("long")]
        at += sizes[p]
    place = F.row_number().over(Window.partitionBy("part").orderBy(key))
    return parts.withColumn("at", F.create_map(*before)[F.col("part")] + place - 1).drop("part"), at


def draw(df: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """n rows with replacement: seeded positions, joined to rows numbered by (id mod 64, id).

    The first column is the id, a long. Returns the columns of df and draw.
    """
    held, size = numbered(df)
    if not size or not n:
        return df.withColumn("draw", F.lit(0).cast("long")).limit(0)
    draws = df.sparkSession.range(n).select(F.col("id").alias("draw"), ((F.col("id") + seed) * 2654435761 % 4294967296 % size).alias("at"))
    return draws.join(held, "at").select(*df.columns, "draw")


def times_gram(vectors: DataFrame, q: np.ndarray) -> np.ndarray:
    """A'AQ for the rows A: a task reads its vectors once and adds up d x rank numbers; the sums reach the driver."""
    dims, width = q.shape
    shared = vectors.sparkSession.sparkContext.broadcast(q)

    def run(batches):
        total = np.zeros((dims, width))
        for b in batches:
            if b.num_rows:
                x = matrix(b.column(0))
                total += x.T @ (x @ shared.value)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(dims * width)), pa.array(total.ravel())], ["at", "v"])

    sums = vectors.select("vec").mapInArrow(run, "at long, v double").groupBy("at").agg(F.sum("v").alias("v")).toArrow()
    out = np.zeros(dims * width)
    out[sums["at"].to_numpy()] = sums["v"].to_numpy()
    shared.unpersist()
    return out.reshape(dims, width)


def range_svd(vectors: DataFrame, dims: int, rank: int, rounds: int = ROUNDS, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(V of `rank` columns, their singular values), largest first, at any width. Reads the vectors rounds + 1 times.

    The error of a direction falls with the power 2 * rounds of the ratio of the first
    singular value that is not carried to its own. Columns beyond the rank of the
    vectors are any that are orthogonal; an empty table gives those only.
    """
    width = min(dims, rank + OVERSAMPLE)
    if not 0 < rank <= dims or dims * width > MAX_VALUES:
        raise ValueError(f"rank must be in [1, {dims}], and dimensions times rank at most {MAX_VALUES}")
    q = np.linalg.qr(np.random.default_rng(seed).normal(size=(dims, width)))[0]
    for _ in range(rounds):
        q = np.linalg.qr(times_gram(vectors, q))[0]
    b = q.T @ times_gram(vectors, q)
    values, u = np.linalg.eigh((b + b.T) / 2)
    order = np.argsort(values)[::-1][:rank]
    return np.ascontiguousarray(q @ u[:, order]), np.sqrt(np.maximum(values[order], 0))


def svd(vectors: DataFrame, dims: int, max_size: int | None = None, seed: int = 0, rank: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(V, singular values), largest first. With max_size and more rows, from max_size rows drawn with replacement.

    rank: columns of V that are needed; beyond MAX_DIMS dimensions V has only those.
    """
    wide = dims > MAX_DIMS
    if wide and rank is None:
        raise ValueError(f"beyond {MAX_DIMS} dimensions a rank is needed")
    if max_size is not None and vectors.limit(max_size + 1).count() > max_size:
        vectors = draw(vectors, max_size, seed)
        vectors = written(vectors) if wide else vectors  # read again in each round
    if wide:
        return range_svd(vectors, dims, rank, seed=seed)
    g = np.zeros((dims, dims))
    for r in gram(vectors, dims).collect():  # dims x dims
        g[r.i, r.j] = r.v
    values, v = np.linalg.eigh((g + g.T) / 2)
    order = np.argsort(values)[::-1]
    return np.ascontiguousarray(v[:, order]), np.sqrt(np.maximum(values[order], 0))


def completed(v: np.ndarray):
    """x -> x times a rotation whose first columns are V's, which are orthonormal; without a d x d matrix.

    With V's upper block P S (its polar form), the block reflector over W = V + [P; 0]
    exchanges the first unit vectors, turned by P, and -V.
    """
    rank = v.shape[1]
    if rank == len(v):
        return lambda x: x @ v
    a, s, bt = np.linalg.svd(v[:rank])
    p = a @ bt
    w = v.copy()
    w[:rank] += p
    inner = np.linalg.inv(np.eye(rank) + bt.T @ (s[:, None] * bt))

    def turn(x: np.ndarray) -> np.ndarray:
        y = x - ((x @ w) @ inner) @ w.T
        y[:, :rank] = -(y[:, :rank] @ p)
        return y

    return turn


def rotate(vectors: DataFrame, v: np.ndarray, col: str = "vec") -> DataFrame:
    """The column times V, completed where V has fewer columns than rows; other columns stay."""
    turn = completed(v)
    names, at = vectors.columns, vectors.columns.index(col)
    schema = ", ".join(f"`{f.name}` {'array<double>' if f.name == col else f.dataType.simpleString()}" for f in vectors.schema)

    def run(batches):
        for b in batches:
            x = turn(matrix(b.column(at))) if b.num_rows else np.zeros((0, len(v)))
            offsets = pa.array(np.arange(0, x.size + 1, max(1, x.shape[1]), dtype=np.int32)) if len(x) else pa.array([0], pa.int32())
            out = [pa.ListArray.from_arrays(offsets, pa.array(x.ravel())) if i == at else c for i, c in enumerate(b.columns)]
            yield pa.RecordBatch.from_arrays(out, names)

    return vectors.mapInArrow(run, schema)


def rotation_table(spark, v: np.ndarray) -> DataFrame:
    """(i, j, v) rows of V."""
    i, j = np.divmod(np.arange(v.size), v.shape[1])
    return spark.createDataFrame(pa.table({"i": i.astype(np.int32), "j": j.astype(np.int32), "v": v.ravel()}))


def rotation_of(table: DataFrame, dims: int) -> np.ndarray:
    """V again from its rows; dims values for each of its columns pass the driver."""
    rows = table.toArrow()
    i, j = rows["i"].to_numpy(), rows["j"].to_numpy()
    v = np.zeros((dims, int(j.max()) + 1))
    v[i, j] = rows["v"].to_numpy()
    return v
