"""Exact nearest neighbours.

exact_knn is the relational form: the queries are the stated small side of a
nested-loop join, whose top-k is limited before the shuffle. exact_knn_blocks is the
same for bulk: a block of queries of a fixed size is sent to the tasks that scan the
base, each keeps its k best per query, and only those are shuffled. Queries of more than
DRIVER_BLOCKS blocks do not pass the driver: blocks of them meet parts of the base, both
of a fixed size, each pair of them in a task of its own, so that no task grows with the tables.
Within a task distances are made tile by tile, TILE vectors against LOT queries.
block_distances gives all pairs by the same division.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import at_least, l2sq
from ..plans.scratch import written
from .topk import topk

#: Queries in a broadcast block, and values in it at most.
BLOCK, BLOCK_VALUES = 4096, 1 << 22
#: Blocks that may pass the driver, one scan of the base each.
DRIVER_BLOCKS = 1
#: Queries and vectors of the base that a task compares at most, where they do not pass the driver; vectors below which a part is not divided further.
GRID_QUERIES, GRID_PART, LEAST_PART = 1 << 16, 1 << 15, 1 << 10
#: Queries and vectors whose pairs a task gives out all, at most.
PAIR_QUERIES, PAIR_PART = 1 << 12, 1 << 13
#: Queries and vectors of a tile, and values of the differences that are made at once.
LOT, TILE, DIFF_VALUES = 1024, 2048, 1 << 20
_NONE = np.iinfo(np.int64).max


def pair_distances(queries: DataFrame, base: DataFrame, dims: int, start: int = 0) -> DataFrame:
    """qid, id, dist for all pairs; queries (qid, vec) are few by contract."""
    return base.select("id", at_least("vec", dims).alias("bv")).crossJoin(F.broadcast(queries.select("qid", at_least("vec", dims).alias("qv")))).select("qid", "id", l2sq("qv", "bv", dims, start).alias("dist"))


def block_distances(queries: DataFrame, base: DataFrame, dims: int, cut: int | None = None) -> DataFrame:
    """qid, id, dist for all pairs of any number of queries, or with a cut qid, id, head, rest: distances over the coordinates [0, cut) and [cut, dims).

    Blocks of queries meet parts of the base, each pair of them in a task of its own, and a task
    holds a few distances at once. A null vector gives null distances.
    """
    ends = [0, dims] if cut is None else [0, cut, dims]
    names = ["dist"] if cut is None else ["head", "rest"]
    size, lot = max(1, BLOCK_VALUES // dims), max(1, DIFF_VALUES // dims)
    cells = _cells(_marked(queries, "qid", dims), _marked(base, "id", dims), min(size, PAIR_QUERIES), min(size, PAIR_PART))

    def meet(batches):
        asked, rows = _sides(batches)
        for ids, x, null in rows:
            for qids, q, none in asked:
                for at in range(0, len(q), lot):
                    yield from _tiles(names, ends, qids[at : at + lot], q[at : at + lot], none[at : at + lot], ids, x, null)

    return cells.mapInArrow(meet, ", ".join(["qid long", "id long", *(f"{n} double" for n in names)]))


def _marked(df: DataFrame, key: str, dims: int) -> DataFrame:
    """(id, vec, mark): the first dims coordinates; of a null vector zeros, with the mark NaN."""
    vec = F.col("vec").cast("array<float>" if df.schema["vec"].dataType.simpleString() == "array<float>" else "array<double>")
    there = F.col("vec").isNotNull()
    zeros = F.array_repeat(F.lit(0.0).cast("float"), dims)
    return df.select(F.col(key).alias("id"), F.when(there, F.slice(at_least(vec, dims), 1, dims)).otherwise(zeros).alias("vec"), F.when(there, F.lit(0.0)).otherwise(F.lit(float("nan"))).alias("mark"))


def _tiles(names: list[str], ends: list[int], qids: np.ndarray, q: np.ndarray, none: np.ndarray, ids: np.ndarray, x: np.ndarray, null: np.ndarray):
    """Batches (qid, id, distances between the ends): all queries for one vector after the other, DIFF_VALUES differences at once."""
    step = max(1, DIFF_VALUES // max(1, q.size))
    for at in range(0, len(ids), step):
        own, diff = ids[at : at + step], x[at : at + step, None, :] - q[None, :, :]
        lost = np.isnan(null[at : at + step, None] + none[None, :]).ravel()
        dist = [np.einsum("ijk,ijk->ij", diff[:, :, lo:hi], diff[:, :, lo:hi]).ravel() for lo, hi in zip(ends, ends[1:], strict=False)]
        yield pa.RecordBatch.from_arrays([pa.array(np.tile(qids, len(own))), pa.array(np.repeat(own, len(qids))), *(pa.array(d, mask=lost) for d in dist)], ["qid", "id", *names])


def exact_knn(queries: DataFrame, base: DataFrame, k: int, dims: int) -> DataFrame:
    """qid, id, dist, rank: the k nearest of each query, ties by id."""
    if queries.limit(BLOCK // 4 + 1).count() > BLOCK // 4:
        return exact_knn_blocks(queries, base, k)
    return topk(pair_distances(queries, base, dims), k)


def nearest(queries: DataFrame, base: DataFrame, dims: int) -> DataFrame:
    """qid, id, dist of the single nearest."""
    if queries.limit(BLOCK + 1).count() > BLOCK:
        return exact_knn_blocks(queries, base, 1).select("qid", "id", "dist")
    return pair_distances(queries, base, dims).groupBy("qid").agg(F.min(F.struct("dist", "id")).alias("m")).select("qid", "m.id", "m.dist")


def matrix(column: pa.Array) -> np.ndarray:
    """An Arrow list column of equal lengths as a float64 matrix; a null vector or coordinate, or another length, is an error."""
    if not len(column):
        return np.zeros((0, 0))
    if column.null_count or column.flatten().null_count:
        raise ValueError("a vector or a coordinate is null")
    lengths = np.asarray(column.value_lengths())
    if (lengths != lengths[0]).any():
        raise ValueError(f"vectors have {lengths.min()} to {lengths.max()} coordinates")
    return np.asarray(column.flatten(), np.float64).reshape(len(column), -1)


def _best(ids: np.ndarray, q: np.ndarray, base, k: int, far: np.ndarray | None = None) -> pa.RecordBatch:
    """(qid, id, dist): the k best of base, an iterable of (ids, vectors), for each query; far: none beyond these distances."""
    best_d, best_i = np.full((len(q), k), np.inf), np.full((len(q), k), _NONE)
    if far is not None:
        best_d[:] = far[:, None]
    for own, x in base:
        if x.shape[1:] != q.shape[1:] and len(own) and len(q):
            raise ValueError(f"queries have {q.shape[1]} coordinates, the base has {x.shape[1]}")
        for at in range(0, len(own), TILE):
            for lot in range(0, len(q), LOT):
                rows = slice(lot, lot + LOT)
                _improve(best_d[rows], best_i[rows], q[rows], own[at : at + TILE], x[at : at + TILE])
    live = (np.isfinite(best_d) & (best_i != _NONE)).ravel()
    return pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, k)[live]), pa.array(best_i.ravel()[live]), pa.array(best_d.ravel()[live])], ["qid", "id", "dist"])


def _improve(best_d: np.ndarray, best_i: np.ndarray, q: np.ndarray, own: np.ndarray, x: np.ndarray) -> None:
    """Takes the vectors x with ids own into the k best of each query, in place, nearest first.

    The matrix product tells which can be among them; their distances are made by differences.
    """
    k, sq = best_d.shape[1], (q * q).sum(1)
    rough = q @ x.T
    rough *= -2
    rough += sq[:, None]
    norms = (x * x).sum(1)
    rough += norms[None, :]
    bound, m = best_d[:, -1].copy(), min(k, len(own)) - 1
    if m + 1 == k:
        new = np.flatnonzero(np.isinf(bound))
        if len(new):
            bound[new] = np.partition(rough[new], m, axis=1)[:, m]
    r, c = np.nonzero(rough <= (bound + 1e-9 * (1 + sq + norms.max()))[:, None])
    del rough
    step = max(1, DIFF_VALUES // max(1, x.shape[1]))
    d = np.concatenate([((q[r[at : at + step]] - x[c[at : at + step]]) ** 2).sum(1) for at in range(0, len(r), step)] or [np.zeros(0)])
    i = own[c]
    nearer = (d < best_d[r, -1]) | ((d == best_d[r, -1]) & (i < best_i[r, -1]))
    r, i, d = r[nearer], i[nearer], d[nearer]
    if not len(r):
        return
    touched = np.unique(r)
    r, i, d = np.concatenate([np.repeat(touched, k), r]), np.concatenate([best_i[touched].ravel(), i]), np.concatenate([best_d[touched].ravel(), d])
    order = np.lexsort((i, d, r))
    place = np.arange(len(order)) - np.repeat(np.searchsorted(r[order], touched), np.bincount(r)[touched])
    first = order[place < k]
    best_d[touched], best_i[touched] = d[first].reshape(-1, k), i[first].reshape(-1, k)


def _block_task(ids: np.ndarray, q: np.ndarray, k: int):
    """Keeps the k best of a task for each query of the block."""

    def run(batches):
        yield _best(ids, q, ((np.asarray(b.column(0)), matrix(b.column(1))) for b in batches), k)

    return run


def _cells(queries: DataFrame, base: DataFrame, block: int, part: int) -> DataFrame:
    """(asks, id, vec, mark) of both tables (id, vec, mark), where each block of queries lies with each part of the base in a partition of its own.

    There are at least three partitions a core, if parts do not get too small for that.
    """
    n_queries, n_base = queries.count(), base.count()
    n_blocks = max(1, -(-n_queries // block))
    wanted = -(-3 * queries.sparkSession.sparkContext.defaultParallelism // n_blocks)
    n_parts = max(1, -(-n_base // part), min(wanted, n_base // LEAST_PART))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    number = lambda n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    vec = "array<float>" if all(df.schema["vec"].dataType.simpleString() == "array<float>" for df in (queries, base)) else "array<double>"
    held = [F.col("id").cast("long").alias("id"), F.col("vec").cast(vec).alias("vec"), "mark"]
    q = queries.select(number(n_blocks).alias("i"), every(n_parts).alias("j"), F.lit(True).alias("asks"), *held)
    b = base.select(every(n_blocks).alias("i"), number(n_parts).alias("j"), F.lit(False).alias("asks"), *held)
    cells = q.union(b).select((F.col("i") * n_parts + F.col("j")).alias("cell"), "asks", "id", "vec", "mark").repartitionById(n_blocks * n_parts, "cell")
    return cells.select("asks", "id", "vec", "mark")


def _sides(batches) -> tuple[list, list]:
    """Queries and vectors of a cell as (ids, vectors, marks): queries as they come, vectors in one piece at most."""
    asked, rows = [], []
    for batch in batches:
        asks, ids, x, mark = np.asarray(batch.column(0)), np.asarray(batch.column(1)), matrix(batch.column(2)), np.asarray(batch.column(3))
        if asks.any():
            asked.append((ids[asks], x[asks], mark[asks]))
        if not asks.all():
            rows.append((ids[~asks], x[~asks], mark[~asks]))
    return asked, [tuple(np.concatenate(c) for c in zip(*rows, strict=True))] if rows else []


def _grid(queries: DataFrame, base: DataFrame, k: int, block: int, part: int) -> DataFrame:
    """(qid, id, dist): the k best in each part of the base, where each block of queries meets each part in one task.

    A column far of the queries bounds the distances that are looked for.
    """
    far = F.col("far") if "far" in queries.columns else F.lit(float("inf"))
    cells = _cells(queries.select(F.col("qid").alias("id"), "vec", far.alias("mark")), base.select("id", "vec", F.lit(float("inf")).alias("mark")), block, part)

    def meet(batches):
        asked, rows = _sides(batches)
        whole = [(ids, x) for ids, x, _ in rows]
        for ids, x, far in asked:
            for at in range(0, len(ids), BLOCK):
                yield _best(ids[at : at + BLOCK], x[at : at + BLOCK], whole, k, far[at : at + BLOCK])

    return cells.mapInArrow(meet, "qid long, id long, dist double")


def exact_knn_blocks(queries: DataFrame, base: DataFrame, k: int) -> DataFrame:
    """As exact_knn for any number of queries: one pass over base for each block of a few, else blocks of queries against parts of base."""
    parts, block = [], []
    first = queries.select("vec").first()
    size = max(1, BLOCK_VALUES // max(1, len(first.vec or ()))) if first else BLOCK
    most = DRIVER_BLOCKS * min(BLOCK, size)
    if queries.limit(most + 1).count() > most:
        return topk(_grid(queries, base, k, min(size, GRID_QUERIES), min(size, GRID_PART)), k)

    def flush() -> None:
        ids, q = np.array([r.qid for r in block], np.int64), matrix(pa.array([r.vec for r in block], pa.list_(pa.float64())))
        parts.append(base.select("id", "vec").mapInArrow(_block_task(ids, q, k), "qid long, id long, dist double"))
        block.clear()

    for r in queries.select("qid", "vec").toLocalIterator():
        if r.vec is None:
            raise ValueError("a vector is null")
        block.append(r)
        if len(block) >= BLOCK or len(block) * len(r.vec) >= BLOCK_VALUES:
            flush()
    if block:
        flush()
    if not parts:
        return base.sparkSession.createDataFrame([], "qid long, id long, dist double, rank int")
    found = parts[0]
    for p in parts[1:]:
        found = found.union(p)
    return topk(found, k)


def completed(queries: DataFrame, base: DataFrame, found: DataFrame, k: int, dims: int) -> DataFrame:
    """qid, id, dist, rank: the k nearest of each query, from what a search found (qid, id) and the exact check that follows it.

    A query's k-th distance found bounds its true ones, so the check brings only vectors within it
    that the search may have missed. All distances are made anew from the given vectors.
    """
    q, b = queries.select("qid", at_least("vec", dims).alias("qv")), base.select("id", at_least("vec", dims).alias("bv"))
    measured = lambda pairs: pairs.join(b, "id").join(q, "qid").select("qid", "id", l2sq("qv", "bv", dims).alias("dist"))
    held = written(found.select("qid", "id").distinct())
    far = topk(measured(held), k).where(F.col("rank") == k).select("qid", (F.col("dist") * (1 + 1e-9)).alias("far"))
    asked = written(queries.select("qid", "vec").join(far, "qid", "left").select("qid", "vec", F.coalesce("far", F.lit(float("inf"))).alias("far")))
    size = max(1, BLOCK_VALUES // dims)
    near = _grid(asked, base.select("id", "vec"), k, min(size, GRID_QUERIES), min(size, GRID_PART)).select("qid", "id")
    return topk(measured(held.union(near).distinct()), k)
