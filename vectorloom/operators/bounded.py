"""Exact k nearest neighbours with bounds: only parts of the base that can hold a neighbour are met.

Base vectors go to the nearest of some pivots; a part knows its size and the least and
largest distance to its pivot. By the triangle inequality no vector of a part is nearer
to a query than D - largest or least - D, where D is the query's distance to the
pivot. A query first meets the parts that are sure to hold k vectors nearest by D + largest;
its k-th distance there is a bound, and only parts whose lower bound is under it are
met in the second round. Each meeting is a block of queries with a lot of a part, both of a
fixed size, in a task of its own, so a hot part or many queries only make more meetings.

The result is that of exact_knn. On vectors without clusters, or of many dimensions, the bounds
exclude little, and exact_knn_blocks does the same with one scan.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import portable_hash
from ..plans.scratch import written
from .exact import _best, matrix
from .topk import topk

#: Bytes of the pivots that every task holds; vectors of a lot and queries of a block that meet.
PIVOT_BYTES, LOT, BLOCK = 1 << 26, 4096, 1024
#: Distances by matrix product differ from those by differences: bounds are loosened by this share.
SLACK = 1e-6


def _to(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Distances of rows to the pivots."""
    sq = (x * x).sum(1)[:, None] + (pivots * pivots).sum(1)[None, :] - 2 * x @ pivots.T
    return np.sqrt(np.maximum(sq, 0))


def parted(base: DataFrame, parts: int | None = None, seed: int = 0) -> tuple[DataFrame, np.ndarray, np.ndarray]:
    """(part, id, vec, r) of all base vectors, the pivots, and of each part (size, least r, largest r). parts: None takes the root of the size."""
    n = base.count()
    width = base.agg(F.max(F.size("vec"))).first()[0] or 1
    parts = max(1, min(parts or int(n**0.5), PIVOT_BYTES // (8 * width)))
    rows = base.orderBy(portable_hash("id", seed), "id").limit(parts).collect()  # PIVOT_BYTES at most
    pivots = matrix(pa.array([r.vec for r in rows], pa.list_(pa.float64())))
    held = base.sparkSession.sparkContext.broadcast(pivots)

    def run(batches):
        for b in batches:
            x = matrix(b.column(1))
            for at in range(0, len(x), 4096):
                d = _to(x[at : at + 4096], held.value)
                own = d.argmin(1)
                yield pa.RecordBatch.from_arrays([pa.array(own.astype(np.int32)), b.column(0).slice(at, 4096), b.column(1).slice(at, 4096), pa.array(d[np.arange(len(own)), own])], ["part", "id", "vec", "r"])

    found = written(base.select("id", F.col("vec").cast("array<double>").alias("vec")).mapInArrow(run, "part int, id long, vec array<double>, r double"))
    sizes = np.zeros((len(pivots), 3))
    for r in found.groupBy("part").agg(F.count("*").alias("n"), F.min("r").alias("low"), F.max("r").alias("high")).collect():  # one row a pivot
        sizes[r.part] = r.n, r.low, r.high
    return found, pivots, sizes


def _asked(queries: DataFrame, shared, k: int) -> DataFrame:
    """(qid, vec, part): with the column bound null the first parts to meet, else all others whose lower bound is not over it."""

    def run(batches):
        pivots, sizes = shared.value
        n, low, high = sizes.T
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                b = whole.slice(at, 1024)
                d = _to(matrix(b.column(1)), pivots)
                slack = SLACK * (1 + d + high)
                order = np.argsort(d + high, 1, kind="stable")
                enough = np.cumsum(n[order], 1)
                first = np.zeros(d.shape, bool)  # the parts up to the one by which k vectors are sure
                np.put_along_axis(first, order, (enough - n[order] < k) & (n[order] > 0), 1)
                bound = np.asarray(b.column(2).fill_null(np.nan))[:, None]
                least = np.maximum(np.maximum(d - high, low - d), 0) - slack
                row, part = np.nonzero(np.where(np.isnan(bound), first, ~first & (least <= bound) & (n > 0)))
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(row)), b.column(1).take(pa.array(row)), pa.array(part.astype(np.int32))], ["qid", "vec", "part"])

    return queries.select("qid", "vec", "bound").mapInArrow(run, "qid long, vec array<double>, part int")


def _met(asked: DataFrame, base: DataFrame, k: int) -> DataFrame:
    """(qid, id, dist): the k best of every meeting."""
    lots = base.groupBy("part").agg(F.ceil(F.count("*") / LOT).alias("lots"))
    blocks = asked.groupBy("part").agg(F.ceil(F.count("*") / BLOCK).alias("blocks"))
    sizes = lots.join(blocks, "part")
    every = lambda c: F.explode(F.sequence(F.lit(0).cast("long"), F.col(c) - 1))
    number = lambda c, n: F.pmod(F.xxhash64(c), F.col(n))
    q = asked.join(sizes, "part").select("part", number("qid", "blocks").alias("i"), every("lots").alias("j"), F.lit(True).alias("asks"), F.col("qid").alias("id"), "vec")
    b = base.join(sizes, "part").select("part", every("blocks").alias("i"), number("id", "lots").alias("j"), F.lit(False).alias("asks"), "id", "vec")

    def meet(table: pa.Table) -> pa.Table:
        asks = np.asarray(table.column("asks"))
        ids, x = np.asarray(table.column("id")), matrix(table.column("vec").combine_chunks())
        if asks.all() or not asks.any():
            return pa.table({"qid": pa.array([], pa.int64()), "id": pa.array([], pa.int64()), "dist": pa.array([], pa.float64())})
        return pa.Table.from_batches([_best(ids[asks], x[asks], [(ids[~asks], x[~asks])], k)])

    return q.union(b).groupBy("part", "i", "j").applyInArrow(meet, "qid long, id long, dist double")


def bounded_knn(queries: DataFrame, base: DataFrame, k: int, parts: int | None = None, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """((qid, id, dist, rank) as exact_knn gives them, (n_pairs, n_all): pairs compared, and all there are)."""
    held, pivots, sizes = parted(base, parts, seed)
    shared = base.sparkSession.sparkContext.broadcast((pivots, sizes))
    asked = written(queries.select("qid", F.col("vec").cast("array<double>").alias("vec")))
    if not len(pivots):
        none = asked.select("qid", F.lit(0).cast("long").alias("id"), F.lit(0.0).alias("dist"), F.lit(1).alias("rank")).limit(0)
        return none, asked.agg(F.lit(0).cast("long").alias("n_pairs"), F.lit(0).cast("long").alias("n_all"))
    one = written(_asked(asked.withColumn("bound", F.lit(None).cast("double")), shared, k))
    near = written(topk(_met(one, held, k), k))
    # Fewer than k vectors in all: every part was met in the first round.
    bound = near.groupBy("qid").agg(F.when(F.count("*") == k, F.sqrt(F.max("dist"))).otherwise(F.lit(float("inf"))).alias("bound"))
    two = written(_asked(asked.join(bound, "qid"), shared, k))
    found = topk(near.drop("rank").union(_met(two, held, k)), k)
    in_part = held.groupBy("part").agg(F.count("*").alias("n"))
    pairs = one.select("part").union(two.select("part")).groupBy("part").count().join(in_part, "part").agg(F.coalesce(F.sum(F.col("count") * F.col("n")), F.lit(0)).alias("n_pairs"))
    every = asked.agg((F.count("*") * int(sizes[:, 0].sum())).alias("n_all"))
    return found, pairs.crossJoin(every)  # one row each
