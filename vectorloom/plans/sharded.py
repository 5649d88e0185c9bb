"""A partition-resident index: every shard is one stored block, searched where it lies.

Vectors go to the nearest of some centres; a centre with more vectors than a shard holds has
several shards, dealt by a hash of the id. A block has a shard's ids, rotated vectors, both
graphs by insertion and the entries, as one NPZ archive in a row of the table `blocks`, whose
size is bounded (SHARD_BYTES). A search broadcasts queries, in blocks of a bounded size,
with the shards they are routed to; a task that reads a block answers its queries by the
staged search. Only the answers, k a query and shard, are shuffled.
"""

from __future__ import annotations

import io
from dataclasses import asdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.vectors import checked, portable_hash
from ..operators import arrow_walk, exact, linalg
from ..operators.insertion import grown
from ..operators.topk import topk
from .index import EF_BUILD, SHARD_ROWS, Config
from .scratch import written

#: Bytes of a block at most; bytes of the centres that every task holds; rounds in which centres move to the mean of theirs.
SHARD_BYTES, CENTRE_BYTES, MOVES = 1 << 25, 1 << 28, 3
#: Values of the queries that are broadcast at once.
QUERY_VALUES = 1 << 22


def shard_rows(config: Config) -> int:
    """Vectors of a shard: SHARD_ROWS, or fewer so that a block stays below SHARD_BYTES."""
    return max(64, min(SHARD_ROWS, SHARD_BYTES // (4 * config.d_model + 8 * config.graph[1] + 16)))


def packed(ids: np.ndarray, x: np.ndarray, config: Config, ef: int = EF_BUILD) -> bytes:
    """A shard's index as an archive: its graph, and the graph, entries and nodes of a sample closed by one hop."""
    degree, n = config.graph[1], len(ids)
    rows = grown(x, degree, ef, config.seed)
    order, held = np.random.default_rng(config.seed).permutation(n), np.zeros(n, bool)
    want = max(1, int(n * config.sample_ratio))
    for at in order:
        if held.sum() >= want:
            break
        held[at] = True
        held[rows[at][rows[at] >= 0]] = True
    sample = np.flatnonzero(held)
    part = grown(x[sample], degree, ef, config.seed)
    sub = np.full((n, degree), -1, np.int32)
    sub[sample] = np.where(part >= 0, sample[part], -1)
    n_entries = int(config.entry_method.removeprefix("random")) if config.entry_method.startswith("random") else 32
    entries = sample[np.linspace(0, len(sample) - 1, min(n_entries, len(sample))).astype(int)].astype(np.int32)
    out = io.BytesIO()
    np.savez(out, ids=ids, x=np.asarray(x, np.float32), rows=rows, sub=sub, entries=entries)
    return out.getvalue()


def unpacked(block: bytes, d_principle: int) -> arrow_walk.LocalIndex:
    with np.load(io.BytesIO(block)) as a:
        return arrow_walk.LocalIndex(a["ids"], a["x"], arrow_walk.Adjacency(a["rows"]), arrow_walk.Adjacency(a["sub"]), d_principle, a["entries"][None, :], None)


def _near(x: np.ndarray, centres: np.ndarray, m: int) -> np.ndarray:
    """Numbers of the m nearest centres of each row, nearest first; equal ones by number."""
    d = (centres * centres).sum(1)[None, :] - 2 * x @ centres.T
    return np.argsort(d, 1, kind="stable")[:, :m]


def _centres(vectors: DataFrame, n: int, dims: int, seed: int, moves: int = MOVES) -> np.ndarray:
    """n vectors of the table, moved to the means of those nearest to them: partial sums a task, n rows at the driver."""
    n = min(n, max(1, CENTRE_BYTES // (8 * dims)))
    rows = vectors.orderBy(portable_hash("id", seed), "id").limit(n).collect()  # CENTRE_BYTES at most
    centres = np.array([r.vec for r in rows], np.float64).reshape(len(rows), -1)
    for _ in range(moves if len(centres) > 1 else 0):
        held = vectors.sparkSession.sparkContext.broadcast(centres)

        def sums(batches, held=held):
            total, count = np.zeros(held.value.shape), np.zeros(len(held.value), np.int64)
            for b in batches:
                x = exact.matrix(b.column(0))
                for at in range(0, len(x), 4096):
                    near = _near(x[at : at + 4096], held.value, 1)[:, 0]
                    np.add.at(total, near, x[at : at + 4096])
                    count += np.bincount(near, minlength=len(count))
            at = np.flatnonzero(count)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(count[at]), pa.array(list(total[at]), pa.list_(pa.float64()))], ["centre", "n", "total"])

        parts = vectors.select("vec").mapInArrow(sums, "centre long, n long, total array<double>")
        coords = parts.select("centre", "n", F.posexplode("total").alias("i", "v")).groupBy("centre", "i").agg(F.sum("n").alias("n"), F.sum("v").alias("v"))
        for r in coords.select("centre", "i", (F.col("v") / F.col("n")).alias("v")).toLocalIterator():
            centres[r.centre, r.i] = r.v
    return centres


class ShardedIndex:
    """For indexes larger than an executor. Tables: blocks (shard, centre, n, block), centres (centre, vec), rotation; and a config."""

    def __init__(self, config: Config, path: str, spark: SparkSession):
        self.config, self.path, self.spark = config, path, spark
        self.blocks, self.shards = spark.read.parquet(f"{path}/blocks"), spark.read.parquet(f"{path}/shards")
        self._centres = np.array([r.vec for r in spark.read.parquet(f"{path}/centres").orderBy("centre").collect()], np.float64)
        self.rotation = linalg.rotation_of(spark.read.parquet(f"{path}/rotation"), config.d_model)

    @classmethod
    def build(cls, vectors: DataFrame, config: Config, shards: int, path: str, ef: int = EF_BUILD, moves: int = MOVES) -> ShardedIndex:
        """About `shards` shards, or so many that none holds more than shard_rows. config is written last: load refuses an index without it."""
        spark, c, most = vectors.sparkSession, config, shard_rows(config)
        vectors = vectors.select("id", checked("vec", c.d_model).alias("vec"))
        v = linalg.svd(vectors, c.d_model, max_size=10_000_000, seed=c.seed, rank=c.d_principle)[0]
        linalg.rotation_table(spark, v).write.parquet(f"{path}/rotation")
        held = written(linalg.rotate(vectors, v))
        n = held.count()
        centres = _centres(held, max(1, shards, -(-n // most)), c.d_model, c.seed, moves)
        spark.createDataFrame([(i, [float(a) for a in row]) for i, row in enumerate(centres)], "centre int, vec array<double>").write.parquet(f"{path}/centres")
        shared = spark.sparkContext.broadcast(centres)

        def dealt(batches):
            for b in batches:
                x = exact.matrix(b.column(1))
                for at in range(0, len(x), 4096):
                    near = _near(x[at : at + 4096], shared.value, 1)[:, 0].astype(np.int32)
                    yield pa.RecordBatch.from_arrays([b.column(0).slice(at, 4096), b.column(1).slice(at, 4096), pa.array(near)], ["id", "vec", "centre"])

        near = written(held.select("id", F.col("vec").cast("array<float>").alias("vec")).mapInArrow(dealt, "id long, vec array<float>, centre int"))
        # Parts are filled to two thirds on the average: a hash deals unevenly.
        sizes = near.groupBy("centre").count().select("centre", F.when(F.col("count") > most, F.ceil(F.col("count") * 1.5 / most)).otherwise(1).alias("parts"))
        split = near.join(sizes, "centre").withColumn("part", F.pmod(F.xxhash64("id", F.lit(c.seed)), F.col("parts")).cast("int"))

        def block(table: pa.Table) -> pa.Table:
            table = table.sort_by("id")
            ids, x = np.asarray(table.column("id")), exact.matrix(table.column("vec").combine_chunks())
            centre, part = (table.column(name)[0].as_py() for name in ("centre", "part"))
            return pa.table({"centre": pa.array([centre], pa.int32()), "part": pa.array([part], pa.int32()), "n": pa.array([len(ids)], pa.int64()), "block": pa.array([packed(ids, x, c, ef)], pa.binary())})

        made = split.groupBy("centre", "part").applyInArrow(block, "centre int, part int, n long, block binary")
        made = made.withColumn("shard", F.col("centre").cast("long") * F.lit(1 << 20) + F.col("part"))
        # One block a file, so that a task reads one; the archive is not compressed again.
        made.write.option("maxRecordsPerFile", 1).option("compression", "none").parquet(f"{path}/blocks")
        spark.read.parquet(f"{path}/blocks").select("shard", "centre", "n").coalesce(1).write.parquet(f"{path}/shards")
        spark.createDataFrame([tuple(asdict(c).values())], "d_model int, d_principle int, sample_ratio double, graph_method string, entry_method string, seed long").coalesce(1).write.parquet(f"{path}/config")
        return cls(c, path, spark)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> ShardedIndex:
        return cls(Config(**spark.read.parquet(f"{path}/config").first().asDict()), path, spark)

    def search(self, queries: DataFrame, k: int, ef: int, probes: int | None = None) -> DataFrame:
        """(qid, rank, id, dist). probes: a query visits the shards of so many nearest centres; None visits all.

        Queries pass the driver in blocks of QUERY_VALUES values, one reading of the routed shards each.
        """
        q = linalg.rotate(queries.select("qid", checked("vec", self.config.d_model).alias("vec")), self.rotation)
        found, ids, rows = None, [], []
        most = max(1, QUERY_VALUES // self.config.d_model)
        for r in q.toLocalIterator():
            ids.append(r.qid)
            rows.append(r.vec)
            if len(ids) == most:
                part = self._asked(np.array(ids, np.int64), np.array(rows, np.float64), k, ef, probes)
                found, ids, rows = part if found is None else found.union(part), [], []
        if ids or found is None:
            part = self._asked(np.array(ids, np.int64), np.array(rows, np.float64).reshape(len(rows), self.config.d_model), k, ef, probes)
            found = part if found is None else found.union(part)
        return topk(found, k)

    def _asked(self, ids: np.ndarray, q: np.ndarray, k: int, ef: int, probes: int | None) -> DataFrame:
        """(qid, id, dist): the k best of each routed shard."""
        near = _near(q, self._centres, min(probes or len(self._centres), len(self._centres))) if len(q) else np.zeros((0, 1), int)
        shared = self.spark.sparkContext.broadcast((ids, q, near))
        d_principle = self.config.d_principle

        def visit(batches):
            names, asked, route = shared.value
            for b in batches:
                for centre, block in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                    use = np.flatnonzero((route == centre).any(1))
                    if not len(use):
                        continue
                    i, d = unpacked(block.as_buffer().to_pybytes(), d_principle).search(asked[use], k, ef)
                    live = (i >= 0).ravel()
                    yield pa.RecordBatch.from_arrays([pa.array(np.repeat(names[use], k)[live]), pa.array(i.ravel()[live]), pa.array(d.ravel()[live])], ["qid", "id", "dist"])

        chosen = self.blocks.where(F.col("centre").isin([int(c) for c in np.unique(near)])) if probes and len(np.unique(near)) <= 1000 else self.blocks
        return chosen.select("centre", "block").mapInArrow(visit, "qid long, id long, dist double")
