"""Indexes: the staged index with its tables, and single-graph searches."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import asdict, dataclass
from hashlib import sha256

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.vectors import checked, prefix
from ..operators import arrow_walk, entry, exact, graph, linalg
from ..operators.topk import topk
from ..operators.walk import Walk, staged_walk, walk
from .scratch import exists, written

#: Candidates of a node when an index is built.
EF_BUILD = 80
#: Vectors of a shard, which one task compares with each other.
SHARD_ROWS = 50_000
_CONFIG = "d_model int, d_principle int, sample_ratio double, graph_method string, entry_method string, seed long"
_TABLES = ("vectors", "rotation", "edges", "sample", "sub_edges", "routers", "entries")


@dataclass(frozen=True)
class Config:
    d_model: int
    d_principle: int
    sample_ratio: float = 0.25
    graph_method: str = "nsw32"
    entry_method: str = "random32"
    seed: int = 0

    @property
    def graph(self) -> tuple[str, int]:
        name = self.graph_method.rstrip("0123456789")
        return name, int(self.graph_method[len(name) :])


class EntrySelector:
    """Entry points by method: random{N} or router{R}x{L}."""

    def __init__(self, method: str, seed: int = 0):
        self.kind, self.n, self.leaves = entry.parse_method(method)
        self.seed = seed
        self.routers: DataFrame | None = None
        self.entries: DataFrame | None = None

    def train(self, vectors: DataFrame, dims: int) -> EntrySelector:
        if self.kind == "random":
            self.entries = entry.random_entries(vectors, self.n, self.seed)
        else:
            self.routers, self.entries = entry.router_entries(vectors, self.n, self.leaves, dims, self.seed)
        return self

    def search(self, queries: DataFrame, vectors: DataFrame, dims: int) -> DataFrame:
        return entry.entry_distances(queries, self.entries, vectors, dims, self.routers)

    def nodes(self) -> DataFrame:
        return self.entries.select("id").distinct()


class StagedIndex:
    """Tables: vectors (id, vec, prefix), rotation, edges, sample, sub_edges, routers, entries; and a config."""

    def __init__(self, config: Config, tables: dict[str, DataFrame]):
        self.config, self.tables, self._broadcast, self._rows = config, tables, None, None

    @classmethod
    def build(cls, vectors: DataFrame, config: Config, path: str, rotation: np.ndarray | None = None, ef: int = EF_BUILD, mode: str = "insert") -> StagedIndex:
        """Build all tables from (id, vec), each written to path before the next reads it. rotation: use this one instead of the SVD. ef and mode: candidates of a node and how they are found (graph.build_graph).

        A build that was stopped goes on at the first table that is not whole, if vectors, config,
        ef and mode are the same (else an error); the config is written last, and load refuses
        a path without it.
        """
        spark, c = vectors.sparkSession, config
        if not 0 < c.sample_ratio <= 1 or not 0 < c.d_principle <= c.d_model:
            raise ValueError("sample_ratio must be in (0, 1] and d_principle in [1, d_model]")
        vectors = vectors.select("id", checked("vec", c.d_model).alias("vec"))

        def table(name: str, make: Callable[[], DataFrame]) -> DataFrame:
            if not exists(spark, f"{path}/{name}/_SUCCESS"):
                make().write.mode("overwrite").parquet(f"{path}/{name}")
            return spark.read.parquet(f"{path}/{name}")

        of = vectors.agg(F.count("*").alias("n"), F.sum(F.xxhash64("id", "vec").cast("decimal(38,0)")).cast("string").alias("digest"))
        of = of.select("*", F.lit(f"{c} {ef} {mode} {None if rotation is None else sha256(rotation.tobytes()).hexdigest()}").alias("what")).first()
        began = table("build", lambda: spark.createDataFrame([of], "n long, digest string, what string").coalesce(1)).first()
        if began != of:
            raise ValueError(f"{path} holds a build of other vectors or settings")
        table("rotation", lambda: linalg.rotation_table(spark, linalg.svd(vectors, c.d_model, max_size=10_000_000, seed=c.seed, rank=c.d_principle)[0] if rotation is None else rotation))
        v = linalg.rotation_of(spark.read.parquet(f"{path}/rotation"), c.d_model)
        held = table("vectors", lambda: linalg.rotate(vectors, v).select("id", F.col("vec").cast("array<float>").alias("vec"), prefix("vec", c.d_principle).cast("array<float>").alias("prefix")))
        method, degree = c.graph
        edges = table("edges", lambda: graph.build_graph(held.select("id", "vec"), method, degree, c.d_model, ef, mode))
        sample = table("sample", lambda: graph.sample_nodes(edges, held.select("id"), max(1, int(of.n * c.sample_ratio)), 1, c.seed))
        table("sub_edges", lambda: graph.subgraph(held.select("id", "vec"), sample, method, degree, c.d_model, ef, mode))
        train = lambda: EntrySelector(c.entry_method, c.seed).train(held.select("id", F.col("prefix").alias("vec")), c.d_principle)
        table("entries", lambda: train().entries)
        none = spark.createDataFrame([], "router int, vec array<double>")
        table("routers", lambda: none if train().routers is None else train().routers)
        table("config", lambda: spark.createDataFrame([tuple(asdict(c).values())], _CONFIG).coalesce(1))
        return cls.load(spark, path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> StagedIndex:
        if not exists(spark, f"{path}/config/_SUCCESS"):
            raise ValueError(f"{path} holds no whole index")
        row = spark.read.parquet(f"{path}/config").first()
        return cls(Config(**row.asDict()), {t: spark.read.parquet(f"{path}/{t}") for t in _TABLES})

    def save(self, path: str) -> None:
        spark = self.tables["vectors"].sparkSession
        for name, df in self.tables.items():
            df.write.parquet(f"{path}/{name}")
        spark.createDataFrame([tuple(asdict(self.config).values())], _CONFIG).coalesce(1).write.parquet(f"{path}/config")

    def rotation(self) -> np.ndarray:
        return linalg.rotation_of(self.tables["rotation"], self.config.d_model)

    def rotated(self, queries: DataFrame) -> DataFrame:
        return linalg.rotate(queries.select("qid", checked("vec", self.config.d_model).alias("vec")), self.rotation())

    def _entries(self, queries: DataFrame) -> DataFrame:
        t, c = self.tables, self.config
        p = t["vectors"].select("id", F.col("prefix").alias("vec"))
        q = queries.select("qid", prefix("vec", c.d_principle).alias("vec"))
        return entry.entry_distances(q, t["entries"], p, c.d_principle, t["routers"] if c.entry_method.startswith("router") else None)

    def rows(self) -> DataFrame:
        """The index as one row a vector (arrow_walk.index_rows), written once; refused above the size that a task may hold."""
        t, c = self.tables, self.config
        if self._rows is None:
            widest = max((r.n or 0) for e in (t["edges"], t["sub_edges"]) for r in e.groupBy("src").count().agg(F.max("count").alias("n")).collect())
            if not arrow_walk.fits(t["vectors"], c.d_model, widest):
                raise ValueError("the index is too large for a task: use tier='relational' or ShardedIndex")
            self._rows = written(arrow_walk.index_rows(t["vectors"], t["edges"], t["sub_edges"]))
        return self._rows

    def starts(self) -> arrow_walk.Starts:
        return arrow_walk.Starts.of(self.tables["entries"], self.tables["routers"] if self.config.entry_method.startswith("router") else None)

    def deploy(self) -> StagedIndex:
        """Broadcast the index for the Arrow tier: all of it passes the driver, and later searches need no shuffle. Refused above its size bound."""
        if self._broadcast is None:
            local = self.starts().local(self.rows().toArrow(), self.config.d_principle)
            self._broadcast = self.tables["vectors"].sparkSession.sparkContext.broadcast(local)
        return self

    def staged(self, queries: DataFrame, ef: int, rounds: int | None = None) -> list[Walk]:
        t, c = self.tables, self.config
        q = written(self.rotated(queries))
        return staged_walk(q, t["vectors"].select("id", "vec"), t["edges"], t["sub_edges"], self._entries(q).select("qid", "id"), ef, c.d_model, c.d_principle, rounds)

    def counts(self, queries: DataFrame, ef: int, max_iter: int | None = None) -> DataFrame:
        """(qid, stage, n_steps, n_visited, n_computed) of the Arrow tier's search."""
        return arrow_walk.arrow_counts(self.rotated(queries), self.deploy()._broadcast, ef, max_iter)

    def search(self, queries: DataFrame, k: int, ef: int, tier: str = "arrow", max_iter: int | None = None, chunk_size: int = arrow_walk.CHUNK) -> DataFrame:
        """(qid, rank, id, dist): the k nearest found. tier: arrow, relational or exact.

        max_iter: steps of a stage at most (arrow, relational). chunk_size: queries that the Arrow tier advances together.
        The Arrow tier's tasks get the index by the shuffle, or have it as a broadcast after deploy().
        """
        if ef < k:
            raise ValueError("ef must be at least k")
        cols = ["qid", "rank", "id", "dist"]
        if tier == "arrow":
            if self._broadcast is not None:
                return arrow_walk.arrow_search(self.rotated(queries), self._broadcast, k, ef, max_iter, chunk_size)
            return arrow_walk.whole_search(self.rotated(queries), self.rows(), self.starts(), self.config.d_principle, k, ef, max_iter, chunk_size)
        if tier == "relational":
            return self.staged(queries, ef, max_iter)[-1].result(k).select(*cols)
        if tier == "exact":
            return exact.exact_knn(self.rotated(queries), self.tables["vectors"], k, self.config.d_model).select(*cols)
        raise ValueError(f"unknown tier {tier!r}")


def single_search(queries: DataFrame, vectors: DataFrame, edges: DataFrame, entries: DataFrame, k: int, ef: int, dims: int) -> DataFrame:
    """One walk over one graph (all of it, or a subgraph) from shared entries (id), or from those of each query (qid, id)."""
    init = entries.select("qid", "id") if "qid" in entries.columns else queries.select("qid").crossJoin(F.broadcast(entries.select("id").distinct()))  # the entry list is a parameter
    return walk(queries, vectors, edges, init, ef, dims).result(k)


def prefix_then_full(queries: DataFrame, vectors: DataFrame, edges: DataFrame, entries: DataFrame, k: int, ef: int, dims: int, d_principle: int) -> DataFrame:
    """A walk over the first coordinates with 4 * ef, then one at full width from its pool, on the same graph."""
    init = queries.select("qid").crossJoin(F.broadcast(entries.select("id").distinct()))
    first = walk(queries, vectors, edges, init, 4 * ef, d_principle)
    return walk(queries, vectors, edges, first.pool.select("qid", "id"), ef, dims).result(k)


def oracle_search(queries: DataFrame, vectors: DataFrame, edges: DataFrame, truth: DataFrame, k: int, ef: int, dims: int, known: float, seed: int = 0) -> DataFrame:
    """A walk from round(known * ef) draws, with replacement, of each query's true ef nearest."""
    n = max(1, round(known * ef))
    draws = queries.select("qid", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("draw"))
    draws = draws.withColumn("rank", 1 + (F.col("qid") * 7919 + F.col("draw") * 104729 + seed) % 10007 % ef)
    init = draws.join(truth.select("qid", "rank", "id"), ["qid", "rank"]).select("qid", "id")
    return walk(queries, vectors, edges, init, ef, dims).result(k)

