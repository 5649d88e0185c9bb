"""Entry points: shared pseudo-random nodes, or routers with leaves."""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vectors import l2sq, portable_hash
from .linalg import numbered

_SCHEMA = "router int, leaf int, id long"


def random_entries(nodes: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """(router null, leaf, id): n shared nodes in pseudo-random order."""
    ids = [r.id for r in nodes.select("id").orderBy(portable_hash("id", seed), "id").limit(n).collect()]
    return nodes.sparkSession.createDataFrame([(None, i, v) for i, v in enumerate(ids)], _SCHEMA)


def choose_routers(vectors: DataFrame, n_routers: int, seed: int = 0) -> list[tuple[int, list[float]]]:
    """The first in pseudo-random order, then of each next n_routers candidates the one with the largest sum of distances to those chosen."""
    rows = vectors.select("id", "vec").orderBy(portable_hash("id", seed), "id").limit(1 + n_routers * max(0, n_routers - 1)).collect()
    if len(rows) < n_routers:
        raise ValueError("fewer vectors than routers")
    x = np.array([r.vec for r in rows], np.float64)
    chosen = [0]
    total = np.sqrt(((x - x[0]) ** 2).sum(1))
    for step in range(1, n_routers):
        lot = [i for i in range(1 + (step - 1) * n_routers, min(len(rows), 1 + step * n_routers)) if i not in chosen] or [i for i in range(len(rows)) if i not in chosen]
        best = min(lot, key=lambda i: (-round(total[i], 9), rows[i].id))
        chosen.append(best)
        total = total + np.sqrt(((x - x[best]) ** 2).sum(1))
    return [(rows[i].id, [float(v) for v in rows[i].vec]) for i in chosen]


def router_entries(vectors: DataFrame, n_routers: int, n_leaves: int, dims: int, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """(routers (router, vec), entries (router, leaf, id)).

    Leaf l of a router is its nearest node of the l-th batch of the pseudo-random
    order. The batches need n_leaves * min(1024, n_routers ** 2) vectors.
    """
    batch = min(1024, n_routers * n_routers)
    spark = vectors.sparkSession
    if vectors.limit(n_leaves * batch).count() < n_leaves * batch:
        raise ValueError(f"{n_leaves} leaves of {n_routers} routers need {n_leaves * batch} vectors")
    routers = spark.createDataFrame([(i, v) for i, (_, v) in enumerate(choose_routers(vectors, n_routers, seed))], "router int, vec array<double>")
    drawn = vectors.select("id", "vec").orderBy(portable_hash("id", seed), "id").limit(n_leaves * batch)
    drawn = drawn.withColumn("leaf", F.floor((F.row_number().over(Window.orderBy(portable_hash("id", seed), "id")) - 1) / batch).cast("int"))  # n_leaves * batch rows
    pairs = drawn.crossJoin(F.broadcast(routers.select("router", F.col("vec").alias("rv")))).select("router", "leaf", "id", l2sq("vec", "rv", dims).alias("dist"))
    return routers, pairs.groupBy("router", "leaf").agg(F.min(F.struct("dist", "id")).alias("m")).select("router", "leaf", "m.id")


def query_entries(queries: DataFrame, nodes: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """(qid, id): n nodes for each query, drawn for it alone, with replacement; a node drawn twice is there once."""
    held, size = numbered(nodes.select("id"))
    draws = queries.select("qid", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("draw"))
    at = portable_hash(F.concat(F.col("qid").cast("string"), F.lit("/"), F.col("draw").cast("string")), seed) % max(1, size)
    return draws.select("qid", at.alias("at")).join(held, "at").select("qid", "id").distinct()


def route(queries: DataFrame, routers: DataFrame, dims: int) -> DataFrame:
    """(qid, router): the nearest router."""
    pairs = queries.crossJoin(F.broadcast(routers.select("router", F.col("vec").alias("rv")))).select("qid", "router", l2sq("vec", "rv", dims).alias("dist"))
    return pairs.groupBy("qid").agg(F.min(F.struct("dist", "router")).alias("m")).select("qid", "m.router")


def entry_distances(queries: DataFrame, entries: DataFrame, vectors: DataFrame, dims: int, routers: DataFrame | None = None) -> DataFrame:
    """(qid, id, dist): squared distances to all shared entries, or to the leaves of the nearest router."""
    held = entries.select("router", "id").distinct().join(vectors, "id").select("router", "id", F.col("vec").alias("ev"))
    if routers is None:
        pairs = queries.crossJoin(F.broadcast(held.select("id", "ev")))  # the entry list is a parameter
    else:
        pairs = queries.join(F.broadcast(route(queries, routers, dims)), "qid").join(F.broadcast(held), "router")
    return pairs.select("qid", "id", l2sq("vec", "ev", dims).alias("dist"))


def parse_method(method: str) -> tuple[str, int, int]:
    """random32 -> (random, 32, 0); router8x16 -> (router, 8, 16)."""
    if m := re.fullmatch(r"random(\d+)", method):
        return "random", int(m[1]), 0
    if m := re.fullmatch(r"router(\d+)x(\d+)", method):
        return "router", int(m[1]), int(m[2])
    raise ValueError(f"unknown entry method {method!r}")
