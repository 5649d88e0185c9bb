"""Round-synchronous graph search by joins.

State: pool (qid, id, dist, x), the ef best of each query with x for expanded rows,
and visited, a list of ids a query. A round joins the unexpanded pool to the neighbour lists, removes
what was visited, fetches vectors of the rest only, and takes the ef best again; neighbours are
lists until they are compared, so what is shuffled by query is a row an expanded node, not one an edge. Both
tables are written, so plans stay short. A frontier of at most FRONT_ROWS rows, which are
counted, is broadcast: edges and vectors are scanned where they lie and not shuffled.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import count

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import at_least, l2sq
from ..plans.scratch import written
from . import insertion
from .exact import BLOCK_VALUES, exact_knn_blocks, matrix
from .topk import topk
from .whole import shares, with_whole

#: Rows (qid, id) of a frontier that may be broadcast: some 16 MB.
FRONT_ROWS = 1 << 18
#: Pairs that a task compares, about, and of these at once.
TASK_PAIRS, PAIRS = 1 << 22, 1 << 16


@dataclass
class Walk:
    pool: DataFrame
    visited: DataFrame
    rounds: int

    def result(self, k: int) -> DataFrame:
        return topk(self.pool.select("qid", "id", "dist"), k)


def _small(df: DataFrame, rows: int, most: int) -> DataFrame:
    """df, marked for broadcast if its counted rows are not too many."""
    return F.broadcast(df) if rows <= most else df


def with_distance(pairs: DataFrame, queries: DataFrame, vectors: DataFrame, dims: int, start: int = 0) -> DataFrame:
    """(qid, id) -> (qid, id, dist); the queries of a search are few beside its vectors."""
    q = queries.select("qid", F.col("vec").alias("qv"))
    v = vectors.select("id", F.col("vec").alias("bv"))
    return pairs.join(v, "id").join(q, "qid").select("qid", "id", l2sq("qv", "bv", dims, start).alias("dist"))


def _lists(pairs: DataFrame) -> DataFrame:
    """(qid, ids) of pairs (qid, id)."""
    return pairs.groupBy("qid").agg(F.collect_list("id").alias("ids"))


def _pairs(lists: DataFrame) -> DataFrame:
    return lists.select("qid", F.explode("ids").alias("id"))


def _measured(pairs: DataFrame, n: int, asked: DataFrame, vectors: DataFrame, dims: int) -> DataFrame:
    """(qid, id, dist) of n pairs (qid, id) within far of their query. asked: few queries (qid, vec, far), which each task gets; pairs and vectors are dealt by id.

    Coordinates are summed one after the other, as l2sq does, so both give the same bits.
    """
    cut = F.slice(at_least("vec", dims), 1, dims).alias("vec")
    none = F.array().cast(vectors.schema["vec"].dataType)
    mixed = vectors.select(F.lit(None).cast("long").alias("qid"), "id", cut).union(pairs.select("qid", "id", none))

    def run(share: pa.Table, whole: pa.Table):
        names, q, far = (np.asarray(whole.column("qid")), matrix(whole.column("vec").combine_chunks()), np.asarray(whole.column("far")))
        order = np.argsort(names)
        names, q, far = names[order], np.ascontiguousarray(q[order].T), far[order]
        held = pc.is_null(share.column("qid"))
        rows, met = share.filter(held), share.filter(pc.invert(held))
        ids, x = np.asarray(rows.column("id")), matrix(rows.column("vec").combine_chunks())
        order = np.argsort(ids)
        ids, x = ids[order], np.ascontiguousarray(x[order].T)
        for b in met.select(["qid", "id"]).to_batches(max_chunksize=PAIRS):
            qid, id_ = np.asarray(b.column(0)), np.asarray(b.column(1))
            if not len(ids):
                return
            r, c = np.searchsorted(names, qid), np.minimum(np.searchsorted(ids, id_), len(ids) - 1)
            dist = np.zeros(len(r))
            for a, e in zip(q, x, strict=True):
                diff = a[r] - e[c]
                dist += diff * diff
            near = (dist <= far[r]) & (ids[c] == id_)
            yield pa.RecordBatch.from_arrays([pa.array(v[near]) for v in (qid, id_, dist)], ["qid", "id", "dist"])

    return with_whole(mixed, asked.select("qid", cut, "far"), run, "qid long, id long, dist double", "id", max(shares(asked, vectors.count()), -(-n // TASK_PAIRS)))


def walk(queries: DataFrame, vectors: DataFrame, edges: DataFrame, init: DataFrame, ef: int, dims: int, rounds: int | None = None, visited: DataFrame | None = None, stop: bool = True) -> Walk:
    """Search from init (qid, id). visited: pairs not to be met again. rounds: at most so many; None goes on until a round finds nothing. stop: end there in any case."""
    if rounds is None and not stop:
        raise ValueError("a search without a number of rounds must stop by itself")
    init = written(init.select("qid", "id").distinct())
    few = queries.count() <= BLOCK_VALUES // dims
    near = lambda pairs, n: with_distance(_small(pairs, n, FRONT_ROWS), F.broadcast(queries) if few else queries, vectors, dims)
    pool = written(topk(near(init, init.count()), ef).drop("rank").withColumn("x", F.lit(False)))
    seen = written(_lists(init if visited is None else init.union(visited.select("qid", "id")).distinct()))
    links = written(edges.groupBy(F.col("src").alias("id")).agg(F.collect_set("dst").alias("links")))
    done = 0
    for _ in count() if rounds is None else range(rounds):
        front = pool.where(~F.col("x")).select("qid", "id")
        met = _small(front, front.count(), FRONT_ROWS).join(links, "id").groupBy("qid").agg(F.array_distinct(F.flatten(F.collect_list("links"))).alias("met"))
        fresh = written(seen.join(met, "qid").select("qid", F.array_except("met", "ids").alias("ids")))
        n = fresh.agg(F.sum(F.size("ids"))).first()[0] or 0
        if stop and not n:
            break
        done += 1
        # What is farther than the last of a full pool cannot enter it, so it need not be sorted.
        full = pool.groupBy("qid").agg(F.when(F.count("*") >= ef, F.max("dist")).alias("far"))
        asked = queries.select("qid", "vec").join(full, "qid", "left").select("qid", "vec", F.coalesce("far", F.lit(float("inf"))).alias("far"))
        new = (_measured(_pairs(fresh), n, asked, vectors, dims) if few else with_distance(_pairs(fresh), asked, vectors, dims).join(asked.select("qid", "far"), "qid").where("dist <= far").drop("far")).withColumn("x", F.lit(False))
        pool = written(topk(pool.withColumn("x", F.lit(True)).unionByName(new), ef).drop("rank"))
        seen = written(seen.join(fresh.withColumnRenamed("ids", "more"), "qid", "left").select("qid", F.when(F.col("more").isNull(), F.col("ids")).otherwise(F.concat("ids", "more")).alias("ids")))
    return Walk(pool, _pairs(seen), done)


def walk_all(queries: DataFrame, vectors: DataFrame, edges: DataFrame, entries: DataFrame, k: int) -> DataFrame:
    """(qid, id, dist, rank) of a walk whose pool holds every vector, from entries (id) that all queries share.

    Such a pool drops nothing, so each query expands all that the entries reach: they are
    followed once for all queries, and what they reach is compared in blocks, not stored by query.
    """
    met = written(insertion.reached(edges, entries.select("id").distinct()))
    return exact_knn_blocks(queries, vectors.join(met.select("id"), "id", "left_semi"), k)


def walk_stats(w: Walk, stage: int, n_init: int) -> DataFrame:
    """(stage, n_steps, n_visited, n_computed), means over queries; entries count as visited but not as computed."""
    n = w.visited.groupBy("qid").count()
    return n.agg(F.lit(stage).alias("stage"), F.lit(w.rounds).cast("long").alias("n_steps"), F.round(F.avg("count"), 6).alias("n_visited"), F.round(F.avg(F.col("count") - n_init), 6).alias("n_computed"))


def staged_walk(queries: DataFrame, vectors: DataFrame, edges: DataFrame, sub_edges: DataFrame, init: DataFrame, ef: int, dims: int, d_principle: int, rounds: int | None = None, refine: int = 2) -> list[Walk]:
    """Three searches: prefix on the subgraph with 4 * ef, `refine` rounds at full width on it, then the full graph.

    The third starts from the second's pool, whose rows count as unexpanded, and does
    not meet again what the second visited.
    """
    one = walk(queries, vectors, sub_edges, init, 4 * ef, d_principle, rounds)
    best = topk(one.pool.select("qid", "id", "dist"), ef).select("qid", "id")
    two = walk(queries, vectors, sub_edges, best, ef, dims, refine)
    three = walk(queries, vectors, edges, two.pool.select("qid", "id"), ef, dims, rounds, visited=two.visited)
    return [one, two, three]
