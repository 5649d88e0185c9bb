"""Proximity graphs as edge tables (src, dst, rank, dist), hop closures and subgraph samples."""

from __future__ import annotations

from collections.abc import Callable
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import l2sq, portable_hash
from ..plans.scratch import written
from . import insertion
from .exact import BLOCK, exact_knn_blocks, matrix, pair_distances
from .insertion import node_batches
from .topk import topk

#: Vectors of a cluster part that one task compares.
PART_ROWS = 4096
#: Bytes of the centres that every task holds, and distances to them that it computes at once.
CENTRE_BYTES, CENTRE_VALUES = 1 << 28, 1 << 22
#: Vectors whose true neighbours decide how many centres are probed.
PROBE_SAMPLE = 256


def _ranked(pairs: DataFrame, k: int) -> DataFrame:
    return topk(pairs.select("src", "dst", "dist"), k, "src", ("dist", "dst"))


def knn_graph(vectors: DataFrame, k: int, dims: int, mode: str = "exact") -> DataFrame:
    """Each vector's k nearest others. mode: exact at any size, which costs the square of it, or clusters (approximate, to a recall measured on a sample)."""
    if mode == "clusters":
        return cluster_knn_graph(vectors, k, dims)
    if mode != "exact":
        raise ValueError(f"unknown mode {mode!r}")
    queries = vectors.select(F.col("id").alias("qid"), "vec")
    few = vectors.limit(BLOCK // 4 + 1).count() <= BLOCK // 4
    found = pair_distances(queries, vectors, dims).where("qid <> id") if few else exact_knn_blocks(queries, vectors, k + 1).where("qid <> id")
    return _ranked(found.withColumnsRenamed({"qid": "src", "id": "dst"}), k)


def cluster_knn_graph(vectors: DataFrame, k: int, dims: int, per_cluster: int = 1024, probes: int | None = None, seed: int = 0, part_rows: int = PART_ROWS, recall: float = 0.95) -> DataFrame:
    """Approximate neighbours for many vectors: each goes to its `probes` nearest of sampled centres and is compared with all others there.

    probes: None takes the fewest that reach `recall` on a sample (probes_for); up to all
    centres, which is exact. The centres are at most 4 * sqrt(n) rows and CENTRE_BYTES. A
    cluster of over part_rows vectors is dealt into parts, and each pair of parts is compared
    by a task of its own, so no neighbour in a cluster is lost, however hot it is.
    """
    n = vectors.count()
    most = max(1, min(n // per_cluster, int(n**0.5) * 4, CENTRE_BYTES // (8 * dims)))
    rows = vectors.select("id", "vec").orderBy(F.xxhash64("id", F.lit(seed)), "id").limit(max(probes or 1, most)).collect()
    centres = vectors.sparkSession.sparkContext.broadcast((np.array([r.id for r in rows], np.int64), np.array([r.vec for r in rows], np.float64)))
    if probes is None:
        probes = probes_for(vectors, centres, k, recall, seed)
    near = _nearest_centres(vectors, centres, probes)
    sizes = near.groupBy("centre").count().select("centre", F.ceil(F.col("count") / part_rows).alias("parts"))
    dealt = near.join(vectors, "id").join(sizes, "centre").withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    dealt = dealt.select("centre", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"), "part", "id", "vec")

    def neighbours(table: pa.Table) -> pa.Table:
        i, j = table.column("i")[0].as_py(), table.column("j")[0].as_py()
        part, ids, x = np.asarray(table.column("part")), np.asarray(table.column("id")), matrix(table.column("vec").combine_chunks())
        src, dst, dist = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]
        for a, b in {(i, j), (j, i)}:
            own, others = np.flatnonzero(part == a), np.flatnonzero(part == b)
            sq = (x[others] ** 2).sum(1)
            for at in range(0, len(own), 512):
                rows = own[at : at + 512]
                d = (x[rows] ** 2).sum(1)[:, None] + sq[None, :] - 2 * x[rows] @ x[others].T
                d[ids[rows][:, None] == ids[others][None, :]] = np.inf
                m = min(k, len(others) - (a == b))
                if m > 0:
                    c = others[np.argpartition(d, m - 1, axis=1)[:, :m]].ravel()
                    r = np.repeat(rows, m)
                    src.append(ids[r])
                    dst.append(ids[c])
                    dist.append(((x[r] - x[c]) ** 2).sum(1))
        return pa.table({"src": np.concatenate(src), "dst": np.concatenate(dst), "dist": np.concatenate(dist)})

    found = dealt.groupBy("centre", "i", "j").applyInArrow(neighbours, "src long, dst long, dist double")
    return _ranked(found.where("src <> dst").groupBy("src", "dst").agg(F.min("dist").alias("dist")), k)


def _to_centres(x: np.ndarray, c: np.ndarray):
    """Squared distances to the centres, less each row's own square, in lots of rows that fit in memory: (rows, distances)."""
    sq, lot = (c * c).sum(1)[None, :], max(1, CENTRE_VALUES // max(1, len(c)))
    for at in range(0, len(x), lot):
        yield slice(at, at + lot), sq - 2 * x[at : at + lot] @ c.T


def _nearest_centres(vectors: DataFrame, centres, probes: int) -> DataFrame:
    """(id, centre) for the nearest centres of each vector; centres: a broadcast (ids, vectors)."""

    def run(batches):
        ids, c = centres.value
        m = min(probes, len(ids))
        for b in batches:
            own = np.asarray(b.column(0))
            for rows, d in _to_centres(matrix(b.column(1)), c):
                top = np.argpartition(d, m - 1, axis=1)[:, :m]
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(own[rows], m)), pa.array(ids[top.ravel()])], ["id", "centre"])

    return vectors.select("id", "vec").mapInArrow(run, "id long, centre long")


def probes_for(vectors: DataFrame, centres, k: int, recall: float, seed: int = 0) -> int:
    """The fewest probes by which a share `recall` of the true k nearest of PROBE_SAMPLE vectors is found; at least 1.

    Two vectors are compared if a centre is among the probes nearest of both, and a true
    neighbour that is compared is kept, so the recall of any number of probes follows from
    the ranks of the centres. The true neighbours take one scan of all vectors.
    """
    asked = written(vectors.orderBy(portable_hash("id", seed), "id").limit(PROBE_SAMPLE).select(F.col("id").alias("qid"), F.col("vec").alias("qv")))
    true = topk(exact_knn_blocks(asked.select("qid", F.col("qv").alias("vec")), vectors, k + 1).where("qid <> id").drop("rank"), k)
    held = vectors.select("id", "vec").join(F.broadcast(true.select("qid", "id")), "id")  # PROBE_SAMPLE * k rows
    pairs = held.join(F.broadcast(asked), "qid").select("qv", "vec")

    def least(batches):
        _, c = centres.value
        place = lambda d: d.argsort(1, kind="stable").argsort(1, kind="stable")
        for b in batches:
            for (_, d), (_, e) in zip(_to_centres(matrix(b.column(0)), c), _to_centres(matrix(b.column(1)), c), strict=True):
                yield pa.RecordBatch.from_arrays([pa.array(1 + np.maximum(place(d), place(e)).min(1))], ["probes"])

    needed = pairs.mapInArrow(least, "probes long").agg(F.expr(f"percentile_disc({recall}) WITHIN GROUP (ORDER BY probes)").alias("p")).first().p
    return int(needed or 1)


def prune(edges: DataFrame, vectors: DataFrame, dims: int) -> DataFrame:
    """(src, dst, dist) without the (u, v) where some candidate w of u is nearer to u, and nearer to v than u is."""

    def seen(dist: np.ndarray, x: np.ndarray) -> list[int]:
        x, nearer = x[:, :dims], np.searchsorted(dist, dist, "left")
        # Equal distances may be summed in another order: the slack keeps them equal.
        return [i for i, n in enumerate(nearer) if not (((x[:n] - x[i]) ** 2).sum(1) < dist[i] * (1 - 1e-12)).any()]

    return _of_each_node(edges, vectors, seen)


def diverse(edges: DataFrame, vectors: DataFrame, most: int) -> DataFrame:
    """At most `most` edges of each node: from the nearest on, those nearer to it than to any chosen before, then the nearest others."""

    def chosen(dist: np.ndarray, x: np.ndarray) -> list[int]:
        kept, rest = [], []
        for i in range(len(dist)):
            if len(kept) == most:
                break
            (kept if not kept or (((x[kept] - x[i]) ** 2).sum(1) >= dist[i]).all() else rest).append(i)
        return sorted(kept + rest[: most - len(kept)])

    return _ranked(_of_each_node(edges, vectors, chosen), most)


def _of_each_node(edges: DataFrame, vectors: DataFrame, chosen: Callable[[np.ndarray, np.ndarray], list[int]]) -> DataFrame:
    """(src, dst, dist) at the places that chosen(distances, vectors) names, of each node's edges from the nearest on.

    A node's candidates and their vectors meet once, in a sorted stream of node batches.
    """
    held = vectors.select(F.col("id").alias("dst"), F.col("vec").alias("dvec"))
    rows = edges.select("src", "dst", "dist").join(held, "dst").select("src", "dst", "dist", "dvec").repartition("src").sortWithinPartitions("src", "dist", "dst")

    def run(batches):
        for table in node_batches(batches):
            yield from picked(table)

    def picked(table: pa.Table):
        src, dist, x = np.asarray(table.column("src")), np.asarray(table.column("dist")), matrix(table.column("dvec").combine_chunks())
        starts = np.flatnonzero(np.concatenate([[True], src[1:] != src[:-1]]))
        at = [lo + i for lo, hi in zip(starts, [*starts[1:], len(src)], strict=True) for i in chosen(dist[lo:hi], x[lo:hi])]
        yield from table.select(["src", "dst", "dist"]).take(pa.array(at)).to_batches()

    return rows.mapInArrow(run, "src long, dst long, dist double")


def nsw_graph(vectors: DataFrame, n_neighbors: int, dims: int, ef: int | None = None, mode: str = "exact") -> DataFrame:
    """Half of n_neighbors edges a node and their reverse, at most n_neighbors each.

    mode insert: nodes enter one batch after the other (insertion.insert_graph), and each
    reaches every other. Else the candidates are a kNN graph's: without ef the half are the nearest ones; with ef they are diverse ones of the ef
    nearest, and so are those that stay of a node with more reverse edges than fit.
    """
    if mode == "insert":
        return insertion.insert_graph(vectors, n_neighbors, dims, ef or insertion.EF)
    if ef is None:
        half = knn_graph(vectors, n_neighbors // 2, dims, mode).select("src", "dst", "dist")
    else:
        half = written(diverse(written(knn_graph(vectors, max(ef, n_neighbors), dims, mode)), vectors, n_neighbors // 2)).select("src", "dst", "dist")
    both = half.union(half.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "dist")).groupBy("src", "dst").agg(F.min("dist").alias("dist"))
    return _ranked(both, n_neighbors) if ef is None else diverse(both, vectors, n_neighbors)


def nsg_graph(vectors: DataFrame, n_neighbors: int, dims: int, ef: int = 80, repair: bool = True, mode: str = "exact") -> DataFrame:
    """Pruned candidates, at most n_neighbors each; with repair every node can be reached from the medoid.

    mode insert: candidates are what a search from the medoid visits (always repaired). Else
    they are the ef nearest of a kNN graph. The repair stays within n_neighbors.
    """
    if mode == "insert":
        start = medoid(vectors, dims)
        return _ranked(insertion.search_path_graph(vectors, n_neighbors, dims, ef, start), n_neighbors)
    most = insertion.room(n_neighbors) if repair else n_neighbors
    edges = _ranked(prune(written(knn_graph(vectors, ef, dims, mode)), vectors, dims), most)
    if not repair:
        return edges
    return _ranked(insertion.connected(written(edges), vectors, n_neighbors, medoid(vectors, dims)), n_neighbors)


def build_graph(vectors: DataFrame, method: str, n_neighbors: int, dims: int, ef: int | None = None, mode: str = "exact") -> DataFrame:
    """method: knn, nsw or nsg. ef: candidates of a node (nsw: the nearest only where it is None; nsg: 80)."""
    if method == "nsw":
        return nsw_graph(vectors, n_neighbors, dims, ef, mode)
    if method == "nsg":
        return nsg_graph(vectors, n_neighbors, dims, ef or 80, mode=mode)
    if method == "knn":
        return knn_graph(vectors, n_neighbors, dims, mode)
    raise ValueError(f"unknown graph method {method!r}")


def degree_stats(edges: DataFrame) -> DataFrame:
    out = edges.groupBy("src").count()
    return out.agg(F.count("*").alias("n_nodes"), F.sum("count").cast("long").alias("n_edges"), F.min("count").alias("min_degree"), F.max("count").alias("max_degree"), F.round(F.avg("count"), 6).alias("mean_degree"))


def medoid(vectors: DataFrame, dims: int) -> int:
    """The vector nearest to the mean."""
    mean = vectors.select([F.avg(F.col("vec")[i]).alias(f"m{i}") for i in range(dims)]).first()
    centre = F.array(*[F.lit(float(m)) for m in mean])
    return vectors.select("id", l2sq(F.col("vec"), centre, dims).alias("dist")).orderBy("dist", "id").first().id


def khop(edges: DataFrame, seeds: DataFrame, hops: int) -> DataFrame:
    """(seed, id, hop): nodes within `hops` of each seed, each with its least hop."""
    found = seeds.select(F.col("id").alias("seed"), "id", F.lit(0).alias("hop"))
    front = found
    for h in range(1, hops + 1):
        front = front.join(edges, F.col("id") == F.col("src")).select("seed", F.col("dst").alias("id"), F.lit(h).alias("hop")).distinct()
        found = found.union(front)
    return found.groupBy("seed", "id").agg(F.min("hop").alias("hop"))


def unreached(edges: DataFrame, nodes: DataFrame, start: int) -> DataFrame:
    """Nodes that no path from start reaches."""
    return nodes.join(insertion.reached(edges, nodes.where(F.col("id") == start)), "id", "left_anti")


def sample_nodes(edges: DataFrame, nodes: DataFrame, n: int, hops: int = 1, seed: int = 0) -> DataFrame:
    """Seeds in pseudo-random order with their closures, until n nodes are covered; whole closures, so it may overshoot."""
    order = nodes.select("id", portable_hash("id", seed).alias("h"))
    size, degree = nodes.count(), edges.count()
    # Only a prefix of the seeds is expanded: twice what would do without overlaps, then twice as many until n nodes are met.
    share = min(1.0, 2 * n / max(1.0, size * (1 + degree / max(1, size)) ** hops))
    while True:
        chosen = order.where(F.col("h") < int(share * (1 << 32)))
        reach = khop(edges, chosen.select("id"), hops).select("seed", "id").join(chosen.select(F.col("id").alias("seed"), "h"), "seed")
        first = written(reach.groupBy("id").agg(F.min(F.struct("h", "seed")).alias("m")).select("id", "m.h", "m.seed"))
        if share >= 1 or first.count() >= n:
            break
        share = min(1.0, 2 * share)
    # Counts by 12 bits of the 32-bit hash find where n is met; twice, so that few seeds are ranked one by one.
    left, low, edge = n, 0, first
    for bits in (20, 8):
        counts, at = edge.groupBy(F.shiftright("h", bits).alias("bin")).count().collect(), None  # 4,096 rows at most
        for r in sorted(counts, key=lambda r: r.bin):
            at = r.bin
            if left <= r["count"]:
                break
            left -= r["count"]
        if at is None:
            return first.select("id")
        low, edge = at << bits, edge.where(F.shiftright("h", bits) == at)
    seeds = edge.groupBy("h", "seed").count().orderBy("h", "seed").collect()  # of 2**-24 of all hashes
    until = next((r for r, before in zip(seeds, accumulate([0, *(r["count"] for r in seeds)])) if before + r["count"] >= left), seeds[-1])
    return first.where((F.col("h") < low) | (F.struct("h", "seed") <= F.struct(F.lit(until.h).cast("long"), F.lit(until.seed).cast("long")))).select("id")


def subgraph(vectors: DataFrame, sample: DataFrame, method: str, n_neighbors: int, dims: int, ef: int | None = None, mode: str = "exact") -> DataFrame:
    """The graph built anew on the sampled vectors; ids stay global."""
    return build_graph(vectors.join(sample, "id", "left_semi"), method, n_neighbors, dims, ef, mode)
