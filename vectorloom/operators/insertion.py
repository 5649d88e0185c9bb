"""Proximity graphs by batch-parallel insertion, and their repair within the degree.

Nodes enter in pseudo-random order. The first are linked with all others, so the graph is
connected and has long edges; each batch doubles it: a new node is searched for in the graph
so far with a pool of ef, linked to half of its degree by the diversity heuristic, and its edges
are added in reverse; a node with more edges than fit keeps diverse ones. The batch is then
searched for again, from its own links, so that nodes of one batch find each other.

grown() does that in one task, for a shard or the first BASE nodes. insert_graph() goes on
with batches as Spark jobs: new nodes are dealt among tasks, each of which gets the vectors and
edges so far by the shuffle (operators.whole), not from the driver; they must fit
arrow_walk.MAX_BYTES together (checked; larger tables are built as shards, see plans.sharded).
Edges are pruned in the same way.

The repair joins what a start node does not reach by edges of parents that have room, and gives
each node that does not reach the start an edge back, so that every node reaches every other; no
node gets more than its degree, of whose places every SPARE-th is left free for that. One task does
it for a graph that fits a task (Nodes.connected); connected() does it in rounds of joins.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vectors import portable_hash
from ..plans.scratch import written
from . import arrow_walk
from .arrow_walk import Adjacency, Marks, beam, laid_out
from .exact import exact_knn_blocks
from .topk import topk
from .whole import shares, with_whole

#: Candidates of a new node; nodes that are linked with all others; nodes that one task inserts.
EF, FIRST, BASE = 80, 64, 4096
#: Of a node's places one in so many is for the repair. Nearest edges of a node that are looked at when it has too many. Nodes that are linked at once.
SPARE, WIDE, LOT = 8, 128, 256
#: Places from which a new node is searched for.
STARTS = 8
#: Nodes of a search path that are looked at, the nearest ones.
PATH = 256


def room(degree: int) -> int:
    """Edges that the building may use; the others are for the repair, two at least."""
    return max(1, degree - max(2, degree // SPARE))


def linked(near: np.ndarray, dist: np.ndarray, x: np.ndarray, most: int, fill: bool = True) -> np.ndarray:
    """(rows, most) places of chosen candidates, -1 for none: from the nearest on, those nearer to the node than to any chosen before; with fill then the nearest others.

    near: (rows, candidates) places in x or -1, with distances ascending.
    """
    rows, wide = near.shape
    v = x[near]
    sq = np.einsum("ijk,ijk->ij", v, v)
    between = sq[:, :, None] + sq[:, None, :] - 2 * v @ v.transpose(0, 2, 1)
    dist = np.where(near >= 0, dist, 0)
    limit = (dist - 1e-5 * (dist + sq)).astype(between.dtype)  # equal distances may be summed in another order
    chosen, count = np.zeros((rows, wide), bool), np.zeros(rows, int)
    for c in range(wide):
        good = (near[:, c] >= 0) & (count < most) & ~((between[:, c, :] < limit[:, c, None]) & chosen).any(1)
        chosen[:, c] = good
        count += good
    rest = (near >= 0) & ~chosen if fill else np.zeros_like(chosen)
    order = np.argsort(np.where(chosen, 0, np.where(rest, 1, 2)), 1, kind="stable")[:, :most]
    out = np.where(np.take_along_axis(chosen | rest, order, 1), np.take_along_axis(near, order, 1), -1)
    return np.pad(out, ((0, 0), (0, most - out.shape[1])), constant_values=-1).astype(np.int32)


def distances(x: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    diff = x[a] - x[b]
    return np.einsum("ij,ij->i", diff, diff).astype(np.float64)


def _pool(x: np.ndarray, graph: Adjacency, nodes: np.ndarray, starts: np.ndarray, ef: int, marks: Marks):
    """(places, distances) of the ef nearest that a search finds for each node, without itself."""
    near, dist, _ = beam(x[nodes], x, graph, starts, ef + 1, marks.fresh())
    own = near == nodes[:, None]
    dist = np.where(own, np.inf, dist)
    order = np.argsort(dist, 1, kind="stable")[:, :ef]
    return np.take_along_axis(np.where(own, -1, near), order, 1), np.take_along_axis(dist, order, 1)


def search_links(x: np.ndarray, graph: Adjacency, nodes: np.ndarray, starts: np.ndarray, ef: int, most: int, marks: Marks, own: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Edges (src, dst, dist) of nodes to what a search finds. starts: places for all, or rows of them for each node. own: candidates include the starts' rows."""
    out = [(np.zeros(0, np.int64),) * 2]
    for at in range(0, len(nodes), len(marks.marks)):
        part = nodes[at : at + len(marks.marks)]
        first = starts[at : at + len(part)] if own else np.repeat(starts[None, :], len(part), 0)
        near, dist = _pool(x, graph, part, first.astype(np.int32), ef, marks)
        for lot in range(0, len(part), LOT):
            links = linked(near[lot : lot + LOT], dist[lot : lot + LOT], x, most)
            r, c = np.nonzero(links >= 0)
            out.append((part[lot + r], links[r, c]))
    src, dst = (np.concatenate(c).astype(np.int64) for c in zip(*out, strict=True))
    return src, dst, distances(x, src, dst)


def thinned(src: np.ndarray, dst: np.ndarray, dist: np.ndarray, x: np.ndarray, most: int, wide: int = WIDE) -> np.ndarray:
    """Places of the edges that stay, at most `most` of each src: all where they fit, else diverse ones of the `wide` nearest. Edges are sorted by src, dist, dst and distinct."""
    starts = np.flatnonzero(np.concatenate([[True], src[1:] != src[:-1]])) if len(src) else np.zeros(0, int)
    count = np.diff(np.append(starts, len(src)))
    stay = np.repeat(count, count) <= most
    many = np.flatnonzero(count > most)
    for at in range(0, len(many), LOT):
        these = many[at : at + LOT]
        cols = min(wide, int(count[these].max()))
        spot = starts[these][:, None] + np.arange(cols)
        there = np.arange(cols) < count[these][:, None]
        spot = np.where(there, spot, 0)
        near = np.where(there, dst[spot], -1)
        links = linked(near, dist[spot], x, most)
        kept = (near[:, :, None] == links[:, None, :]).any(2) & there
        stay[spot[kept]] = True
    return np.flatnonzero(stay)


def _distinct(src: np.ndarray, dst: np.ndarray, dist: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted by src, dist, dst; each pair once."""
    order = np.lexsort((dst, dist, src))
    src, dst, dist = src[order], dst[order], dist[order]
    _, once = np.unique(np.stack([src, dst]), axis=1, return_index=True) if len(src) else (None, np.zeros(0, int))
    once = np.sort(once)
    return src[once], dst[once], dist[once]


class Grown:
    """A graph that grows in one task: rows of places by node, and how many are used."""

    def __init__(self, x: np.ndarray, degree: int, ef: int):
        self.x, self.degree, self.ef = np.ascontiguousarray(x, np.float32), degree, ef
        self.rows = np.full((len(x), degree), -1, np.int32)
        self.marks = Marks(max(1, min(LOT, (1 << 26) // max(1, len(x)))), len(x))

    def add(self, src: np.ndarray, dst: np.ndarray, dist: np.ndarray) -> None:
        """Add edges and their reverse, and thin out the nodes that have too many."""
        nodes = np.unique(np.concatenate([src, dst]))
        r, c = np.nonzero(self.rows[nodes] >= 0)
        old_s, old_d = nodes[r], self.rows[nodes][r, c].astype(np.int64)
        s, d, w = _distinct(np.concatenate([src, dst, old_s]), np.concatenate([dst, src, old_d]), np.concatenate([dist, dist, distances(self.x, old_s, old_d)]))
        stay = thinned(s, d, w, self.x, room(self.degree))
        s, d = s[stay], d[stay]
        self.rows[nodes] = -1
        starts = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]]))
        self.rows[s, np.arange(len(s)) - np.repeat(starts, np.diff(np.append(starts, len(s))))] = d

    def grow(self) -> Grown:
        n, half = len(self.x), max(1, self.degree // 2)
        done = min(FIRST, n)
        if done > 1:
            d = ((self.x[:done, None, :].astype(np.float64) - self.x[None, :done, :]) ** 2).sum(2)
            np.fill_diagonal(d, np.inf)
            near = np.argsort(d, 1, kind="stable")[:, : done - 1]
            links = linked(near, np.take_along_axis(d, near, 1), self.x, half)
            r, c = np.nonzero(links >= 0)
            dst = links[r, c].astype(np.int64)
            self.add(r.astype(np.int64), dst, distances(self.x, r, dst))
        while done < n:
            new = np.arange(done, min(2 * done, n))
            starts = np.unique(np.linspace(0, done - 1, STARTS).astype(np.int32))
            self.add(*search_links(self.x, Adjacency(self.rows), new, starts, self.ef, half, self.marks))
            self.add(*search_links(self.x, Adjacency(self.rows), new, self.rows[new], self.ef, half, self.marks, own=True))
            done = int(new[-1]) + 1
        return self

    def edges(self) -> tuple[np.ndarray, np.ndarray]:
        src, c = np.nonzero(self.rows >= 0)
        return src, self.rows[src, c].astype(np.int64)

    def reaches(self, start: int, back: bool = False, seen: np.ndarray | None = None) -> np.ndarray:
        """Marks of the nodes that start reaches, or that reach it (back); with seen more marks are added to those."""
        seen = np.zeros(len(self.x), bool) if seen is None else seen
        if back:
            src, dst = self.edges()
            order = np.argsort(dst, kind="stable")
            src, ends = src[order], np.searchsorted(dst[order], np.arange(len(self.x) + 1))
        front = np.array([start])
        while len(front):
            seen[front] = True
            if back:
                size = ends[front + 1] - ends[front]
                met = src[np.repeat(ends[front] - np.cumsum(size) + size, size) + np.arange(size.sum())]
            else:
                met = self.rows[front].ravel()
                met = met[met >= 0]
            front = np.unique(met[~seen[met]])
        return seen

    def connect(self, start: int = 0) -> Grown:
        """Every node is reached from start and reaches it; no node gets over its degree. Each node has two free places before."""
        if not len(self.x):
            return self
        seen, used = self.reaches(start), (self.rows >= 0).sum(1)
        while not seen.all():
            for v in np.flatnonzero(~seen):
                if not seen[v]:  # nodes that an earlier one leads to need no edge
                    open_ = np.flatnonzero(seen & (used < self.degree - 1))
                    u = open_[int(((self.x[open_] - self.x[v]) ** 2).sum(1).argmin())]
                    self.rows[u, used[u]] = v
                    used[u] += 1
                    self.reaches(v, seen=seen)
        back = self.reaches(start, back=True)
        good = np.flatnonzero(back)
        for v in np.flatnonzero(~back):
            self.rows[v, used[v]] = good[int(((self.x[good] - self.x[v]) ** 2).sum(1).argmin())]
        return self


def grown(x: np.ndarray, degree: int, ef: int = EF, seed: int = 0) -> np.ndarray:
    """(n, degree) places of neighbours, -1 for none: a connected graph of the rows of x, built in this task."""
    order = np.random.default_rng(seed).permutation(len(x))
    rows = Grown(np.asarray(x)[order], degree, ef).grow().connect().rows
    out = np.empty_like(rows)
    out[order] = np.where(rows >= 0, order[rows], -1)
    return out


# --- as Spark jobs -----------------------------------------------------------


def node_batches(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Tables of whole nodes from a stream that is sorted by src."""
    rest = None
    for b in batches:
        now = pa.Table.from_batches([b])
        now = now if rest is None else pa.concat_tables([rest, now])
        src = np.asarray(now.column("src"))
        cut = int(np.flatnonzero(src != src[-1])[-1]) + 1 if len(src) and src[0] != src[-1] else 0
        rest = now.slice(cut)  # the last node may go on in the next batch
        if cut:
            yield now.slice(0, cut)
    if rest is not None and len(rest):
        yield rest


_EDGES = "src long, dst long, dist double"


def _edge_batch(src: np.ndarray, dst: np.ndarray, dist: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(src), pa.array(dst), pa.array(dist)], ["src", "dst", "dist"])


class Nodes:
    """The vectors of a build, written once: ids and float32 rows. Tasks that need all of them get them by the shuffle."""

    def __init__(self, vectors: DataFrame, dims: int, degree: int):
        if not arrow_walk.fits(vectors, dims, degree):
            raise ValueError("the vectors are too many for a task that inserts: build a ShardedIndex, or use mode='clusters' or 'exact'")
        self.held = written(vectors.select("id", F.col("vec").cast("array<float>").alias("vec")))
        self.n = self.held.count()

    def graph(self, edges: DataFrame, held: DataFrame | None = None) -> DataFrame:
        """(id, vec, links): the vectors (held: of so many nodes only) with their neighbours, nearest first."""
        return (self.held if held is None else held).select("id", "vec").join(arrow_walk.neighbour_lists(edges, "dist"), "id", "left")

    def each(self, ids: DataFrame, edges: DataFrame, run: Callable[..., tuple[np.ndarray, np.ndarray, np.ndarray]], start: int | None = None, held: DataFrame | None = None) -> DataFrame:
        """(src, dst, dist) that run(x, graph, places, place of start) gives, by place, for shares of the nodes in ids; held as in graph."""

        def mapped(asked: pa.Table, whole: pa.Table):
            names, x, graph = laid_out(whole, "links")
            places = np.searchsorted(names, np.sort(np.asarray(asked.column("id"))))
            src, dst, dist = run(x, graph, places, None if start is None else int(np.searchsorted(names, start)))
            yield _edge_batch(names[src], names[dst], dist)

        return with_whole(ids.select("id"), self.graph(edges, held), mapped, _EDGES, "id", shares(ids, ids.count()))

    def connected(self, edges: DataFrame, degree: int, start: int | None = None) -> DataFrame:
        """edges (src, dst, dist) and those that connect what start (None: the least id) does not reach, or what does not reach it.

        One task finds them: it holds vectors and edges below MAX_BYTES.
        """

        def run(_, whole: pa.Table):
            names, x, graph = laid_out(whole, "links")
            g = Grown(x, degree, 1)
            g.rows[:, : graph.rows.shape[1]] = graph.rows
            g.connect(0 if start is None else int(np.searchsorted(names, start)))
            src, c = np.nonzero(np.pad(graph.rows, ((0, 0), (0, degree - graph.rows.shape[1])), constant_values=-1) != g.rows)
            dst = g.rows[src, c].astype(np.int64)
            yield _edge_batch(names[src], names[dst], distances(x, src, dst))

        more = with_whole(edges.sparkSession.range(1), self.graph(edges), run, _EDGES, "id", 1)
        return edges.select("src", "dst", "dist").union(written(more))

    def thinned(self, edges: DataFrame, most: int, held: DataFrame | None = None) -> DataFrame:
        """At most `most` edges of each node, each once with its least distance; held as in graph."""

        def run(asked: pa.Table, whole: pa.Table):
            names, x = laid_out(whole)
            src, dst, dist = (np.asarray(asked.column(c)) for c in ("src", "dst", "dist"))
            order = np.lexsort((dist, dst, src))
            s, d = src[order], dst[order]
            order = order[np.concatenate([[True], (s[1:] != s[:-1]) | (d[1:] != d[:-1])])]
            order = order[np.lexsort((dst[order], dist[order], src[order]))]
            src, dst, dist = src[order], dst[order], dist[order]
            stay = thinned(src, np.searchsorted(names, dst), dist, x, most)
            yield _edge_batch(src[stay], dst[stay], dist[stay])

        whole = (self.held if held is None else held).select("id", "vec")
        return with_whole(edges.select("src", "dst", "dist"), whole, run, _EDGES, "src", shares(edges, self.n))


def _with_reverse(edges: DataFrame) -> DataFrame:
    return edges.union(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "dist"))


def insert_edges(vectors: DataFrame, nodes: Nodes, degree: int, ef: int = EF, base: int = BASE, seed: int = 0) -> DataFrame:
    """(src, dst, dist) of a graph built by insertion; at most room(degree) edges of a node."""
    part = F.least(F.lit(1.0), F.lit(base / max(1, nodes.n)))
    share = (portable_hash("id", seed) + 1) / float(1 << 32)
    level = F.greatest(F.lit(0), F.ceil(F.log2(share / part))).cast("int")  # each level as many as all before
    order = written(nodes.held.select("id", level.alias("level"), "vec"))

    def first(table: pa.Table) -> pa.Table:
        ids, x = laid_out(table)
        shuffled = np.random.default_rng(seed).permutation(len(ids))
        src, dst = Grown(x[shuffled], degree, ef).grow().edges()
        src, dst = shuffled[src], shuffled[dst]
        return pa.table({"src": ids[src], "dst": ids[dst], "dist": distances(x, src, dst)})

    edges = written(order.where("level = 0").groupBy("level").applyInArrow(first, _EDGES))  # about `base` nodes
    half = max(1, degree // 2)
    for at in range(1, (order.agg(F.max("level")).first()[0] or 0) + 1):
        new, held = order.where(F.col("level") == at).select("id"), order.where(F.col("level") <= at)
        for again in (False, True):

            def run(x: np.ndarray, adjacency: Adjacency, places: np.ndarray, _, again=again):
                marks = Marks(max(1, min(LOT, (1 << 26) // max(1, len(x)))), len(x))
                old = np.flatnonzero((adjacency.rows[:, 0] >= 0)) if not again else None
                starts = adjacency.rows[places] if again else old[np.linspace(0, len(old) - 1, STARTS).astype(int)]
                return search_links(x, adjacency, places, starts, ef, half, marks, own=again)

            found = written(nodes.each(new, edges, run, held=held))
            edges = written(nodes.thinned(edges.union(_with_reverse(found)), room(degree), held))
    return edges


def insert_graph(vectors: DataFrame, degree: int, dims: int, ef: int = EF, base: int = BASE, seed: int = 0) -> DataFrame:
    """(src, dst, dist, rank): a graph by insertion, at most `degree` edges of a node, in which every node reaches every other."""
    nodes = Nodes(vectors, dims, degree)
    edges = insert_edges(vectors, nodes, degree, ef, base, seed)
    return topk(nodes.connected(edges, degree), degree, "src", ("dist", "dst"))


def search_path_graph(vectors: DataFrame, degree: int, dims: int, ef: int = EF, start: int | None = None, candidates: int = PATH, base: int = BASE, seed: int = 0) -> DataFrame:
    """(src, dst, dist): edges of each node to what a search for it from start visits, pruned; connected, at most `degree` of a node.

    The search runs on a graph by insertion. Of the visited nodes the `candidates` nearest are
    looked at, and v stays unless some chosen w is nearer to the node and nearer to v.
    """
    nodes = Nodes(vectors, dims, degree)
    held, most = nodes.connected(insert_edges(vectors, nodes, degree, ef, base, seed), degree, start), room(degree)

    def run(x: np.ndarray, graph: Adjacency, places: np.ndarray, first: int):
        out, marks = [(np.zeros(0, np.int64),) * 2], Marks(max(1, min(LOT, (1 << 26) // max(1, len(x)))), len(x))
        for at in range(0, len(places), len(marks.marks)):
            part, trace = places[at : at + len(marks.marks)], []
            beam(x[part], x, graph, np.full((len(part), 1), first, np.int32), ef, marks.fresh(), trace=trace)
            row, node, dist = (np.concatenate(c) for c in zip(*trace, strict=True))
            other = node != part[row]
            row, node, dist = row[other], node[other], dist[other]
            order = np.lexsort((node, dist, row))
            row, node, dist = row[order], node[order], dist[order]
            count = np.bincount(row, minlength=len(part))
            place = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
            few = place < candidates
            near, d = np.full((len(part), min(candidates, int(count.max()))), -1), np.zeros((len(part), min(candidates, int(count.max()))))
            near[row[few], place[few]], d[row[few], place[few]] = node[few], dist[few]
            for lot in range(0, len(part), 64):
                links = linked(near[lot : lot + 64], d[lot : lot + 64], x, most, fill=False)
                r, c = np.nonzero(links >= 0)
                out.append((part[lot + r], links[r, c]))
        src, dst = (np.concatenate(c).astype(np.int64) for c in zip(*out, strict=True))
        return src, dst, distances(x, src, dst)

    return nodes.connected(written(nodes.each(vectors, held, run, start)), degree, start)


def reached(edges: DataFrame, start: DataFrame, seen: DataFrame | None = None) -> DataFrame:
    """Nodes (id) that paths from start (id) reach, and those of seen, beyond which no path goes: breadth first; a round writes only what it found."""
    parts = [] if seen is None else [seen]
    front = written(start.select("id").distinct() if seen is None else start.select("id").distinct().join(seen, "id", "left_anti"))
    while front.take(1):
        parts.append(front)
        if len(parts) == 8:  # plans stay short, however long the paths are
            parts = [written(_all(parts))]
        front = written(front.join(edges, F.col("id") == F.col("src")).select(F.col("dst").alias("id")).distinct().join(_all(parts), "id", "left_anti"))
    return _all(parts) if parts else front


def _all(parts: list[DataFrame]) -> DataFrame:
    found = parts[0]
    for p in parts[1:]:
        found = found.union(p)
    return found


def connected(edges: DataFrame, vectors: DataFrame, degree: int, start: int | None = None, tries: int = 32) -> DataFrame:
    """As Nodes.connected for any number of nodes, in rounds of joins.

    In a round each lost node asks the `tries` nearest reached ones with room, and a
    parent takes the nearest that ask while it has room; at least one is taken a round, and the
    next goes on from there. Edges must leave two places of every node free.
    """
    edges = written(edges.select("src", "dst", "dist"))
    ids = vectors.select("id")
    first = ids.agg(F.min("id").alias("id")) if start is None else ids.where(F.col("id") == start)
    seen = written(reached(edges, first))
    while (lost := written(ids.join(seen, "id", "left_anti"))).take(1):
        used = edges.groupBy("src").count()
        free = seen.join(used, F.col("id") == F.col("src"), "left").select("id", (F.lit(degree - 1) - F.coalesce("count", F.lit(0))).alias("free")).where("free > 0")
        asked = exact_knn_blocks(vectors.join(lost, "id").select(F.col("id").alias("qid"), "vec"), vectors.join(free.select("id"), "id", "left_semi"), tries)
        asked = asked.join(free, "id")
        heard = F.row_number().over(Window.partitionBy("id").orderBy("dist", "qid"))
        taken = asked.withColumn("place", heard).where("place <= free").groupBy("qid").agg(F.min(F.struct("dist", "id")).alias("m"))
        taken = written(taken.select(F.col("m.id").alias("src"), F.col("qid").alias("dst"), F.col("m.dist").alias("dist")))
        edges = written(edges.union(taken))
        seen = written(reached(edges, taken.select(F.col("dst").alias("id")), seen))
    back = written(reached(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")), first))
    stuck = written(ids.join(back, "id", "left_anti"))
    if stuck.take(1):
        ways = exact_knn_blocks(vectors.join(stuck, "id").select(F.col("id").alias("qid"), "vec"), vectors.join(back, "id", "left_semi"), 1)
        edges = edges.union(ways.select(F.col("qid").alias("src"), F.col("id").alias("dst"), "dist"))
    return edges
