"""SimHash near copies, verified by exact Jaccard similarity of word shingles.

Two texts link if their sets of five-word shingles (64-bit XXH64 hashes) have a
Jaccard similarity of at least SIMILAR. Operator 1 proposes links first: SimHash
fingerprints of the same shingles that differ in at most NEAR_BITS bits, found by
pigeonring filtering; each is verified on the sets. A similarity of 0.8 leaves about
10 of 64 bits different, which no fingerprint filter of that width can search, so
MinHash keys complete the links: texts that still lie in different components and
share one of BANDS keys, each of ROWS minima, are compared on their sets. A pair at 0.8
shares no key with probability (1 - 0.8**5)**24 < 1e-4, a more similar one with less.

Texts with the same key are compared pair by pair where they are BUCKET at most: they bring
their sets to one task, once for all keys that the same texts share, so no table holds pairs. Larger
buckets are dealt into blocks, and a task compares the texts of a block that are not of
the bucket's main component with those of another block. Nothing is left out: only pairs
within one component, whose links would add nothing, are not compared.

Defined results: as for simhash_neardup; equal sets are one node; null text counts as
empty; texts without words have one empty set and link to each other only; a shorter
text is one shingle; long texts are hashed whole, their set being held by one task. The
input is read more than once and must give the same rows in the same partitions, as a
stored table does.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import connected_components, rows_among, split_join, stored
from .simhash import fingerprint_edges, majority

SEED, SHINGLE, SIMILAR, NEAR_BITS = 42, 5, 0.8, 7
BANDS, ROWS, BUCKET, BLOCK, LOT = 24, 5, 128, 256, 256
#: Texts for each file of a table that is written between steps.
TEXTS_A_FILE = 20_000
_BLOCK = 4096
_hash = partial(xxhash.xxh64_intdigest, seed=SEED)
_A, _B = (np.random.default_rng(SEED).integers(0, 1 << 63, (2, BANDS * ROWS, 1), dtype=np.int64).astype(np.uint64) << np.uint64(1)) | np.uint64(1)


def hashes(text: bytes, shingle: int = SHINGLE) -> np.ndarray:
    """Hashes of the lower-cased (A-Z) text's shingles, repeats included."""
    words = text.lower().split()  # of bytes: ASCII letters and ASCII white space only
    if not words:
        return np.zeros(0, np.uint64)
    texts = zip(*(words[i:] for i in range(shingle)), strict=False) if len(words) > shingle else [words]
    return np.fromiter(map(_hash, map(b" ".join, texts)), np.uint64)


def bands(found: np.ndarray) -> np.ndarray:
    """BANDS keys of a set that is not empty; each is a hash of its number and ROWS minima."""
    low = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(found), _BLOCK):
        low = np.minimum(low, (found[None, at : at + _BLOCK] * _A + _B).min(1))
    return np.array([_hash(part.tobytes(), seed=i) for i, part in enumerate(low.reshape(BANDS, ROWS))], np.uint64) if len(found) else low[:0]


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of two sorted sets."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / max(1, len(a) + len(b) - both)


def _kept(df: DataFrame, name: str, texts: int) -> DataFrame:
    """df stored in as many files as that number of texts asks for, and at least two a core."""
    return stored(df.coalesce(max(2 * df.sparkSession.sparkContext.defaultParallelism, -(-texts // TEXTS_A_FILE))), name)


def _digest(found: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(found.tobytes())


def _signed(values) -> pa.Array:
    return pa.array(np.array(values, np.uint64).view(np.int64))


def _sets(rows: DataFrame) -> DataFrame:
    """rows (doc_id, rid, text) -> doc_id, rid, node (digest of the set), n, fp, keys; the sets themselves are made again where needed."""

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                b = batch.slice(at, 512)
                bags = [hashes(t.as_py() or b"") for t in b.column(2)]
                sets = [np.unique(x) for x in bags]
                keys = pa.array([bands(s).view(np.int64) for s in sets], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), _signed([_digest(s) for s in sets]), pa.array([len(s) for s in sets], pa.int64()), _signed([majority(x) for x in bags]), keys], ["doc_id", "rid", "node", "n", "fp", "keys"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, rid long, node long, n long, fp long, keys array<long>")


class Sets:
    """The sets of nodes: which row has them, and how to make them again from its text."""

    def __init__(self, rows: DataFrame, known: DataFrame):
        self.rows, self.known, self.texts = rows, known, known.count()

    def of(self, nodes: DataFrame) -> DataFrame:
        """node, hashes (the set's bytes, in order) of the nodes in the only column of nodes."""
        chosen = split_join(self.known.groupBy("node").agg(F.min("rid").alias("rid")), nodes.select(F.col(nodes.columns[0]).alias("node")).distinct(), "node").select("rid")

        def run(batches):
            for batch in batches:
                for at in range(0, batch.num_rows, 512):
                    sets = [np.unique(hashes(t.as_py() or b"")) for t in batch.slice(at, 512).column(0)]
                    yield pa.RecordBatch.from_arrays([_signed([_digest(s) for s in sets]), pa.array([s.tobytes() for s in sets], pa.binary())], ["node", "hashes"])

        return _kept(rows_among(self.rows, "rid", chosen).select("text").mapInArrow(run, "node long, hashes binary"), "near-sets", self.texts)


class _Forest:
    """Components of labels, joined as links are found."""

    def __init__(self):
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        while x != self.up.get(x, x):
            x = self.up[x]
        return x

    def join(self, x: int, y: int) -> None:
        self.up[max(x, y)] = min(x, y)


def _verified(pairs: DataFrame, sets: Sets, similar: float) -> DataFrame:
    """Links (a, b) that span those of the pairs (place, a, b) whose sets are similar enough.

    A place is a bucket or a like meeting point of a bounded number of nodes: each of
    them brings its set there once, however many pairs it has.
    """
    members = pairs.select("place", F.explode(F.array("a", "b")).alias("node")).distinct()
    brought = split_join(members, sets.of(members.select("node")), "node").select("place", F.col("node").alias("a"), F.lit(None).cast("long").alias("b"), "hashes")

    def compare(table: pa.Table) -> pa.Table:
        own, pairs = {}, []
        for x, y, h in zip(table.column("a").to_pylist(), table.column("b").to_pylist(), table.column("hashes"), strict=True):
            if y is None:
                own[x] = np.frombuffer(h.as_py(), np.uint64)
            else:
                pairs.append((x, y))
        forest, out = _Forest(), []
        for x, y in sorted(pairs):
            if (one := forest.root(x)) != (two := forest.root(y)) and similarity(own[x], own[y]) >= similar:
                forest.join(one, two)
                out.append((x, y))
        return pa.table({"a": pa.array([x for x, _ in out], pa.int64()), "b": pa.array([y for _, y in out], pa.int64())})

    return brought.union(pairs.select("place", "a", "b", F.lit(None).cast("binary").alias("hashes"))).groupBy("place").applyInArrow(compare, "a long, b long")


def simhash_pairs(known: DataFrame, max_diff: int = NEAR_BITS, lot: int = LOT) -> DataFrame:
    """Pairs (place, a, b) of nodes that span the links of operator 1: equal fingerprints, or at most max_diff bits apart."""
    texts, known = known.count(), known.select("fp", "node").distinct()
    heads = _kept(known.groupBy("fp").agg(F.min("node").alias("head")), "near-heads", texts)
    equal = split_join(known, heads, "fp").where("node <> head").select(F.col("node").alias("a"), F.col("head").alias("b"))
    edges = fingerprint_edges(heads.select("fp"), max_diff).withColumnsRenamed({"a": "x", "b": "y"})
    for fp, node in (("x", "a"), ("y", "b")):
        edges = split_join(edges, heads.withColumnsRenamed({"fp": fp, "head": node}), fp)
    pairs = equal.union(edges.select("a", "b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    # A node meets its upper partners in lots of about `lot`, so that a hub brings its set once a lot and no lot grows with it.
    pairs = _kept(pairs, "near-pairs", texts)
    lots = pairs.groupBy("b").agg(F.ceil(F.count("*") / lot).alias("lots"))
    return split_join(pairs, lots, "b").select(F.xxhash64("b", F.pmod(F.xxhash64("a"), F.col("lots"))).alias("place"), "a", "b")


def _fit(a: np.ndarray, b: np.ndarray, similar: float) -> bool:
    """Sets of too unequal sizes cannot be similar."""
    few, many = sorted((len(a), len(b)))
    return few >= (similar - 1e-9) * many


def _in_buckets(small: DataFrame, sets: Sets, similar: float) -> DataFrame:
    """Links (a, b) that span those between the labels of each bucket (key, node, label); buckets of the same texts are one."""
    alike = small.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("node", "label"))).alias("members")).groupBy("members").agg(F.min("key").alias("place"))  # `bucket` members at most
    brought = _kept(alike.select("place", F.explode("members").alias("m")).select("place", "m.node", "m.label"), "near-small", sets.texts)

    def compare(table: pa.Table) -> pa.Table:
        node, label = table.column("node").to_pylist(), table.column("label").to_pylist()
        own = [np.frombuffer(v.as_py(), np.uint64) for v in table.column("hashes")]
        order = sorted(range(len(node)), key=node.__getitem__)
        forest, out = _Forest(), []
        for at, p in enumerate(order):
            for q in order[:at]:
                if _fit(own[p], own[q], similar) and (one := forest.root(label[p])) != (two := forest.root(label[q])) and similarity(own[p], own[q]) >= similar:
                    forest.join(one, two)
                    out.append((node[p], node[q]))
        return pa.table({"a": pa.array([x for x, _ in out], pa.int64()), "b": pa.array([x for _, x in out], pa.int64())})

    return split_join(brought, sets.of(brought.select("node")), "node").groupBy("place").applyInArrow(compare, "a long, b long")


def _in_blocks(hot: DataFrame, sets: Sets, similar: float, block: int) -> DataFrame:
    """Links (a, b) in large buckets (key, node, label, size, main): texts of other components than the main one against all, block by block."""
    held = sets.of(hot.select("node"))
    number = lambda n, salt: F.pmod(F.xxhash64("node", F.lit(salt)), F.ceil(n / block)).cast("int")
    odd = hot.where("label <> main").groupBy("key").agg(F.count("*").alias("n_odd"))
    dealt = split_join(hot, odd, "key")
    all_parts = lambda n: F.explode(F.sequence(F.lit(0), (F.ceil(n / block) - 1).cast("int")))
    left = dealt.where("label <> main").withColumn("i", number(F.col("n_odd"), 1)).withColumn("j", all_parts(F.col("size"))).withColumn("odd", F.lit(True))
    right = dealt.withColumn("j", number(F.col("size"), 2)).withColumn("i", all_parts(F.col("n_odd"))).withColumn("odd", F.lit(False))
    cols = ["key", "i", "j", "odd", "node", "label"]
    rows = split_join(left.select(*cols).union(right.select(*cols)), held, "node")

    def compare(table: pa.Table) -> pa.Table:
        odd, node, label = (table.column(c).to_pylist() for c in ("odd", "node", "label"))
        sets = [np.frombuffer(v.as_py(), np.uint64) for v in table.column("hashes")]
        forest, out = _Forest(), []
        for p in (i for i, o in enumerate(odd) if o):
            for q in (i for i, o in enumerate(odd) if not o):
                if _fit(sets[p], sets[q], similar) and (one := forest.root(label[p])) != (two := forest.root(label[q])) and similarity(sets[p], sets[q]) >= similar:
                    forest.join(one, two)
                    out.append((node[p], node[q]))
        return pa.table({"a": pa.array([x for x, _ in out], pa.int64()), "b": pa.array([x for _, x in out], pa.int64())})

    return rows.groupBy("key", "i", "j").applyInArrow(compare, "a long, b long")


def jaccard_edges(known: DataFrame, sets: Sets, similar: float = SIMILAR, bucket: int = BUCKET, block: int = BLOCK) -> DataFrame:
    """Verified edges (a, b) between the nodes known (node, n, fp, keys), whose components are those of all similar pairs."""
    tried = _kept(simhash_pairs(known), "near-tried", sets.texts)
    edges = _kept(_verified(tried, sets, similar), "near-edges", sets.texts)
    labels = connected_components(edges).withColumnRenamed("node", "own")
    keyed = known.select("node", F.explode("keys").alias("key")).distinct()
    keyed = keyed.join(labels, keyed.node == labels.own, "left").select("key", "node", F.coalesce("label", "node").alias("label"))
    keyed = _kept(keyed, "near-keys", sets.texts)
    mixed = keyed.groupBy("key").agg(F.min("label").alias("one"), F.max("label").alias("two"), F.count("*").alias("size")).where("one <> two").select("key", "size")
    met = _kept(split_join(keyed, mixed, "key"), "near-buckets", sets.texts)
    small, hot = met.where(F.col("size") <= bucket), met.where(F.col("size") > bucket)
    out = edges.union(_kept(_in_buckets(small, sets, similar), "near-edges-again", sets.texts)) if small.take(1) else edges
    if not hot.take(1):
        return out
    shares = hot.groupBy("key", "label").agg(F.count("*").alias("c")).groupBy("key").agg(F.max(F.struct("c", "label")).alias("m")).select("key", F.col("m.label").alias("main"))
    return out.union(_kept(_in_blocks(split_join(hot, shares, "key"), sets, similar, block), "near-edges-hot", sets.texts))


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similar: float = SIMILAR, bucket: int = BUCKET, block: int = BLOCK, row_col: str | None = None) -> DataFrame:
    """One row per row: doc_id, component_id (smallest doc_id reachable by links), kept (one row of each component: that id's first), and with row_col that number of the row."""
    texts = docs.select(F.col(id_col).alias("doc_id"), (F.col(row_col) if row_col else F.monotonically_increasing_id()).cast("long").alias("rid"), F.col(text_col).cast("binary").alias("text"))
    known = stored(_sets(texts), "near-shingles")
    labels = connected_components(jaccard_edges(known, Sets(texts, known), similar, bucket, block)).withColumnRenamed("node", "own")
    rows = known.select("doc_id", "rid", "node")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "rid"))
    nodes = rows.groupBy("node").agg(first.alias("low"))
    nodes = nodes.join(labels, nodes.node == labels.own, "left").select("node", "low", F.coalesce("label", "node").alias("label"))
    reached = split_join(nodes.select("node", "label"), nodes.groupBy("label").agg(F.min("low").alias("low")), "label").select("node", "low")
    found = split_join(rows, reached, "node")
    return found.select("doc_id", F.col("low.doc_id").alias("component_id"), (F.col("doc_id").eqNullSafe(F.col("low.doc_id")) & (F.col("rid") == F.col("low.rid"))).alias("kept"), *([F.col("rid").alias(row_col)] if row_col else []))
