"""SimHash near-duplicates with pigeonring filtering.

A text's fingerprint has 64 bits, each the majority of that bit over the XXH64
hashes of the text's word shingles. Two fingerprints link if at most max_diff bits
differ. The ring of m = max_diff + 1 equal segments has, for each linked pair, a
start segment from which every chain of l consecutive segments differs in at most
floor(l * max_diff / m) = l - 1 bits (Qin and Xiao, 2018). So the start segment is
equal: distinct fingerprints are dealt into buckets by (start, segment). In a
bucket, pairs must pass the chains of 2, 3, ... segments before the full check.

A bucket of over BUCKET fingerprints is dealt again by the next segment, which may
differ in one bit, so one of its halves is equal; then by the thirds of the one
after, and so on. No pair is lost, and a bucket with a large share of all
fingerprints ends up in parts. A bucket yields the edges of a spanning forest of
its links, never all pairs.

Defined results: null text counts as empty; a text without words has fingerprint
zero and links like any other; a null id links like any other and is never a
component's smallest id unless all are null; repeated rows each give a row; an
empty table gives no rows; other columns are ignored. Texts of any length are
hashed in blocks of words.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import connected_components, split_join, stored

SEED = 42
BUCKET = 4096
_BLOCK = 1 << 16
_hash = partial(xxhash.xxh64_intdigest, seed=SEED)


def fingerprint(text: bytes, shingle: int = 3) -> int:
    """Unsigned SimHash of the lower-cased (A-Z) text's shingles of that many words, repeats included."""
    words = text.lower().split()  # of bytes: ASCII letters and ASCII white space only
    if not words:
        return 0
    if len(words) <= shingle:
        return _hash(b" ".join(words))
    n, ones = len(words) - shingle + 1, np.zeros(64, np.int64)
    for at in range(0, n, _BLOCK):
        part = words[at : at + _BLOCK + shingle - 1]
        texts = map(b" ".join, zip(*(part[i:] for i in range(shingle)), strict=False))
        hashes = np.fromiter(map(_hash, texts), "<u8", len(part) - shingle + 1)
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n, bitorder="little").tobytes(), "little")


def majority(hashes: np.ndarray) -> int:
    """Unsigned SimHash of 64-bit hashes, repeats included; zero without any."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), _BLOCK):
        ones += np.unpackbits(hashes[at : at + _BLOCK].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes), bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """One row per row: doc_id, fp (the 64 bits as a signed long)."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("binary").alias("text"))

    def run(batches):
        for b in batches:
            found = np.fromiter((fingerprint(t.as_py() or b"", shingle) for t in b.column(1)), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found.view(np.int64))], ["doc_id", "fp"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, fp long")


def _part(fp: np.ndarray, start: np.ndarray, width: int, level: int, piece: int) -> np.ndarray:
    """The piece-th of level + 1 parts of the segment that stands level places after the start."""
    ring = _turned(fp, start, width)
    segment = (ring >> np.uint64(64 - width * (level + 1))) & np.uint64((1 << width) - 1)
    lo, hi = piece * width // (level + 1), (piece + 1) * width // (level + 1)
    return (segment >> np.uint64(lo)) & np.uint64((1 << (hi - lo)) - 1)


def _turned(fp: np.ndarray, start: np.ndarray, width: int) -> np.ndarray:
    """The bits with the start segment on top."""
    by = (start * width).astype(np.uint64)
    return np.where(by == 0, fp, (fp << by) | (fp >> ((np.uint64(64) - by) & np.uint64(63))))


def _keys(rows: DataFrame, segments: int, level: int) -> DataFrame:
    """Deal (fp) or, from level 1 on, (fp, start, key) into the next buckets."""
    width = 64 // segments

    def run(batches):
        for b in batches:
            fp = b.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for piece in range(segments if level == 0 else level + 1):
                if level == 0:
                    start, key = np.full(len(fp), piece, np.int64), np.zeros(len(fp), np.uint64)
                    bits = _part(fp, start, width, 0, 0)
                else:
                    start, key = b.column(1).to_numpy(zero_copy_only=False), b.column(2).to_numpy(zero_copy_only=False).view(np.uint64)
                    bits = _part(fp, start, width, level, piece)
                room = np.uint64(-(-width // (level + 1)))
                own = ((key * np.uint64(level + 1) + np.uint64(0 if level == 0 else piece)) << room) | bits
                yield pa.RecordBatch.from_arrays([pa.array(fp.view(np.int64)), pa.array(start), pa.array(own.view(np.int64))], ["fp", "start", "key"])

    return rows.mapInArrow(run, "fp long, start long, key long")


def _links(key: np.ndarray, start: np.ndarray, fp: np.ndarray, segments: int) -> tuple[np.ndarray, np.ndarray]:
    """Spanning edges of the links inside each run of equal (start, key)."""
    width, n = 64 // segments, len(fp)
    label, ring = np.arange(n), _turned(fp, start, width)
    same = lambda i, d: i[(key[i + d] == key[i]) & (start[i + d] == start[i])]
    d, live = 1, same(np.arange(n - 1), 1)
    while len(live):
        pair = live
        for chain in range(2, segments + 1):  # the last chain is the whole ring: the full check
            differ = (ring[pair] ^ ring[pair + d]) >> np.uint64(64 - chain * width)
            pair = pair[np.bitwise_count(differ) <= chain - 1]
        a, b = label[pair], label[pair + d]
        while len(a := a[ne := a != b]):
            b = b[ne]
            low, high = np.minimum(a, b), np.maximum(a, b)
            np.minimum.at(label, high, low)
            while (label != (up := label[label])).any():
                label = up
            a, b = label[a], label[b]
        d += 1
        live = same(live[live + d < n], d)
    far = np.flatnonzero(label != np.arange(n))
    return fp[far], fp[label[far]]


def _bucket_links(rows: DataFrame, segments: int) -> DataFrame:
    """(fp, start, key), sorted by bucket in each partition -> edges (a, b)."""

    def run(batches):
        none = np.zeros(0, np.int64)
        rest = (none, none, none.view(np.uint64))
        for b in batches:
            now = [b.column(i).to_numpy(zero_copy_only=False) for i in range(3)]
            fp, start, key = _joined(rest, now)
            cut = np.flatnonzero((key[:-1] != key[1:]) | (start[:-1] != start[1:]))
            at = int(cut[-1]) + 1 if len(cut) else 0  # the last bucket may go on in the next batch
            rest = (key[at:], start[at:], fp[at:])
            if at:
                yield _edges(*_links(key[:at], start[:at], fp[:at], segments))
        if len(rest[0]):
            yield _edges(*_links(*rest, segments))

    return rows.mapInArrow(run, "a long, b long")


def _joined(rest, now):
    key, start, fp = rest
    return np.concatenate([fp, now[0].view(np.uint64)]), np.concatenate([start, now[1]]), np.concatenate([key, now[2]])


def _edges(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])


def fingerprint_edges(nodes: DataFrame, max_diff: int = 3, bucket: int = BUCKET) -> DataFrame:
    """Edges (a, b) between distinct fingerprints whose components are those of all links of up to max_diff bits."""
    segments = max_diff + 1
    if max_diff < 1 or 64 % segments:
        raise ValueError("max_diff + 1 must divide 64: 1, 3, 7, 15 or 31")
    rows, edges = _keys(nodes.select("fp"), segments, 0), None
    for level in range(1, segments + 1):
        hot = rows.groupBy("start", "key").count().where(F.col("count") > bucket).select("start", "key")
        last = level == segments or not (hot := stored(hot, "hot-buckets")).take(1)
        cold = rows if last else rows.join(hot, ["start", "key"], "left_anti").select("fp", "start", "key")
        found = _bucket_links(cold.repartition("start", "key").sortWithinPartitions("start", "key"), segments)
        edges = found if edges is None else edges.union(found)
        if last:
            return edges.distinct()
        rows = _keys(rows.join(hot, ["start", "key"], "left_semi").select("fp", "start", "key"), segments, level)
    raise AssertionError("unreachable")


def simhash_neardup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, max_diff: int = 3, bucket: int = BUCKET) -> DataFrame:
    """One row per row: doc_id, fingerprint (16 hex digits), component_id (smallest doc_id reachable by links)."""
    rows = stored(fingerprints(docs, id_col, text_col, shingle), "fingerprints")
    nodes = rows.groupBy("fp").agg(F.min("doc_id").alias("low"))
    labels = connected_components(stored(fingerprint_edges(nodes, max_diff, bucket), "fingerprint-edges"))
    nodes = nodes.join(labels, nodes.fp == labels.node, "left").select("fp", "low", F.coalesce("label", "fp").alias("label"))
    lowest = nodes.groupBy("label").agg(F.min("low").alias("component_id"))
    reached = split_join(nodes, lowest, "label").select("fp", "component_id")
    return split_join(rows, reached, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
