"""Substring de-duplication by content-defined chunks.

A text is cut between characters where a gear rolling hash over the last WINDOW bytes is
the least within RADIUS bytes on either side, and MOST bytes on at the latest. Such cuts
do not depend on spaces, nor on what stands farther away, so equal passages fall into
equal chunks wherever they stand and whatever the script. A run of white space counts as one
space. RUN adjoining chunks make a
piece, about a dozen words: too long to recur by chance, as single chunks do. Pieces are
counted by a 128-bit digest; the smallest doc_id that has a digest owns it, and its first
place there stays. A run of adjoining pieces that stand in other rows too is a repeated
passage if it spans at least MIN_WORDS words. Of a passage, the cuts lose a hash window, a
radius and the rest of a chunk at either end, so passages of over 50 words are found
(tested at all offsets, also without spaces), and short common lines are left alone.

What goes are the bytes of pieces that another place owns, but never bytes of a piece
that is kept here: so every piece stays whole in its owner.

Digests are pre-aggregated before the shuffle, so a passage in a third of all texts
costs one row for each task. A second pass sends on only pieces whose digest may be a
repeated one, told by a filter of fixed size (8 MiB); they then meet their digest in a
join that adaptive execution can split. No task holds a group of copies.

Defined results: null and empty texts have no pieces and no spans; a text of any length is
cut whole; a repeat within one row only is none; rows with null ids take part in counts but
a null id never owns while another has the passage; rows repeated with the same id are each
a copy of the other: both own, and only their first places within a row count as kept; an
empty table gives no rows; other columns are ignored. The input is read more than once and
must give the same rows in the same partitions, as a stored table does.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import FILTER_BITS, stored
from .gear import minima

RADIUS, MOST, WINDOW, RUN, MIN_WORDS = 12, 64, 16, 3, 25
#: Longest piece that a row can tell; only a piece with 2 MiB of white space is longer, and loses some of it.
_LENGTH = (1 << 21) - 1
_SPACES = np.zeros(256, bool)
_SPACES[[9, 10, 11, 12, 13, 28, 29, 30, 31, 32]] = True
#: Letters of scripts that are written without spaces count as a word each.
_ALONE = "\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u2e80-\u9fff\uf900-\ufaff\U00020000-\U0003ffff"
_WORD = re.compile(rf"[{_ALONE}]|[^\s{_ALONE}]+")
_SPECIAL = re.compile(rf"[{_ALONE}\u0085\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]").search


def text_chunks(text: bytes) -> np.ndarray:
    """Ends of the text's chunks, in bytes; no chunk splits a UTF-8 character."""
    data = np.frombuffer(text, np.uint8)
    size = len(data)
    if not size:
        return np.zeros(0, np.int64)
    ends = minima(data, RADIUS, WINDOW)
    ends = ends[ends < size]
    ends = ends[data[ends] & 0xC0 != 0x80]
    bounds = np.concatenate([[0], ends, [size]])
    if (np.diff(bounds) <= MOST).all():
        return bounds[1:]
    out = []
    for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        while hi - lo > MOST:
            at = lo + MOST
            while at > lo + 1 and data[at] & 0xC0 == 0x80:
                at -= 1
            out.append(at)
            lo = at
        out.append(hi)
    return np.array(out, np.int64)


def word_starts(text: bytes) -> np.ndarray:
    """Byte positions where words start."""
    if not text.isascii() and _SPECIAL(plain := text.decode("utf-8", "replace")):
        width = np.cumsum(np.concatenate([[0], [len(c.encode("utf-8", "replace")) for c in plain]]))
        return width[np.array([m.start() for m in _WORD.finditer(plain)], np.int64)]
    space = _SPACES[np.frombuffer(text, np.uint8)]
    return np.flatnonzero(~space & np.concatenate([[True], space[:-1]]))


def text_pieces(text: bytes) -> tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bodies, starts, ends, words before the start, words before the end) of the runs of RUN chunks; a shorter text is one piece.

    Places are those of the text, bodies have one space for each run of white space.
    """
    data, words = np.frombuffer(text, np.uint8), word_starts(text)
    space = _SPACES[data]
    one = np.flatnonzero(~(space & np.concatenate([[False], space[:-1]])))
    plain = np.where(space, 32, data).astype(np.uint8)[one].tobytes()
    ends = text_chunks(plain)
    starts = np.concatenate([[0], ends[:-1]])
    n = max(1, len(ends) - RUN + 1)
    starts, ends = starts[:n], ends[-n:]
    bodies = [plain[s:e] for s, e in zip(starts.tolist(), ends.tolist(), strict=True)]
    at = np.append(one, len(data))
    at[0] = 0
    starts, ends = at[starts], at[ends]
    return bodies, starts, ends, np.searchsorted(words, starts), np.searchsorted(words, ends)


def _bits(digests: DataFrame) -> np.ndarray:
    """A bitmap of FILTER_BITS bits by the lowest bits of d1."""
    at = digests.select(F.col("d1").bitwiseAND(FILTER_BITS - 1).alias("at"))
    found = at.groupBy(F.expr("at div 32768").alias("word")).agg(F.expr("bitmap_construct_agg(at % 32768)").alias("bits"))
    out = np.zeros((FILTER_BITS // 32768, 4096), np.uint8)
    for row in found.toLocalIterator():  # 2,048 rows at most
        out[row.word] = np.frombuffer(row.bits, np.uint8)
    return out.reshape(-1)


def _piece_rows(docs: DataFrame, id_col: str, text_col: str, among=None) -> DataFrame:
    """One row per piece; with among, a broadcast bitmap, only of those whose digest may be in it."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.monotonically_increasing_id().alias("rid"), F.col(text_col).cast("binary").alias("text"))

    def run(batches):
        for b in batches:
            parts, digests, size = [], [], 0
            for i, text in enumerate(b.column(2)):
                text = text.as_py()
                if not text:
                    continue
                bodies, starts, ends, before, until = text_pieces(text)
                own = list(map(xxhash.xxh3_128_digest, bodies))
                seen: set[bytes] = set()
                first = np.array([not (d in seen or seen.add(d)) for d in own])
                if among is not None:
                    at = np.frombuffer(b"".join(own), ">u8")[::2] & np.uint64(FILTER_BITS - 1)
                    may = (among.value[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8) & 1).astype(bool)
                    own, first, starts, ends, before, until = [d for d, m in zip(own, may.tolist(), strict=True) if m], first[may], starts[may], ends[may], before[may], until[may]
                parts.append(np.stack([np.full(len(own), i), (starts << 22) | (np.minimum(ends - starts, _LENGTH) << 1) | first, (before << 9) | (until - before)]))
                digests += own
                size += len(own)
                if size > 200_000:
                    yield _batch(b, np.concatenate(parts, 1), digests)
                    parts, digests, size = [], [], 0
            if size:
                yield _batch(b, np.concatenate(parts, 1), digests)

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, rid long, d1 long, d2 long, place long, words long")


def _batch(b, columns: np.ndarray, digests: list[bytes]) -> pa.RecordBatch:
    """place packs start, length (21 bits) and first (1 bit); words packs the words before and those in the piece (9 bits)."""
    d, at = np.frombuffer(b"".join(digests), ">i8").astype(np.int64).reshape(-1, 2), pa.array(columns[0])
    return pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at), pa.array(d[:, 0]), pa.array(d[:, 1]), pa.array(columns[1]), pa.array(columns[2])], ["doc_id", "rid", "d1", "d2", "place", "words"])


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """Passages that repeat in other rows, one row per span: doc_id, rid, start, end (bytes), n_words, first_doc_id, kept.

    kept marks the places that stay; other spans can go. A passage's parts that
    stay and those that go are rows of their own.
    """
    in_rows = F.sum(F.col("place").bitwiseAND(1))  # first places are one a row
    twice = stored(_piece_rows(docs, id_col, text_col).groupBy("d1", "d2").agg(in_rows.alias("n"), F.min("doc_id").alias("first_doc_id")).where("n > 1").select("d1", "d2", "first_doc_id"), "digests")
    pieces = _piece_rows(docs, id_col, text_col, docs.sparkSession.sparkContext.broadcast(_bits(twice)))
    point = lambda at, words: F.struct(at.alias("at"), words.alias("words"))
    start, before = F.shiftright("place", 22), F.shiftright("words", 9)
    found = pieces.join(twice, ["d1", "d2"]).select(
        "doc_id", "rid", "first_doc_id",
        point(start, before).alias("lo"),
        point(start + F.shiftright("place", 1).bitwiseAND(_LENGTH), before + F.col("words").bitwiseAND(511)).alias("hi"),
        ((F.col("place").bitwiseAND(1) == 1) & F.col("doc_id").eqNullSafe(F.col("first_doc_id"))).alias("kept"),
    )
    text = Window.partitionBy("doc_id", "rid")
    order = text.orderBy("lo", "hi")
    so_far, on = order.rowsBetween(Window.unboundedPreceding, 0), order.rowsBetween(0, Window.unboundedFollowing)
    apart = F.coalesce(F.col("lo.at") > F.max("hi.at").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(True))
    runs = found.withColumn("apart", apart.cast("int")).withColumn("before", F.max(F.when(F.col("kept"), F.col("hi"))).over(so_far)).withColumn("after", F.min(F.when(F.col("kept"), F.col("lo"))).over(on))
    runs = runs.withColumn("run", F.sum("apart").over(so_far))
    # What is kept here is not gone: the end of a kept piece before and the start of one after bound the others.
    runs = runs.withColumn("lo", F.when(F.col("kept"), F.col("lo")).otherwise(F.greatest("lo", "before"))).withColumn("hi", F.when(F.col("kept"), F.col("hi")).otherwise(F.least("hi", "after"))).where("lo.at < hi.at")
    turn = (F.col("apart") == 1) | (F.col("kept") != F.lag("kept").over(order)) | (F.col("run") != F.lag("run").over(order))
    parts = runs.withColumn("part", F.sum(F.coalesce(turn, F.lit(True)).cast("int")).over(so_far)).groupBy("doc_id", "rid", "run", "part", "kept").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.min("first_doc_id").alias("first_doc_id"))
    whole = Window.partitionBy("doc_id", "rid", "run")
    long = F.max("hi.words").over(whole) - F.min("lo.words").over(whole) >= min_words
    return parts.withColumn("long", long).where("long").select("doc_id", "rid", F.col("lo.at").alias("start"), F.col("hi.at").alias("end"), (F.col("hi.words") - F.col("lo.words")).alias("n_words"), "first_doc_id", "kept")


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """One row per row: doc_id, the text without the spans that go, and removed_bytes."""
    kind = docs.schema[id_col].dataType.simpleString()
    gone = stored(repeated_spans(docs, id_col, text_col, min_words).where("not kept"), "spans").groupBy("rid").agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("spans"))  # of one text
    rows = docs.select(F.col(id_col).alias("doc_id"), F.monotonically_increasing_id().alias("rid"), F.col(text_col).cast("binary").alias("body")).join(gone, "rid", "left").select("doc_id", "body", "spans")

    def run(batches):
        for b in batches:
            texts, removed = [], []
            for body, spans in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                last, kept = 0, []
                for s in spans or ():
                    kept.append(body[last : s["start"]])
                    last = s["end"]
                left = None if body is None else b"".join([*kept, body[last:]])
                texts.append(None if left is None else left.decode("utf-8", "replace"))
                removed.append(0 if left is None else len(body) - len(left))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string()), pa.array(removed, pa.int64())], ["doc_id", "text", "removed_bytes"])

    return rows.mapInArrow(run, f"doc_id {kind}, text string, removed_bytes long")
