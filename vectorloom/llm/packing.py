"""Best-fit packing into fixed sequences, online with bounded space.

Documents are tokenized where they are read; those longer than a sequence are cut
into whole sequences and a rest. The pieces, without texts, are dealt into lots of a
bounded number, and a task places a lot's pieces online: OPEN bins at most are open,
kept in lists by free space; a bitset over the free sizes finds the tightest bin
that fits by one shift and one lowest-bit operation; of equally free bins the latest is
taken. When a new bin is needed and OPEN are open, the fullest closes first. Large lots
leave few bins partly filled. A lot is sorted before it is placed, so that places do not
depend on the order in which its rows arrive.

Tokens are those of the tokenizer over the whole text. Since it drops white space,
text is tokenized by the words it cuts, whose ids are kept in a bounded table; the
ids are the same as for the whole text (tested).

Defined results: null text counts as empty and has one token, the end id; every
document has at least one piece; a long text is tokenized whole by one task; repeated rows are packed each on its own; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import json
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored

SIZE, OPEN, END, LOT = 4096, 512, 1, 100_000
KEPT, PART_CHARS = 400_000, 64


class BestFit:
    """Bounded-space online best fit. place(length) -> (bin, offset)."""

    def __init__(self, size: int = SIZE, most: int = OPEN):
        self.size, self.most, self.open, self.bins = size, most, 0, 0
        self.free = 0  # bit s is set if a bin with s free is open
        self.by_free: list[list[int]] = [[] for _ in range(size + 1)]

    def place(self, length: int) -> tuple[int, int]:
        fits = self.free >> length
        if fits:
            free = length + (fits & -fits).bit_length() - 1  # the tightest
            own = self._take(free)
        else:
            if self.open == self.most:
                self._take((self.free & -self.free).bit_length() - 1)  # the fullest closes
            own, free = self.bins, self.size
            self.bins += 1
        left = free - length
        if left:
            self.by_free[left].append(own)
            self.free |= 1 << left
            self.open += 1
        return own, self.size - free

    def _take(self, free: int) -> int:
        bins = self.by_free[free]
        own = bins.pop()
        if not bins:
            self.free &= ~(1 << free)
        self.open -= 1
        return own


# How the tokenizer file cuts a text; its parts are runs of letters, single digits and runs of other signs.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Texts of these code points and ASCII white space are cut here; all are composed, and lower-cased one by one.
_PLAIN = re.compile("[\t-\r -~À-ÖØ-öø-ÿ]*").fullmatch
_PARTS = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^\t-\r a-z0-9ß-öø-ÿ]+").findall
_SPACE = re.compile("[\t-\r ]+").split


def _byte_signs() -> dict[int, str]:
    """The printable sign that stands for each byte in a byte-level vocabulary: itself, or the next free from 256 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in printable]
    return {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(others)}


class Ids:
    """Ids of whole texts as little-endian uint32 bytes.

    A tokenizer that cuts a text into words and drops white space is asked by these
    parts; KEPT of them are kept at most. Any other tokenizer, and any run with
    signs whose cutting is not known here, goes to the tokenizer as it is.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.of = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            how = json.load(f).get("pre_tokenizer") or {}
        first = (how.get("pretokenizers") or [{}])[0]
        self.by_parts = first.get("pattern") == {"Regex": PATTERN} and first.get("behavior") == "Removed"
        self.known: dict[str, bytes] = {}
        self.signs = _byte_signs()

    def whole(self, text: str) -> bytes:
        return np.array(self.of.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _part(self, part: str) -> bytes:
        signs = part.encode().decode("latin-1").translate(self.signs)
        return b"".join([t.id.to_bytes(4, "little") for t in self.of.model.tokenize(signs)])

    def _plain(self, text: str) -> bytes:
        parts, known = _PARTS(text.lower()), self.known
        missing = list(set(parts).difference(known))
        if len(known) + len(missing) > KEPT:
            known.clear()
            missing = list(set(parts))
        known.update(zip(missing, map(self._part, missing), strict=True))
        ids = b"".join(map(known.__getitem__, parts))
        for x in missing:
            if len(x) > PART_CHARS:
                del known[x]
        return ids

    def text(self, text: str) -> bytes:
        """The ids of the whole text."""
        if not self.by_parts:
            return self.whole(text)
        if _PLAIN(text) and "<|" not in text:
            return self._plain(text)
        # ASCII white space always parts; only runs with other signs are left to the tokenizer.
        return b"".join([self._plain(w) if _PLAIN(w) and "<|" not in w else self.whole(w) for w in _SPACE(text) if w])


def tokenized(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE, end_id: int = END, with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, and with with_ids the ids (little-endian uint32)."""
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    names = ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids
    end = np.array([end_id], "<u4").tobytes()

    def run(batches):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        of = Ids(tokenizer)
        for b in batches:
            at, out, bodies = [], [], []
            for i, text in enumerate(b.column(1)):
                ids = of.text(text.as_py()) + end
                for piece, lo in enumerate(range(0, len(ids), 4 * size)):
                    part = ids[lo : lo + 4 * size]
                    at.append(i)
                    out.append((piece, lo // 4, len(part) // 4, zlib.crc32(part)))
                    if with_ids:
                        bodies.append(part)
            cols = np.array(out, np.int64).reshape(-1, 4)
            arrays = [b.column(0).take(pa.array(at, pa.int64())), pa.array(cols[:, 0].astype(np.int32)), *(pa.array(cols[:, k]) for k in (1, 2, 3))]
            yield pa.RecordBatch.from_arrays(arrays + ([pa.array(bodies, pa.binary())] if with_ids else []), names)

    return rows.mapInArrow(run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids)


def pack(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE, most_open: int = OPEN, end_id: int = END, with_ids: bool = False, lot: int = LOT) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset, and with with_ids the ids.

    tokenizer: path of a tokenizer file, found at the same place on all executors.
    lot: pieces that one task packs, about.
    """
    pieces = stored(tokenized(docs, tokenizer, id_col, text_col, size, end_id, with_ids), "pieces")
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema] + ["sequence_id long", "offset long"]

    def run(batches):
        from pyspark import TaskContext

        base, bins = TaskContext.get().partitionId() << 40, BestFit(size, most_open)
        for b in batches:
            places = np.array([bins.place(n) for n in b.column(3).to_pylist()], np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(places[:, 0] | base), pa.array(places[:, 1])], [*b.schema.names, "sequence_id", "offset"])

    lots = max(1, round(pieces.count() / lot))
    # Blocks arrive in any order: a lot is placed in the order of a hash, then by its columns; rows alike in all of them are interchangeable.
    order = [F.xxhash64("doc_id", "piece", "ids_crc32"), "doc_id", "piece", "length", "ids_crc32"]
    return pieces.repartition(lots).sortWithinPartitions(*order).mapInArrow(run, ", ".join(fields))
