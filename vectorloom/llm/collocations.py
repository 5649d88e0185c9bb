"""Phrase collocations from count tries of bounded depth.

Texts are lower-cased (A-Z) and split at BREAKS into pieces, these at spaces and tabs into
words. A task keeps the words of its rows by language; every LOT of them it makes a trie of
all phrases of up to `depth` words: its nodes are the distinct phrases with their counts,
serialised in depth-first order (words by their bytes). A trie is cut at the bounds of
prefix ranges, and each range of it is one stored block with the ancestors of the range's
first node. A task merges the blocks of one range, sorted runs all, into one trie. The
bounds come from SAMPLE_DOCS documents; they decide where phrases are counted, not how
often. A range holds about RANGE_WORDS words, and a bound may have all DEPTH words, so the
phrases of a frequent word, or pair, are spread over ranges.

Two rounds: tries of depth 2 give the pairs with at least min_count occurrences, which mark
a bitmap of FILTER_BITS bits. In the second round phrases end at a pair that is not marked;
no phrase that occurs min_count times has such a pair, so its count and those of all
its parts stay exact, and most of the tries' nodes are never written. A pair marked by
chance only costs space.

Left parts are counted by the walk: a node's ancestors are the first words of its phrase.
Right parts follow suffix links, from a phrase to the phrase without its first words, which
occurs at least as often and so has a row of its own.

Defined results: null text counts as empty; null language is `und`; empty texts and
languages without candidates give no rows; repeated rows count each; long texts are read
whole; ties go by the smallest cut, then by count and phrase (UTF-8 bytes); an empty
table gives none; other columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_left
from itertools import pairwise

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import split_join, stored

DEPTH, MIN_COUNT, TOP, UNKNOWN = 5, 100, 2000, "und"
BREAKS = b".,;:!?\n\x0b\x0c\r"
#: Words of a trie, words of a prefix range, documents that place the ranges and phrases drawn of each, bytes of text that are split at once.
LOT, RANGE_WORDS, SAMPLE_DOCS, SAMPLE_PHRASES, SLICE = 2_000_000, 2_000_000, 2000, 64, 1 << 20
#: Bits of the filter of pairs: 2,048 bitmaps of 32,768 bits, 8 MiB.
FILTER_BITS = 2048 * 32768
_UPPER = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_SIGNS = bytes.maketrans(_UPPER + BREAKS + b"\t", _UPPER.lower() + b"\n" * len(BREAKS) + b" ")
_NOTHING, _BREAK = 0, 1


class Words(dict):
    """Numbers of words; a new word gets the next."""

    def __init__(self):
        super().__init__({b"": _NOTHING, b"\n": _BREAK})

    def __missing__(self, word: bytes) -> int:
        number = self[word] = len(self)
        return number

    def of(self, text: bytes):
        """Numbers of the text's words in arrays, breaks where a piece ends; a long text is split in slices that end between words."""
        text, at = text.translate(_SIGNS), 0
        while at < len(text):
            end = at + SLICE
            while end < len(text) and text[end] not in b" \n":
                end += 1
            found = text[at:end].replace(b"\n", b" \n ").split(b" ")
            at, code = end, np.fromiter(map(self.__getitem__, found), np.int32, len(found))
            yield code[code != _NOTHING]


def keys(cols: list[np.ndarray], most: int) -> list[np.ndarray]:
    """The columns of numbers up to `most` as few whole numbers, the first deciding first."""
    bits = max(1, int(most).bit_length())
    per, out = 63 // bits, []
    for at in range(0, len(cols), per):
        key = cols[at].astype(np.int64)
        for c in cols[at + 1 : at + per]:
            key = key << bits | c
        out.append(key)
    return out


def _sorted(cols: list[np.ndarray], n: np.ndarray | None, most: int) -> tuple[list[np.ndarray], np.ndarray]:
    """The distinct rows of the columns in order, with the sums of n (None: 1 each). Sorted runs that follow each other are merged, as the sort is natural."""
    if not len(cols[0]):
        return cols, np.zeros(0, np.int64)
    key = keys(cols, most)
    order = np.argsort(key[0], kind="stable") if len(key) == 1 else np.lexsort(key[::-1])
    key = [k[order] for k in key]
    first = np.concatenate([[True], np.logical_or.reduce([k[1:] != k[:-1] for k in key])])
    starts = np.flatnonzero(first)
    sums = np.diff(np.append(starts, len(order))) if n is None else np.add.reduceat(n[order], starts)
    return [c[order[starts]] for c in cols], sums.astype(np.int64)


def trie(code: np.ndarray, windows: int, depth: int, most: int, joined: np.ndarray | None = None) -> tuple[list[np.ndarray], np.ndarray]:
    """(columns of words, counts) of all phrases of up to `depth` words that start at the first `windows` places, in depth-first order.

    code: ranks of words from 1, 0 at breaks; a phrase has zeros after its last word.
    joined: whether a phrase may go on from each place to the next.
    """
    code = np.concatenate([code, np.zeros(depth, code.dtype)])
    cols = [code[:windows]]
    for j in range(1, depth):
        more = np.where(cols[-1] > 0, code[j : j + windows], 0)
        if joined is not None:
            more[~joined[j - 1 : j - 1 + windows]] = 0
        cols.append(more)
    single = cols[1] == 0 if depth > 1 else np.ones(windows, bool)
    alone = np.bincount(cols[0][single], minlength=most + 1)
    alone[0] = 0
    ends, n = _sorted([c[~single] for c in cols], None, most)  # phrases as long as they go
    words = np.flatnonzero(alone)
    parts, counts = [[words.astype(code.dtype), *[np.zeros(len(words), code.dtype)] * (depth - 1)]], [alone[words]]
    new = np.zeros(len(n), bool)
    new[:1] = True
    for d in range(1, depth + 1):  # a node of d words begins where one of them changes
        if len(n):
            new[1:] |= ends[d - 1][1:] != ends[d - 1][:-1]
            starts = np.flatnonzero(new)
            sums = np.add.reduceat(n, starts)
            own = ends[d - 1][starts] > 0
            parts.append([c[starts[own]] if i < d else np.zeros(own.sum(), code.dtype) for i, c in enumerate(ends)])
            counts.append(sums[own])
    return _sorted([np.concatenate(c) for c in zip(*parts, strict=True)], np.concatenate(counts), most)


def place(cols: list[np.ndarray], path: list[int], exact: list[bool]) -> tuple[int, list[int]]:
    """(place of the first node that is not before the path, places of the path's ancestors). path: ranks; exact: whether the word itself has that rank, or the next word."""
    lo, hi, above = 0, len(cols[0]), []
    for j, (rank, same) in enumerate(zip(path, exact, strict=True)):
        lo, hi = lo + int(np.searchsorted(cols[j][lo:hi], rank, "left")), lo + int(np.searchsorted(cols[j][lo:hi], rank, "right"))
        if not same:
            return lo, above
        if j < len(path) - 1 and lo < hi:
            above.append(lo)
    return lo, above


def _ranks(path: tuple[bytes, ...], words: list[bytes]) -> tuple[list[int], list[bool]]:
    at = [bisect_left(words, w) for w in path]
    return [i + 1 for i in at], [i < len(words) and words[i] == w for i, w in zip(at, path, strict=True)]


def pair_bits(lang: str, hashes: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The filter's bit of the pairs of words number a and b."""
    h = (hashes[a] ^ np.uint64(xxhash.xxh64_intdigest(lang))) * np.uint64(0x9E3779B97F4A7C15)
    h = ((h ^ (h >> np.uint64(29))) + hashes[b]) * np.uint64(0xBF58476D1CE4E5B9)
    return ((h ^ (h >> np.uint64(32))) % np.uint64(FILTER_BITS)).astype(np.int64)


def _hashed(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))


_BLOCK = "lang string, part int, words array<binary>, path binary, n binary"


def _blocks(texts: DataFrame, bounds: dict[str, list[tuple[bytes, ...]]], depth: int, marked=None, lot: int = LOT) -> DataFrame:
    """texts (lang, text) -> serialised ranges of the tries of each task's words. marked: a broadcast filter of pairs, or None."""

    def run(batches):
        words, held, size = Words(), {}, 0

        def handed():
            order = sorted(w for w, i in words.items() if i > _BREAK)
            rank = np.zeros(len(words), np.int32)
            rank[np.fromiter(map(words.get, order), np.int64, len(order))] = np.arange(1, len(order) + 1)
            hashes = None if marked is None else np.concatenate([np.zeros(1, np.uint64), _hashed(order)])
            for lang, parts in held.items():
                code, joined = rank[np.concatenate(parts)], None
                if marked is not None:
                    bit = pair_bits(lang, hashes, code, np.append(code[1:], 0))
                    joined = np.append((marked.value[bit >> 3] >> (bit & 7) & 1).astype(bool), np.zeros(depth, bool))
                for at in range(0, len(code), lot):
                    here = min(lot, len(code) - at)
                    yield from cut(lang, *trie(code[at : at + here + depth - 1], here, depth, len(order), None if joined is None else joined[at : at + here + depth]), order)
            words.clear()
            words.update(Words())
            held.clear()

        def cut(lang: str, cols: list[np.ndarray], n: np.ndarray, order: list[bytes]):
            found = [(0, []), *[place(cols, *_ranks(path[:depth], order)) for path in bounds.get(lang, [])], (len(n), [])]
            for part, ((lo, above), (hi, _)) in enumerate(pairwise(found)):
                if lo < hi or above:  # a range without own nodes still adds to its ancestors
                    rows = np.concatenate([np.array(above, np.int64), np.arange(lo, hi)])
                    own = [c[rows] for c in cols]
                    used = np.unique(np.concatenate(own))
                    local = [np.searchsorted(used, c).astype(np.int32) + (used[0] > 0) for c in own]
                    yield pa.RecordBatch.from_arrays([pa.array([lang]), pa.array([part], pa.int32()), pa.array([[order[i - 1] for i in used if i]], pa.list_(pa.binary())), pa.array([np.stack(local).tobytes()], pa.binary()), pa.array([n[rows].tobytes()], pa.binary())], ["lang", "part", "words", "path", "n"])

        for b in batches:
            for lang, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                parts = held.setdefault(lang, [])
                for code in words.of(text.as_py()):
                    parts.append(code)
                    size += len(code)
                parts.append(np.array([_BREAK], np.int32))
                if size >= lot:
                    yield from handed()
                    size = 0
        yield from handed()

    return texts.select("lang", "text").mapInArrow(run, _BLOCK)


def _nodes(blocks: DataFrame, bounds: dict[str, list[tuple[bytes, ...]]], depth: int, min_count: int) -> DataFrame:
    """lang, path, len, n, lefts (counts of the first 1, 2, .. words), bit (of pairs, with depth 2): phrases with at least min_count occurrences; path null: n is the range's number of words."""

    def merged(table: pa.Table) -> pa.Table:
        lang, part = table.column("lang")[0].as_py(), table.column("part")[0].as_py()
        lists = table.column("words").to_pylist()
        order = sorted(set().union(*lists))
        at = {w: i + 1 for i, w in enumerate(order)}
        cols, counts = [[] for _ in range(depth)], []
        for words, path, n in zip(lists, table.column("path"), table.column("n"), strict=True):
            rank = np.array([0, *[at[w] for w in words]], np.int32)
            counts.append(np.frombuffer(n.as_buffer(), np.int64))
            for c, own in zip(cols, np.frombuffer(path.as_buffer(), np.int32).reshape(depth, -1), strict=True):
                c.append(rank[own])
        cols, n = _sorted([np.concatenate(c) for c in cols], np.concatenate(counts), len(order))
        start = place(cols, *_ranks(bounds[lang][part - 1][:depth], order))[0] if part else 0
        size, rows = sum((c > 0).astype(np.int8) for c in cols), np.arange(len(n))
        total = int(n[start:][size[start:] == 1].sum())
        # The walk: in depth-first order the last node of d words is the ancestor.
        above = [n[np.maximum.accumulate(np.where(size == d, rows, 0))] for d in range(1, depth)]
        out = np.flatnonzero((n >= min_count) & (rows >= start))
        phrases = [b" ".join([order[c[i] - 1] for c in cols[: size[i]]]).decode() for i in out]
        lefts = [[int(a[i]) for a in above[: size[i] - 1]] for i in out]
        bits = [None] * len(out)
        if depth == 2 and len(out):
            hashes = np.concatenate([np.zeros(1, np.uint64), _hashed(order)])
            found = pair_bits(lang, hashes, cols[0][out], cols[1][out])
            bits = [int(b) if size[i] == 2 else None for i, b in zip(out, found, strict=True)]
        return pa.table(
            {
                "lang": pa.array([lang] * (len(out) + 1), pa.string()), "path": pa.array([*phrases, None], pa.string()), "len": pa.array([*size[out].tolist(), 0], pa.int32()),
                "n": pa.array([*n[out].tolist(), total], pa.int64()), "lefts": pa.array([*lefts, []], pa.list_(pa.int64())), "bit": pa.array([*bits, None], pa.int64()),
            }
        )

    return blocks.groupBy("lang", "part").applyInArrow(merged, "lang string, path string, len int, n long, lefts array<long>, bit long")


def _bounds(texts: DataFrame, range_words: int, sample_docs: int = SAMPLE_DOCS) -> dict[str, list[tuple[bytes, ...]]]:
    """First phrases of the ranges after the first, by language, from about sample_docs documents with SAMPLE_PHRASES places each. They share out the work and change no result."""
    docs = texts.count()
    share = min(1.0, sample_docs / max(1, docs))

    def drawn(batches):
        for b in batches:
            for lang, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                words = Words()
                code = np.concatenate([*words.of(text.as_py()), np.zeros(DEPTH, np.int32)])
                names = list(words)
                starts = np.unique(np.random.default_rng(len(code)).integers(0, max(1, len(code) - DEPTH), SAMPLE_PHRASES))
                paths = []
                for i in starts:
                    run = code[i : i + DEPTH]
                    path = [names[w] for w in run[: int(np.argmax(np.append(run, _BREAK) <= _BREAK))]]
                    if path:
                        paths.append(path)
                weight = [(len(code) - DEPTH) / max(1, len(paths))] * len(paths)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(paths), pa.string()), pa.array(paths, pa.list_(pa.binary())), pa.array(weight, pa.float64())], ["lang", "path", "weight"])

    found: dict[str, list] = {}
    for r in texts.sample(False, share, 7).select("lang", "text").mapInArrow(drawn, "lang string, path array<binary>, weight double").toLocalIterator():
        found.setdefault(r.lang, []).append((tuple(map(bytes, r.path)), r.weight / share))
    out = {}
    for lang, paths in found.items():
        paths.sort()
        total = np.cumsum([w for _, w in paths])
        ranges = int(total[-1] // range_words) + 1
        out[lang] = sorted({paths[int(np.searchsorted(total, total[-1] * i / ranges))][0] for i in range(1, ranges)})
    return out


def _filter(bits: DataFrame) -> np.ndarray:
    """The marked bits (column bit) of FILTER_BITS as bytes: 2,048 bitmaps of 4 KiB at most pass the driver."""
    rows = bits.groupBy(F.expr("bit div 32768").alias("word")).agg(F.expr("bitmap_construct_agg(bit % 32768)").alias("bits")).collect()
    out = np.zeros(FILTER_BITS // 8, np.uint8)
    for r in rows:
        out[r.word * 4096 : r.word * 4096 + len(r.bits)] = np.frombuffer(bytes(r.bits), np.uint8)
    return out


def phrases(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", min_count: int = MIN_COUNT, depth: int = DEPTH, lot: int = LOT, range_words: int = RANGE_WORDS) -> tuple[DataFrame, DataFrame]:
    """(lang, path, len, n, lefts) of all phrases of up to `depth` words with at least min_count occurrences, and (lang, n) with all words of each language."""
    texts = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit(UNKNOWN)).alias("lang"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"))
    bounds = _bounds(texts, range_words)
    # Bounds of two words, each once, for the pairs.
    short = {lang: sorted({path[:2] for path in paths}) for lang, paths in bounds.items()}
    pairs = _nodes(_blocks(texts, short, 2, None, lot), short, 2, min_count).where("bit IS NOT NULL")
    marked = docs.sparkSession.sparkContext.broadcast(_filter(pairs.select("bit")))  # FILTER_BITS
    found = stored(_nodes(_blocks(texts, bounds, depth, marked, lot), bounds, depth, min_count), "phrase-nodes")
    return found.where("path IS NOT NULL").drop("bit"), found.where("path IS NULL").groupBy("lang").agg(F.sum("n").alias("n"))


def collocations(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", min_count: int = MIN_COUNT, top: int = TOP, depth: int = DEPTH, lot: int = LOT, range_words: int = RANGE_WORDS) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the first `top` phrases of each language."""
    nodes, totals = phrases(docs, text_col, lang_col, min_count, depth, lot, range_words)
    cuts = nodes.where("len >= 2").select("lang", "path", F.col("n").alias("a"), F.posexplode("lefts").alias("k0", "l"), F.split("path", " ").alias("words"))
    cuts = cuts.select("lang", "path", "a", "l", (F.col("k0") + 1).alias("k"), F.size("words").alias("len"), F.struct("lang", F.array_join(F.slice("words", F.col("k0") + 2, F.lit(depth)), " ").alias("path")).alias("link"))
    ends = nodes.select(F.struct("lang", "path").alias("link"), F.col("n").alias("r"))
    cuts = split_join(split_join(cuts, ends, "link").drop("link"), totals, "lang")
    big = lambda c: F.col(c).cast("decimal(19,0)")
    cuts = cuts.withColumn("by", big("l") * big("r")).withColumn("of", (big("a") * 1000).cast("decimal(19,0)") * big("n"))
    cuts = stored(cuts.withColumn("score", F.expr("of div by")), "phrase-cuts")
    best = cuts.groupBy("lang", "path").agg(F.min(F.struct("score", "k", "a", "l", "r", "n")).alias("m"))
    # A phrase goes if a longer one has its count; it is then part of one that is a word longer and has it too.
    inner = lambda at, n: F.array_join(F.slice(F.split("path", " "), at, n), " ")
    longer = cuts.where("len >= 3")
    gone = longer.where("k = len - 1 AND l = a").select("lang", inner(F.lit(1), F.col("len") - 1).alias("path")).union(longer.where("k = 1 AND r = a").select("lang", inner(F.lit(2), F.col("len") - 1).alias("path"))).distinct()
    kept = best.join(gone, ["lang", "path"], "left_anti").select("lang", F.col("path").alias("phrase"), "m.*")
    place_ = F.row_number().over(Window.partitionBy("lang").orderBy(F.col("score").desc(), F.col("a").desc(), "phrase"))
    return kept.withColumn("rank", place_).where(F.col("rank") <= top).select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def collocations_sql(min_count: int = MIN_COUNT, top: int = TOP, depth: int = DEPTH) -> str:
    """The same in DuckDB SQL over a table documents."""
    signs = "[.,;:!?" + "".join(rf"\x{b:02X}" for b in BREAKS if b < 32) + "]"
    lower = f"translate(coalesce(text, ''), '{_UPPER.decode()}', '{_UPPER.lower().decode()}')"
    return rf"""
    WITH pieces AS (SELECT coalesce(lang, '{UNKNOWN}') AS lang, unnest(string_split_regex({lower}, '{signs}')) AS piece FROM documents),
    lists AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
    spots AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM lists),
    runs AS (SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase FROM spots, range(1, {depth + 1}) t(k) WHERE i + k - 1 <= len(w)),
    f AS MATERIALIZED (SELECT lang, k, phrase, count(*) AS n FROM runs GROUP BY ALL),
    totals AS (SELECT lang, sum(n)::BIGINT AS n FROM f WHERE k = 1 GROUP BY lang),
    c AS MATERIALIZED (SELECT * FROM f WHERE k >= 2 AND n >= {min_count}),
    parts AS MATERIALIZED (SELECT lang, phrase, a, cut, array_to_string(w[1:cut], ' ') AS lp, array_to_string(w[cut + 1:], ' ') AS rp FROM (SELECT lang, phrase, n AS a, string_split(phrase, ' ') AS w, unnest(range(1, k)) AS cut FROM c)),
    cuts AS (
      SELECT p.lang, p.phrase, a, cut, lf.n AS l, rf.n AS r, t.n, ((1000::HUGEINT * a * t.n) // (lf.n::HUGEINT * rf.n))::BIGINT AS score
      FROM parts p JOIN f lf ON lf.lang = p.lang AND lf.phrase = p.lp JOIN f rf ON rf.lang = p.lang AND rf.phrase = p.rp JOIN totals t ON t.lang = p.lang),
    best AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
    shorter AS (SELECT lang, n, w, k, unnest(range(2, k)) AS m FROM (SELECT lang, n, k, string_split(phrase, ' ') AS w FROM c)),
    inside AS (SELECT lang, n, array_to_string(w[s:s + m - 1], ' ') AS phrase FROM (SELECT *, unnest(range(1, k - m + 2)) AS s FROM shorter)),
    gone AS (SELECT DISTINCT c.lang, c.phrase FROM inside i JOIN c ON c.lang = i.lang AND c.phrase = i.phrase WHERE 100 * i.n >= 100 * c.n),
    kept AS (SELECT * FROM best ANTI JOIN gone USING (lang, phrase))
    SELECT lang, rank, phrase, a, l, r, n, score FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept) WHERE rank <= {top}"""
