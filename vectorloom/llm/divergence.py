"""Source divergence audit: how far the sources of a language differ in their terms.

Terms are runs of ASCII letters (A-Z lower-cased) and signs beyond ASCII. A language keeps
the terms of at least min_docs of its documents; the share of a term in a group (a source
of a language, or the whole language) is 1 + floor(10**9 * (count + 5) / (N + 5 V)) in
whole numbers, N being the group's occurrences of all kept terms and V their number.

The comparison is a systolic rotation. Kept terms are dealt by hash into slices of about
SLICE_TERMS, the groups of a language into blocks of about BLOCK_GROUPS; a cell (language,
slice, block) holds the block's counts of one slice and stays in its partition. A row of a
cell is a compressed vector: the places of the terms that occur and their counts. At home
the groups of a block are compared with each other and with their language, whose vector
visits each block; a heap of `top` terms for each group and slice is all that leaves. Then
the vectors of blocks travel in the rounds of a round-robin tournament, in which each block
meets one other at a time, and a meeting gives the distances in both directions. Each
round's results are written before the next. Sums over slices are the distances.

Defined results: null text, language and source count as ''; texts without terms make a
group all the same; a language without kept terms has distances 0 and no terms; repeated
rows are documents of their own; long texts are read whole; ties of a value go by the
item's UTF-8 bytes; an empty table gives none; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

MIN_DOCS, TOP, UNIT, PRIOR = 30, 50, 10**9, 5
SLICE_TERMS, BLOCK_GROUPS = 1 << 14, 8
#: Terms whose counts a task holds before it hands them on; bytes of a text that are split at once.
HELD, SLICE = 400_000, 1 << 20
_UPPER = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_LETTERS = bytes(b | 32 if b in _UPPER else b if b in _UPPER.lower() or b > 127 else 32 for b in range(256))
_VECTOR = "lang string, slice int, block int, source string, total long, terms long, size long, ids binary, counts binary"


def _terms(text: bytes):
    """The text's terms in lists; a long text is split in slices that end between terms."""
    text, at = text.translate(_LETTERS), 0
    while at < len(text):
        end = at + SLICE
        while end < len(text) and text[end] != 32:
            end += 1
        yield text[at:end].split()
        at = end


def term_counts(rows: DataFrame, held: int = HELD) -> DataFrame:
    """rows (lang, source, text as bytes) -> lang, source, term, n, docs (documents that have it)."""

    def run(batches):
        groups: dict[tuple[str, str], tuple[Counter, Counter]] = {}
        size = 0

        def handed():
            for (lang, source), (n, docs) in groups.items():
                terms = list(n)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(terms), pa.string()), pa.array([source] * len(terms), pa.string()), pa.array([t.decode() for t in terms], pa.string()), pa.array([n[t] for t in terms], pa.int64()), pa.array([docs[t] for t in terms], pa.int64())], ["lang", "source", "term", "n", "docs"])
            groups.clear()

        for b in batches:
            for lang, source, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                n, docs = groups.setdefault((lang, source), (Counter(), Counter()))
                before, own = len(n), set()
                for found in _terms(text.as_py()):
                    n.update(found)
                    own.update(found)
                docs.update(own)
                size += len(n) - before
                if size >= held:
                    yield from handed()
                    size = 0
        yield from handed()

    found = rows.select("lang", "source", "text").mapInArrow(run, "lang string, source string, term string, n long, docs long")
    return found.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def shares(counts: np.ndarray, total: int, terms: int) -> np.ndarray:
    """1 + floor(UNIT * (count + PRIOR) / (total + PRIOR * terms)), exactly."""
    if not len(counts):
        return counts
    wide = (int(counts.max()) + PRIOR) * UNIT >= 1 << 63
    found = 1 + UNIT * ((counts.astype(object) if wide else counts) + PRIOR) // (total + PRIOR * terms)
    return found.astype(np.int64)


class Cell:
    """The vectors of a cell: sources, counts and shares, one row each."""

    def __init__(self, table: pa.Table):
        table = table.sort_by("source")
        rows = table.select(["source", "total", "terms", "size", "ids", "counts"]).to_pylist()
        self.sources, self.size = [r["source"] for r in rows], rows[0]["size"] if rows else 0
        self.counts = np.zeros((len(rows), self.size), np.int64)
        for own, r in zip(self.counts, rows, strict=True):
            own[np.frombuffer(r["ids"], np.int32)] = np.frombuffer(r["counts"], np.int64)
        self.shares = np.stack([shares(own, r["total"], r["terms"]) for own, r in zip(self.counts, rows, strict=True)]) if rows else self.counts

    def distances(self, other: Cell):
        """(own source, other's source, distance) of all meetings of the two."""
        for source, own in zip(self.sources, self.shares, strict=True):
            yield from ((source, peer, int(d)) for peer, d in zip(other.sources, np.abs(other.shares - own).sum(1), strict=True))


_FOUND = "lang string, slice int, source string, item string, id int, value long"


def _rows(table: pa.Table, found: list[tuple]) -> pa.Table:
    """found: (source, item, id, value)."""
    lang, part = (table.column("lang")[0].as_py(), table.column("slice")[0].as_py()) if len(table) else (None, None)
    cols = list(zip(*found, strict=True)) or [()] * 4
    kinds = (pa.string(), pa.string(), pa.int32(), pa.int64())
    source, item, at, value = (pa.array(list(c), t) for c, t in zip(cols, kinds, strict=True))
    return pa.table({"lang": pa.array([lang] * len(found), pa.string()), "slice": pa.array([part] * len(found), pa.int32()), "source": source, "item": item, "id": at, "value": value})


def _at_home(top: int):
    def run(block: pa.Table, visitor: pa.Table) -> pa.Table:
        """Distances within a block, and the `top` terms of each group by their share over the language's."""
        cell, lang = Cell(block), Cell(visitor)
        found = [(a, b, None, d) for a, b, d in cell.distances(cell) if a != b]
        for source, counts, own in zip(cell.sources, cell.counts, cell.shares, strict=True):
            over = own - lang.shares[0]
            at = np.flatnonzero((counts > 0) & (over > 0))
            best = at[np.lexsort((at, -over[at]))[:top]]  # ids follow the terms' bytes
            found += [(source, None, int(i), int(over[i])) for i in best]
        return _rows(block, found)

    return run


def _met(host: pa.Table, guest: pa.Table) -> pa.Table:
    """One meeting of two blocks, both directions."""
    if not len(host) or not len(guest):
        return _rows(host, [])
    found = list(Cell(host).distances(Cell(guest)))
    return _rows(host, [(a, b, None, d) for a, b, d in found] + [(b, a, None, d) for a, b, d in found])


def partner(block: Column, blocks: Column, turn: int) -> Column:
    """The block that a block meets in a turn of the tournament (circle method); itself where it has none."""
    last = blocks + blocks % 2 - 1  # an odd number has one more place, which is empty
    other = F.when(block == last, F.lit(turn)).when(block == turn, last).otherwise(F.pmod(F.lit(2 * turn) - block, last))
    return F.when((F.lit(turn) < last) & (other < blocks), other).otherwise(block)


def _vectors(counted: DataFrame, lexicon: DataFrame, groups: DataFrame) -> DataFrame:
    """Compressed vectors of all groups (lang, source, total, terms, slices), one row for each slice, those without terms included.

    counted: (lang, source, term, n); lexicon: (lang, term, slice, id).
    """
    placed = counted.join(lexicon.select("lang", "term", "slice", "id"), ["lang", "term"])
    own = placed.groupBy("lang", "source", "slice").agg(F.sort_array(F.collect_list(F.struct("id", "n"))).alias("v"))  # a slice's terms at most
    sizes = lexicon.groupBy("lang", "slice").agg(F.count("*").alias("size"))
    every = groups.withColumn("slice", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)))
    found = every.join(own, ["lang", "source", "slice"], "left").join(sizes, ["lang", "slice"], "left")
    found = found.select("lang", "slice", "block", "source", "total", "terms", F.coalesce("size", F.lit(0)).cast("long").alias("size"), F.col("v.id").alias("i"), F.col("v.n").alias("c"))

    def packed(batches):
        for b in batches:
            as_bytes = lambda col, kind: pa.array([b"" if v.as_py() is None else np.asarray(v.values, kind).tobytes() for v in b.column(col)], pa.binary())
            yield pa.RecordBatch.from_arrays([*b.columns[:7], as_bytes(7, np.int32), as_bytes(8, np.int64)], ["lang", "slice", "block", "source", "total", "terms", "size", "ids", "counts"])

    return found.mapInArrow(packed, _VECTOR)


def divergence(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", min_docs: int = MIN_DOCS, top: int = TOP, slice_terms: int = SLICE_TERMS, block_groups: int = BLOCK_GROUPS) -> DataFrame:
    """lang, source, part (pair or term), item, value, rank."""
    plain = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = docs.select(plain(lang_col).alias("lang"), plain(source_col).alias("source"), plain(text_col).cast("binary").alias("text"))
    counted = stored(term_counts(rows), "divergence-terms")
    kept = counted.groupBy("lang", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")).where(F.col("docs") >= min_docs)
    kept = stored(kept.select("lang", "term", "n"), "divergence-kept")
    pairs = rows.select("lang", "source").distinct()
    in_lang = pairs.groupBy("lang").agg(F.count("*").alias("sources"))
    of_kept = kept.groupBy("lang").agg(F.count("*").alias("terms"), F.sum("n").alias("lang_total"))
    parts = lambda n, size: F.greatest(F.lit(1), F.ceil(F.col(n) / size)).cast("int")
    langs = in_lang.join(of_kept, "lang", "left").select("lang", F.coalesce("terms", F.lit(0)).alias("terms"), F.coalesce("lang_total", F.lit(0)).alias("lang_total"), "sources")
    langs = stored(langs.withColumn("slices", parts("terms", slice_terms)).withColumn("blocks", parts("sources", block_groups)), "divergence-langs")
    in_slice = Window.partitionBy("lang", "slice").orderBy("term")
    lexicon = kept.join(langs.select("lang", "slices"), "lang").withColumn("slice", F.pmod(F.xxhash64("term"), F.col("slices")).cast("int"))
    lexicon = stored(lexicon.withColumn("id", F.row_number().over(in_slice) - 1).select("lang", "term", "n", "slice", "id"), "divergence-lexicon")

    sums = counted.join(kept.select("lang", "term"), ["lang", "term"]).groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = pairs.join(sums, ["lang", "source"], "left").join(langs, "lang")
    groups = groups.select("lang", "source", F.coalesce("total", F.lit(0)).alias("total"), "terms", "slices", F.pmod(F.xxhash64("source"), F.col("blocks")).cast("int").alias("block"))
    cell, width = ["lang", "slice", "block"], int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    resident = stored(_vectors(counted, lexicon, groups), "divergence-vectors").repartition(width, *cell).persist()  # made again from the files if lost
    whole = langs.select("lang", F.lit("").alias("source"), F.col("lang_total").alias("total"), "terms", "slices", F.lit(0).alias("block"))
    visitor = _vectors(lexicon.select("lang", F.lit("").alias("source"), "term", "n"), lexicon, whole).drop("block")
    visitor = stored(visitor, "divergence-languages").join(langs.select("lang", "blocks"), "lang").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks")
    found = stored(resident.groupBy(*cell).cogroup(visitor.groupBy(*cell)).applyInArrow(_at_home(top), _FOUND), "divergence-home")
    distances = found.where("id IS NULL")
    most = langs.agg(F.max("blocks")).first()[0] or 1
    travellers = resident.join(langs.select("lang", "blocks"), "lang")
    for turn in range(most + most % 2 - 1 if most > 1 else 0):
        to = partner(F.col("block"), F.col("blocks"), turn)
        guests = travellers.withColumn("to", to).where("to < block").drop("block", "blocks").withColumnRenamed("to", "block")  # the lower one is host
        guests = guests.toDF(*guests.columns)  # columns of their own, as both sides are one table
        distances = distances.union(stored(resident.groupBy(*cell).cogroup(guests.groupBy(*cell)).applyInArrow(_met, _FOUND), "divergence-round"))
    resident.unpersist()
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item"))
    far = distances.groupBy("lang", "source", "item").agg(F.sum("value").alias("value")).withColumn("rank", rank)
    names = lexicon.select("lang", "slice", "id", F.col("term").alias("name"))
    best = found.where("id IS NOT NULL").drop("item").join(names, ["lang", "slice", "id"]).select("lang", "source", F.col("name").alias("item"), "value").withColumn("rank", rank).where(F.col("rank") <= top)
    cols = lambda df, part: df.select("lang", "source", F.lit(part).alias("part"), "item", "value", "rank")
    return cols(far, "pair").union(cols(best, "term"))


def divergence_sql(min_docs: int = MIN_DOCS, top: int = TOP) -> str:
    """The same in DuckDB SQL over a table documents."""
    lower = f"translate(coalesce(text, ''), '{_UPPER.decode()}', '{_UPPER.lower().decode()}')"
    share = lambda n, total: f"(1 + ({UNIT}::HUGEINT * ({n} + {PRIOR})) // ({total} + {PRIOR} * v.v))::BIGINT"
    return rf"""
    WITH d AS (SELECT row_number() OVER () AS i, coalesce(lang, '') AS lang, coalesce(source, '') AS source, regexp_extract_all({lower}, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents),
    t AS MATERIALIZED (SELECT i, lang, source, unnest(terms) AS term FROM d),
    kept AS MATERIALIZED (SELECT lang, term, count(*) AS n FROM t GROUP BY ALL HAVING count(DISTINCT i) >= {min_docs}),
    groups AS (SELECT DISTINCT lang, source FROM d),
    v AS (SELECT lang, count(term) AS v, coalesce(sum(n), 0)::BIGINT AS total FROM (SELECT DISTINCT lang FROM d) LEFT JOIN kept USING (lang) GROUP BY lang),
    c AS (SELECT t.lang, source, term, count(*) AS n FROM t SEMI JOIN kept USING (lang, term) GROUP BY ALL),
    totals AS (SELECT lang, source, coalesce(sum(n), 0)::BIGINT AS total FROM groups LEFT JOIN c USING (lang, source) GROUP BY ALL),
    p AS MATERIALIZED (
      SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, {share("coalesce(c.n, 0)", "g.total")} AS p, {share("k.n", "v.total")} AS q
      FROM totals g JOIN v USING (lang) JOIN kept k USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
    far AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p))::BIGINT AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
    pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN far f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source),
    terms AS (SELECT lang, source, 'term' AS part, term AS item, p - q AS value FROM p WHERE n > 0 AND p > q),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INT AS rank FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms))
    SELECT lang, source, part, item, value, rank FROM ranked WHERE part = 'pair' OR rank <= {top}"""
