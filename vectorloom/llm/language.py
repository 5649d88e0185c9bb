"""Language identification by multinomial naive Bayes over hashed character n-grams.

A text is lower-cased, each run of other signs than letters becomes one space, and its
n-grams of SIZES characters (a space at either end) are hashed into BUCKETS. Training
counts the n-grams of every labelled text that is not held out, one sum for each language
and bucket; a weight is the logarithm of the bucket's smoothed share, kept as a whole number of
1 / SCALE, so sums are exact and do not depend on the order of rows. The matrix of weights
is broadcast for at most LANGS languages at a time (256 KiB each), more are scored in passes that carry
the best so far. Texts are scored in numpy as sparse rows of n-grams, in lots of LOT.

Defined results: null text, and text without a letter, is `und` with score 0; so is every
text where no language was learned. Of equally likely languages the first by code points
is taken. The score is the posterior probability of the language. A null id is not held
out; a null language is not learned; the empty string is a language as any other. Repeated
rows count and are scored each; long texts are read whole, in steps of LOT characters; an
empty table gives none; other columns are ignored.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SIZES, BUCKETS, ALPHA, SCALE, LANGS, LOT = (1, 2, 3), 1 << 16, 0.1, 1 << 16, 256, 1 << 18
UNKNOWN = "und"
#: Languages whose counts a task holds before it hands them on.
HELD = 64
_OTHERS = re.compile(r"[\W\d_]+")
_MIX = np.array([0x9E3779B1, 0x85EBCA6B, 0xC2B2AE35], np.uint32)


def held_out(doc_id: Column) -> Column:
    """Rows that training never sees: crc32 of the id as text leaves 2 when divided by 4."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


def letters(text: str) -> np.ndarray:
    """Code points of the text in lower case between spaces, other signs as single spaces."""
    return np.frombuffer(f" {_OTHERS.sub(' ', text.lower()).strip()} ".encode("utf-32-le"), np.uint32)


def grams(text: str):
    """Buckets of all n-grams of the text, in arrays of about LOT at most."""
    code = letters(text)
    for at in range(0, len(code), LOT):
        for n in SIZES:
            last = min(at + LOT, len(code) - n + 1)
            if last > at:
                h = code[at:last] * _MIX[0] + np.uint32(n)
                for j in range(1, n):
                    h = (h ^ (h >> np.uint32(15))) * _MIX[1] + code[at + j : last + j] * _MIX[2]
                h = (h ^ (h >> np.uint32(13))) * _MIX[0]
                yield (h >> np.uint32(16)).astype(np.int64) % BUCKETS


def _counted(rows: DataFrame) -> DataFrame:
    """rows (lang, text) -> lang, bucket, n: occurrences in the rows; bucket -1 has the number of texts."""

    def run(batches):
        held: dict[str, np.ndarray] = {}

        def handed():
            for lang, counts in held.items():
                at = np.flatnonzero(counts)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at - 1), pa.array(counts[at])], ["lang", "bucket", "n"])
            held.clear()

        for b in batches:
            for lang, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                if lang not in held and len(held) == HELD:
                    yield from handed()
                counts = held.setdefault(lang, np.zeros(BUCKETS + 1, np.int64))
                counts[0] += 1
                for found in grams(text.as_py()):
                    counts[1:] += np.bincount(found, minlength=BUCKETS) if len(found) > BUCKETS // 8 else 0
                    if len(found) <= BUCKETS // 8:
                        np.add.at(counts, found + 1, 1)
        yield from handed()

    found = rows.select("lang", "text").mapInArrow(run, "lang string, bucket long, n long")
    return found.groupBy("lang", "bucket").agg(F.sum("n").alias("n"))


def learn(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """lang, texts (their number), weights (BUCKETS whole numbers as bytes): one row for each language of the rows not held out."""
    rows = docs.where(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull() & ~held_out(F.col(id_col))).select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"))

    def weigh(table: pa.Table) -> pa.Table:
        bucket, n = np.asarray(table.column("bucket")), np.asarray(table.column("n"))
        counts = np.zeros(BUCKETS + 1)
        counts[bucket + 1] = n  # a language has BUCKETS + 1 rows at most
        share = np.log(counts[1:] + ALPHA) - np.log(counts[1:].sum() + ALPHA * BUCKETS)
        return pa.table({"lang": [table.column("lang")[0].as_py()], "texts": pa.array([int(counts[0])], pa.int64()), "weights": pa.array([np.rint(share * SCALE).astype(np.int32).tobytes()], pa.binary())})

    return _counted(rows).groupBy("lang").applyInArrow(weigh, "lang string, texts long, weights binary")


def _lots(texts: list[str]):
    """(places of the texts, buckets, row starts): sparse rows, each lot of about LOT n-grams; a long text has several."""
    at, parts, starts, size = [], [], [], 0
    for i, text in enumerate(texts):
        for found in grams(text):
            at.append(i)
            starts.append(size)
            parts.append(found)
            size += len(found)
            if size >= LOT:
                yield at, np.concatenate(parts), np.array(starts)
                at, parts, starts, size = [], [], [], 0
    if parts:
        yield at, np.concatenate(parts), np.array(starts)


def likelihoods(texts: list[str], weights: np.ndarray) -> np.ndarray:
    """(texts, languages): sums of the weights (BUCKETS, languages) of each text's n-grams."""
    out = np.zeros((len(texts), weights.shape[1]), np.int64)
    step = max(1, 64 // weights.shape[1]) * 4096
    for at, buckets, starts in _lots(texts):
        ends = np.append(starts[1:], len(buckets))
        for row, lo, hi in zip(at, starts, ends, strict=True) if weights.shape[1] > 16 else ():
            for x in range(lo, hi, step):  # many languages: few n-grams at once
                out[row] += weights[buckets[x : min(hi, x + step)]].sum(0, dtype=np.int64)
        if weights.shape[1] <= 16:
            np.add.at(out, at, np.add.reduceat(weights[buckets], starts, axis=0, dtype=np.int64))
    return out


def _passed(rows: DataFrame, model, kind: str) -> DataFrame:
    """rows (doc_id, held_out, text, lang_pred, top, total) after one more block of languages; model: a broadcast (languages, priors, weights)."""

    def run(batches):
        langs, prior, weights = model.value
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                b = whole.slice(at, 256)
                texts = b.column(2).to_pylist()
                use = [i for i, t in enumerate(texts) if has_letter(t)]
                pred, top, total = (b.column(c).to_pylist() for c in (3, 4, 5))
                z = (likelihoods([texts[i] for i in use], weights) + prior) / SCALE
                for i, own in zip(use, z, strict=True):
                    best = int(own.argmax())  # the first of equal ones
                    more = float(np.exp(own - own[best]).sum())
                    if top[i] is None or own[best] > top[i]:
                        total[i] = more + (0.0 if top[i] is None else total[i] * float(np.exp(top[i] - own[best])))
                        pred[i], top[i] = langs[best], float(own[best])
                    else:
                        total[i] += more * float(np.exp(own[best] - top[i]))
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(pred, pa.string()), pa.array(top, pa.float64()), pa.array(total, pa.float64())], ["doc_id", "held_out", "text", "lang_pred", "top", "total"])

    return rows.mapInArrow(run, f"doc_id {kind}, held_out boolean, text string, lang_pred string, top double, total double")


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", model: DataFrame | None = None, block: int = LANGS) -> DataFrame:
    """One row per row: doc_id, held_out, lang_pred, score. model: what learn() gave, else it is learned from docs."""
    spark = docs.sparkSession
    model = (learn(docs, id_col, text_col, lang_col) if model is None else model).persist()  # one row a language
    known = sorted((r.lang, r.texts) for r in model.select("lang", "texts").collect())
    none = F.lit(None).cast("double")
    rows = docs.select(F.col(id_col).alias("doc_id"), held_out(F.col(id_col)).alias("held_out"), F.col(text_col).alias("text"), F.lit(None).cast("string").alias("lang_pred"), none.alias("top"), none.alias("total"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    for at in range(0, len(known), block):
        part = known[at : at + block]
        held = {r.lang: r.weights for r in model.where(F.col("lang").isin([lang for lang, _ in part])).collect()}  # `block` rows of 256 KiB
        weights = np.stack([np.frombuffer(held[lang], np.int32) for lang, _ in part], 1)
        prior = np.rint(np.log(np.array([n for _, n in part]) / sum(n for _, n in known)) * SCALE).astype(np.int64)
        rows = _passed(rows, spark.sparkContext.broadcast(([lang for lang, _ in part], prior, weights)), kind)
    model.unpersist()
    return rows.select("doc_id", "held_out", F.coalesce("lang_pred", F.lit(UNKNOWN)).alias("lang_pred"), F.coalesce(1 / F.col("total"), F.lit(0.0)).alias("score"))
