"""Toxicity by subword-bag embeddings and a linear softmax, trained jointly in numpy.

A word is the bag of its character 3- to 5-grams (with word ends) and itself, hashed
into BUCKETS; a text is the average of its distinct words' n-gram embeddings, and a linear
softmax on it gives the classes. Embeddings and softmax are trained together by steps with
momentum as in Adam, but with one second moment for each table instead of one for each
value. A misspelling shares most n-grams with the word it hides, and so its vector.

Training uses at most FIT_ROWS labelled rows of each class, chosen by a hash of the
id, and never a held-out one. Their bags are made in the executors: the driver, which
trains, gets no texts, and at most 2 * FIT_ROWS bags of BUCKETS numbers; the logits are calibrated to the classes' shares among all
labels that are not held out, so scores do not depend on FIT_ROWS. Scoring covers all texts; since everything after the
bag is linear, a word's share of the logit is kept in a bounded table.

Defined results: null and empty texts are scored by the bias alone; texts of any length are
scored whole; equal texts have equal scores, so repeated rows and ties do too; of labelled
rows with one id training takes the least text; rows with null labels are not used; repeated
labels of a document count once, as toxic if any is; without labels of both classes every
score is 0; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BUCKETS, DIM, FIT_ROWS, EPOCHS, RATE, DECAY, SEED = 1 << 16, 4, 2000, 20, 0.1, 1e-6, 11
BATCH, SCALE = 128, 100.0
THRESHOLD = 0.3
_WORDS = re.compile(r"[^\W_]+").findall
_KEPT = 200_000


def grams(word: str) -> list[int]:
    """Buckets of a lower-cased word: its 3- to 5-grams between < and >, and the whole."""
    w = f"<{word}>"
    found = [w[i : i + n] for n in (3, 4, 5) for i in range(len(w) - n + 1)]
    found.append(w)
    return [zlib.crc32(g.encode("utf-8", "replace")) % BUCKETS for g in found]


def held_out(doc_id: Column) -> Column:
    """Rows that training never sees: crc32 of the id as text leaves 2 when divided by 4."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


class Bags:
    """Average bags of texts; the n-grams of words are kept in a bounded table."""

    def __init__(self):
        self.known: dict[str, np.ndarray] = {}

    def of(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """(buckets, their shares) of a text's distinct words: BUCKETS of each at most, whatever its length."""
        words = set(_WORDS(text.lower()))
        if len(self.known) + len(words) > _KEPT:
            self.known.clear()
        found = []
        for w in words:
            if (g := self.known.get(w)) is None:
                g = self.known[w] = np.array(grams(w))
            found.append(g)
        at, n = np.unique(np.concatenate(found) if found else np.zeros(0, np.int64), return_counts=True)
        return at.astype(np.int32), n.astype(np.float32) / np.float32(max(1, n.sum()))


def train(bags: list[tuple[np.ndarray, np.ndarray]], labels: list[int], epochs: int = EPOCHS, dim: int = DIM, rate: float = RATE, prior: float | None = None) -> tuple[np.ndarray, float]:
    """(each bucket's share of the logit, bias). Embeddings (BUCKETS, dim) and softmax (dim, 2) are trained jointly.

    prior: share of class 1 among all labelled rows, for the calibration of the
    logits, which uses every fifth text and trains on the others.
    """
    y = np.array(labels)
    if not len(y) or y.min() == y.max():
        return np.zeros(BUCKETS), -np.inf
    at, share = (np.concatenate(x) for x in zip(*bags, strict=True))
    starts = np.cumsum([0, *(len(own) for own, _ in bags)])
    rng = np.random.default_rng(SEED)
    learn = np.arange(len(y)) % 5 != 0
    if len(set(y[learn])) < 2 or len(set(y[~learn])) < 2:
        learn[:] = True
    rows = np.flatnonzero(learn)
    E, W, b = rng.normal(0, 0.01, (BUCKETS, dim)).astype(np.float32), rng.normal(0, 1.0, (dim, 2)), np.zeros(2)
    weight, target = np.where(y == 1, 0.5 / (y[learn] == 1).mean(), 0.5 / (y[learn] == 0).mean()), np.eye(2)[y]
    pace = [[np.zeros(p.shape), 0.0] for p in (E, W, b)]
    step = 0
    for _ in range(epochs):
        rng.shuffle(rows)
        for lot in np.array_split(rows, max(1, len(rows) // BATCH)):
            step += 1
            sizes = starts[lot + 1] - starts[lot]
            where = np.concatenate([np.arange(starts[i], starts[i + 1]) for i in lot])
            own, value, row = at[where], share[where], np.repeat(np.arange(len(lot)), sizes)
            H = np.stack([np.bincount(row, value * E[own, d], len(lot)) for d in range(dim)], 1) * SCALE
            z = H @ W + b
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            g = (p - target[lot]) * weight[lot, None] / len(lot)
            gH = (g @ W.T) * SCALE
            gE = np.stack([np.bincount(own, value * gH[row, d], BUCKETS) for d in range(dim)], 1)
            # One pace for each table: a bucket moves as far as it says something about the class.
            for param, grad, m in zip((E, W, b), (gE + DECAY * E, H.T @ g + DECAY * W, g.sum(0)), pace, strict=True):
                m[0] += 0.1 * (grad - m[0])
                m[1] += 0.02 * (float((grad * grad).sum()) - m[1])
                param -= (rate * (m[0] / (1 - 0.9**step)) / (np.sqrt(m[1] / (1 - 0.98**step)) + 1e-12)).astype(param.dtype)
    logit = (E @ (W[:, 1] - W[:, 0])).astype(np.float64) * SCALE
    z = np.add.reduceat(np.append(share * logit[at], 0.0), starts[:-1]) * (starts[1:] > starts[:-1]) + (b[1] - b[0])
    tuned = ~learn if not learn.all() else learn
    slope, offset = _calibrated(z[tuned], y[tuned], y.mean() if prior is None else prior)
    return logit * slope, float((b[1] - b[0]) * slope + offset)


def _calibrated(z: np.ndarray, y: np.ndarray, prior: float) -> tuple[float, float]:
    """Slope and offset of a logistic fit to the logits, with the classes weighted as among all labelled rows."""
    prior = min(max(prior, 1e-3), 1 - 1e-3)
    w = np.where(y == 1, prior / (y == 1).sum(), (1 - prior) / (y == 0).sum())
    x, theta = np.stack([z / (np.abs(z).max() + 1e-9), np.ones(len(z))], 1), np.zeros(2)
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ theta, -30, 30)))
        grad = x.T @ (w * (p - y)) + 1e-5 * theta
        hess = (x * (w * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ x + 1e-5 * np.eye(2)
        theta -= np.linalg.solve(hess, grad)
    return float(theta[0] / (np.abs(z).max() + 1e-9)), float(theta[1])


class Scorer:
    """Probability of class 1 of a text."""

    def __init__(self, share: np.ndarray, bias: float):
        self.share, self.bias = share, bias
        self.known: dict[str, complex] = {}  # sum of shares + number of n-grams * 1j

    def _word(self, word: str) -> complex:
        g = grams(word)
        return complex(float(self.share[g].sum()), len(g))

    def of(self, text: str) -> float:
        if self.bias == -np.inf:
            return 0.0
        words, known = set(_WORDS(text.lower())), self.known
        missing = words.difference(known)
        if len(known) + len(missing) > _KEPT:
            known.clear()
            missing = words
        missing = list(missing)
        known.update(zip(missing, map(self._word, missing), strict=True))
        total = sum(map(known.__getitem__, sorted(words)), 0j)  # in one order: equal texts, equal scores
        z = (total.real / total.imag if words else 0.0) + self.bias
        return float(1 / (1 + np.exp(-np.clip(z, -700, 700))))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", fit_rows: int = FIT_ROWS) -> tuple[np.ndarray, float]:
    one = labels.where(F.col(label_col).isin(0, 1)).groupBy(F.col(id_col).alias("doc_id")).agg(F.max(F.col(label_col)).alias("y")).where(~held_out(F.col("doc_id")))
    order = [F.xxhash64("doc_id", F.lit(SEED)), F.col("doc_id")]
    chosen = one.where("y = 1").orderBy(*order).limit(fit_rows).union(one.where("y = 0").orderBy(*order).limit(fit_rows))
    texts = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    found = texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.first("y").alias("y")).orderBy("doc_id")  # 2 * fit_rows ids at most

    def run(batches):
        bags = Bags()
        for b in batches:
            for t, y in zip(b.column(0), b.column(1), strict=True):
                at, share = bags.of(t.as_py())
                yield pa.RecordBatch.from_arrays([pa.array([at]), pa.array([share]), pa.array([y.as_py()], y.type)], ["at", "share", "y"])

    label = found.schema["y"].dataType.simpleString()
    rows = found.select("text", "y").mapInArrow(run, f"at array<int>, share array<float>, y {label}").toArrow()
    bags = [(at.values.to_numpy(), share.values.to_numpy()) for at, share in zip(rows["at"], rows["share"], strict=True)]
    return train(bags, rows["y"].to_pylist(), prior=one.agg(F.avg("y")).first()[0])


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", threshold: float = THRESHOLD, fit_rows: int = FIT_ROWS) -> DataFrame:
    """One row per row: doc_id, held_out, score, predicted."""
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, id_col, text_col, label_col, fit_rows))  # BUCKETS doubles
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches):
        scorer = Scorer(*model.value)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([scorer.of(t.as_py()) for t in b.column(1)], pa.float64())], ["doc_id", "score"])

    found = rows.mapInArrow(run, f"doc_id {kind}, score double")
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
