"""Quality selection by importance resampling.

Texts are bags of hashed n-grams: words and word pairs in lower case, and pairs of
word shapes (case, digits, signs, a word that repeats the one before). Two
generative models over the same buckets are fitted: the target from good labelled
texts, the raw one from counts over all texts. A text's evidence is the mean over its
n-grams of log p_target - log p_raw, with PRIOR_GRAMS neutral n-grams added, so that
length alone says nothing. A logistic fit to the labels scales it to the log weight, the
log odds that the text is good: its slope sets how far the ratio outweighs the noise, its
offset changes no rank. A text's key is log weight / temperature plus Gumbel noise, and
the k largest keys are the sample, drawn without replacement in proportion to
weight ** (1 / temperature) (Xie et al., 2023; Kool et al., 2019). Noise decides near the
margin, where the odds are close to even; a text with odds of a thousand stays.

All fitting is across FOLDS: the target model that weighs a text never saw the labelled
texts of its own fold, so labelled texts are weighed like all others, and the logistic fit
and the cut hold for texts that were not labelled. k follows from the labels: the cut
between good and bad labelled texts' log weights that loses fewest of either gives the
number of texts above it, counted over all.

Target models and the logistic fit use at most FIT_ROWS labelled texts of each class, of
rows with one id the least text; the classes weigh in it as among all labels. Texts stay in
the executors: sums by fold and bucket and one number a labelled text reach the driver.
Everything else covers all texts. The k-th key is
found by histograms of fixed size, refined until it is exact; no keys are gathered.

Defined results: null and empty texts have no n-grams and neutral evidence; long texts are
read whole; null labels are not used for fitting; repeated rows have equal keys and are kept
or rejected together, as are ties at the k-th key; if no good or no bad labels are there,
all are kept; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored

BUCKETS, FIT_ROWS, TEMPERATURE, SEED, FOLDS = 1 << 15, 4000, 1.0, 7, 4
#: Neutral n-grams added to each text, weight of the raw shares in the target model (n-grams), and ridge of the logistic fit.
PRIOR_GRAMS, SMOOTH, RIDGE = 30, 0.5 * BUCKETS, 1e-3
_TOKENS = re.compile(r"[^\W_]+|[^\w\s]+|_+").findall
_KEPT = 200_000
_MIX = np.int64(1_000_003)


class Grams:
    """Bucket numbers of a text's n-grams; word hashes are kept in a bounded table."""

    def __init__(self, buckets: int = BUCKETS):
        self.buckets = buckets
        self.known: dict[str, int] = {}

    def _code(self, token: str) -> int:
        """Word hash in the upper bits, shape in the lower 16."""
        if token[0].isalnum():
            shape = "9" if token.isdigit() else "a" if token.islower() else "A" if token.isupper() and len(token) > 1 else "Aa" if token[:1].isupper() else "mixed"
        else:
            shape = token[:4]
        return zlib.crc32(token.lower().encode("utf-8", "replace")) << 16 | zlib.crc32(shape.encode("utf-8", "replace")) & 0xFFFF

    def of(self, text: str) -> np.ndarray:
        tokens = _TOKENS(text)
        if not tokens:
            return np.zeros(0, np.int64)
        known = self.known
        missing = list(set(tokens).difference(known))
        if len(known) + len(missing) > _KEPT:
            known.clear()
            missing = list(set(tokens))
        known.update(zip(missing, map(self._code, missing), strict=True))
        codes = np.fromiter(map(known.__getitem__, tokens), np.int64, len(tokens))
        words, shapes = codes >> 16, codes & 0xFFFF
        shapes[1:][words[1:] == words[:-1]] = 1  # says the last word again
        with np.errstate(over="ignore"):
            grams = np.concatenate([words * 3, (words[:-1] * _MIX + words[1:]) * 3 + 1, (shapes[:-1] * _MIX + shapes[1:]) * 7919 + 2])
            grams ^= grams >> 17
            return np.abs(grams * np.int64(0x9E3779B97F4A7C1 | 1) >> 20) % self.buckets


def fold_of(doc_id) -> Column:
    """The fold of a document: a hash of its id."""
    return F.pmod(F.xxhash64(doc_id, F.lit(SEED + 1)), F.lit(FOLDS)).cast("int")


def _texts(docs: DataFrame, id_col: str, text_col: str, row_col: str | None = None) -> DataFrame:
    row = [F.col(row_col).alias("rid")] if row_col else []
    return docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), *row)


def gram_counts(texts: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """Counts of all texts' n-grams."""
    return _counts(texts.select("text", F.lit(0).alias("fold")), buckets, 1)[0]


def _counts(texts: DataFrame, buckets: int, folds: int) -> np.ndarray:
    """Counts of the n-grams of each fold's texts: each task adds its own, and folds * buckets sums reach the driver."""

    def run(batches):
        grams, total = Grams(buckets), np.zeros((folds, buckets), np.int64)
        for b in batches:
            for t, f in zip(b.column(0), b.column(1).to_pylist(), strict=True):
                total[f] += np.bincount(grams.of(t.as_py()), minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total.reshape(-1)[at])], ["bucket", "n"])

    sums = texts.select("text", "fold").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(folds * buckets, np.int64)
    out[sums["bucket"].to_numpy()] = sums["n"].to_numpy()
    return out.reshape(folds, buckets)


def _labelled(docs: DataFrame, labels: DataFrame, id_col: str, label_col: str, fit_rows: int) -> tuple[DataFrame, float]:
    """(doc_id, text, y, fold of at most fit_rows texts of each class, chosen by a hash of the id; the share of good ones among all labels). Of rows with one id the least text counts."""
    one = labels.where(F.col(label_col).isin(0, 1)).groupBy(F.col(id_col).alias("doc_id")).agg(F.max(F.col(label_col)).alias("y"))
    order = [F.xxhash64("doc_id", F.lit(SEED)), F.col("doc_id")]
    chosen = one.where("y = 1").orderBy(*order).limit(fit_rows).union(one.where("y = 0").orderBy(*order).limit(fit_rows))
    found = docs.join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.first("y").alias("y"))  # 2 * fit_rows ids at most
    return stored(found.withColumn("fold", fold_of("doc_id")), "quality-labelled"), one.agg(F.avg("y")).first()[0] or 0.0


def _evidence(rows: DataFrame, ratios: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(evidence, label) of labelled rows in the order of their ids: two numbers a row reach the driver."""
    shared = rows.sparkSession.sparkContext.broadcast(ratios)  # FOLDS * BUCKETS doubles
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches):
        grams = Grams(shared.value.shape[1])
        for b in batches:
            x = [evidence(grams.of(t.as_py()), shared.value[f]) for t, f in zip(b.column(1), b.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(x, pa.float64())], ["doc_id", "y", "x"])

    label = rows.schema["y"].dataType.simpleString()
    found = rows.select("doc_id", "text", "y", "fold").mapInArrow(run, f"doc_id {kind}, y {label}, x double").orderBy("doc_id").toArrow()
    shared.unpersist()
    return found["x"].to_numpy(), found["y"].to_numpy().astype(int)


def evidence(bag: np.ndarray, ratio: np.ndarray) -> float:
    """Mean log ratio of a bag's n-grams, with PRIOR_GRAMS neutral ones added."""
    return float(ratio[bag].sum()) / (len(bag) + PRIOR_GRAMS)


@dataclass
class Model:
    """log p_target - log p_raw by fold and bucket; slope and offset of the log weight; the cut between the classes' log weights."""

    ratios: np.ndarray
    slope: float = 0.0
    offset: float = 0.0
    cut: float = -np.inf

    def weight(self, bag: np.ndarray, fold: int) -> float:
        return self.slope * evidence(bag, self.ratios[fold]) + self.offset


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", fit_rows: int = FIT_ROWS, buckets: int = BUCKETS) -> Model:
    texts = _texts(docs, id_col, text_col)
    rows, prior = _labelled(texts, labels, id_col, label_col, fit_rows)
    if rows.select("y").distinct().count() < 2:
        return Model(np.zeros((FOLDS, buckets)))
    raw, own = gram_counts(texts, buckets), _counts(rows.where("y = 1"), buckets, FOLDS)
    counts = own.sum(0) - own  # a fold's target model is that of the other folds
    # The raw shares smooth the target.
    share = (raw + 0.5) / (raw.sum() + 0.5 * buckets)
    ratios = np.log((counts + SMOOTH * share) / (counts.sum(1, keepdims=True) + SMOOTH)) - np.log(share)
    x, y = _evidence(rows, ratios)
    slope, offset = _logistic(x, y, prior)
    weights = slope * x + offset
    return Model(ratios, slope, offset, _cut(weights[y == 1], weights[y == 0]))


def _logistic(x: np.ndarray, y: np.ndarray, prior: float) -> tuple[float, float]:
    """Slope and offset of the log odds of y = 1 by x, the classes weighing as among all labels."""
    prior = min(max(prior, 1e-3), 1 - 1e-3)
    w, unit = np.where(y == 1, prior / (y == 1).sum(), (1 - prior) / (y == 0).sum()), x.std() + 1e-12
    z, theta = np.stack([(x - x.mean()) / unit, np.ones(len(x))], 1), np.zeros(2)
    ridge = np.diag([RIDGE, 1e-6])
    for _ in range(200):
        p = 1 / (1 + np.exp(-np.clip(z @ theta, -30, 30)))
        step = np.linalg.solve((z * (w * np.maximum(p * (1 - p), 1e-9))[:, None]).T @ z + ridge, z.T @ (w * (p - y)) + ridge @ theta)
        theta -= step / max(1.0, np.abs(step).max())
        if np.abs(step).max() < 1e-9:
            break
    return float(theta[0] / unit), float(theta[1] - theta[0] * x.mean() / unit)


def _cut(good: np.ndarray, bad: np.ndarray) -> float:
    """Between the two: the middle of the gap that leaves the smallest share of either on its wrong side."""
    values = np.unique(np.concatenate([good, bad]))
    wrong = np.searchsorted(np.sort(good), values) / len(good) + 1 - np.searchsorted(np.sort(bad), values) / len(bad)
    best = int(np.argmin(wrong))
    return float(values[best] if best == 0 else (values[best - 1] + values[best]) / 2)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", row_col: str | None = None) -> DataFrame:
    """doc_id, n_grams, log_weight of every row, and with row_col rid."""
    texts = _texts(docs, id_col, text_col, row_col).withColumn("fold", fold_of("doc_id"))
    texts = texts.select("doc_id", *(["rid"] if row_col else []), "fold", "text")
    shared = docs.sparkSession.sparkContext.broadcast(model)  # FOLDS * BUCKETS doubles
    kind = texts.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", *(["rid"] if row_col else []), "n_grams", "log_weight"]

    def run(batches):
        model = shared.value
        grams = Grams(model.ratios.shape[1])
        for b in batches:
            n, w = [], []
            for t, fold in zip(b.column(b.num_columns - 1), b.column(b.num_columns - 2).to_pylist(), strict=True):
                bag = grams.of(t.as_py())
                n.append(len(bag))
                w.append(model.weight(bag, fold))
            yield pa.RecordBatch.from_arrays([*b.columns[:-2], pa.array(n, pa.int64()), pa.array(w, pa.float64())], names)

    return texts.mapInArrow(run, f"doc_id {kind}, {'rid long, ' if row_col else ''}n_grams long, log_weight double")


def kth_largest(df: DataFrame, col: str, k: int, bins: int = 4096) -> float:
    """The k-th largest value of a column of finite doubles, exact: histograms of `bins` counts narrow it down."""
    lo, hi, n = df.agg(F.min(col), F.max(col), F.count(col)).first()
    if not n or k >= n:
        return -np.inf
    if k <= 0:
        return np.inf
    while lo < hi:
        width = (hi - lo) / bins
        if width == 0 or lo + width == lo:
            bounds = df.where(F.col(col).between(lo, hi)).groupBy(col).count().orderBy(F.desc(col)).collect()  # a few neighbouring doubles
            for row in bounds:
                k -= row["count"]
                if k <= 0:
                    return row[col]
        inside = df.where(F.col(col).between(lo, hi)).select(F.least(F.floor((F.col(col) - lo) / width), F.lit(bins - 1)).alias("bin"), F.col(col).alias("v"))
        for row in sorted(inside.groupBy("bin").agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")).collect(), key=lambda r: -r.bin):
            if k <= row.n:
                lo, hi = row.lo, row.hi
                break
            k -= row.n
    return lo


def resample(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", fit_rows: int = FIT_ROWS, temperature: float = TEMPERATURE, k: int | None = None, row_col: str | None = None) -> DataFrame:
    """One row per row: doc_id, n_grams, log_weight, gumbel_key, kept, and with row_col that number of the row. k: sample size instead of that from the labels."""
    model = fit(docs, labels, id_col, text_col, label_col, fit_rows)
    u = (F.shiftrightunsigned(F.xxhash64("doc_id", F.lit(SEED)), 11).cast("double") + 0.5) / float(1 << 53)
    keyed = score(docs, model, id_col, text_col, row_col).withColumn("gumbel_key", F.col("log_weight") / temperature - F.log(-F.log(u)))
    keyed = stored(keyed, "quality-keys")
    if k is None:
        k = keyed.where(F.col("log_weight") >= float(model.cut)).count()
    least = kth_largest(keyed, "gumbel_key", k)
    return keyed.select("doc_id", "n_grams", "log_weight", "gumbel_key", (F.col("gumbel_key") >= float(least)).alias("kept"), *([F.col("rid").alias(row_col)] if row_col else []))
