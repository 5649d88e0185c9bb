"""Language identification against plain naive Bayes, and on awkward rows."""

import math
import random
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from vectorloom.llm import language as li

SCHEMA = "doc_id long, text string, lang string, top string, total string, held_out string"
SOUNDS = {"aa": "the of and ing tion er".split(), "bb": "der die und sch ung ä".split(), "cc": "le de et eau é ç".split()}


def corpus(n=240, seed=3):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        lang = rng.choice(sorted(SOUNDS))
        text = " ".join("".join(rng.choices(SOUNDS[lang], k=rng.randint(1, 3))) for _ in range(rng.randint(1, 30))).capitalize()
        rows.append((i, text + rng.choice([".", " 12!", ""]), lang if rng.random() < 0.9 else None))
    rows += [(900, None, "aa"), (901, "", "bb"), (902, " 12 #_", "cc"), (None, "the of", "aa"), (903, "X", None), (904, "日本語 text", "aa"), (904, "日本語 text", "aa"), (905, "the " * 100_000, "aa")]
    return rows


def held(i):
    return i is not None and zlib.crc32(str(i).encode()) % 4 == 2


def plain_grams(text):
    """Buckets of each n-gram, one by one, in whole numbers of 32 bits."""
    s = "".join(c if li._OTHERS.fullmatch(c) is None else " " for c in text.lower())
    s = f" {' '.join(s.split(' ')).strip()} "
    while "  " in s and s.strip():
        s = s.replace("  ", " ")
    a, b, c = (int(x) for x in li._MIX)
    for n in li.SIZES:
        for i in range(len(s) - n + 1):
            h = (ord(s[i]) * a + n) % 2**32
            for x in s[i + 1 : i + n]:
                h = ((h ^ h >> 15) * b + ord(x) * c) % 2**32
            yield ((h ^ h >> 13) * a) % 2**32 >> 16


def plain(rows):
    counts, texts = defaultdict(Counter), Counter()
    for i, text, lang in rows:
        if lang is not None and text is not None and not held(i):
            counts[lang].update(plain_grams(text))
            texts[lang] += 1
    logs = {}
    for lang, c in counts.items():
        total = sum(c.values()) + li.ALPHA * li.BUCKETS
        logs[lang] = lambda g, c=c, total=total: math.log((c[g] + li.ALPHA) / total)
    out = []
    for i, text, _ in rows:
        if text is None or not any(x.isalpha() for x in text):
            out.append((i, held(i), "und", 0.0))
            continue
        own = Counter(plain_grams(text))
        z = {lang: math.log(texts[lang] / sum(texts.values())) + sum(n * f(g) for g, n in own.items()) for lang, f in logs.items()}
        best = max(sorted(z), key=z.get)
        out.append((i, held(i), best, 1 / sum(math.exp(max(-700, v - z[best])) for v in z.values())))
    return out


@pytest.mark.parametrize("block", [li.LANGS, 1, 2])
def test_equals_plain_naive_bayes(spark, block):
    rows = corpus()
    df = spark.createDataFrame([(*r, "x", "x", "x") for r in rows], SCHEMA).repartition(3)
    key = lambda r: (r[0] is None, r[0] or 0)
    found, want = sorted(map(tuple, li.identify(df, block=block).collect()), key=key), sorted(plain(rows), key=key)
    assert [f[:3] for f in found] == [w[:3] for w in want]
    assert [f[3] for f in found] == pytest.approx([w[3] for w in want], abs=1e-2)
    right = [f[2] == r[2] for f, r in zip(found, sorted(rows, key=key), strict=True) if r[2] in SOUNDS and f[1] and f[2] != "und"]
    assert sum(right) / len(right) > 0.9


def test_nothing_learned_and_empty(spark):
    df = spark.createDataFrame([(1, "abc", None, "", "", ""), (2, None, "aa", "", "", "")], SCHEMA)
    assert sorted(map(tuple, li.identify(df).collect())) == [(1, False, "und", 0.0), (2, zlib.crc32(b"2") % 4 == 2, "und", 0.0)]
    assert li.identify(df.where("false")).collect() == []


def test_held_out_rows_and_other_columns_do_not_matter(spark):
    rows = corpus()
    df = spark.createDataFrame([(*r, "x", "x", "x") for r in rows], SCHEMA)
    before = {r.doc_id: (r.lang_pred, r.score) for r in li.identify(df).collect()}
    wrong = df.withColumn("lang", F.when(li.held_out(F.col("doc_id")), "bb").otherwise(F.col("lang"))).repartition(7).withColumn("lang_pred", F.lit("zz"))
    assert {r.doc_id: (r.lang_pred, r.score) for r in li.identify(wrong).collect()} == before


def test_many_languages_score_alike():
    import numpy as np

    rng = np.random.default_rng(1)
    weights = rng.integers(-1000, 0, (li.BUCKETS, 40)).astype(np.int32)
    texts = ["the of and", "x", "ing " * 30_000]
    wide = li.likelihoods(texts, weights)
    assert (wide[:, :7] == li.likelihoods(texts, np.ascontiguousarray(weights[:, :7]))).all()
