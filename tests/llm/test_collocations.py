"""Phrase collocations against plain counting, with tries and ranges small enough to be cut and merged."""

import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from vectorloom.llm import collocations as co

SCHEMA = "doc_id long, text string, lang string, path string, n string, part string"


def corpus(n=300, seed=5):
    rng = random.Random(seed)
    common = "of the in a to and it Is é x y \x01 b~ zz".split(" ")
    rows = []
    for i in range(n):
        words = []
        while len(words) < 40:
            words += rng.choice([["new", "york", "city"], ["state", "of", "the", "art"], ["a", "a", "a"], rng.choices(common, k=3), [f"r{rng.randrange(2000)}"]])
        text = "".join(w + rng.choice([" "] * 8 + ["  ", "\t", ". ", "\n", ", and ", "\x0b", "!"]) for w in words)
        rows.append((i, text, rng.choice(["en", "en", "de", None])))
    rows += [(900, None, "en"), (901, "", "en"), (902, " .,; \n", "xx"), (903, "once only", "yy"), (904, "The the " * 30_000, "en"), (904, "new york", "en"), (904, "new york", "en")]
    return rows


def plain(rows, min_count, top):
    f, n = Counter(), Counter()
    for _, text, lang in rows:
        lang = "und" if lang is None else lang
        lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            f.update((lang, tuple(w[i : i + k])) for i in range(len(w)) for k in range(1, 6) if i + k <= len(w))
    found = {p: a for p, a in f.items() if len(p[1]) > 1 and a >= min_count}
    gone = {(lang, q[s : s + m]) for (lang, q), a in found.items() for m in range(2, len(q)) for s in range(len(q) - m + 1) if f[lang, q[s : s + m]] <= a}
    out = {}
    for (lang, p), a in found.items():
        if (lang, p) not in gone:
            score, k = min((1000 * a * n[lang] // (f[lang, p[:k]] * f[lang, p[k:]]), k) for k in range(1, len(p)))
            out.setdefault(lang, []).append((-score, -a, " ".join(p).encode(), f[lang, p[:k]], f[lang, p[k:]]))
    return sorted((lang, i + 1, p.decode(), -a, l, r, n[lang], -s) for lang, x in out.items() for i, (s, a, p, l, r) in enumerate(sorted(x)[:top]))


@pytest.mark.parametrize("lot, words", [(co.LOT, co.RANGE_WORDS), (1500, 700), (97, 5000)])
def test_equals_plain_counting(spark, lot, words):
    rows = corpus()
    df = spark.createDataFrame([(*r, "x", "x", "x") for r in rows], SCHEMA).repartition(5)
    found = co.collocations(df, min_count=12, top=40, lot=lot, range_words=words)
    assert found.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    want = plain(rows, 12, 40)
    assert {w[0] for w in want} == {"en", "de", "und"} and any(len(w[2].split(" ")) == 5 for w in want)
    assert sorted(map(tuple, found.collect())) == want


def test_scores_beyond_64_bits(spark):
    big = 1 << 52
    nodes = spark.createDataFrame([("en", "a b", 2, big, [big]), ("en", "a", 1, big, []), ("en", "b", 1, big + 1, [])], "lang string, path string, len int, n long, lefts array<long>")
    totals = spark.createDataFrame([("en", 3 * big)], "lang string, n long")
    held = co.phrases
    try:
        co.phrases = lambda *a: (nodes, totals)
        row = co.collocations(nodes).first()
    finally:
        co.phrases = held
    assert row.score == 1000 * big * 3 * big // (big * (big + 1)) == 2999


def test_empty_and_nothing_frequent(spark):
    df = spark.createDataFrame([(1, "a b c", "en", "", "", "")], SCHEMA)
    assert co.collocations(df).collect() == []
    assert co.collocations(df.where("false")).collect() == []
    assert co.collocations(df.withColumn("text", F.lit(None).cast("string"))).collect() == []


def test_long_texts_are_split_between_words(monkeypatch):
    text = "".join(random.Random(2).choices("ab .\n\té", k=5000)).encode()
    whole = co.Words()
    want = np.concatenate(list(whole.of(text)))
    monkeypatch.setattr(co, "SLICE", 7)
    words = co.Words()
    found = np.concatenate(list(words.of(text)))
    assert [list(words)[i] for i in found] == [list(whole)[i] for i in want]


def test_trie_holds_every_prefix_with_its_count():
    code = np.array([1, 2, 1, 2, 3, 0, 1, 2, 3, 1], np.int32)
    cols, n = co.trie(code, len(code), 3, 3)
    paths = [tuple(int(c[i]) for c in cols if c[i]) for i in range(len(n))]
    assert paths == sorted(paths)
    want = Counter(tuple(code[i : i + k].tolist()) for i in range(len(code)) for k in (1, 2, 3) if i + k <= len(code) and (code[i : i + k] > 0).all())
    assert dict(zip(paths, n.tolist(), strict=True)) == want
