"""The divergence audit against plain arithmetic, with cells small enough that blocks travel."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from vectorloom.llm import divergence as dv

SCHEMA = "doc_id long, text string, lang string, source string, value string, block string, id string"


def corpus(n=260, seed=9):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        lang, source = rng.choice(["en", "en", "de"]), f"s{rng.randrange(7)}"
        own = [f"{source[1:] * 0}{chr(97 + int(source[1:]))}{chr(97 + k)}" for k in range(4)]
        words = rng.choices(["the", "The", "of", "été", "日本"] + own, k=rng.randrange(30))
        rows.append((i, " 1,".join(words), lang, source))
    rows += [(900, None, "en", "silent"), (901, "", None, None), (902, "the", None, "s1"), (903, "12 34", "zz", "a"), (904, "", "zz", "b"), (905, "the " * 50_000, "en", "s1"), (905, "x", "en", "s1"), (905, "x", "en", "s1")]
    return rows


def plain(rows, min_docs, top):
    count, docs = defaultdict(Counter), defaultdict(Counter)
    for _, text, lang, source in rows:
        terms = [re.sub("[A-Z]", lambda m: m[0].lower(), t) for t in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text or "")]
        count[lang or "", source or ""].update(terms)
        docs[lang or ""].update(set(terms))
    out = []
    for lang in docs:
        kept = sorted((t for t, d in docs[lang].items() if d >= min_docs), key=str.encode)
        groups = {s: c for (x, s), c in count.items() if x == lang}
        share = lambda c: (lambda total: {t: 1 + 10**9 * (c[t] + 5) // (total + 5 * len(kept)) for t in kept})(sum(c[t] for t in kept))  # noqa: E731, B023
        q, p = share(sum(groups.values(), Counter())), {s: share(c) for s, c in groups.items()}
        for s in groups:
            pairs = sorted((-sum(abs(p[s][t] - p[o][t]) for t in kept), o.encode()) for o in groups if o != s)
            terms = sorted((q[t] - p[s][t], t.encode()) for t in kept if groups[s][t] and p[s][t] > q[t])[:top]
            out += [(lang, s, part, item.decode(), -v, i + 1) for part, x in (("pair", pairs), ("term", terms)) for i, (v, item) in enumerate(x)]
    return sorted(out)


@pytest.mark.parametrize("terms, groups", [(dv.SLICE_TERMS, dv.BLOCK_GROUPS), (3, 1), (5, 2)])
def test_equals_plain_arithmetic(spark, terms, groups):
    rows = corpus()
    df = spark.createDataFrame([(*r, "x", "x", "x") for r in rows], SCHEMA).repartition(4)
    found = dv.divergence(df, min_docs=8, top=3, slice_terms=terms, block_groups=groups)
    assert found.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert sorted(map(tuple, found.collect())) == plain(rows, 8, 3)


def test_no_kept_terms_and_empty(spark):
    df = spark.createDataFrame([(1, "a", "en", "s", "", "", ""), (2, "b", "en", None, "", "", "")], SCHEMA)
    assert sorted(map(tuple, dv.divergence(df).collect())) == [("en", "", "pair", "s", 0, 1), ("en", "s", "pair", "", 0, 1)]
    assert dv.divergence(df.where("false")).collect() == []


@pytest.mark.parametrize("blocks", range(2, 10))
def test_every_two_blocks_meet_once(spark, blocks):
    met = []
    for turn in range(blocks + blocks % 2 - 1):
        rows = spark.range(blocks).select(F.col("id").cast("int").alias("block")).withColumn("to", dv.partner(F.col("block"), F.lit(blocks), turn)).collect()
        to = {r.block: r.to for r in rows}
        assert all(to[to[b]] == b for b in to)
        met += [(b, t) for b, t in to.items() if b < t]
    assert sorted(met) == [(a, b) for a in range(blocks) for b in range(a + 1, blocks)]


def test_shares_beyond_64_bits():
    counts = np.array([0, 7, 10**13], np.int64)
    assert dv.shares(counts, 10**13 + 7, 3).tolist() == [1 + 10**9 * (int(c) + 5) // (10**13 + 7 + 15) for c in counts]


def test_tasks_hand_on_their_counts(spark):
    rows = spark.createDataFrame([("en", "s", b"a b b"), ("en", "s", b"A c"), ("en", "t", b"a")], "lang string, source string, text binary").coalesce(1)
    found = {tuple(r) for r in dv.term_counts(rows, held=1).collect()}
    assert found == {("en", "s", "a", 2, 2), ("en", "s", "b", 2, 1), ("en", "s", "c", 1, 1), ("en", "t", "a", 1, 1)}
