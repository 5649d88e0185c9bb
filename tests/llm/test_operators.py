"""Each operator against a plain version of itself, and on the awkward inputs: nulls, empty and very long texts, ties, repeated rows, no rows, clashing columns."""

import base64
import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from vectorloom.llm import exact_dedup as ed
from vectorloom.llm import gear, license_scan, media, mixing, packing, quality, simhash, substring_dedup, toxicity, warc
from vectorloom.llm.common import connected_components, stored
from vectorloom.llm.queries import tokenizer_path

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
CLASH = ("rid", "h", "n", "fp", "label", "salt", "kept", "norm", "start", "key", "media", "topic", "weight", "body", "payload")


def words(rng, n, size=400):
    return " ".join(f"w{rng.randrange(size)}" for _ in range(n))


def awkward():
    rng = random.Random(1)
    text = words(rng, 300)
    rows = [
        (1, None), (2, ""), (3, " \n\t"), (4, "One"), (5, "two words"), (6, "a b c"), (7, "A B  c"), (None, text), (8, text), (8, text), (9, text + " "),
        (10, words(rng, 20000)), (11, "é" * 5000), (12, "Ünïcode 日本 <|endoftext|> x　y"), (13, "The MIT License, mit license; cc by"), (14, text.replace("w7", "W7")),
    ]
    return [(i, t, "en" if i != 5 else None, "s1" if i != 6 else None, len(t or "")) for i, t in rows]


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame(awkward(), SCHEMA).repartition(3)
    for c in CLASH:
        df = df.withColumn(c, F.lit("clash"))
    return df


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def by_id(rows):
    out = defaultdict(list)
    for r in rows:
        out[r.doc_id].append(r)
    return out


# --- 1 ---------------------------------------------------------------------


def plain_fingerprint(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    s = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_fingerprints(docs):
    for r in simhash.fingerprints(docs).collect():
        texts = {t for i, t, *_ in awkward() if i == r.doc_id}
        assert r.fp % (1 << 64) in {plain_fingerprint(t) for t in texts}


@pytest.mark.parametrize("max_diff,bucket", [(3, 4096), (3, 4), (7, 4096), (7, 16)])
def test_links_are_complete(spark, max_diff, bucket):
    rng = random.Random(max_diff)
    fps = set()
    for _ in range(40):
        f = rng.getrandbits(64)
        for _ in range(12):
            fps.add(f)
            for _ in range(rng.randrange(1, max_diff + 3)):
                f ^= 1 << rng.randrange(64)
    fps |= {0, 1, 3, (1 << 64) - 1} | {i << 40 for i in range(60)}  # one dense bucket
    fps = sorted(fps)
    low = {f: f for f in fps}
    find = lambda x: x if low[x] == x else find(low[x])
    for i, a in enumerate(fps):
        for b in fps[:i]:
            if (a ^ b).bit_count() <= max_diff:
                low[max(find(a), find(b))] = min(find(a), find(b))
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    edges = simhash.fingerprint_edges(spark.createDataFrame([(signed(f),) for f in fps], "fp long").repartition(3), max_diff, bucket)
    found = edges.collect()
    assert all(((r.a ^ r.b) % (1 << 64)).bit_count() <= 64 for r in found)
    got = {f: f for f in fps}
    root = lambda x: x if got[x] == x else root(got[x])
    for r in found:
        a, b = root(r.a % (1 << 64)), root(r.b % (1 << 64))
        got[max(a, b)] = min(a, b)
    assert {f: find(f) for f in fps} == {f: root(f) for f in fps}


def test_simhash_components(docs, empty):
    rows = simhash.simhash_neardup(docs).collect()
    assert len(rows) == len(awkward()) and simhash.simhash_neardup(empty).count() == 0
    fps = {(r.doc_id, r.fingerprint) for r in rows}
    by_fp = defaultdict(set)
    for i, f in fps:
        by_fp[int(f, 16)].add(i)
    near = lambda f: {g for g in by_fp if (f ^ g).bit_count() <= 3}
    for r in rows:
        seen, todo = set(), {int(r.fingerprint, 16)}
        while todo:
            seen |= todo
            todo = set().union(*map(near, todo)) - seen
        assert r.component_id == min(i for f in seen for i in by_fp[f] if i is not None)
    assert {r.component_id for r in rows if r.doc_id in (1, 2, 3)} == {1}


def test_components_of_a_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(7, 7)]
    found = {r.node: r.label for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert set(found[i] for i in range(41)) == {0} and set(found[i] for i in range(100, 160)) == {100}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


# --- 2 ---------------------------------------------------------------------


def test_license_base_matches_plain(docs, empty):
    rows = license_scan.license_scan(docs).collect()
    assert len(rows) == len(awkward()) and license_scan.license_scan(empty).count() == 0
    texts = {i: t for i, t, *_ in awkward()}
    for r in rows:
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), texts[r.doc_id] or ""))
        at = [(i, label) for p, label in license_scan.BASE.items() for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
        assert (r.n_words, r.n_base) == (len(w), len(at))
        assert (r.first_word, r.last_word) == ((min(at)[0], max(at)[0]) if at else (None, None))
        assert r.base_labels == ",".join(sorted({x for _, x in at})) and set(r.base_labels.split(",")) <= set(r.labels.split(","))
        assert 0 <= r.score <= 1


def test_license_notices_with_changed_words(spark):
    whole = "Redistribution and use in source and binary forms, with or without modification, are permitted"
    rows = [(1, whole), (2, whole.replace("forms,", "forms and files,")), (3, "Redistribution and use of knives"), (4, "cc by cc by cc by")]
    found = {r.doc_id: r for r in license_scan.license_scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found[1].labels == "bsd-text" and found[1].score == 1 and found[2].labels == "bsd-text" and 0.75 <= found[2].score < 1
    assert found[3].labels == "" and found[3].score == 0
    assert (found[4].n_base, found[4].first_word, found[4].last_word) == (3, 0, 4)


def test_license_spans_are_verified(spark):
    notice = next(p for p, l in license_scan.NOTICES.items() if l == "bsd-text").split()
    pairs = list(zip(notice, notice[1:]))
    scattered = " ".join(f"{a} {b} junk" for a, b in pairs)
    turned = " ".join(f"{a} {b}" for a, b in reversed(pairs))
    whole = next(p for p, l in license_scan.NOTICES.items() if l == "mit-whole")
    words = whole.split()
    changed = " ".join("other" if i % 25 == 24 else w for i, w in enumerate(words))
    mine = {"you may eat this text on sundays only and never with a spoon": "mine"}
    rows = [(1, scattered), (2, turned), (3, "x " * 30 + whole), (4, changed), (5, " ".join(words[:60])), (6, "so " + next(iter(mine)))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r.doc_id: r for r in license_scan.license_scan(df).collect()}
    assert found[1].score < 0.75 and found[1].labels == "" and found[2].labels == ""
    assert found[3].labels == "mit-text,mit-whole" and found[3].score == 1 and "mit-whole" in found[4].labels
    assert found[5].labels == "mit-text" and found[6].labels == ""  # sixty words are less than the whole
    assert {r.doc_id: r.labels for r in license_scan.license_scan(df, notices=mine).collect()} == {1: "", 2: "", 3: "", 4: "", 5: "", 6: "mine"}


# --- 3 ---------------------------------------------------------------------


@pytest.mark.parametrize("hash_of", [ed.content_hash, lambda t: F.lit("same"), lambda t: F.substring(F.md5(t.cast("binary")), 1, 1)])
def test_exact_dedup_even_with_collisions(docs, empty, hash_of):
    rows = ed.exact_dedup(docs, hash_of=hash_of).collect()
    assert len(rows) == len(awkward()) and ed.exact_dedup(empty).count() == 0
    groups = defaultdict(list)
    for i, t, *_ in awkward():
        groups[re.sub(r"[\x20\x09-\x0D]", "", t or "")].append((-len(t or ""), i is None, i or 0, i))
    best = {hashlib.sha256(k.encode()).hexdigest(): (min(v)[3], len(v)) for k, v in groups.items()}
    for r in rows:
        assert (r.keep_id, r.group_size) == best[r.text_sha256]
    assert Counter(r.text_sha256 for r in rows if r.kept) == Counter(dict.fromkeys(best, 1))


# --- 4 ---------------------------------------------------------------------


def test_gear_is_the_recurrence_and_moves_with_text():
    data = np.random.default_rng(0).integers(0, 256, 5000).astype(np.uint8)
    h, want = 0, []
    for b in data:
        h = ((h << 1) + int(gear.GEAR[b])) % (1 << 32)
        want.append(h)
    assert gear.rolling(data)[31:].tolist() == want[31:]  # full windows
    old, gear._BLOCK = gear._BLOCK, 700
    try:
        blocks = gear.candidates(data, 5)
    finally:
        gear._BLOCK = old
    assert blocks.tolist() == gear.candidates(data, 5).tolist()
    moved = gear.candidates(np.concatenate([np.zeros(13, np.uint8), data]), 5) - 13
    assert set(c for c in gear.candidates(data, 5) if c > 40) == set(c for c in moved if c > 40)


def test_minima_are_those_of_each_place_and_move_with_text():
    data = np.random.default_rng(1).integers(0, 256, 3000).astype(np.uint8)
    h = (gear.rolling(data) << np.uint32(16)).astype(np.int64).tolist()
    want = [p + 1 for p in range(len(h)) if all(h[p] < x for x in h[max(0, p - 12) : p]) and all(h[p] <= x for x in h[p + 1 : p + 13])]
    assert gear.minima(data, 12, 16).tolist() == want and len(want) > 60
    old, gear._BLOCK = gear._BLOCK, 700
    try:
        assert gear.minima(data, 12, 16).tolist() == want
    finally:
        gear._BLOCK = old
    moved = gear.minima(np.concatenate([np.zeros(13, np.uint8), data]), 12, 16) - 13
    assert set(c for c in want if c > 60) == set(c for c in moved.tolist() if c > 60)


TEXTS = (words(random.Random(2), 500), "é" * 3000, "x" * 1000, "日本 " * 300, "".join(chr(0x4E00 + random.Random(i).randrange(3000)) for i in range(900)), "a\u00a0b", "z")


def test_text_chunks_cover_and_keep_characters():
    for text in TEXTS:
        raw = text.encode()
        ends = substring_dedup.text_chunks(raw).tolist()
        assert ends[-1] == len(raw) and ends == sorted(set(ends)) and max(np.diff([0, *ends])) <= substring_dedup.MOST
        assert "".join(raw[s:e].decode() for s, e in zip([0, *ends], ends)) == text
        starts = substring_dedup.word_starts(raw)
        assert [raw[: s].decode() for s in starts.tolist()] == [text[: m.start()] for m in re.finditer(r"[\u4e00-\u9fff]|[^\s\u4e00-\u9fff]+", text)]


def plain_spans(rows, min_words):
    """The spans by sets of bytes: for each row those kept and those gone, as positions."""
    pieces = [list(zip(*(list(x) for x in substring_dedup.text_pieces(t.encode())[:3]))) if t else [] for _, t in rows]
    where = defaultdict(list)
    for r, (i, _) in enumerate(rows):
        for body, s, _ in pieces[r]:
            where[body].append((i is None, i or 0, r, s))
    out = []
    for r, (i, t) in enumerate(rows):
        kept, gone, seen = set(), set(), set()
        for body, s, e in pieces[r]:
            places = where[body]
            if len({x[2] for x in places}) > 1:
                owner = min(places)[:2]
                (kept if (i is None, i or 0) == owner and body not in seen else gone).update(range(s, e))
            seen.add(body)
        starts = substring_dedup.word_starts((t or "").encode())
        both = sorted(kept | gone)
        runs = np.split(both, np.flatnonzero(np.diff(both) != 1) + 1) if both else []
        far = {int(x) for run in runs if ((starts >= run[0]) & (starts <= run[-1])).sum() >= min_words for x in run}
        out.append((kept & far, (gone - kept) & far))
    return out


def test_repeated_spans_match_plain(docs, empty, spark):
    rng = random.Random(3)
    passage, other = words(rng, 55, 10**6), words(rng, 70, 10**6)
    cjk = "".join(chr(0x4E00 + rng.randrange(8000)) for _ in range(600))
    rows = [(i, f"{words(rng, 40, 10**6)} {passage} {words(rng, 30, 10**6)} {other if i % 2 else ''}") for i in range(6)]
    rows += [(10 + i, words(rng, 200, 10**6) + " Licensed under the MIT License.") for i in range(6)]
    rows += [(20, cjk), (21, "一" + cjk), (22, cjk[100:400] + "二" * 50), (23, passage.replace(" ", "\u00a0")), (24, "x" + passage.replace(" ", "\u00a0"))]
    rows += [(30, f"{other} {words(rng, 20, 10**6)} {other}"), (31, passage + " " + other), (31, passage + " " + other), (None, other), (33, "  " + passage.replace(" ", " \n\t")), (40, None), (41, ""), (42, f"{words(rng, 60, 10**6)} " * 2)]
    df = stored(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), "texts")
    found = defaultdict(list)
    for r in substring_dedup.repeated_spans(df).collect():
        found[r.doc_id].append(r)
    want = defaultdict(list)
    for (i, _), spans in zip(rows, plain_spans(rows, substring_dedup.MIN_WORDS)):
        want[i].append(spans)
    for i, spans in want.items():
        cover = lambda kept: Counter(x for r in found[i] if r.kept == kept for x in range(r.start, r.end))  # noqa: B023, E731
        assert cover(True) == sum((Counter(k) for k, _ in spans), Counter()) and cover(False) == sum((Counter(g) for _, g in spans), Counter()), i
    assert {20, 21, 22, 23, 24, 30, 31, 33, None, *range(6)} == {i for i, v in found.items() if v}  # shifted texts without spaces too
    texts = dict(rows[:24])
    assert all(r.n_words == len(texts[i].encode()[: r.end].split()) - len(texts[i].encode()[: r.start].split()) or abs(r.n_words - len(texts[i].encode()[r.start : r.end].split())) <= 2 for i in range(6) for r in found[i])
    clean = defaultdict(list)
    for r in substring_dedup.substring_dedup(df).collect():
        clean[r.doc_id].append(r)
    assert clean[0][0].text == rows[0][1] and all(clean[i][0].removed_bytes > 200 for i in range(1, 6)) and all(clean[10 + i][0].removed_bytes == 0 for i in range(6))
    assert clean[40][0].text is None and clean[41][0].text == "" and clean[42][0].removed_bytes == 0 and clean[21][0].removed_bytes > 1500
    assert substring_dedup.repeated_spans(docs).count() > 0 and substring_dedup.repeated_spans(empty).count() == 0
    assert substring_dedup.substring_dedup(docs).count() == len(awkward())


def test_passages_of_fifty_words_are_found_wherever_they_stand(spark):
    rng = random.Random(13)
    word = lambda: "".join(rng.choice("etaoinshrdlu") for _ in range(max(1, int(rng.gauss(5, 2)))))
    line = lambda n: " ".join(word() for _ in range(n))
    rows = []
    for i in range(600):
        passage = line(50 + i % 11)
        rows += [(2 * i + k, f"{line(rng.randrange(15, 60))} {passage} {line(30)}") for k in range(2)]
    found = substring_dedup.repeated_spans(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    assert {r.doc_id for r in found} == set(range(1200))


# --- 5 ---------------------------------------------------------------------


@pytest.fixture(scope="module")
def judged(spark):
    rng = random.Random(4)
    good = [words(rng, rng.randrange(30, 200), 3000) for _ in range(120)]
    bad = [" ".join(w.upper() + "!!" for w in words(rng, 80, 3000).split()) for _ in range(30)] + [" ".join([words(rng, 1)] * 60) for _ in range(20)]
    rows = [(i, t, "en", "s", len(t), int(i < 120)) for i, t in enumerate(good + bad)]
    df = spark.createDataFrame(rows, SCHEMA + ", q int").repartition(3)
    return df.drop("q"), df.select("doc_id", F.col("q").alias("quality"), F.lit(0).alias("toxic")).where("doc_id % 2 = 0")


def test_quality_keeps_good_and_rejects_bad(judged, docs, empty):
    rows = {r.doc_id: r for r in quality.resample(*judged).collect()}
    assert sum(rows[i].kept for i in range(120)) >= 118 and sum(rows[i].kept for i in range(120, 170)) <= 2
    assert quality.resample(docs, judged[1]).count() == len(awkward()) and quality.resample(empty, judged[1]).count() == 0
    assert all(r.kept for r in quality.resample(docs, judged[1].where("doc_id < 0")).collect())  # no labels
    assert sum(r.kept for r in quality.resample(*judged, k=50).collect()) == 50


def test_quality_is_the_plain_version(judged):
    docs, labels = judged
    rows = {r.doc_id: r for r in quality.resample(docs, labels).collect()}
    fold = {r.doc_id: r.f for r in docs.select("doc_id", quality.fold_of("doc_id").alias("f")).collect()}
    y = {r.doc_id: r.quality for r in labels.collect()}
    grams = quality.Grams()
    bags = {r.doc_id: Counter(grams.of(r.text).tolist()) for r in docs.collect()}
    size = lambda bag: sum(bag.values())
    raw = sum(bags.values(), Counter())
    share = {b: (raw[b] + 0.5) / (size(raw) + 0.5 * quality.BUCKETS) for b in range(quality.BUCKETS)}
    means = {}
    for f in range(quality.FOLDS):
        target = sum((bags[i] for i in y if y[i] == 1 and fold[i] != f), Counter())
        ratio = {b: np.log((target[b] + quality.SMOOTH * share[b]) / (size(target) + quality.SMOOTH)) - np.log(share[b]) for b in raw}
        means |= {i: sum(n * ratio[b] for b, n in bag.items()) / (size(bag) + quality.PRIOR_GRAMS) for i, bag in bags.items() if fold[i] == f}
    slope, offset = quality._logistic(np.array([means[i] for i in sorted(y)]), np.array([y[i] for i in sorted(y)]), sum(y.values()) / len(y))
    weight = {i: slope * m + offset for i, m in means.items()}
    assert all(abs(rows[i].log_weight - w) < 1e-6 for i, w in weight.items())
    # Odds: the slope makes the likelihood of the labels largest, but for a small ridge.
    best = lambda a: sum(np.log1p(np.exp(-(a * weight[i]) if y[i] else a * weight[i])) for i in y)
    assert best(1.0) < best(0.5)
    u = {r.doc_id: r.u for r in docs.selectExpr("doc_id", f"(shiftrightunsigned(xxhash64(doc_id, {quality.SEED}), 11) + 0.5) / {1 << 53}D u").collect()}
    key = {i: w - np.log(-np.log(u[i])) for i, w in weight.items()}
    assert all(abs(rows[i].gumbel_key - k) < 1e-6 for i, k in key.items())
    cut = quality.fit(docs, labels).cut
    k = sum(w >= cut for w in weight.values())
    assert {i for i, r in rows.items() if r.kept} == set(sorted(key, key=key.get)[-k:])


def test_quality_samples_in_proportion_to_the_odds(spark):
    # With a high temperature all weights are alike, and the noise alone decides.
    rng = random.Random(15)
    rows = [(i, words(rng, 60, 500) if i % 2 else words(rng, 60, 500).upper()) for i in range(2000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(0, 2000, 7)], "doc_id long, quality int")
    odd = lambda t: sum(r.doc_id % 2 for r in quality.resample(df, labels, k=1000, temperature=t).where("kept").collect())
    assert odd(1.0) > 990 and 420 < odd(1e6) < 580


def test_gram_counts_are_sums(judged):
    grams, total = quality.Grams(), np.zeros(quality.BUCKETS, np.int64)
    for r in judged[0].collect():
        total += np.bincount(grams.of(r.text), minlength=quality.BUCKETS)
    assert np.array_equal(quality.gram_counts(judged[0]), total)


def test_kth_largest(spark):
    rng = random.Random(5)
    values = [rng.choice([rng.gauss(0, 1), 1.5, -3e8, rng.random() * 1e-9]) for _ in range(500)]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    for k in (1, 7, 130, 499):
        assert quality.kth_largest(df, "v", k, bins=8) == sorted(values)[-k]
    assert quality.kth_largest(df, "v", 500) == -np.inf and quality.kth_largest(df, "v", 0) == np.inf


# --- 6 ---------------------------------------------------------------------


def test_toxicity_finds_misspellings_and_holds_out(spark, docs, empty):
    rng = random.Random(6)
    rows = []
    for i in range(600):
        w, toxic = words(rng, 60, 2000).split(), i % 4 == 0
        if toxic:
            for _ in range(4):
                w[rng.randrange(60)] = rng.choice(["stupidest", "stupido", "xstupid"]) if i % 8 else "stupid"
        rows.append((i, " ".join(w), int(toxic)))
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int").repartition(2)
    found = {r.doc_id: r for r in toxicity.toxicity(df.drop("toxic"), df.select("doc_id", "toxic")).collect()}
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) and r.predicted == (r.score >= 0.3) for i, r in found.items())
    held = [(found[i].predicted, y) for i, _, y in rows if found[i].held_out]
    assert sum(p == y for p, y in held) / len(held) > 0.95
    labels = df.select("doc_id", "toxic")
    odd = toxicity.toxicity(docs, labels.union(spark.createDataFrame([(1, None), (None, 1)], "doc_id long, toxic int"))).collect()
    assert len(odd) == len(awkward()) and all(0 <= r.score <= 1 for r in odd) and len({r.score for r in odd if r.doc_id in (1, 2, 3)}) == 1
    assert toxicity.toxicity(empty, labels).count() == 0
    assert {r.score for r in toxicity.toxicity(docs, labels.where("toxic = 0")).collect()} == {0.0}


def test_toxicity_prior_is_that_of_all_labels(spark, monkeypatch):
    rows = [(i, "stupid thing" if i % 10 == 0 else "fine thing", int(i % 10 == 0)) for i in range(1000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    used = []
    monkeypatch.setattr(toxicity, "train", lambda texts, labels, prior=None: used.append((len(labels), prior)))
    for fit_rows in (20, 2000):
        toxicity.fit(df, df, fit_rows=fit_rows)
    seen = [y for i, _, y in rows if zlib.crc32(str(i).encode()) % 4 != 2]
    assert used == [(40, sum(seen) / len(seen)), (len(seen), sum(seen) / len(seen))]


def _plain_bag(text: str) -> dict[int, float]:
    found = [g for w in set(re.findall(r"[^\W_]+", text.lower())) for g in [f"<{w}>"[i : i + n] for n in (3, 4, 5) for i in range(len(w) + 3 - n)] + [f"<{w}>"]]
    out: dict[int, float] = {}
    for g in found:
        at = zlib.crc32(g.encode()) % toxicity.BUCKETS
        out[at] = out.get(at, 0) + 1 / len(found)
    return out


def test_toxicity_training_is_the_plain_one(monkeypatch):
    monkeypatch.setattr(toxicity, "BUCKETS", 256)
    rng = random.Random(9)
    labels = [int(i % 3 == 0) for i in range(300)]
    texts = [words(rng, 8, 40) + " Vile" * y for y in labels]
    maker = toxicity.Bags()
    logit, bias = toxicity.train([maker.of(t) for t in texts], labels, epochs=2)
    bags, draw = [_plain_bag(t) for t in texts], np.random.default_rng(toxicity.SEED)
    E, W, b = draw.normal(0, 0.01, (256, toxicity.DIM)), draw.normal(0, 1.0, (toxicity.DIM, 2)), np.zeros(2)
    hidden = lambda bag: sum(v * E[g] for g, v in bag.items()) * toxicity.SCALE
    rows = np.array([i for i in range(300) if i % 5])
    share = [np.mean([labels[i] == c for i in rows]) for c in (0, 1)]
    pace, step = [[0.0, 0.0] for _ in range(3)], 0
    for _ in range(2):
        draw.shuffle(rows)
        for lot in np.array_split(rows, max(1, len(rows) // toxicity.BATCH)):
            step += 1
            grads = [toxicity.DECAY * E, toxicity.DECAY * W, np.zeros(2)]
            for i in lot:
                p = np.exp(hidden(bags[i]) @ W + b)
                d = (p / p.sum() - np.eye(2)[labels[i]]) * 0.5 / share[labels[i]] / len(lot)
                grads[1] = grads[1] + np.outer(hidden(bags[i]), d)
                grads[2] = grads[2] + d
                for g, v in bags[i].items():
                    grads[0][g] += v * (W @ d) * toxicity.SCALE
            for param, grad, m in zip((E, W, b), grads, pace, strict=True):
                m[0], m[1] = 0.9 * m[0] + 0.1 * grad, 0.98 * m[1] + 0.02 * (grad**2).sum()
                param -= toxicity.RATE * m[0] / (1 - 0.9**step) / (np.sqrt(m[1] / (1 - 0.98**step)) + 1e-12)
    z = np.array([hidden(bag) @ (W[:, 1] - W[:, 0]) for bag in bags]) + b[1] - b[0]
    slope, offset = toxicity._calibrated(z[::5], np.array(labels[::5]), float(np.mean(labels)))
    plain = [1 / (1 + np.exp(-(v * slope + offset))) for v in z]
    scorer = toxicity.Scorer(logit, bias)
    assert np.allclose([scorer.of(t) for t in texts], plain, atol=1e-3) and np.std(plain) > 0.1
    none = 1 / (1 + np.exp(-((b[1] - b[0]) * slope + offset)))
    assert abs(scorer.of("") - none) < 1e-3 and abs(scorer.of("?! ...") - none) < 1e-3


def test_toxicity_calibration_is_where_the_gradient_ends():
    rng = np.random.default_rng(4)
    z, y = rng.normal(0, 3, 200), rng.integers(0, 2, 200)
    slope, offset = toxicity._calibrated(z, y, 0.2)
    w = np.where(y == 1, 0.2 / (y == 1).sum(), 0.8 / (y == 0).sum())
    off = w * (1 / (1 + np.exp(-(slope * z + offset))) - y)
    top = np.abs(z).max()
    assert abs(off.sum() + 1e-5 * offset) < 1e-8 and abs((off * z / top).sum() + 1e-5 * slope * top) < 1e-8


@pytest.mark.parametrize("flip", [False, True])
def test_models_take_the_least_text_of_a_repeated_id(spark, flip):
    rows = [(i, t) for i in range(80) for t in ((f"vile thing {i % 7}" if i % 2 else f"fine thing {i % 7}"), f"zzz {i}")]
    docs = spark.createDataFrame(rows[::-1] if flip else rows, "doc_id long, text string")
    least = spark.createDataFrame([r for r in rows if not r[1].startswith("zzz")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(80)], "doc_id long, y int")
    assert all(np.array_equal(a, b) for a, b in zip(toxicity.fit(docs, labels, label_col="y"), toxicity.fit(least, labels, label_col="y"), strict=True))
    kept = quality._labelled(docs, labels, "doc_id", "y", 100)[0]
    assert {(r.doc_id, r.text) for r in kept.collect()} == {(r.doc_id, r.text) for r in least.collect()}


# --- 7 ---------------------------------------------------------------------


def test_warc_round_trip(spark):
    rng = random.Random(7)
    htmls = [None, "", "", "<p>é\r\n\r\nWARC/1.1\r\n</p>", "x" * 3_000_000] + [words(rng, 50) for _ in range(30)]
    rows = [(i, rng.choice([None, "", "http://a.example.com/b?x=1", "https://www.Example.com:8443/p\nq", "http://[bad"]), htmls[i % len(htmls)]) for i in range(90)]
    rows += [(None, "http://a.example.com/", htmls[6]), (89, *rows[89][1:])]
    df = stored(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4).withColumns({c: F.lit(1) for c in ("sha", "date", "run", "rid", "doc_id", "n", "word", "bits")}), "pages")
    found = warc.capture_history(df).collect()
    assert len(found) == len(rows)
    last = defaultdict(list)
    for i, _, h in rows:
        last[h or ""].append(i)
    text = {i: h or "" for i, _, h in rows}
    for r in found:
        p = text[r.page_id]
        top = max(x for x in last[p] if x is not None)
        assert (r.payload_bytes, r.payload_digest) == (len(p.encode()), base64.b32encode(hashlib.sha1(p.encode()).digest()).decode())
        assert (r.record_type, r.refers_to) == (("response", None) if r.page_id == top else ("revisit", top))
    keys = [(r.url_key, r.warc_date, r.page_id is not None, r.page_id or 0) for r in found]
    assert keys == sorted(keys)  # ranges in order, rows in order
    assert all(r.record_type == "response" for r in warc.capture_history(df, min_bytes=10**9).collect())
    assert warc.capture_history(df.where("page_id < 0")).count() == 0
    lists = warc.write_warcs(df, records=7).collect()  # archives are rolled
    assert sum(r.records for r in lists) == len(rows) and max(r.records for r in lists) == 7


def test_loser_tree_merges():
    rng = random.Random(8)
    for k in (0, 1, 2, 3, 7, 8):
        runs = [sorted(rng.randrange(50) for _ in range(rng.randrange(20))) for _ in range(k)]
        assert list(warc.LoserTree(runs, key=lambda x: x)) == sorted(x for r in runs for x in r)


# --- 8 ---------------------------------------------------------------------


def test_raking_meets_targets(spark, docs, empty):
    rng = random.Random(9)
    cells = spark.createDataFrame([(s, l, t, rng.randrange(500, 1000)) for s in "abc" for l in "xy" for t in "pq"], "source string, lang string, topic string, tokens long")
    aim = {"source": {"a": 0.2, "b": 0.5, "c": 0.3}, "lang": {"x": 0.6, "y": 0.4}, "topic": {"p": 0.7, "q": 0.3}}
    raked = mixing.rake(cells, {d: spark.createDataFrame(list(v.items()), "value string, target double") for d, v in aim.items()}, keep=0.3)
    total = 0.3 * cells.agg(F.sum("tokens")).first()[0]
    assert raked.where("weight > tokens").count() == 0
    for d, want in aim.items():
        assert all(abs(r[1] / total / want[r[0]] - 1) <= mixing.TOLERANCE for r in raked.groupBy(d).agg(F.sum("weight")).collect())
    rows = by_id(mixing.mix(docs).collect())
    assert sum(map(len, rows.values())) == len(awkward()) and all(0 <= r.probability <= 1 for v in rows.values() for r in v)
    assert rows[5][0].lang == "(none)" and rows[6][0].source == "(none)" and len({r.kept for r in rows[8]}) == 1
    assert mixing.mix(empty).count() == 0 and mixing.achieved(mixing.mix(empty)).count() == 0


def test_mix_meets_the_targets_within_supply(spark):
    rng = random.Random(14)
    rows = [(i, words(rng, 20), rng.choice("aaab"), rng.choice("xxxxxxxxxy"), rng.choice("p" * 30 + "q")) for i in range(6000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, t string")
    mixed = mixing.mix(df, source_col="source", lang_col="lang", topic_col="t")
    found = mixed.collect()
    assert len(found) == len(rows) and all(0 <= r.probability <= 1 for r in found)
    expected, supply = sum(r.probability * r.n_tokens for r in found), sum(r.n_tokens for r in found)
    assert abs(expected / supply - 0.8) < 0.002
    short = set()
    for d in mixing.DIMS:
        had, got, kept = Counter(), Counter(), Counter()
        for r in found:
            had[r[d]] += r.n_tokens
            got[r[d]] += r.probability * r.n_tokens
            kept[r[d]] += r.kept * r.n_tokens
        powered = {v: n**mixing.ALPHA for v, n in had.items()}
        short |= {v for v in powered if 0.8 * powered[v] / sum(powered.values()) > had[v] / supply}
        assert all(got[v] > 0.995 * had[v] for v in short & set(powered))
        over = [got[v] / powered[v] for v in powered if v not in short]
        assert max(over) / min(over) < 1.005
        for r in mixing.achieved(mixed).where(F.col("dimension") == d).collect():
            assert abs(r.supply - had[r.value] / supply) < 1e-9 and abs(r.target - powered[r.value] / sum(powered.values())) < 1e-9
            assert abs(r.expected - got[r.value] / sum(got.values())) < 1e-9 and abs(r.kept - kept[r.value] / sum(kept.values())) < 1e-9
            assert abs(r.kept - r.expected) < 0.02
    assert "q" in short


# --- 9 ---------------------------------------------------------------------


def test_media_round_trip(spark, docs, empty):
    rng = random.Random(10)
    shared = words(rng, 3000)
    rows = awkward() + [(100 + i, words(rng, 200) + " " + shared + " " + words(rng, 200), "en", "s", 0) for i in range(4)] + [(200, "ab" * 40000, "en", "s", 0)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    kept, store = media.store_media(df)
    found = media.read_media(store, with_file=True)
    joined = by_id(kept.join(found, "media").collect())
    for i, t, *_ in rows:
        raw = (t or "").encode()
        p = media.padded(raw)
        for r in joined[i]:
            assert r.n_bytes in {len((x or "").encode()) for j, x, *_ in rows if j == i} and r.wav[44:] in {media.padded((x or "").encode()) for j, x, *_ in rows if j == i}
        r = next(r for r in joined[i] if r.n_bytes == len(raw))
        assert (r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:])) and len(p) % 64 == 0 < len(p)
        assert (r.media_bytes, r.media_sha256) == (len(r.wav), hashlib.sha256(r.wav).hexdigest())
    chunks = store.where("kind = 'chunk'").collect()
    assert chunks and len({r.media for r in chunks}) == len(chunks)  # lent chunks are stored once
    assert store.where("kind = 'medium'").count() == len({media.padded((t or "").encode()) for _, t, *_ in rows})
    assert media.media_columns(docs).count() == len(awkward()) and media.media_columns(empty).count() == 0


# --- 10 --------------------------------------------------------------------


def test_ids_are_those_of_the_whole_text():
    ids = packing.Ids(tokenizer_path())
    rng = random.Random(11)
    signs = "aAbB .,'sSéÉßẞ0123<|>ıİΣς́ﬁ中 \t　-_'re²\x1c"
    for text in [t or "" for _, t, *_ in awkward()] + ["".join(rng.choice(signs) for _ in range(rng.randrange(40))) for _ in range(1500)]:
        assert ids.text(text) == ids.whole(text)


def test_packing_is_gapless_and_whole(docs, empty):
    rows = packing.pack(docs, tokenizer_path(), size=64, most_open=4, with_ids=True).collect()
    assert packing.pack(empty, tokenizer_path()).count() == 0
    of, texts = packing.Ids(tokenizer_path()), defaultdict(list)
    for i, t, *_ in awkward():
        texts[i].append(of.whole(t or "") + (1).to_bytes(4, "little"))
    assert sorted((r.doc_id or 0, r.ids) for r in rows) == sorted((i or 0, ids[k : k + 256]) for i, v in texts.items() for ids in v for k in range(0, len(ids), 256))
    by_seq = defaultdict(list)
    for r in rows:
        assert len(r.ids) == 4 * r.length <= 256 and r.ids_crc32 == zlib.crc32(r.ids) and r.start == 64 * r.piece
        by_seq[r.sequence_id].append((r.offset, r.length))
    for places in by_seq.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 64


def test_packing_does_not_depend_on_the_order_of_rows(spark):
    rng = random.Random(16)
    df = spark.createDataFrame([(i, words(rng, rng.randrange(1, 90))) for i in range(300)], "doc_id long, text string")
    key = lambda d: sorted((r.doc_id, r.piece, r.sequence_id, r.offset) for r in packing.pack(d, tokenizer_path(), size=64, most_open=4).collect())
    assert key(df.coalesce(1).orderBy("doc_id")) == key(df.coalesce(1).orderBy(F.desc("doc_id")))


def plain_features(samples):
    x = [b - 128 for b in samples]
    sign = [-1 if v < 0 else 1 for v in x]
    n = len(x)
    return f"n={n};mean={sum(x) / n:.6f};rms={(sum(v * v for v in x) / n) ** 0.5:.6f};peak={max(map(abs, x))};zero={sum(v == -128 for v in x)};crossings={sum(a != b for a, b in zip(sign, sign[1:]))}"


def test_media_features_are_the_plain_ones():
    rng = random.Random(17)
    for n in (64, 1000, 5000):
        data = bytes(rng.randrange(256) for _ in range(n))
        assert media.features(data) == plain_features(data)
    file = media.wav_file(b"ab" * 32)
    assert media.wav_samples(file) == b"ab" * 32
    for bad in (file[:-1], file + b"x", b"RIFX" + file[4:]):
        with pytest.raises(ValueError):
            media.wav_samples(bad)


def test_best_fit_takes_the_tightest_and_closes_the_fullest():
    b = packing.BestFit(10, 2)
    assert [b.place(n) for n in (6, 7, 3, 4)] == [(0, 0), (1, 0), (1, 7), (0, 6)]
    b = packing.BestFit(10, 2)
    assert [b.place(n) for n in (6, 7, 8, 4)] == [(0, 0), (1, 0), (2, 0), (0, 6)]  # bin 1, the fuller, closes for bin 2
    rng = random.Random(12)
    sizes = [rng.randrange(1, 4096) // rng.choice([1, 4, 16]) + 1 for _ in range(4000)]
    b = packing.BestFit()
    for n in sizes:
        b.place(min(n, 4096))
    assert b.bins <= 1.02 * sum(sizes) / 4096 + 1
