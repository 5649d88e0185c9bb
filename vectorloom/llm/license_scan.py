"""License scans by diagonal voting. DataFrame operations only.

Every text is cut into words; the hashes of all its rolling word pairs are joined
to the positions of the same pairs in a list of templates, which is a parameter. A hit at
word position p of the text and t of the template votes for the diagonal p - t. A base
phrase stands where one diagonal has the votes of all its pairs. Notices may differ by a
few words: the votes of a diagonal and of those at most SLACK above it are merged, so a
span drifts by SLACK words at most and is at most that much longer than its template. The
merged span is verified: its hits, whose words are compared themselves and not only their
hashes, must stand in the order of the template. It is accepted if such a chain covers
COVERAGE of the template's voting pairs. Pairs of two very common words do not vote.

Votes are lists of template positions, as long as the template at most. The only broadcast
is the template table, whose size is that of the list given. Each text yields one extra row
with its word count, so that one pass over the texts gives both hits and counts.

Defined results: null and empty texts have n_words 0, n_base 0, null positions,
empty labels and score 0; long texts are scanned whole, one array of words for a text;
a table without rows gives none; repeated rows are counted each on its own; spans of equal
share all count; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import ascii_lower, stored, unique_rows

#: All bytes of ASCII but 0-9 and letters separate words; fixed by the contract.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

# Base phrases and their labels.
BASE = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
# Opening words and whole texts of common notices, and the labels of the method itself.
NOTICES = {
    "licensed under the apache license version 2 0": "apache-2.0",
    "this work is licensed under the gnu general public license version 3": "gpl-3.0",
    "released under the mit license": "mit",
    "licensed under cc by nc 4 0": "cc-by-nc",
    "licensed under cc by sa 4 0": "cc-by-sa",
    "permission is hereby granted free of charge to any person obtaining a copy of this software": "mit-text",
    "redistribution and use in source and binary forms with or without modification are permitted": "bsd-text",
    "this program is free software you can redistribute it and or modify it under the terms": "gpl-text",
    "subject to the terms of the mozilla public license": "mpl",
    "all rights reserved no part of this publication may be reproduced": "proprietary",
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software": "mit-whole",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution": "bsd-whole",
    "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0 unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license": "apache-2.0-whole",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license for more details": "gpl-3.0-whole",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies": "isc-whole",
}
# Words so common that a pair of two of them says nothing of a notice.
COMMON = ("a", "and", "any", "at", "by", "for", "in", "is", "of", "or", "the", "this", "to", "with")
SLACK, COVERAGE = 2, 0.75
#: A pair no text can hold, for the row that carries the word count.
_COUNT_ROW = -1


def _values(spark, rows: list[tuple], names: str) -> DataFrame:
    """A literal table; its strings hold letters, digits, points and hyphens only."""
    return spark.sql(f"SELECT * FROM VALUES {', '.join(map(repr, rows))} AS t({names})")


def _listed(notices: dict[str, str]) -> tuple[list[tuple], list[tuple]]:
    """(word a, word b, template, position) of voting pairs; (template, label, base, number of voting pairs)."""
    pairs, heads = [], []
    for i, (phrase, label, base) in enumerate([(p, l, True) for p, l in BASE.items()] + [(p, l, False) for p, l in notices.items()]):
        words = phrase.split(" ")
        own = [(a, b, i, t) for t, (a, b) in enumerate(zip(words, words[1:])) if base or not (a in COMMON and b in COMMON)]
        pairs += own
        heads.append((i, label, base, len(own)))
    return pairs, heads


def _templates(spark, notices: dict[str, str]) -> tuple[DataFrame, DataFrame]:
    """(pairs with their positions, one row per template)."""
    listed, heads = _listed(notices)
    pairs = _values(spark, [(0, "", "", _COUNT_ROW, 0)] + [(1, *row) for row in listed], "kind, a, b, template, t")
    pairs = pairs.select(F.when(F.col("kind") == 0, F.lit(0)).otherwise(F.xxhash64("a", "b")).cast("long").alias("h"), F.col("a").alias("ta"), F.col("b").alias("tb"), "template", "t")
    return pairs, _values(spark, heads, "template, label, base, n_pairs")


def license_hits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", notices: dict[str, str] = NOTICES) -> DataFrame:
    """One row per text (template -1, with n_words) and one per verified pair hit: doc_id, rid, n_words, template, p, t."""
    pairs, _ = _templates(docs.sparkSession, notices)
    words = F.filter(F.split(ascii_lower(F.coalesce(F.col(text_col), F.lit(""))), SEPARATORS), lambda w: w != "")
    texts = unique_rows(docs, id_col, text_col).select("doc_id", "rid", words.alias("w")).withColumn("n_words", F.size("w").cast("long"))
    empty = F.array(F.struct(F.lit(0).cast("long").alias("h"), F.lit("").alias("a"), F.lit("").alias("b")))
    rolling = F.zip_with(
        F.slice("w", 1, F.greatest(F.size("w") - 1, F.lit(0))),
        F.slice("w", 2, F.greatest(F.size("w") - 1, F.lit(0))),
        lambda a, b: F.struct(F.xxhash64(a, b).alias("h"), a.alias("a"), b.alias("b")),
    )
    # explode, not explode_outer: the leading row is always there.
    found = texts.select("doc_id", "rid", "n_words", F.posexplode(F.concat(empty, rolling)).alias("p", "g"))
    flat = found.select("doc_id", "rid", "n_words", (F.col("p") - 1).alias("p"), F.col("g.h").alias("h"), F.col("g.a").alias("a"), F.col("g.b").alias("b"))
    return flat.join(F.broadcast(pairs), "h").where("a = ta and b = tb").select("doc_id", "rid", "n_words", "template", F.col("p").cast("long").alias("p"), "t")


def license_spans(hits: DataFrame, notices: dict[str, str] = NOTICES) -> DataFrame:
    """Accepted spans: doc_id, rid, template, label, base, start (their diagonal), share of the template's voting pairs."""
    _, heads = _templates(hits.sparkSession, notices)
    key = ["doc_id", "rid", "template"]
    votes = hits.where(F.col("template") >= 0).groupBy(*key, (F.col("p") - F.col("t")).alias("diagonal")).agg(F.collect_list("t").alias("ts"))  # as many as the template has pairs
    votes = votes.join(F.broadcast(heads), "template")
    exact = votes.where("base").select(*key, "label", "base", F.col("diagonal").alias("start"), (F.size("ts") / F.col("n_pairs")).alias("share")).where("share = 1")
    near = Window.partitionBy(*key).orderBy("diagonal").rangeBetween(0, SLACK)
    hit = F.transform("ts", lambda t: F.struct(t.cast("long").alias("t"), (t + F.col("diagonal")).alias("p")))
    merged = votes.where("not base").withColumn("hits", F.sort_array(F.flatten(F.collect_list(hit).over(near))))  # SLACK + 1 lists at most
    none = F.struct(F.lit(-1).cast("long").alias("t"), F.lit(-1).cast("long").alias("p"), F.lit(0).alias("n"))
    chain = F.aggregate("hits", none, lambda last, h: F.when((h["t"] > last["t"]) & (h["p"] > last["p"]), F.struct(h["t"].alias("t"), h["p"].alias("p"), (last["n"] + 1).alias("n"))).otherwise(last), lambda last: last["n"])
    found = merged.select(*key, "label", "base", F.col("diagonal").alias("start"), (chain / F.col("n_pairs")).alias("share")).where(F.col("share") >= COVERAGE)
    return exact.unionByName(found)


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", notices: dict[str, str] = NOTICES) -> DataFrame:
    """One row per text: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    notices: words in lower case, parted by one space, and their labels (letters, digits, points and hyphens).
    score is the best accepted share of a template's voting pairs, 1 for a base phrase.
    """
    hits = stored(license_hits(docs, id_col, text_col, notices), "license-hits")  # read twice, made once
    spans = license_spans(hits, notices)
    counts = hits.where(F.col("template") == _COUNT_ROW).select("doc_id", "rid", "n_words", *[F.lit(None).cast(t).alias(c) for c, t in (("label", "string"), ("base", "boolean"), ("start", "long"), ("share", "double"))])
    both = counts.unionByName(spans.select("doc_id", "rid", F.lit(None).cast("long").alias("n_words"), "label", "base", "start", "share"))
    labels = lambda c: F.array_join(F.sort_array(F.collect_set(c)), ",")  # noqa: E731  a set of the list's labels
    return both.groupBy("doc_id", "rid").agg(
        F.max("n_words").alias("n_words"),
        F.count_if("base").alias("n_base"),
        F.min(F.when(F.col("base"), F.col("start"))).alias("first_word"),
        F.max(F.when(F.col("base"), F.col("start"))).alias("last_word"),
        labels(F.when(F.col("base"), F.col("label"))).alias("base_labels"),
        labels("label").alias("labels"),
        F.coalesce(F.max("share"), F.lit(0.0)).alias("score"),
    ).drop("rid")


def license_sql(notices: dict[str, str] = NOTICES) -> str:
    """The same in DuckDB SQL over a table documents."""
    pairs, heads = _listed(notices)
    values = lambda x: ", ".join(map(repr, x))
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    step = "CASE WHEN h.t > s.t AND h.p > s.p THEN {'t': h.t, 'p': h.p, 'n': s.n + 1} ELSE s END"
    return rf"""
        WITH t AS (SELECT doc_id, row_number() OVER () AS rid, list_filter(string_split_regex(translate(coalesce(text, ''), '{upper}', '{upper.lower()}'), '{SEPARATORS}'), lambda x: x <> '') AS w FROM documents),
        pairs(a, b, template, t) AS (VALUES {values(pairs)}),
        heads(template, label, base, n_pairs) AS (VALUES {values(heads)}),
        g AS (SELECT rid, p1 - 1 AS p, w[p1] AS a, w[p1 + 1] AS b FROM (SELECT rid, w, unnest(range(1, len(w))) AS p1 FROM t)),
        d AS (SELECT rid, template, p - t AS diagonal, list({{'t': t::BIGINT, 'p': p::BIGINT, 'n': 0::BIGINT}}) AS hits FROM g JOIN pairs USING (a, b) GROUP BY ALL),
        h AS (SELECT * FROM d JOIN heads USING (template)),
        e AS (SELECT rid, label, base, diagonal AS start, 1.0::DOUBLE AS share FROM h WHERE base AND len(hits) = n_pairs),
        m AS (SELECT rid, label, base, diagonal AS start, n_pairs, list_sort(flatten(list(hits) OVER (PARTITION BY rid, template ORDER BY diagonal RANGE BETWEEN CURRENT ROW AND {SLACK} FOLLOWING))) AS hits FROM h WHERE NOT base),
        n AS (SELECT rid, label, base, start, list_reduce(list_prepend({{'t': -1::BIGINT, 'p': -1::BIGINT, 'n': 0::BIGINT}}, hits), lambda s, h: {step}).n / n_pairs::DOUBLE AS share FROM m),
        s AS (SELECT rid, count(*) FILTER (base) AS n_base, min(start) FILTER (base) AS first_word, max(start) FILTER (base) AS last_word, array_to_string(list_sort(list_distinct(list(label) FILTER (base))), ',') AS base_labels, array_to_string(list_sort(list_distinct(list(label))), ',') AS labels, max(share) AS score FROM (SELECT * FROM e UNION ALL SELECT * FROM n WHERE share >= {COVERAGE}) GROUP BY rid)
        SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0.0) AS score
        FROM t LEFT JOIN s USING (rid)"""
