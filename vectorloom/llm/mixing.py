"""Mixing sources to target weights by iterative proportional fitting. DataFrame operations only.

Tokens (words between ASCII white space) are summed in cells of source, language
and topic. Raking multiplies the cells' expected tokens so that the marginals of source,
language and topic match their targets in turn, each cell bounded by its supply: nothing
is repeated. All together are the share KEEP of the tokens. A value whose supply is short
of its target gives all it has, and the others of its dimension share the rest by their
targets, so what is missed is missed for want of supply only; `achieved` reports both.
Lots of ROUNDS rounds go on until every marginal is within TOLERANCE, until a lot
improves on the last by less than a hundredth, or for LOTS lots.

A document's probability is its cell's expected tokens over its supply, and it stays if a
hash of its id falls under it. Targets default to shares raised to ALPHA, which flattens
large sources. The cells are a table like any other, and each step is a sum over those
that share a value: a window over cells, which are one row per source, language and topic
whatever the number of documents, and which spills. Without a topic column, the topic is
the register of the whole text: table, shout, symbols, numbers or prose.

Defined results: null source, language and topic are cells of their own (written
as (none)); null texts count as empty and, like all texts without words, have
no tokens: they stay with their cell's probability, or always where a cell has no tokens;
long texts are counted whole; repeated rows stay or go together; a null id is
hashed as such; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import settled, stored

ALPHA, ROUNDS, KEEP = 0.85, 5, 0.8
#: Share of a target that its marginal may be off, lots of ROUNDS rounds at most, steps of lifting targets.
TOLERANCE, LOTS, FILLS = 0.002, 8, 50
DIMS = ("source", "lang", "topic")


def n_tokens(text: Column) -> Column:
    """Words between runs of ASCII white space."""
    return F.size(F.filter(F.split(text, "[\\x20\\x09-\\x0D]+"), lambda w: w != "")).cast("long")


def register(text: Column) -> Column:
    """Topic of the whole text by its signs: the first that holds of table, shout, symbols, numbers, else prose."""
    chars = F.greatest(F.char_length(text), F.lit(1))
    share = lambda signs: (F.char_length(text) - F.char_length(F.translate(text, signs, ""))) / chars
    return (
        F.when(share("|") > 0.02, "table")
        .when(share("ABCDEFGHIJKLMNOPQRSTUVWXYZ") > 0.3, "shout")
        .when(share("%$#*&!") > 0.05, "symbols")
        .when(share("0123456789") > 0.02, "numbers")
        .otherwise("prose")
    )


def _prepared(docs: DataFrame, id_col: str, text_col: str, source_col: str, lang_col: str, topic_col: str | None, row_col: str | None) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    none = lambda c: F.coalesce(c.cast("string"), F.lit("(none)"))
    return docs.select(F.col(id_col).alias("doc_id"), none(F.col(source_col)).alias("source"), none(F.col(lang_col)).alias("lang"), none(F.col(topic_col) if topic_col else register(text)).alias("topic"), n_tokens(text).alias("n_tokens"), *([F.col(row_col).alias("rid")] if row_col else []))


def targets_of(cells: DataFrame, alpha: float = ALPHA) -> dict[str, DataFrame]:
    """For each dimension (value, target): shares of tokens raised to alpha, scaled to 1."""
    out = {}
    for d in DIMS:
        sums = cells.groupBy(F.col(d).alias("value")).agg(F.sum("tokens").alias("t")).where("t > 0")
        powered = sums.select("value", F.pow(F.col("t").cast("double"), alpha).alias("p"))
        total = powered.agg(F.sum("p").alias("all"))
        out[d] = powered.crossJoin(F.broadcast(total)).select("value", (F.col("p") / F.col("all")).alias("target"))  # one row
    return out


def rake(cells: DataFrame, targets: dict[str, DataFrame], keep: float = KEEP, rounds: int = ROUNDS) -> DataFrame:
    """cells (source, lang, topic, tokens) with a column weight: expected tokens kept, each cell's supply at most, whose marginals meet the targets as far as there is supply."""
    now, (total, size) = cells, cells.agg(F.sum("tokens"), F.count("*")).first()
    for d in DIMS:
        now = now.join(targets[d].select(F.col("value").alias(d), F.col("target").alias(f"{d}_target")), d, "left")
    now = settled(now.fillna(0.0, [f"{d}_target" for d in DIMS]), size)
    if not total:
        return cells.withColumn("weight", F.lit(0.0))
    for d in DIMS:
        sums = now.groupBy(d).agg((F.sum("tokens") / (keep * total)).alias("most"), F.first(f"{d}_target").alias("a")).where("a > 0")
        lift = 1.0
        for _ in range(FILLS):  # values short of supply give all; the others' targets are lifted to fill the rest
            full = F.col("most") <= F.col("a") * lift
            r = sums.agg(F.sum(F.when(full, F.col("most"))).alias("m"), F.sum(F.when(~full, F.col("a"))).alias("a")).first()
            was, lift = lift, (1 - (r.m or 0.0)) / r.a if r.a else lift
            if lift <= was * (1 + 1e-12):
                break
        now = now.drop(f"{d}_target").join(sums.select(d, F.least("most", F.col("a") * lift).alias(f"{d}_target")), d, "left").fillna(0.0, [f"{d}_target"])
    raked, last = settled(now.withColumn("weight", F.col("tokens") * F.lit(keep)), size), float("inf")
    for _ in range(LOTS):
        for _ in range(rounds):
            for d in DIMS:
                was = F.sum("weight").over(Window.partitionBy(d))
                raked = raked.withColumn("weight", F.when(was > 0, F.least(F.col("tokens").cast("double"), F.col("weight") * F.col(f"{d}_target") * (keep * total) / was)).otherwise(0.0))
        raked = settled(raked, size)
        off = _off(raked, keep * total)
        if off <= TOLERANCE or off > 0.99 * last:
            break
        last = off
    return raked.select(*DIMS, "tokens", "weight")


def _off(raked: DataFrame, total: float) -> float:
    """The largest share of a target that its marginal is off."""
    sums = None
    for d in DIMS:
        own = raked.groupBy(F.col(d).alias("value")).agg(F.sum("weight").alias("w"), F.first(f"{d}_target").alias("a")).where("a > 0")
        sums = own if sums is None else sums.union(own)
    return sums.agg(F.max(F.abs(F.col("w") / (F.col("a") * total) - 1))).first()[0] or 0.0


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", lang_col: str = "lang", topic_col: str | None = None, targets: dict[str, DataFrame] | None = None, rounds: int = ROUNDS, alpha: float = ALPHA, keep: float = KEEP, row_col: str | None = None) -> DataFrame:
    """One row per row: doc_id, source, lang, topic, n_tokens, probability, kept, and with row_col that number of the row.

    targets: for source, lang and topic a table (value, target) of shares that sum to 1.
    keep: share of all tokens to be kept.
    """
    rows = stored(_prepared(docs, id_col, text_col, source_col, lang_col, topic_col, row_col), "mix-rows")  # texts are read once
    cells = stored(rows.groupBy(*DIMS).agg(F.sum("n_tokens").alias("tokens")), "mix-cells")
    raked = rake(cells, targets or targets_of(cells, alpha), keep, rounds)
    chance = raked.select(*DIMS, F.coalesce(F.round(F.when(F.col("tokens") > 0, F.least(F.lit(1.0), F.col("weight") / F.col("tokens"))), 9), F.lit(1.0)).alias("probability"))
    return _drawn(rows, chance, row_col)


def achieved(mixed: DataFrame, alpha: float = ALPHA) -> DataFrame:
    """What mix() achieved, for each value: dimension, value, supply (its share of all tokens), target (the default one), expected and kept (shares of the tokens expected and kept)."""
    kept = F.sum(F.when(F.col("kept"), F.col("n_tokens")).otherwise(0))
    cells = stored(mixed.groupBy(*DIMS).agg(F.sum("n_tokens").alias("tokens"), F.sum(F.col("n_tokens") * F.col("probability")).alias("expected"), kept.alias("kept")), "mix-achieved")
    targets, out = targets_of(cells, alpha), None
    for d in DIMS:
        sums = cells.groupBy(F.col(d).alias("value")).agg(*[F.sum(c).cast("double").alias(c) for c in ("tokens", "expected", "kept")])
        total = cells.agg(*[F.sum(c).alias(f"all_{c}") for c in ("tokens", "expected", "kept")])
        own = sums.join(targets[d], "value", "left").crossJoin(F.broadcast(total))  # one row
        own = own.select(F.lit(d).alias("dimension"), "value", (F.col("tokens") / F.col("all_tokens")).alias("supply"), F.coalesce("target", F.lit(0.0)).alias("target"), (F.col("expected") / F.col("all_expected")).alias("expected"), (F.col("kept") / F.col("all_kept")).alias("kept"))
        out = own if out is None else out.union(own)
    return out


def _drawn(rows: DataFrame, chance: DataFrame, row_col: str | None) -> DataFrame:
    """rows with their cell's probability, and whether they stay."""
    # A cell may hold a third of all rows: documents are dealt over salts, and each cell's row is there once a salt.
    salts = 16
    dealt = rows.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(salts)).cast("int"))
    found = dealt.join(chance.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))), [*DIMS, "salt"])
    u = F.conv(F.substring(F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")).cast("binary")), 1, 12), 16, 10).cast("double") / float(1 << 48)
    return found.select("doc_id", *DIMS, "n_tokens", "probability", (u < F.col("probability")).alias("kept"), *([F.col("rid").alias(row_col)] if row_col else []))


def mixing_sql(alpha: float = ALPHA, rounds: int = ROUNDS, keep: float = KEEP) -> str:
    """The same in DuckDB SQL over a table documents, with the default targets. Lots of rounds are steps of a recursion."""
    share = lambda signs: f"(length(x) - length(translate(x, '{signs}', ''))) / greatest(length(x), 1)"
    topic = f"CASE WHEN {share('|')} > 0.02 THEN 'table' WHEN {share('ABCDEFGHIJKLMNOPQRSTUVWXYZ')} > 0.3 THEN 'shout' WHEN {share('%$#*&!')} > 0.05 THEN 'symbols' WHEN {share('0123456789')} > 0.02 THEN 'numbers' ELSE 'prose' END"
    parts = [
        "t AS (SELECT doc_id, coalesce(source, '(none)') AS source, coalesce(lang, '(none)') AS lang, coalesce(text, '') AS x FROM documents)",
        rf"r AS (SELECT doc_id, source, lang, {topic} AS topic, len(list_filter(string_split_regex(x, '[\x20\x09-\x0D]+'), lambda w: w <> ''))::BIGINT AS n_tokens FROM t)",
        "c AS MATERIALIZED (SELECT source, lang, topic, sum(n_tokens)::BIGINT AS tokens FROM r GROUP BY ALL)",
        f"n AS MATERIALIZED (SELECT sum(tokens)::DOUBLE * {keep} AS total FROM c)",
    ]
    for d in DIMS:  # targets, and the lift at which those with supply fill up what the others lack
        parts += [
            f"a_{d} AS (SELECT {d}, pow(sum(tokens)::DOUBLE, {alpha}) / sum(pow(sum(tokens)::DOUBLE, {alpha})) OVER () AS a, sum(tokens) / any_value(total) AS most FROM c, n GROUP BY {d} HAVING sum(tokens) > 0)",
            f"l_{d} AS (SELECT *, (1 - coalesce(sum(most) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(a) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lift FROM a_{d} WINDOW o AS (ORDER BY most / a, {d}))",
            f"g_{d} AS MATERIALIZED (SELECT {d}, least(most, a * (SELECT coalesce(arg_min(lift, most / a) FILTER (most / a >= lift), max(most / a)) FROM l_{d})) AS g_{d} FROM a_{d})",
        ]
    joins = " ".join(f"LEFT JOIN g_{d} USING ({d})" for d in DIMS)
    zero = ", ".join(f"coalesce(g_{d}, 0) AS g_{d}" for d in DIMS)
    names = "source, lang, topic, tokens, g_source, g_lang, g_topic, total, step, last"
    body = "SELECT * FROM k WHERE step = 0 OR off > {tol} AND off <= 0.99 * last AND step < {lots}".format(tol=TOLERANCE, lots=LOTS)
    body = body.replace("SELECT *", f"SELECT {names.replace('step, last', 'step + 1 AS step, CASE WHEN step = 0 THEN CAST(1e300 AS DOUBLE) ELSE off END AS last')}, weight")
    for d in [d for _ in range(rounds) for d in DIMS]:
        body = f"SELECT {names}, CASE WHEN sum(weight) OVER (PARTITION BY {d}) > 0 THEN least(tokens::DOUBLE, weight * g_{d} * total / sum(weight) OVER (PARTITION BY {d})) ELSE 0.0 END AS weight FROM ({body})"
    miss = "greatest(" + ", ".join(f"max(CASE WHEN g_{d} > 0 THEN abs(w_{d} / (g_{d} * total) - 1) ELSE 0 END) OVER ()" for d in DIMS) + ")"
    sums = ", ".join(f"sum(weight) OVER (PARTITION BY {d}) AS w_{d}" for d in DIMS)
    columns = names.replace(", last", "")
    parts.append(f"k AS (SELECT source, lang, topic, tokens, {zero}, total, 0 AS step, CAST(1e300 AS DOUBLE) AS last, tokens * {keep}::DOUBLE AS weight, CAST(1e300 AS DOUBLE) AS off FROM c {joins}, n UNION ALL SELECT {columns}, last, weight, {miss} AS off FROM (SELECT *, {sums} FROM ({body})))")
    parts.append("p AS (SELECT source, lang, topic, CASE WHEN tokens > 0 THEN round(least(1.0, weight / tokens), 9) ELSE 1.0 END AS probability FROM k WHERE step = (SELECT max(step) FROM k))")
    return f"""WITH RECURSIVE {', '.join(parts)}
        SELECT r.doc_id, r.source, r.lang, r.topic, r.n_tokens, probability,
               CAST('0x' || substr(md5(coalesce(r.doc_id::VARCHAR, 'null')), 1, 12) AS BIGINT) / 281474976710656.0 < probability AS kept
        FROM r JOIN p USING (source, lang, topic)"""
