"""Exact de-duplication by a 128-bit content hash with a byte comparison inside groups.

DataFrame operations only. Rows are hashed by the MD5 of the normalised text (ASCII
white space deleted). Only hashes of two rows or more go further: a filter of fixed
size keeps the texts of other hashes out of the shuffle, and texts are compared as
bytes by grouping them on (hash, text), which pre-aggregates copies before the shuffle,
so a group of any size costs one row for each task. A hash with more than one text is a
collision and is told apart by the text itself. Rows then find their group in a join of
narrow rows, which adaptive execution can split where a group is hot.

Defined results: null text counts as empty; texts of any length are hashed and compared
whole; null ids sort last and are kept only when all ids of the group are null; rows
repeated with the same id form a group of copies of which exactly one row has kept =
true; an empty table gives no rows; other columns of the input are ignored, whatever
their names. The input is read twice and must give the same rows in the same partitions,
as a stored table does.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ASCII_SPACE, likely_in, stored, unique_rows


def content_hash(text: Column) -> Column:
    """128 bits of the text's UTF-8 bytes, as 32 hex digits."""
    return F.md5(text.cast("binary"))


def _best(length: str, doc_id: str, rid: str) -> Column:
    """Sorts the row that stays first: most code points, then smallest id, then first row."""
    return F.min(F.struct((-F.col(length)).alias("len"), F.col(doc_id).isNull().alias("no_id"), F.col(doc_id).alias("doc_id"), F.col(rid).alias("rid")))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hash_of=content_hash, row_col: str | None = None) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256, n_chars, and with row_col that number of the row.

    hash_of: the grouping hash as a function of the normalised text; another one
    may be given, and the result is the same for any, collisions included.
    """
    rows = unique_rows(docs, id_col, text_col, row_col=row_col)
    text = F.coalesce(F.col(text_col), F.lit(""))
    norm = F.translate(text, ASCII_SPACE, "")
    seen = rows.select("doc_id", "rid", norm.alias("norm"), F.char_length(text).alias("n_chars"))
    hashed = stored(seen.select("doc_id", "rid", "n_chars", hash_of(F.col("norm")).alias("h"), F.sha2(F.col("norm").cast("binary"), 256).alias("text_sha256")), "exact-hashes")

    shared = hashed.groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h")
    texts = likely_in(seen.withColumn("h", hash_of(F.col("norm"))), F.col("h"), shared)
    classes = texts.groupBy("h", "norm").agg(F.count("*").alias("group_size"), _best("n_chars", "doc_id", "rid").alias("best")).where("group_size > 1")
    # Rows find their class by (hash, SHA-256): a collision of the grouping hash leaves more than one class for it.
    one = classes.select(F.col("h").alias("g"), F.sha2(F.col("norm").cast("binary"), 256).alias("sha"), "group_size", "best")
    joined = hashed.join(one, (hashed.h == one.g) & (hashed.text_sha256 == one.sha), "left")
    alone = F.col("g").isNull()
    return joined.select(
        "doc_id",
        F.when(alone, F.col("doc_id")).otherwise(F.col("best.doc_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        (alone | (F.col("rid") == F.col("best.rid"))).alias("kept"),
        "text_sha256",
        F.col("n_chars").cast("long").alias("n_chars"),
        *([F.col("rid").alias(row_col)] if row_col else []),
    )
