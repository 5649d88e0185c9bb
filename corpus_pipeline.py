"""A corpus pipeline: quality, exact copies, near copies, mixing, packing.

STAGES lists (name, function); a function takes (spark, docs, sf_dir) and returns a
DataFrame, which is written as Parquet and read again as the next one's docs. All
but the last return the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from vectorloom.llm.common import numbered, rows_among, stored
from vectorloom.llm.exact_dedup import exact_dedup
from vectorloom.llm.mixing import mix
from vectorloom.llm.near_copies import near_copies
from vectorloom.llm.packing import pack
from vectorloom.llm.quality import resample
from vectorloom.llm.queries import tokenizer_path


def _keep(docs: DataFrame, decide: Callable[[DataFrame, str], DataFrame]) -> DataFrame:
    """The rows of docs that decide(rows, name of their number) marks as kept; all columns as they are.

    Decisions go by row, so that rows with equal or null ids are told apart. docs is read
    twice and must number alike, as a stored table does.
    """
    rows, number = numbered(docs)
    return rows_among(rows, number, decide(rows, number).where("kept").select(number)).drop(number)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts that the quality classifier rejects go.

    Repeated rows share their fate; null and empty texts have no n-grams and a neutral
    weight; long texts are read whole; ties of keys stay together; an empty table gives none.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return _keep(docs, lambda rows, number: resample(rows, labels, row_col=number))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of equal texts stays: that with the most code points, then the smallest id, then the first.

    White space does not count; null and empty texts are equal; rows repeated with the same
    or a null id leave one.
    """
    return _keep(docs, lambda rows, number: exact_dedup(rows, row_col=number))


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near copies (five-word shingles, similarity 0.8 or more) the row with the smallest id stays, of several the first.

    Texts without words link to each other only; a null id stays only where all are null.
    """
    return _keep(docs, lambda rows, number: near_copies(rows, row_col=number))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are sampled by the probabilities that give source, language and topic their target weights.

    Null sources and languages are values of their own; texts without words stay with their
    cell's probability; rows with equal ids share their draw.
    """
    return _keep(docs, lambda rows, number: mix(rows, row_col=number))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in sequences of 4096 tokens; null and empty texts are one end token."""
    return pack(docs, tokenizer_path())


STAGES = [("quality", quality), ("exact dedup", exact), ("near dedup", near), ("mixing", mixing), ("packing", packing)]

#: SQL has neither the hashed models, nor XXH64, nor the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each one's result is written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = stored(docs, f"stage-{name.replace(' ', '-')}")
    return docs
