"""Bounded top-k, visited sets and recall as relational operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def topk(df: DataFrame, k: int, by: str = "qid", order=("dist", "id"), rank: str = "rank") -> DataFrame:
    """The k smallest rows of each group, ranked from 1; the filter on the rank becomes a partial limit before the shuffle."""
    w = Window.partitionBy(by).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).where(F.col(rank) <= k)


def heap_pushpop(heap: DataFrame, more: DataFrame, n: int, by: str = "heap") -> DataFrame:
    """A bounded heap after pushing all of more: the n smallest keys of each heap stay."""
    cols = [by, "key", "value"]
    return topk(heap.select(*cols).union(more.select(*cols)), n, by, ("key", "value")).select(*cols)


def heap_pop(heap: DataFrame, by: str = "heap") -> DataFrame:
    """The smallest key of each heap with its value."""
    return heap.groupBy(by).agg(F.min(F.struct("key", "value")).alias("m")).select(by, "m.key", "m.value")


def heap_popped(heap: DataFrame, by: str = "heap") -> DataFrame:
    """The heaps after heap_pop: the slot of the smallest key holds (+inf, -1)."""
    top = F.row_number().over(Window.partitionBy(by).orderBy("key", "value")) == 1
    marked = heap.select(by, "key", "value", top.alias("top"))
    return marked.select(by, F.when(F.col("top"), F.lit(float("inf"))).otherwise(F.col("key")).alias("key"), F.when(F.col("top"), F.lit(-1)).otherwise(F.col("value")).alias("value"))


def bitmask_put(keys: DataFrame, col: str = "key") -> DataFrame:
    """The set of keys as words of a bit mask: (bucket, bits), 32,768 positions a word."""
    at = F.col(col)
    return keys.where(at >= 0).groupBy(F.expr(f"{col} div 32768").alias("bucket")).agg(F.expr(f"bitmap_construct_agg({col} % 32768)").alias("bits"))


def bitmask_keys(mask: DataFrame) -> DataFrame:
    """Number of keys in a mask."""
    return mask.agg(F.coalesce(F.sum(F.bitmap_count("bits")), F.lit(0)).alias("n_keys"))


def recall(found: DataFrame, truth: DataFrame) -> DataFrame:
    """Per query: |found and truth| / |truth| over distinct ids; queries without any found id count as 0."""
    f, t = found.select("qid", "id").distinct(), truth.select("qid", "id").distinct()
    hits = t.join(f.withColumn("hit", F.lit(1)), ["qid", "id"], "left")
    return hits.groupBy("qid").agg((F.count("hit") / F.count("*")).alias("recall"))


def mean_recall(found: DataFrame, truth: DataFrame) -> DataFrame:
    return recall(found, truth).agg(F.round(F.avg("recall"), 6).alias("recall"), F.count("*").alias("n_queries"))
