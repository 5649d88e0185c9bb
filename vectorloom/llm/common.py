"""Helpers shared by the training-data operators: shared storage, digests of frames, connected components."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space, as the contracts name it: U+0020 and U+0009 to U+000D.
ASCII_SPACE = " \t\n\x0b\x0c\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def ascii_lower(col):
    """Lower-case A-Z only; every other code point stays as it is."""
    return F.translate(col, UPPER, UPPER.lower())


def shared_root(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which driver and executors share.

    Where it is unset (plain local mode, as in tests) a temporary folder is set;
    on a cluster without the setting this raises, because a machine-local folder
    would lose data.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    sc = spark.sparkContext
    if not sc.master.startswith("local[") and sc.master != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    current = sc.getCheckpointDir()
    if current:
        return current.rstrip("/")
    root = tempfile.mkdtemp(prefix="vectorloom-")
    sc.setCheckpointDir(f"file://{root}")
    return f"file://{root}"


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path under the shared folder."""
    return f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str, compression: str = "zstd") -> DataFrame:
    """Write df as Parquet to the shared folder and read it again: the lineage ends at files that outlive executors."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.option("compression", compression).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Rows in a partition of a small table that is written between steps.
ROWS_A_FILE = 200_000


def settled(df: DataFrame, rows: int) -> DataFrame:
    """df of about that many rows, checkpointed in no more files than they fill."""
    shared_root(df.sparkSession)
    files = max(1, -(-rows // ROWS_A_FILE))
    # A table of one file stays one partition: sums over it need no exchange.
    return df.coalesce(files).checkpoint().coalesce(files)


def unique_rows(docs: DataFrame, id_col: str, *cols: str, row_col: str | None = None) -> DataFrame:
    """The named columns as doc_id and their own names, plus rid, a number of the row (repeated rows stay apart); row_col has it already."""
    return docs.select(F.col(id_col).alias("doc_id"), *[F.col(c) for c in cols], (F.col(row_col) if row_col else F.monotonically_increasing_id()).alias("rid"))


def free_name(df: DataFrame, name: str) -> str:
    """The name, with underscores until no column of df has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def numbered(docs: DataFrame) -> tuple[DataFrame, str]:
    """docs with a number for each row, and its name. Two reads number alike: docs must be stored, or else give the same rows in the same partitions."""
    name = free_name(docs, "row_number")
    return docs.withColumn(name, F.monotonically_increasing_id()), name


#: Bitmaps of 4 KiB that may be broadcast: 32 MiB.
MAX_BITMAPS = 8192


def _bit_set(bits: Column, at: Column) -> Column:
    """Whether bit number `at` of a bitmap of 32,768 bits is set."""
    byte = F.conv(F.hex(F.substring(bits, (F.floor(at / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    return byte.bitwiseAND(F.element_at(F.array(*[F.lit(1 << i) for i in range(8)]), (at % 8 + 1).cast("int"))) != 0


def rows_among(docs: DataFrame, row: str, chosen: DataFrame, among: bool = True, most: int = MAX_BITMAPS) -> DataFrame:
    """The rows of docs whose number (column row) is among those of the only column of chosen, or is not.

    Up to `most` bitmaps the numbers are broadcast as bitmaps, one for 32,768 rows of a
    partition, and texts stay where they are; beyond it the two are joined by number.
    """
    at = chosen.select(F.col(chosen.columns[0]).alias("n")).select(F.expr("n div 32768").alias("word"), (F.col("n") % 32768).alias("bit"))
    names = [free_name(docs, n) for n in ("word", "bits")]
    maps = at.groupBy(F.col("word").alias(names[0])).agg(F.expr("bitmap_construct_agg(bit)").alias(names[1])).persist()  # counted, then broadcast
    if maps.limit(most + 1).count() > most:
        number = free_name(docs, "chosen")
        return docs.join(chosen.select(F.col(chosen.columns[0]).alias(number)), F.col(row) == F.col(number), "left_semi" if among else "left_anti")
    found = docs.join(F.broadcast(maps), F.expr(f"`{row}` div 32768") == F.col(names[0]), "inner" if among else "left")  # `most` bitmaps at most
    is_set = _bit_set(F.col(names[1]), F.col(row) % 32768)
    return found.where(is_set if among else ~F.coalesce(is_set, F.lit(False))).select(*[F.col(f"`{c}`") for c in docs.columns])


#: Bits of a filter of fixed size: 2,048 bitmaps of 32,768 bits, 8 MiB.
FILTER_BITS = 2048 * 32768


def likely_in(df: DataFrame, key: Column, keys: DataFrame) -> DataFrame:
    """The rows of df whose key may be among those of the only column of keys: none is lost, and a false one is rare while keys are few beside FILTER_BITS.

    The filter's size is fixed, so it is broadcast; where it fills up, more rows stay than needed.
    """
    bit = lambda c: F.pmod(F.xxhash64(c), F.lit(FILTER_BITS))
    names = [free_name(df, n) for n in ("word", "bits", "at")]
    at = keys.select(bit(F.col(keys.columns[0])).alias("at")).select(F.floor(F.col("at") / 32768).alias("word"), (F.col("at") % 32768).alias("bit"))
    maps = at.groupBy(F.col("word").alias(names[0])).agg(F.expr("bitmap_construct_agg(bit)").alias(names[1]))
    marked = df.withColumn(names[2], bit(key))
    found = marked.join(F.broadcast(maps), F.floor(F.col(names[2]) / 32768) == F.col(names[0]))  # 2,048 rows at most
    return found.where(_bit_set(F.col(names[1]), F.col(names[2]) % 32768)).select(*[F.col(f"`{c}`") for c in df.columns])


def split_join(many: DataFrame, few: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """Join on a key that a large share of `many` may hold; few has each key once.

    Both sides are dealt anew by a hash of the key: a side that an aggregate has dealt
    already would be joined where it lies, and adaptive execution could not split a hot key.
    """
    k, own = free_name(many, "join_hash"), free_name(few, f"{key}_of_few")
    left = many.withColumn(k, F.xxhash64(key))
    right = few.withColumnRenamed(key, own).withColumn(f"{k}_", F.xxhash64(own))
    found = left.join(right, (F.col(k) == F.col(f"{k}_")) & (F.col(key) == F.col(own)), how)
    return found.drop(k, f"{k}_", own)


def connected_components(edges: DataFrame) -> DataFrame:
    """Smallest node reachable, for each node of an edge list (a, b) of longs.

    Large-star and small-star rounds (Kiveris et al., 2014), each written to the
    shared folder. No task holds a component: a hub's neighbours meet its minimum in a
    join that adaptive execution can split. Returns (node, label); self-loops and
    repeated edges are harmless; no edges give no rows.
    """
    shared_root(edges.sparkSession)
    rows = edges.count()  # edges are stored
    cur = settled(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), rows)
    before = None
    while True:
        both = cur.union(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = split_join(both.where("v > u"), low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = split_join(large, low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v")))
        cur = settled(small.distinct(), 2 * rows)
        after = cur.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if after == before:
            break
        before, rows = after, after[0]
    return cur.select(F.col("u").alias("node"), F.col("v").alias("label")).union(cur.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())
