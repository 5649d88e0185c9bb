"""Tasks that hold a whole table each, which they get by the shuffle.

A broadcast of numpy arrays is made at the driver, so all of its rows pass there. Here each
of some tasks is sent all rows of a table and a share of the rows that ask; only counts reach
the driver. What is shuffled is the table as often as there are tasks: a core has one at most.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

#: Rows that ask below which a task is not divided further.
LEAST = 256


def shares(df: DataFrame, rows: int, least: int = LEAST) -> int:
    """Tasks among which so many rows are dealt."""
    return max(1, min(df.sparkSession.sparkContext.defaultParallelism, -(-rows // least)))


def few_shares(df: DataFrame, rows: int) -> int:
    """A third of those, for work that is small beside what a task is sent."""
    return -(-shares(df, rows) // 3)


def _blank(df: DataFrame) -> Column:
    """A struct of df's columns in which lists are empty and the rest is null."""
    empty = lambda t: F.array().cast(t) if isinstance(t, ArrayType) else F.lit(None).cast(t)
    return F.struct(*[empty(f.dataType).alias(f.name) for f in df.schema.fields])


def dealt(asked: DataFrame, whole: DataFrame, by: str, tasks: int) -> DataFrame:
    """(cell, asks, share, all): the rows of asked in the cell that a hash of `by` names, the rows of whole in each cell; the side that a row does not have is blank.

    A blank has no null list: Arrow's list writer goes over all null lists since the last other
    one again at each row, so a batch of n rows without vectors took n * n / 2 steps.
    """
    mine = asked.select(F.pmod(F.xxhash64(by), F.lit(tasks)).cast("int").alias("cell"), F.lit(True).alias("asks"), F.struct(*asked.columns).alias("share"), _blank(whole).alias("all"))
    each = whole.select(F.explode(F.sequence(F.lit(0), F.lit(tasks - 1))).alias("cell"), F.lit(False).alias("asks"), _blank(asked).alias("share"), F.struct(*whole.columns).alias("all"))
    return mine.union(each)


def with_whole(asked: DataFrame, whole: DataFrame, run: Callable[[pa.Table, pa.Table], Iterable[pa.RecordBatch]], schema: str, by: str, tasks: int) -> DataFrame:
    """run(share, all) in `tasks` tasks: the rows of asked that a hash of the column `by` deals to the task, and all rows of whole, in any order. Without a share there is no call."""
    cells = dealt(asked, whole, by, tasks).repartitionById(tasks, "cell")

    def meet(batches):
        share, rows = [], []
        for b in batches:
            asks = b.column(0)
            for side, mask, kept in ((b.column(1), asks, share), (b.column(2), pc.invert(asks), rows)):
                found = side.filter(mask)
                if len(found) or not kept:
                    kept.append(pa.Table.from_struct_array(found))
        if sum(map(len, share)):
            share, rows = pa.concat_tables(share), pa.concat_tables(rows)
            yield from run(share, rows)

    return cells.select("asks", "share", "all").mapInArrow(meet, schema)
