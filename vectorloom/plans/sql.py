"""Search from SQL: a deployed index as a table function.

    register(spark, "nearest_rows", index)
    SELECT * FROM nearest_rows(TABLE(SELECT qid, vec FROM queries), 10, 64)
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..operators.exact import matrix
from .index import StagedIndex

#: Queries that are searched at once.
LOT = 1024


def register(spark: SparkSession, name: str, index: StagedIndex) -> None:
    """name(TABLE(qid, vec), k, ef): (qid, rank, id, dist) of the k nearest found, as StagedIndex.search gives them.

    Each partition of the queries is searched where it lies, in lots of LOT, by the Arrow
    tier, so the index must be small enough to broadcast (StagedIndex.deploy refuses it
    otherwise). An empty table gives no rows; a vector of another length is an error.
    """
    shared, v, d = index.deploy()._broadcast, index.rotation(), index.config.d_model

    class Search:
        def __init__(self):
            self.held, self.rows, self.k, self.ef = [], 0, 0, 0

        def eval(self, queries: pa.RecordBatch, k: pa.Array, ef: pa.Array):
            if not queries.num_rows:
                return
            self.held.append(queries)
            self.rows += queries.num_rows
            self.k, self.ef = k[0].as_py(), ef[0].as_py()
            if self.rows >= LOT:
                yield self.found()

        def terminate(self):
            if self.held:
                yield self.found()

        def found(self) -> pa.Table:
            table = pa.Table.from_batches(self.held).select(["qid", "vec"])
            self.held, self.rows = [], 0
            vec = table.column("vec").combine_chunks()
            if vec.null_count or set(vec.value_lengths().unique().to_pylist()) != {d}:
                raise ValueError(f"query vectors must have {d} coordinates")
            i, dist = shared.value.search(matrix(vec) @ v, self.k, self.ef)
            live = (i >= 0).ravel()
            rank = np.tile(np.arange(1, self.k + 1, dtype=np.int32), table.num_rows)
            columns = {"qid": np.repeat(np.asarray(table.column("qid")).astype(np.int64), self.k), "rank": rank, "id": i.ravel(), "dist": dist.ravel()}
            return pa.table({c: a[live] for c, a in columns.items()})

    spark.udtf.register(name, F.arrow_udtf(Search, returnType="qid bigint, rank int, id bigint, dist double"))


_SQUARES = "aggregate(zip_with({a}, {b}, (x, y) -> (x - y) * (x - y)), 0D, (total, v) -> total + v)"
#: Scalar SQL functions over vectors: name, arguments, result, body. They stay in the JVM.
FUNCTIONS = (
    ("vec_l2sq", "a ARRAY<DOUBLE>, b ARRAY<DOUBLE>", "DOUBLE", _SQUARES.format(a="a", b="b")),
    ("vec_prefix_l2sq", "a ARRAY<DOUBLE>, b ARRAY<DOUBLE>, d INT", "DOUBLE", _SQUARES.format(a="slice(a, 1, d)", b="slice(b, 1, d)")),
    ("vec_residual_l2sq", "a ARRAY<DOUBLE>, b ARRAY<DOUBLE>, d INT", "DOUBLE", _SQUARES.format(a="slice(a, d + 1, size(a))", b="slice(b, d + 1, size(b))")),
    ("vec_recall", "found ARRAY<BIGINT>, truth ARRAY<BIGINT>", "DOUBLE", "size(array_intersect(found, truth)) / size(array_distinct(truth))"),
)


def register_functions(spark: SparkSession) -> None:
    """vec_l2sq, vec_prefix_l2sq, vec_residual_l2sq and vec_recall for SQL. Vectors of unequal lengths give null; a null vector too."""
    for name, given, kind, body in FUNCTIONS:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({given}) RETURNS {kind} RETURN {body}")
