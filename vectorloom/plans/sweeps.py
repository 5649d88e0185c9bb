"""Jobs over indexes: build and save, sweeps over ef, and ablations. Each sweep returns rows (mode, known, ef, recall, milliseconds, spread)."""

from __future__ import annotations

import sys
import time
from collections.abc import Callable, Iterable
from statistics import fmean, pstdev

from pyspark.sql import DataFrame, SparkSession

from ..operators import entry, exact, topk
from ..sources.vector_files import Dataset, load_dataset
from .index import Config, StagedIndex, oracle_search, single_search
from .scratch import written

_ROWS = "mode string, known double, ef int, recall double, milliseconds double, spread double"


def timed(found: Callable[[], DataFrame], truth: DataFrame, repeats: int = 1, warmups: int = 0) -> tuple[float, float, float]:
    """(mean recall, mean milliseconds of running the search to its end, their standard deviation); the first `warmups` runs do not count."""
    spent = []
    for _ in range(warmups + repeats):
        began = time.time()
        found().write.format("noop").mode("overwrite").save()
        spent.append(1000 * (time.time() - began))
    return topk.mean_recall(found(), truth).first().recall, fmean(spent[warmups:]), pstdev(spent[warmups:])


def build_job(spark: SparkSession, name: str, root: str, config: Config, path: str, mode: str = "insert") -> StagedIndex:
    """Load a named dataset, build its index and save it at path."""
    data = load_dataset(spark, name, root)
    if data.storage is None:
        raise ValueError(f"{name} has no base vectors")
    return StagedIndex.build(data.storage, config, path, mode=mode)


def sweep(index: StagedIndex, queries: DataFrame, truth: DataFrame, efs: Iterable[int], k: int = 10, repeats: int = 1, tier: str = "arrow", warmups: int = 0) -> DataFrame:
    """The staged search at each ef."""
    rows = [(tier, None, ef, *timed(lambda ef=ef: index.search(queries, k, ef, tier), truth, repeats, warmups)) for ef in efs]
    return queries.sparkSession.createDataFrame(rows, _ROWS)


def sweep_saved(spark: SparkSession, path: str, data: Dataset, efs: Iterable[int], n_queries: int = 1024, k: int = 10, repeats: int = 1, seed: int = 0, warmups: int = 0) -> DataFrame:
    """As sweep, from a saved index and queries drawn from a dataset."""
    queries, truth = data.load_query(n_queries, k, seed)
    return sweep(StagedIndex.load(spark, path).deploy(), written(queries), written(truth), efs, k, repeats, warmups=warmups)


def oracle_ablation(queries: DataFrame, vectors: DataFrame, edges: DataFrame, known: Iterable[float], efs: Iterable[int], dims: int, k: int = 10, seed: int = 0) -> DataFrame:
    """Recall of searches that start from a share `known` of each query's true neighbours."""
    efs = list(efs)
    wide = written(exact.exact_knn(queries, vectors, max(*efs, k), dims))
    truth = wide.where(f"rank <= {k}")
    rows = [("oracle", float(share), ef, *timed(lambda s=share, ef=ef: oracle_search(queries, vectors, edges, wide, k, ef, dims, s, seed), truth)) for share in known for ef in efs]
    return queries.sparkSession.createDataFrame(rows, _ROWS)


def single_or_staged(index: StagedIndex, queries: DataFrame, vectors: DataFrame, efs: Iterable[int], k: int = 10, n_entries: int = 32) -> DataFrame:
    """One walk over the whole graph against the staged search of the same tables, both by joins."""
    d, t = index.config.d_model, index.tables
    truth, rotated = written(exact.exact_knn(queries, vectors, k, d)), written(index.rotated(queries))
    held, start = t["vectors"].select("id", "vec"), entry.random_entries(t["vectors"], n_entries, index.config.seed)
    rows = []
    for ef in efs:
        rows.append(("single", None, ef, *timed(lambda ef=ef: single_search(rotated, held, t["edges"], start, k, ef, d), truth)))
        rows.append(("staged", None, ef, *timed(lambda ef=ef: index.search(queries, k, ef, "relational"), truth)))
    return queries.sparkSession.createDataFrame(rows, _ROWS)


def main(args: list[str]) -> None:
    """build NAME ROOT PATH D_MODEL D_PRINCIPLE GRAPH ENTRIES, or sweep NAME ROOT PATH EF..."""
    spark = SparkSession.builder.getOrCreate()
    job, name, root, path, *more = args
    if job == "build":
        build_job(spark, name, root, Config(int(more[0]), int(more[1]), 0.25, more[2], more[3]), path)
    elif job == "sweep":
        sweep_saved(spark, path, load_dataset(spark, name, root), [int(ef) for ef in more]).show(1000, False)
    else:
        raise SystemExit(main.__doc__)


if __name__ == "__main__":
    main(sys.argv[1:])
