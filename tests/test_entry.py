"""The driver's contract: names, imports without the training-data folder, and SQL against DuckDB."""

import shutil
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry

ROOT, SF = Path(__file__).resolve().parent.parent, "/root/testdata/sf0.001"


def test_sql_belongs_to_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_imports_without_the_llm_folder(tmp_path):
    shutil.copytree(ROOT / "vectorloom", tmp_path / "vectorloom", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    said = subprocess.run([sys.executable, "-B", "-c", "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"], cwd=tmp_path, capture_output=True, text=True)
    assert said.returncode == 0, said.stderr
    from vectorloom.queries import QUERIES, SQL

    assert said.stdout.split() == [str(len(QUERIES)), str(len(SQL))]


@pytest.mark.skipif(not Path(SF).exists(), reason="the driver's tables are not here")
@pytest.mark.parametrize("name", ["exact_knn", "residual_dist", "recall_at_k", "svd_gram", "router_init", "entry_routed_distances", "graph_nsw", "subgraph_sample", "load_query"])
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{SF}/embeddings.parquet')")
    found = con.execute(entry.oracle_sql()[name])
    cols = sorted(d[0] for d in found.description)
    order = [[d[0] for d in found.description].index(c) for c in cols]
    want = sorted(tuple(r[i] for i in order) for r in found.fetchall())
    df = entry.queries()[name](spark, SF)
    assert sorted(df.columns) == cols
    assert sorted(tuple(r[c] for c in cols) for r in df.collect()) == want
