"""The SQL of the queries, in DuckDB on the driver's smallest tables."""

from pathlib import Path

import duckdb
import pytest

from vectorloom.llm.queries import QUERIES, SQL

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not Path(SF).exists(), reason="the driver's tables are not here")
@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    found = con.execute(SQL[name])
    names = [d[0] for d in found.description]
    cols = sorted(names)
    plain = lambda r: repr(tuple(round(v, 9) if isinstance(v, float) else v for v in r))
    want = sorted(plain(tuple(r[names.index(c)] for c in cols)) for r in found.fetchall())
    df = QUERIES[name](spark, SF)
    assert sorted(df.columns) == cols and sorted(plain(tuple(r[c] for c in cols)) for r in df.collect()) == want
