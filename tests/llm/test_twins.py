"""Queries against their SQL twins in DuckDB."""

import duckdb
import pytest

from docintake.llm import queries as q


@pytest.mark.parametrize("name", sorted(q.oracle_sql()))
def test_twin(name, spark, sf):
    c = duckdb.connect()
    for t in ("documents", "benchmark", "embeddings"):
        c.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    want, got = c.sql(q.oracle_sql()[name]), q.queries()[name](spark, sf)
    columns = sorted(got.columns)
    assert sorted(want.columns) == columns
    rows = lambda found: sorted(map(repr, found))
    assert rows(want.select(*columns).fetchall()) == rows(map(tuple, got.select(*columns).collect()))
