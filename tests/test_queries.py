"""Every registered query of the library against its SQL twin in DuckDB."""

import pandas as pd
import pytest

from docintake import catalog

TABLES = "region nation customer supplier part orders lineitem events documents conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    import duckdb

    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return c


def plain(df):
    def cell(x):
        if x is None or x is pd.NA or (isinstance(x, float) and x != x):
            return "NULL"
        return repr(float(x)) if isinstance(x, (int, float)) and not isinstance(x, bool) else str(x)

    df = df.reindex(sorted(df.columns), axis=1).astype(object)
    return list(df.columns), sorted(tuple(map(cell, r)) for r in df.itertuples(index=False))


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(name, spark, sf, duck):
    assert plain(catalog.queries()[name](spark, sf).toPandas()) == plain(duck.sql(catalog.oracle_sql()[name]).df())
