"""Every registered query with SQL against DuckDB, on the smallest tables."""

import duckdb
import pytest

from lumenfold.plans import catalog

TABLES = "region nation customer supplier part orders lineitem events embeddings".split()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return con


def rows(values, columns):
    return sorted(tuple(str(v[c]) for c in columns) for v in values)


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_same_rows_as_sql(spark, sf, duck, name):
    got = catalog.queries()[name](spark, sf)
    want = duck.execute(catalog.oracle_sql()[name]).to_arrow_table()
    columns = sorted(got.columns)
    assert columns == sorted(want.column_names)
    assert rows((r.asDict() for r in got.collect()), columns) == rows(want.to_pylist(), columns)
