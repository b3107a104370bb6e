"""Every registered query of the engine against its SQL in DuckDB, on the smallest data."""

import duckdb
import pytest

from paneflow import catalog, oracle

SF = "/root/testdata/sf0.001"
SQL = oracle.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute(f"create view events as select * from '{SF}/events.parquet'")
    return con


def ordered(rows):
    return sorted(rows, key=lambda x: tuple((v is None, str(v)) for v in x))


@pytest.mark.parametrize("name", [x for x in catalog.queries() if x in SQL])
def test_query(spark, duck, name):
    df = catalog.queries()[name](spark, SF)
    got = [tuple(x) for x in df.collect()]
    found = duck.execute(SQL[name])
    columns = [x[0] for x in found.description]
    assert sorted(columns) == sorted(df.columns)
    at = [columns.index(c) for c in df.columns]
    assert ordered(got) == ordered(tuple(x[i] for i in at) for x in found.fetchall())


@pytest.mark.parametrize("name", [x for x in catalog.queries() if x not in SQL])
def test_other_queries_run(spark, name):
    assert catalog.queries()[name](spark, SF).count() > 0


def test_all_but_ordered_sketches_have_sql():
    assert set(catalog.queries()) - set(SQL) == {"cu", "sumax", "mv", "hashpipe", "sliding_sumax", "sliding_mv", "sliding_hashpipe"}
