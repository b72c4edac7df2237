"""Every query with SQL gives what DuckDB gives, on the smallest tables."""

from pathlib import Path

import pytest

import __spark_entry__ as entry
from driftmatch import queries as base

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="no tables")


def normal(x):
    if x is None or x != x:
        return None
    if hasattr(x, "tolist"):
        x = x.tolist()
    if isinstance(x, list):
        return tuple(map(normal, x))
    return round(x, 6) if isinstance(x, float) else x


def rows(df):
    return sorted((tuple(map(normal, r)) for r in df[sorted(df.columns)].itertuples(index=False)), key=repr)


@pytest.fixture(scope="session")
def duck():
    import duckdb

    con = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


@pytest.mark.parametrize("name", sorted(base.ORACLE))
def test_query_equals_its_sql(spark, duck, name):
    got, want = base.QUERIES[name](spark, SF).toPandas(), duck.sql(base.ORACLE[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_the_others_run(spark):
    for name in set(base.QUERIES) - set(base.ORACLE):
        assert base.QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
