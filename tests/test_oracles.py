"""Every query that has SQL returns the rows that DuckDB returns, at the smallest size."""

import os

import pandas as pd
import pytest

from marlstone import oracles, queries

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables are not here")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return c


def plain(frame):
    columns = sorted(frame.columns)

    def show(v):
        if pd.isna(v):
            return "~"
        if isinstance(v, bool) or type(v).__name__ == "bool":
            return str(bool(v))
        return repr(round(float(v), 6) + 0.0) if hasattr(v, "__float__") and not isinstance(v, str) else str(v)

    return columns, sorted(tuple(show(v) for v in r) for r in frame[columns].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(oracles.oracle_sql()))
def test_same_rows(spark, duck, name):
    assert plain(queries.queries()[name](spark, SF).toPandas()) == plain(duck.sql(oracles.oracle_sql()[name]).df())


@pytest.mark.parametrize("name", sorted(set(queries.queries()) - set(oracles.oracle_sql())))
def test_runs(spark, name):
    assert queries.queries()[name](spark, SF).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
