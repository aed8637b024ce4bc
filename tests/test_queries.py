"""Every registered query against its SQL, on the smallest data folder."""

import os

import duckdb
import pytest

from checks import REGISTRY
from tools.compare import rows_of

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in sorted(os.listdir(SF)):
        c.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    return c


@pytest.mark.parametrize("name", sorted(REGISTRY))
def test_query(spark, con, name):
    q = REGISTRY[name]
    df = q.run(spark, SF)
    got = rows_of(df.columns, df.collect())
    if q.sql is None:
        assert df.columns
        return
    cursor = con.execute(q.sql)
    columns = [d[0] for d in cursor.description]
    assert sorted(columns) == sorted(df.columns)
    assert got == rows_of(columns, cursor.fetchall())


def test_entry_contract():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())


def test_entry_has_rows(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
