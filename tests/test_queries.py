"""Every registered query that has SQL gives the rows of that SQL, on the smallest tables."""

import os

import duckdb
import pytest

from cindermap.plans.queries import ORACLES, QUERIES


@pytest.fixture(scope="module")
def db(small):
    con = duckdb.connect()
    for name in os.listdir(small):
        con.sql(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{small}/{name}'")
    return con


def normal(value):
    if value is None or value != value or str(value) == "<NA>":
        return ""
    try:
        return repr(round(float(value), 6))
    except (TypeError, ValueError):
        return str(value)


def rows(frame, columns):
    return sorted(tuple(map(normal, r)) for r in frame[columns].astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, small, db, name):
    got = QUERIES[name](spark, small).toPandas()
    if name in ORACLES:
        want = db.sql(ORACLES[name]).df()
        columns = sorted(got.columns)
        assert columns == sorted(want.columns)
        assert rows(got, columns) == rows(want, columns)


def test_entry_imports():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
