"""Every query against its SQL in another engine, on the smallest tables."""

import math
from pathlib import Path

import duckdb
import pytest

from threadloom import queries as library

DATA = Path("/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for table in DATA.glob("*.parquet"):
        con.execute(f"CREATE VIEW {table.stem} AS SELECT * FROM '{table}'")
    return con


def plain(value):
    if value is None or isinstance(value, float) and math.isnan(value):
        return "null"
    return repr(round(value, 9)) if isinstance(value, float) else str(value)


@pytest.mark.parametrize("name", sorted(library.ORACLE_SQL))
def test_same_rows(spark, duck, name):
    frame = library.QUERIES[name](spark, str(DATA))
    columns = sorted(frame.columns)
    result = duck.execute(library.ORACLE_SQL[name])
    at = {c[0]: i for i, c in enumerate(result.description)}
    assert columns == sorted(at)
    expected = sorted(tuple(plain(row[at[c]]) for c in columns) for row in result.fetchall())
    assert sorted(tuple(plain(row[c]) for c in columns) for row in frame.collect()) == expected


@pytest.mark.parametrize("name", sorted(set(library.QUERIES) - set(library.ORACLE_SQL)))
def test_runs(spark, name):
    assert library.QUERIES[name](spark, str(DATA)).count() >= 0
