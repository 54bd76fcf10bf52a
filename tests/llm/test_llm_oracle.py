"""Training-data queries against their SQL in another engine, on the smallest tables."""

from pathlib import Path

import duckdb
import pytest

from threadloom.llm import queries

DATA = Path("/root/testdata/sf0.001")


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_same_rows(spark, name):
    con = duckdb.connect()
    for table in DATA.glob("*.parquet"):
        con.execute(f"CREATE VIEW {table.stem} AS SELECT * FROM '{table}'")
    frame = queries.QUERIES[name](spark, str(DATA))
    result = con.execute(queries.ORACLE_SQL[name])
    at = {c[0]: i for i, c in enumerate(result.description)}
    assert set(frame.columns) == set(at)
    expected = sorted(repr([row[at[c]] for c in sorted(at)]) for row in result.fetchall())
    assert sorted(repr([row[c] for c in sorted(at)]) for row in frame.collect()) == expected
