"""Queries against their SQL on rows that the given tables lack: missing and repeated keys, empty texts."""

from collections import Counter

import duckdb

from threadloom import queries as library


def same(spark, folder, table, rows, schema, name):
    """Whether a query and its SQL return the same rows of one table; with them, how many they are."""
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/{table}.parquet")
    frame, con = library.QUERIES[name](spark, str(folder)), duckdb.connect()
    con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet/*.parquet'")
    result = con.execute(library.ORACLE_SQL[name])
    at = {c[0]: i for i, c in enumerate(result.description)}
    expected = Counter(tuple(row[at[c]] for c in frame.columns) for row in result.fetchall())
    found = Counter(map(tuple, frame.collect()))
    return found == expected, found.total()


def test_window_of_lines_with_gaps_and_copies(spark, tmp_path):
    turns = [0, 1, 1, 1, 3, 5, 6, 7, None]  # line 3 is missing, as is 5; line 2 is there three times
    rows = [(c, t, "user", "x") for c in (4, 5) for t in turns]
    assert same(spark, tmp_path, "conversations", rows, "conv_id long, turn long, role string, text string", "f2_message_window") == (True, 4)


def test_chunks_of_empty_texts_and_repeated_ids(spark, tmp_path):
    texts = [(1, "x"), (1, "x"), (1, "y" * 2000), (2, ""), (2, ""), (3, None), (4, " "), (5, "z" * 2001), (5, "z"), (None, "a"), (None, "b")]
    rows = [(i, t, "en", "src1", 0) for i, t in texts]
    assert same(spark, tmp_path, "documents", rows, "doc_id long, text string, lang string, source string, n_chars long", "p_register") == (True, 11)
