from pyspark.sql import functions as F

from threadloom.functions import text as T
from threadloom.operators import ingest, search


def value(spark, text, f):
    return spark.createDataFrame([(text,)], "t string").select(f(F.col("t"))).first()[0]


def test_redact_counts_and_masks(spark):
    secret = "key sk-" + "a" * 24 + " and ghp_" + "b" * 36 + " password: hunter2hunter2 https://u:p@host/x"
    masked = value(spark, secret, T.redact)
    assert masked == "key [API_KEY_REDACTED] and [GITHUB_TOKEN_REDACTED] password=[REDACTED] https://[CREDS_REDACTED]@host/x"
    assert value(spark, secret, T.count_secrets) == 4
    assert value(spark, "plain text", T.count_secrets) == 0


def test_trigram_similarity_of_a_typo(spark):
    row = spark.sql("SELECT 'lookup' AS a, 'lokup' AS b")
    assert row.select(T.trigram_similarity(F.col("a"), F.col("b"))).first()[0] == 0.625


def test_compact_title_cuts_between_words(spark):
    assert value(spark, "## A  title\n here", T.compact_title) == "A title here"
    long = value(spark, "word " * 40, T.compact_title)
    assert len(long) <= 96 and long.endswith("word…")
    assert value(spark, "  # ", T.compact_title) is None


def test_bound_text_keeps_head_and_tail(spark):
    cut = value(spark, "é" * 200, lambda c: T.bound_text(c, 101))
    assert len(cut.encode()) <= 101 and cut.startswith("é") and cut.endswith("é") and "[...]" in cut and "�" not in cut
    assert value(spark, "short", lambda c: T.bound_text(c, 101)) == "short"


def test_snippet_is_centred(spark):
    text = "x" * 100 + " needle " + "y" * 100
    assert value(spark, text, lambda c: T.snippet(c, "needle", 20)) == "…" + "x" * 6 + " needle " + "y" * 6 + "…"


def test_unspaced_runs_become_pairs(spark):
    assert value(spark, "请使用Spark引擎处理 a 数据。中 日本語テスト", T.tokens) == [
        "请使", "使用", "spark", "引擎", "擎处", "处理", "数据", "中", "日本", "本語", "語テ", "テス", "スト",
    ]
    assert value(spark, "plain words, x", T.tokens) == ["plain", "words"]
    docs = spark.createDataFrame([(1, "我们今天使用引擎。"), (2, "没有别的")], "document_id int, content string")
    assert [r[0] for r in search.fts_match(docs, "使用引擎").collect()] == [1]


def test_clean_title(spark):
    assert value(spark, "\x1b[31m A\x07\n title ", T.clean_title) == "A title"
    assert value(spark, "<system-reminder> x", T.clean_title) is None
    assert value(spark, "x" * 501, T.clean_title) is None


def test_chunks_end_behind_the_strongest_separator(spark):
    text = "a" * 60 + ". " + "b" * 20 + "\n" + "c" * 200
    docs = spark.createDataFrame([(1, text), (2, "short"), (3, ""), (4, None)], "document_id int, content string")
    rows = [tuple(r) for r in search.chunk_text(docs, 100, 10, 5).orderBy("document_id", "chunk_index").collect()]
    assert rows[0] == (1, 0, "a" * 60 + ". " + "b" * 20) and rows[-1] == (2, 0, "short")
    assert rows[1][2] == "b" * 9 + "\n" + "c" * 90 and sum(r[0] == 1 for r in rows) == 4


def test_merges_without_columns_set(spark):
    schema = "document_id int, title string, project string, hash string, metadata map<string,string>"
    old = spark.createDataFrame([(1, "Mine", "p", "a", {"manual_title": "1", "x": "1"}), (2, "t", "p", "a", None)], schema)
    new = spark.createDataFrame([(1, "Theirs", None, "b", {"manual_title": "0", "y": "2"}), (3, None, None, None, None)], schema)
    rows = {r["document_id"]: r for r in ingest.merge_documents(old, new).collect()}
    assert (rows[1]["title"], rows[1]["project"], rows[1]["hash"], rows[1]["action"]) == ("Mine", "p", "b", "update")
    assert rows[1]["metadata"] == {"manual_title": "1", "y": "2"}
    assert rows[2]["action"] == "keep" and rows[2]["metadata"] is None and rows[3]["action"] == "insert"
