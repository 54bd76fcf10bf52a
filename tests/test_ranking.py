"""Rank, likeness and JSON redaction against plain versions."""

import itertools
import json
import random

from pyspark.sql import functions as F

from threadloom.functions.text import redact_json
from threadloom.operators.search import cover_density, rank_messages, score_with_correction, word_similarity


def plain_density(words, wanted):
    spans = [(a, b) for a in range(len(words)) for b in range(a, len(words)) if set(wanted) <= set(words[a : b + 1])]
    covers = [s for s in spans if not any(o != s and s[0] <= o[0] and o[1] <= s[1] for o in spans)]
    return sum(0.1 / (1 + sum(w not in wanted for w in words[a : b + 1])) for a, b in covers)


def test_cover_density(spark):
    rng = random.Random(7)
    rows = [[rng.choice("abcdef") for _ in range(rng.randrange(14))] for _ in range(150)]
    frame = spark.createDataFrame([(i, w) for i, w in enumerate(rows)], "i long, w array<string>")
    for wanted in (["a"], ["a", "b"], ["a", "b", "c"], ["a", "a"]):
        got = {r["i"]: r["s"] for r in frame.select("i", cover_density(F.col("w"), wanted).alias("s")).collect()}
        assert all(abs(got[i] - plain_density(w, wanted)) < 1e-9 for i, w in enumerate(rows))
    assert spark.range(1).select(cover_density(F.lit(None).cast("array<string>"), ["a"]).alias("s")).first()["s"] == 0


def plain_likeness(query, text):
    def grams(value):
        words = ["".join(run) for letter, run in itertools.groupby(value.lower(), str.isalnum) if letter]
        return [f"  {w} "[i : i + 3] for w in words for i in range(len(w) + 1)]

    q, t = set(grams(query)), grams(text)
    sets = [set(t[a:b]) for a in range(len(t)) for b in range(a + 1, len(t) + 1)]
    return max((len(q & s) / len(q | s) for s in sets), default=0.0)


def test_word_similarity(spark):
    rng = random.Random(3)
    texts = ["", "word", "two words", "...", *(" ".join(rng.choice(["wort", "sword", "wordy", "two", "wo", "rds"]) for _ in range(6)) for _ in range(40))]
    frame = spark.createDataFrame([(t,) for t in [*texts, None]], "t string")
    for row in frame.select("t", word_similarity("two words", F.col("t")).alias("s")).collect():
        assert abs(row["s"] - plain_likeness("two words", row["t"] or "")) < 1e-9


def test_fuzzy_messages_follow_exact_ones(spark):
    rows = [(1, "user", "a data stream"), (2, "user", "many dataa streams"), (3, "user", "nothing"), (4, "tool", "data stream"), (5, "assistant", "stream of data")]
    frame = spark.createDataFrame(rows, "message_id long, role string, content string")
    found = rank_messages(frame, "data stream", fuzzy=0.5).orderBy(F.desc("score")).collect()
    assert [(r["message_id"], r["match_type"]) for r in found] == [(1, "exact"), (5, "full_text"), (2, "fuzzy")]


def test_redact_json(spark):
    record = {"a": [{"PASSWORD": {"x": 1}}, "ghp_" + "a" * 36], "token": None, "n": 1, "u": "é"}
    texts = [json.dumps(record), "no json, Bearer abc", "[1, 2]", '"\\ud800"', "[" * 100_000, None]
    frame = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = {r["i"]: (r["r"]["content"], r["r"]["count"]) for r in frame.select("i", redact_json(F.col("t")).alias("r")).collect()}
    assert json.loads(got[0][0]) == {"a": [{"PASSWORD": "[REDACTED]"}, "[GITHUB_TOKEN_REDACTED]"], "token": "[REDACTED]", "n": 1, "u": "é"}
    assert got[0][1] == 3
    assert got[1] == ("no json, Bearer [TOKEN_REDACTED]", 1)
    assert got[2] == ("[1,2]", 0) and got[3] == ('"?"', 0) and got[4][1] == 0
    assert got[5] == (None, 0)


def test_short_pages_take_the_corrected_query(spark):
    rows = [(1, "user", "a streams of dta"), (2, "user", "the data stream"), (3, "assistant", "stream data"), (4, "user", "other")]
    messages = spark.createDataFrame(rows, "message_id long, role string, content string")
    lexicon = spark.createDataFrame([("stream", 40), ("data", 30), ("other", 9)], "term string, frequency long")

    def found(query, enough):
        return sorted((r["message_id"], round(r["score"], 6), r["match_type"]) for r in score_with_correction(messages, query, lexicon, enough).collect())

    assert found("streams", 1) == [(1, 4.0, "exact")]
    assert found("streams", 5) == [(1, 4.0, "exact"), (2, 1.999999, "fuzzy"), (3, 1.999999, "fuzzy")]
    assert found("data streams", 5) == [(2, 1.999999, "fuzzy"), (3, 1.0, "fuzzy")]
    assert found("qqqq", 5) == []
