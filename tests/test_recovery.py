"""Recovered prompts and inserted rows against plain versions."""

import itertools
import random

import numpy as np
import pytest
from pyspark import cloudpickle

from threadloom.operators import recovery


def brute(source, history, tolerance):
    best = (0, 0.0)
    for k in range(1, min(len(source), len(history)) + 1):
        for a in itertools.combinations(range(len(history)), k):
            for b in itertools.combinations(range(len(source)), k):
                apart = [0.0 if np.isnan(history[i]) or np.isnan(source[j]) else abs(history[i] - source[j]) for i, j in zip(a, b, strict=True)]
                if max(apart) <= tolerance:
                    best = max(best, (k, -sum(apart)))
    return best


@pytest.mark.parametrize("gaps", [False, True])
def test_matching_is_largest_then_nearest(gaps):
    rng = random.Random(4)
    for _ in range(120):
        source, history = (np.sort(np.array([rng.randint(0, 900) for _ in range(rng.randint(1, 5))], float)) for _ in range(2))
        if gaps:
            source[rng.randrange(len(source))] = np.nan
        pairs = recovery.match_in_order(source, history, 300)
        assert all(a < c and b < d for (a, b), (c, d) in itertools.pairwise(pairs))
        apart = [0.0 if np.isnan(source[j]) else abs(history[i] - source[j]) for i, j in pairs]
        assert all(x <= 300 for x in apart) and (len(pairs), -sum(apart)) == brute(source, history, 300)


def test_the_earlier_of_equal_rows_is_matched():
    assert recovery.match_in_order(np.array([10.0]), np.array([5.0, 15.0]), 300) == [(0, 0)]
    assert recovery.match_in_order(np.array([]), np.array([5.0]), 300) == []


def test_runs_of_a_text_are_matched_like_the_whole(spark):
    rng = random.Random(6)
    source = [(d, i, rng.choice("xy"), None if d == 3 and i == 4 else rng.randint(0, 6000)) for d in range(5) for i in range(25)]
    history = [(d, 100 + i, rng.choice("xyz"), rng.randint(0, 6000)) for d in range(5) for i in range(20)]
    schema = "document_id long, key long, content string, ts long"
    found = recovery.match_recovered_prompts(spark.createDataFrame(source, schema), spark.createDataFrame(history, schema)).collect()
    assert sorted((r[0], r[1]) for r in found) == sorted((h[0], h[1]) for h in history)
    for d, text in itertools.product(range(5), "xyz"):
        a, b = (sorted((r for r in rows if r[0] == d and r[2] == text), key=lambda r: (r[3] is None, r[3] or 0, r[1])) for rows in (source, history))
        times = [np.array([np.nan if r[3] is None else r[3] for r in rows], float) for rows in (a, b)]
        expected = {b[i][1]: a[j][1] for i, j in recovery.match_in_order(*times, 300)}
        keys = {r[1] for r in b}
        assert {r[1]: r[2] for r in found if r[0] == d and r[1] in keys and r[2] is not None} == expected


def test_empty_sides(spark):
    schema = "document_id long, key long, content string, ts long"
    none, one = spark.createDataFrame([], schema), spark.createDataFrame([(1, 1, "a", 5)], schema)
    assert recovery.match_recovered_prompts(one, none).collect() == []
    assert [tuple(r) for r in recovery.match_recovered_prompts(none, one).collect()] == [(1, 1, None)]


def test_history_is_repaired(spark):
    rows = [
        (1, 1, 1, "user", "text", "ask", 100), (1, 2, 2, "assistant", "text", "yes", 200), (1, 3, 5, "user", "text", "more", 900),
        (1, 10, -1, "user", "history_user_message", "ask", 130), (1, 11, -2, "user", "history_user_message", "lost", 150),
        (1, 12, -3, "user", "history_user_message", "late", 5000), (1, 13, -4, "user", "history_user_message", "ask", 140),
        (1, 14, -5, "user", "history_user_message", "timeless", None), (2, 20, -1, "user", "history_user_message", "alone", 1),
    ]
    schema = "document_id long, message_id long, line_number long, role string, message_type string, content string, ts long"
    out = recovery.repair_history(spark.createDataFrame(rows, schema)).collect()
    assert sorted((r["document_id"], r["line_number"], r["message_id"]) for r in out) == [
        (1, 1, 1), (1, 2, 13), (1, 3, 11), (1, 4, 2), (1, 7, 3), (1, 8, 12), (1, 9, 14), (2, 1, 20),
    ]


def test_semantic_rows_find_their_place(spark):
    parsed = [
        (1, 0, "user", "text", "a", "hello", 10), (1, 1, "assistant", "reasoning", "r1", "why", 11), (1, 2, "assistant", "text", None, "yes", 12),
        (1, 3, "assistant", "reasoning", None, "known", 13), (1, 4, "assistant", "agent_event", None, "start", 14), (1, 5, "user", "text", None, "same", 15),
        (1, 6, "user", "text", None, "same", 16), (1, 7, "assistant", "reasoning", "r2", "late", 15), (1, 8, "assistant", "reasoning", "r3", "end", None),
    ]
    stored = [
        (1, 1, "user", "text", "a", "edited", 10), (1, 3, "assistant", "text", "x", "yes", 12), (1, 4, "assistant", "reasoning", None, "known", 13),
        (1, 5, "user", "text", None, "same", 15), (1, 6, "user", "text", None, "same", 16), (2, 1, "user", "text", None, "other", None),
    ]
    p = spark.createDataFrame(parsed, "document_id long, position long, role string, message_type string, source_id string, content string, ts long")
    s = spark.createDataFrame(stored, "document_id long, line_number long, role string, message_type string, source_id string, content string, ts long")
    assert sorted((r["position"], r["anchor"]) for r in recovery.semantic_inserts(p, s).collect()) == [(1, 3), (4, 5), (7, 6), (8, 7)]
    lines = sorted((r["document_id"], r["line_number"], r["content"]) for r in recovery.align_and_insert(p, s).collect())
    assert lines == [(1, 1, "edited"), (1, 3, "why"), (1, 4, "yes"), (1, 5, "known"), (1, 6, "start"), (1, 7, "same"), (1, 8, "late"), (1, 9, "same"), (1, 10, "end"), (2, 1, "other")]
    assert recovery.semantic_inserts(p, s.limit(0)).count() == 5 and recovery.semantic_inserts(p.limit(0), s).count() == 0


def test_overlays_fill_what_is_missing(spark):
    schema = "document_id long, line_number long, role string, message_type string, content string, model string, effort string"
    stored = [(1, 1, "assistant", "text", "a", None, None), (1, 2, "assistant", "text", "b", "own", None), (1, 3, "user", "text", "twice", None, None), (1, 4, "user", "text", "twice", None, None), (1, 5, None, None, None, None, None)]
    parsed = [(1, 1, "assistant", "text", "a", "m1", "high"), (1, 7, "assistant", "text", "b", "m2", "low"), (1, 8, "user", "text", "twice", "m3", None), (1, 9, "user", "text", "gone", "m4", None)]
    s, p = spark.createDataFrame(stored, schema), spark.createDataFrame(parsed, schema)
    out = recovery.backfill_overlays(s, p, ["model", "effort"]).orderBy("line_number").collect()
    assert [(r["model"], r["effort"], r["aligned"]) for r in out] == [("m1", "high", "line"), ("own", "low", "unique"), (None, None, None), (None, None, None), (None, None, None)]
    assert recovery.backfill_overlays(s, p.limit(0), ["model"]).where("aligned is null").count() == 5 and recovery.backfill_overlays(s.limit(0), p, ["model"]).count() == 0


def test_single_rows_are_paired_without_a_table_of_scores(spark, monkeypatch):
    def refuse(*_):
        raise AssertionError("a run of one row on each side")

    rows = [(d, d, "a", 1000 * d) for d in range(40)]
    schema = "document_id long, key long, content string, ts long"
    apart = [(d, 100 + d, "a", 1000 * d + 10 * d) for d in range(40)]
    source, history = spark.createDataFrame(rows, schema), spark.createDataFrame(apart, schema)
    monkeypatch.setattr(recovery, "match_in_order", refuse)
    cloudpickle.register_pickle_by_value(recovery)  # so that tasks see it refused
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        found = {r[1]: r[2] for r in recovery.match_recovered_prompts(source, history).collect()}
    finally:
        cloudpickle.unregister_pickle_by_value(recovery)
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert found == {100 + d: d if 10 * d <= 300 else None for d in range(40)}
