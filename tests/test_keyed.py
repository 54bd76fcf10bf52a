"""Keyed streams over several runs: late, repeated and expired rows."""

import random

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from threadloom.streaming import keyed
from threadloom.streaming.runs import run_available

HOUR = 3600


@pytest.fixture
def feed(spark, tmp_path):
    def run(operator, schema, batches):
        for rows in batches:
            frame = spark.createDataFrame(rows, schema).withColumn("at", F.timestamp_seconds("ts"))
            frame.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
            out = run_available(operator(spark.readStream.schema(frame.schema).parquet(str(tmp_path / "in"))), "t", str(tmp_path / "out"))
        return sorted(tuple(r) for r in out.collect())

    return run


DELTA = "source long, mode string, base_offset long, byte_offset long, hash string, ts long"


def test_deltas_in_any_order_end_alike(feed):
    rng = random.Random(1)
    rows = [(s, "full" if k == 0 else "delta", None if k == 0 else 10 * k, 10 * (k + 1), f"{s}:{k}", 100) for s in range(8) for k in range(7) if not (s == 3 and k == 4)]
    rows += rng.sample(rows, 10)
    rng.shuffle(rows)
    found = feed(lambda s: keyed.contiguous_deltas(s, wait_seconds=10 * HOUR), DELTA, [rows[i::3] for i in range(3)])
    accepted = sorted((r[0], r[1]) for r in found if r[3] == "accepted")
    assert accepted == sorted((s, 10 * (k + 1)) for s in range(8) for k in range(7) if s != 3 or k < 4)
    assert {r[3] for r in found} <= {"accepted", "stale"}


def test_a_gap_that_never_closes_expires(feed):
    early = [(1, "full", None, 10, "a", 0), (1, "delta", 20, 30, "c", 0), (1, "delta", 5, 25, "x", 0)]
    found = feed(lambda s: keyed.contiguous_deltas(s, wait_seconds=HOUR), DELTA, [early, [(2, "full", None, 10, "b", 5 * HOUR)], [(1, "delta", 10, 20, "d", 5 * HOUR)], [(1, "full", None, 90, "e", 5 * HOUR)]])
    assert found == [(1, 10, "a", "accepted"), (1, 20, "d", "accepted"), (1, 25, "x", "mismatched"), (1, 30, "c", "expired"), (1, 90, "e", "accepted"), (2, 10, "b", "accepted")]


SIGNAL = "session long, is_document boolean, signal_id string, kind string, payload string, ts long"


def test_a_signal_waits_for_its_document_and_comes_once(feed):
    waits = {"activity": HOUR, "title": 100 * HOUR}
    first = [(1, False, "a", "activity", "old", 10), (1, False, "t", "title", "kept", 10), (2, False, "a", "activity", "never", 10), (3, False, "a", "activity", "x", 10)]
    second = [(1, False, "a", "activity", "new", 20), (1, False, "a", "activity", "older", 15)]
    third = [(1, True, None, None, None, 500), (3, True, None, None, None, 10 + HOUR), (2, False, "t", "title", "late", 9000)]
    fourth = [(1, True, None, None, None, 600), (1, False, "a", "activity", "direct", 700), (2, True, None, None, None, 9100)]
    found = feed(lambda s: keyed.inbox(s, waits=waits), SIGNAL, [first, second, third, fourth])
    assert found == [(1, "a", "direct", 700), (1, "a", "new", 500), (1, "t", "kept", 500), (2, "t", "late", 9100)]


EVENT = "document_id long, place long, status string, interaction_id string, kind string, fingerprint string, ts long"


def test_questions_over_runs_equal_one_fold(feed):
    rng = random.Random(7)
    rows = [
        (d, i, rng.choice(["pending", "pending", "answered", "cancelled", "human"]), rng.choice("abcd"), None, None, 60 * i) for d in range(4) for i in range(40)
    ]
    kinds = {"a": ("ask", "f"), "b": ("wrapper", "f"), "c": ("permission", "g"), "d": ("ask", "h")}
    rows = [(*r[:4], *kinds[r[3]], r[6]) for r in rows]
    found = feed(keyed.interaction_state, EVENT, [[r for r in rows if low <= r[1] < low + 10] for low in range(0, 40, 10)])
    for d in range(4):
        pending, history, human = {}, {}, -1
        for r in sorted(r for r in rows if r[0] == d):
            human = keyed.advance_questions(pending, history, human, (r[2], r[3], r[4], r[5], r[6]))
        last = max(r for r in found if r[0] == d)
        assert last[2] == sorted(pending) and last[3] == [f"{k}:{v[0]}" for k, v in sorted(history.items(), key=lambda kv: (-kv[1][1], kv[0]))]


def test_open_questions_are_forgotten_and_history_is_bounded(feed):
    late = [(2, 9, "human", "x", "ask", "f", 50 * HOUR)]
    found = feed(lambda s: keyed.interaction_state(s, HOUR, 2), EVENT, [[(1, i, "pending", f"p{i}", "permission", "f", i) for i in range(4)], late, late])
    assert found[0] == (1, 1, ["p0", "p1", "p2", "p3"], ["p3:pending", "p2:pending"])
    assert max(r for r in found if r[0] == 1)[2] == []


def test_wrappers_and_questions_of_one_fingerprint():
    pending, history = {}, {}
    for event in [("pending", "w", "wrapper", "f", 1), ("pending", "q", "ask", "f", 2), ("pending", "w", "wrapper", "f", 3)]:
        keyed.advance_questions(pending, history, -1, event)
    assert list(pending) == ["q"] and keyed.advance_questions(pending, history, -1, ("human", "", "", "", 9)) == 9
    keyed.advance_questions(pending, history, 9, ("pending", "q", "ask", "f", 9))
    assert pending == {}


def test_title_rules():
    state = ("t", "fallback", {"m": 5})
    assert keyed.advance_title(state, ("m", 3, "t", "custom")) == (state, "ignored")
    assert keyed.advance_title(state, ("m", 3, "u", "unknown")) == (("u", "unknown", {"m": 3}), "updated")
    assert keyed.advance_title(state, ("n", 1, "t", "fallback")) == (("t", "fallback", {"m": 5, "n": 1}), "ticked")
    assert keyed.advance_title(("t", "custom", {}), ("m", 1, "u", "fallback")) == (("t", "custom", {"m": 1}), "kept")
    assert keyed.advance_title(("t", "manual", {}), ("m", 1, "u", "custom"))[1] == "kept"
    assert keyed.advance_title(("t", "custom", {"a": 1, "b": 2, "c": 3}), ("d", 1, "u", "custom"), most=3)[0][2] == {"b": 2, "c": 3, "d": 1}


def test_titles_shuffled_across_machines_end_alike(feed):
    """Renames of one machine in order, in whatever order the machines' deliveries meet, end with the newest in time."""
    rows = [(1, 10 * i, i, f"m{i % 3}", i, f"t{i}", "custom") for i in range(12)]
    schema = "document_id long, ts long, place long, machine string, revision long, title string, kind string"
    random.Random(3).shuffle(rows)
    found = feed(keyed.title_revisions, schema, [rows])
    assert max(found)[2:4] == ("t11", "custom") and max(found)[5] == ["m0=9", "m1=10", "m2=11"]


def test_deltas_of_one_batch_go_by_their_offsets(feed):
    rows = [(1, "full", None, 90, "e", 0), (1, "delta", 10, 20, "b", 0), (1, "delta", 30, 40, "d", 0), (1, "full", None, 10, "a", 0)]
    found = feed(keyed.contiguous_deltas, DELTA, [rows])
    assert found == [(1, 10, "a", "accepted"), (1, 20, "b", "accepted"), (1, 40, "d", "stale"), (1, 90, "e", "accepted")]


class Calls:
    """A state store that counts its calls."""

    def __init__(self):
        self.calls, self.held, self.timers = 0, {}, []

    def __getattr__(self, name):
        def call(*args):
            self.calls += 1
            if name in ("getValueState", "getMapState"):
                return self.held.setdefault(args[0], Calls())
            if name == "registerTimer":
                self.timers.append(args[0])
            if name == "iterator":
                return iter(())
            return None if name == "get" else False

        return call


def test_a_session_asks_its_state_a_few_times():
    handle, row = Calls(), Row("ts", "is_document", "signal_id", "kind", "payload")
    inbox = keyed.Inbox(keyed.WAITS)
    inbox.init(handle)
    rows = [row(i, False, f"s{i % 2}", "title", f"p{i}") for i in range(100)]
    assert list(inbox.handleInputRows((1,), iter(rows), None)) == []
    assert sum(h.calls for h in handle.held.values()) <= 5 and sorted(handle.timers) == [1000 * (t + keyed.WAITS["title"]) for t in (98, 99)]


def test_a_document_sets_one_timer_for_its_questions():
    handle, row = Calls(), Row("document_id", "place", "status", "interaction_id", "kind", "fingerprint", "ts")
    questions = keyed.Questions(60, 32)
    questions.init(handle)
    rows = [row(1, i, "pending", f"p{i}", "permission", "f", i) for i in range(50)]
    assert len(list(questions.handleInputRows((1,), iter(rows), None))) == 1
    assert handle.timers == [60_000] and sum(h.calls for h in handle.held.values()) <= 2
