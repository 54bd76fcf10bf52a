"""Keyed state of the live paths: chains of deltas, waiting signals, open questions, title clocks.

Each operator is a ``StatefulProcessor`` for ``transformWithState``, but for the chains, whose state is a
table; its rules stand in one function over plain values, so that a batch form can fold the same rows in order.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from threadloom.streaming.runs import Folded

DAY = 86_400
#: Seconds that a signal of each kind waits for its document; other kinds wait like titles.
WAITS = {"activity": 2 * DAY, "interaction": 7 * DAY, "title": 30 * DAY}
#: Entries of a document's history, its title clocks, and seconds that a question stays open.
HISTORY, CLOCKS, OPEN_SECONDS = 32, 32, 7 * DAY


# Rows that the processors give.
Applied = Row("session", "signal_id", "payload", "applied_at")
Asked = Row("document_id", "revision", "pending", "history")
Titled = Row("document_id", "revision", "title", "source", "updates", "clocks")


class _Processor(StatefulProcessor):
    def close(self) -> None:
        pass


def _timed(rows: DataFrame, lateness: str) -> DataFrame:
    """The rows under a watermark that fires timers; without the time's column no late row is dropped."""
    return rows.withWatermark("at", lateness).drop("at")


# --- chains of deltas ----------------------------------------------------------------

#: Rows of a source's state among its deliveries, and of the stream's watermark.
COMMITTED, HELD, WATERMARK = "committed", "held", "watermark"
PLACED = "source long, byte_offset long, hash string, disposition string, base_offset long, expires long"
PLACED_COLUMNS = [c.split()[0] for c in PLACED.split(", ")]


def place_delta(committed: int, mode: str, base: int | None, end: int) -> str:
    """What becomes of a delivery whose source is committed up to ``committed``: accepted, stale, mismatched or ahead."""
    if end <= committed:
        return "stale"
    if mode == "full" or base == committed:
        return "accepted"
    return "ahead" if base is not None and base > committed else "mismatched"


def _chained(passed: int) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """Over rows sorted by source, its state first, what becomes of each delivery, and the state behind it. ``passed``: the watermark."""

    def ended(source: int, committed: int, held: dict) -> Iterator[tuple]:
        for (end, name), (base, expires) in held.items():
            what = place_delta(committed, "delta", base, end)
            yield source, end, name, ("expired" if expires <= passed else HELD) if what == "ahead" else what, base, expires
        yield source, committed, None, COMMITTED, None, None

    def chain(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        source, committed, held = None, 0, {}
        for frame in frames:
            out: list[tuple] = []
            for key, state, mode, base, end, name, expires in frame.itertuples(index=False, name=None):
                base = None if pd.isna(base) else base
                if key != source:
                    if source is not None:
                        out.extend(ended(source, committed, held))
                    source, committed, held = key, 0, {}
                if state == COMMITTED:
                    committed = end
                    continue
                what = place_delta(committed, mode, base, end)
                if what == "ahead":
                    held.setdefault((end, name), (base, expires))
                    continue
                out.append((key, end, name, what, None, None))
                if what == "accepted":
                    committed = end
            yield pd.DataFrame(out, columns=PLACED_COLUMNS).astype({"base_offset": "Int64", "expires": "Int64"})
        if source is not None:
            yield pd.DataFrame(list(ended(source, committed, held)), columns=PLACED_COLUMNS).astype({"base_offset": "Int64", "expires": "Int64"})

    return chain


def contiguous_deltas(deliveries: DataFrame, wait_seconds: int = OPEN_SECONDS, lateness: str = "1 hour") -> Folded:
    """source, byte_offset, hash, disposition of a stream of deliveries, each as soon as it is known.

    ``deliveries(source, mode, base_offset, byte_offset, hash, ts, at)``, ts in seconds and at the same as a timestamp: a full delivery ahead of what
    is committed begins anew, a delta is accepted when its base is what is committed. One whose
    base is ahead waits; accepting its predecessor accepts it too. Others are stale (already
    covered) or mismatched (their base was passed over). What still waits for a gap to close
    when deliveries ``wait_seconds`` younger have come (behind ``lateness``) expires; its source needs
    a full delivery. No delivery is dropped for being late. Copies of a waiting delivery give no row.

    There are about as many sources as deliveries, so state is no store that Python asks for each key, but a table: a batch's
    deliveries and the state before it are sorted by source and offset and read as one stream.
    """

    def place(batch: DataFrame, before: DataFrame | None) -> DataFrame:
        passed = F.unix_millis(F.max("at") - F.expr(f"interval {lateness}"))
        marks = [batch.agg(passed.alias("m")).first()["m"]]
        new = batch.select("source", F.lit("new").alias("state"), "mode", "base_offset", "byte_offset", "hash", (F.col("ts") * 1000 + wait_seconds * 1000).alias("expires"))
        rows = new
        if before is not None:
            marks.append(before.where(F.col("disposition") == WATERMARK).select("byte_offset").first()[0])
            old = before.where(F.col("disposition").isin(COMMITTED, HELD)).select("source", F.col("disposition").alias("state"), F.lit("delta").alias("mode"), "base_offset", "byte_offset", "hash", "expires")
            rows = old.unionByName(new)
        mark = max((m for m in marks if m is not None), default=0)
        order = ["source", F.col("state") != COMMITTED, "byte_offset", F.col("state") == "new", F.col("mode") != "full", "base_offset", "hash"]
        sorted_rows = rows.where("source is not null").repartition("source").sortWithinPartitions(*order)
        placed = sorted_rows.mapInPandas(_chained(mark), PLACED)
        return placed.unionByName(batch.sparkSession.range(1).select(F.lit(mark).cast("long").alias("byte_offset"), F.lit(WATERMARK).alias("disposition")), allowMissingColumns=True)

    return Folded(deliveries, place, "source long, byte_offset long, hash string, disposition string", F.col("disposition").isin(COMMITTED, HELD, WATERMARK))


# --- signals that wait for their document ---------------------------------------------


class Inbox(_Processor):
    """Holds the newest payload of each signal until the document of the session arrives."""

    def __init__(self, waits: dict[str, int]):
        self.waits = waits

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.arrived = handle.getValueState("arrived", "ts long")
        self.held = handle.getMapState("held", "signal_id string", "payload string, ts long, expires long")

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        arrived = (self.arrived.get() or (None,))[0]
        # each call of the state is a message to the JVM: the session's signals are read once and written where they changed
        before = {k[0]: tuple(v) for k, v in self.held.iterator()} if arrived is None else {}
        held = dict(before)
        for row in sorted(rows, key=lambda r: (r["ts"], r["is_document"], r["signal_id"] or "", r["payload"] or "")):
            if row["is_document"]:
                if arrived is None:
                    arrived = row["ts"]
                    self.arrived.update((arrived,))
                    for signal in sorted(held, key=lambda s: s or ""):
                        payload, _, expires = held[signal]
                        if expires > arrived:
                            yield Applied(key[0], signal, payload, arrived)
                    held.clear()
                continue
            expires = row["ts"] + self.waits.get(row["kind"], self.waits["title"])
            if arrived is not None:
                if expires > arrived:
                    yield Applied(key[0], row["signal_id"], row["payload"], max(row["ts"], arrived))
                continue
            if row["signal_id"] not in held or held[row["signal_id"]][1] <= row["ts"]:
                held[row["signal_id"]] = (row["payload"], row["ts"], expires)
        if before and not held:
            self.held.clear()
        changed = {k: v for k, v in held.items() if before.get(k) != v}
        for k, v in changed.items():
            self.held.updateValue((k,), v)
        for expires in {v[2] for v in changed.values()}:
            self.handle.registerTimer(expires * 1000)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        now = expiredTimerInfo.getExpiryTimeInMs() // 1000
        for k in [tuple(k) for k, v in self.held.iterator() if v[2] <= now]:
            self.held.removeKey(k)
        return iter(())


def inbox(signals: DataFrame, lateness: str = "1 hour", waits: dict[str, int] | None = None) -> DataFrame:
    """session, signal_id, payload, applied_at: each signal once its document is there, at most one payload of those that waited.

    ``signals(session, is_document, signal_id, kind, payload, ts, at)`` holds signals and the arrivals
    of documents; ``ts`` is the event time in seconds, ``at`` the same as a timestamp for the
    watermark. A waiting signal takes a newer payload, and is dropped if the document arrives
    ``waits[kind]`` seconds or more behind it; state that the watermark has passed goes.
    """
    return _timed(signals, lateness).groupBy("session").transformWithState(
        Inbox(waits or WAITS), "session long, signal_id string, payload string, applied_at long", "Append", "EventTime"
    )


# --- questions ------------------------------------------------------------------------


def advance_questions(pending: dict, history: dict, human: int, event: Any, most: int = HISTORY) -> int:
    """Apply an event to a document's pending questions and history, both by id; returns the newest human turn's time.

    ``event``: (status, interaction_id, kind, fingerprint, ts). Kinds: ask (a question), wrapper (the
    permission request that repeats a question) and permission. pending holds (kind, fingerprint, ts),
    history (status, ts) of permissions.
    """
    status, key, kind, fingerprint, ts = event
    if status == "human":
        return max(human, ts)
    if status == "pending" and ts > human:
        twins = [k for k, v in pending.items() if k != key and v[1] == fingerprint and v[0] != "permission"] if kind != "permission" else []
        if kind == "wrapper" and twins:
            return human
        for k in twins:
            del pending[k]
        pending[key] = (kind, fingerprint, ts)
        if kind == "permission":
            history[key] = ("pending", min(ts, history[key][1]) if key in history else ts)
    else:
        pending.pop(key, None)
        if status != "pending" and key in history:
            history[key] = (status, min(ts, history[key][1]))
    for k in sorted(history, key=lambda k: (-history[k][1], k))[most:]:
        del history[k]
    return human


class Questions(_Processor):
    """Pending questions and the history of permissions of a document."""

    def __init__(self, open_seconds: int, most: int):
        self.open, self.most = open_seconds, most

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        # one value, as each call of the state is a message to the JVM; ``due`` is the timer that is set, -1 without one
        self.state = handle.getValueState("state", "human long, revision long, due long, pending string, history string")

    def _read(self) -> tuple[int, int, int, dict, dict]:
        human, revision, due, *maps = self.state.get() or (-1, 0, -1, "[]", "[]")
        return human, revision, due, *({k: tuple(v) for k, v in json.loads(m)} for m in maps)

    def _write(self, human: int, revision: int, due: int, pending: dict, history: dict) -> None:
        """Write the state with a timer for the question that is forgotten next, unless an earlier one is set."""
        following = min((v[2] + self.open for v in pending.values()), default=-1)
        if following >= 0 and (due < 0 or following < due):
            self.handle.registerTimer(following * 1000)
            due = following
        self.state.update((human, revision, due, *(json.dumps(list(m.items())) for m in (pending, history))))

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        human, revision, due, pending, history = self._read()
        before = dict(pending), dict(history)
        for r in sorted(rows, key=lambda r: (r["ts"], r["place"])):
            human = advance_questions(pending, history, human, (r["status"], r["interaction_id"], r["kind"], r["fingerprint"], r["ts"]), self.most)
        self._write(human, revision + 1, due, pending, history)
        if revision == 0 or (pending, history) != before:
            yield self._shown(key, revision + 1, pending, history)

    @staticmethod
    def _shown(key: Any, revision: int, pending: dict, history: dict) -> Row:
        newest = sorted(history.items(), key=lambda kv: (-kv[1][1], kv[0]))
        return Asked(key[0], revision, sorted(pending), [f"{k}:{v[0]}" for k, v in newest])

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        human, revision, _, pending, history = self._read()
        # all that the watermark has passed goes at once
        now = max(timerValues.getCurrentWatermarkInMs(), expiredTimerInfo.getExpiryTimeInMs()) // 1000
        over = [k for k, v in pending.items() if v[2] + self.open <= now]
        for k in over:
            del pending[k]
        self._write(human, revision + bool(over), -1, pending, history)
        if over:
            yield self._shown(key, revision + 1, pending, history)


def interaction_state(interactions: DataFrame, open_seconds: int = OPEN_SECONDS, most: int = HISTORY, lateness: str = "1 hour") -> DataFrame:
    """document_id, revision, pending (ids), history (id:status, newest first): a row for each change of a document's questions.

    ``interactions(document_id, place, status, interaction_id, kind, fingerprint, ts, at)``, at being ts as a timestamp; statuses are pending,
    answered, cancelled, and human for a human turn, behind which older questions are stale. A wrapper is
    passed over while a question of its fingerprint is pending, and goes when that question follows. Questions
    nobody answers are forgotten ``open_seconds`` later by the watermark. The highest revision is a document's state.
    """
    return _timed(interactions, lateness).groupBy("document_id").transformWithState(
        Questions(open_seconds, most), "document_id long, revision long, pending array<string>, history array<string>", "Append", "EventTime"
    )


# --- titles ---------------------------------------------------------------------------


def advance_title(state: tuple, event: Any, most: int = CLOCKS) -> tuple[tuple, str]:
    """The state (title, source, clocks) after an update (machine, revision, title, kind), and what became of it.

    A revision is only compared with those of its own machine: a lower one with the title that stands
    is ignored, a lower one with another title comes from a restored clock and counts. Manual titles
    stay; after a rename (custom) only renames count. Of more than ``most`` clocks the first by name goes.
    """
    title, source, clocks = state
    machine, revision, new, kind = event
    if revision < clocks.get(machine, 0) and new == title:
        return state, "ignored"
    others = sorted(k for k in clocks if k != machine)[-(most - 1) :] if most > 1 else []
    ticked = {**{k: clocks[k] for k in others}, machine: revision}
    if source == "manual" or (source == "custom" and kind != "custom"):
        return (title, source, ticked), "kept"
    return (new, kind, ticked), "updated" if new != title else "ticked"


class Titles(_Processor):
    """The title of a document and the clocks of the machines that set it."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.title = handle.getValueState("title", "title string, source string, revision long, updates long")
        self.clocks = handle.getMapState("clocks", "machine string", "revision long")

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        title, source, revision, updates = self.title.get() if self.title.exists() else (None, None, 0, 0)
        before = {k[0]: v[0] for k, v in self.clocks.iterator()}
        state, old = (title, source, before), updates
        for r in sorted(rows, key=lambda r: (r["ts"], r["place"])):
            if r["kind"] == "manual":
                state = (r["title"], "manual", state[2])
            else:
                state, what = advance_title(state, (r["machine"], r["revision"], r["title"], r["kind"]))
                updates += what == "updated"
        title, source, clocks = state
        for k in before.keys() - clocks.keys():
            self.clocks.removeKey((k,))
        for k, v in clocks.items():
            if before.get(k) != v:
                self.clocks.updateValue((k,), (v,))
        self.title.update((title, source, revision + 1, updates))
        if revision == 0 or updates != old or clocks != before:
            yield Titled(key[0], revision + 1, title, source, updates, [f"{k}={clocks[k]}" for k in sorted(clocks)])


def title_revisions(titles: DataFrame) -> DataFrame:
    """document_id, revision, title, source, updates, clocks: a row for each change of a document's title or clocks.

    ``titles(document_id, ts, place, machine, revision, title, kind)`` in kinds custom, fallback, unknown and
    manual (a title set by hand, which stays). The highest revision is a document's state.
    """
    return titles.groupBy("document_id").transformWithState(
        Titles(), "document_id long, revision long, title string, source string, updates long, clocks array<string>", "Append", "None"
    )
