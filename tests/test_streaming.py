from pathlib import Path

import pytest
from pyspark.sql import functions as F

from threadloom.bindings import bind
from threadloom.operators import ingest
from threadloom.sources import normalize
from threadloom.streaming import states

DATA = Path("/root/testdata/sf0.001")


@pytest.fixture
def streamed(spark, tmp_path):
    signals = bind(spark, str(DATA), "signals").withColumn("ts", F.col("ts").cast("timestamp"))
    signals.repartition(3).write.parquet(str(tmp_path / "in"))

    def run(operator, mode, name):
        stream = spark.readStream.schema(signals.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        query = operator(stream).writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        query.awaitTermination(120)
        return spark.table(name)

    return signals, run


def test_day_counts_equal_batch(streamed):
    signals, run = streamed
    found = run(lambda s: states.day_counts(s, "1000 days"), "complete", "days")
    batch = signals.groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day"), "status").agg(F.count("*").alias("n"))
    assert sorted(found.collect()) == sorted(batch.collect())


def test_dedup_drops_repeats(streamed):
    signals, run = streamed
    found = run(lambda s: states.event_dedup(s.union(s), "1000 days"), "append", "once")
    assert found.count() == signals.count()


def test_activity_state_never_reopens():
    assert states._advance(None, [(5, "completed")]) is None
    assert states._advance(None, [(5, "running"), (5, "failed"), (9, "running")]) == ("failed", 5, 5)
    assert states._advance(("running", 1, 8), [(7, "completed")]) == ("running", 1, 8)


def test_activity_state_in_one_batch_equals_batch_form(spark, streamed, tmp_path):
    signals, _ = streamed
    signals.coalesce(1).write.parquet(str(tmp_path / "one"))
    stream = spark.readStream.schema(signals.schema).parquet(str(tmp_path / "one"))
    out = states.activity_state(stream).writeStream.format("memory").queryName("acts").outputMode("update").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    out.awaitTermination(120)
    assert sorted(spark.table("acts").collect()) == sorted(states.activity_state_batch(signals).collect())


def test_transcript_files_stream_once(spark, tmp_path):
    (tmp_path / "in").mkdir()
    record = '{"role": "%s", "content": "%s", "timestamp": "t"}'

    def run():
        rows = states.stream_transcripts(spark, str(tmp_path / "in"), normalize.normalize_generic)
        query = rows.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        query.awaitTermination(120)
        return sorted((r["line_number"], r["role"], r["content"]) for r in spark.read.parquet(str(tmp_path / "out")).collect())

    (tmp_path / "in" / "a.jsonl").write_text("\n".join([record % ("user", "ask"), "", record % ("assistant", "yes"), "{broken"]))
    assert run() == [(1, "user", "ask"), (3, "assistant", "yes")]
    (tmp_path / "in" / "b.jsonl").write_text(record % ("user", "more"))
    assert run() == [(1, "user", "ask"), (1, "user", "more"), (3, "assistant", "yes")]


def test_streamed_read_model_equals_refresh(spark, tmp_path):
    messages = bind(spark, str(DATA), "messages")
    messages.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(messages.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = states.update_read_model(stream, str(tmp_path / "model"), str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    last = max((tmp_path / "model").glob("batch=*"))
    assert last.name == "batch=2"
    assert sorted(spark.read.parquet(str(last)).collect()) == sorted(ingest.refresh_read_model(messages).collect())
