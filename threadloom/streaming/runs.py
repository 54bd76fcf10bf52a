"""Running a stream over all that is there, with its results as a table."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession

from threadloom.tables import shared_folder

#: Settings of keyed state: on disk beside each executor, its changes in the checkpoint.
STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}


@contextmanager
def keyed_state(spark: SparkSession) -> Iterator[None]:
    """While a stream starts, its state lies in RocksDB."""
    before = {k: spark.conf.get(k, None) for k in STATE}
    for k, v in STATE.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


@dataclass(frozen=True)
class Folded:
    """A stream whose state is a table: ``fold(batch, before)`` gives a batch's rows and the state behind it.

    ``before`` is what the batch before gave, None for the first; ``state`` tells its rows of state from results, whose columns are ``schema``.
    """

    stream: DataFrame
    fold: Callable[[DataFrame, DataFrame | None], DataFrame]
    schema: str
    state: Column


def _fold_available(folded: Folded, folder: str) -> DataFrame:
    spark = folded.stream.sparkSession

    def step(batch: DataFrame, n: int) -> None:
        # a repeated batch overwrites its own folder
        before = batch.sparkSession.read.parquet(f"{folder}/rows/batch={n - 1}") if n else None
        folded.fold(batch, before).write.mode("overwrite").parquet(f"{folder}/rows/batch={n}")

    folded.stream.writeStream.foreachBatch(step).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    names = [c.split()[0] for c in folded.schema.split(", ")]
    try:
        rows = spark.read.parquet(f"{folder}/rows")
    except AnalysisException:  # nothing has arrived yet
        return spark.createDataFrame([], folded.schema)
    return rows.where(~folded.state).select(*names)


def run_available(stream: DataFrame | Folded, name: str, folder: str | None = None) -> DataFrame:
    """All rows that an append-mode stream gives for what has arrived; in the same ``folder`` a later run goes on where this one ended."""
    spark = stream.stream.sparkSession if isinstance(stream, Folded) else stream.sparkSession
    folder = folder or f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    if isinstance(stream, Folded):
        return _fold_available(stream, folder)
    with keyed_state(spark):
        writer = stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", f"{folder}/checkpoint")
        writer.option("path", f"{folder}/rows").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/rows")
