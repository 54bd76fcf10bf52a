"""Filter interaction audit as a stream with retractions.

Five filters are applied to documents in all 120 orders. A document's mask says which of
the filters it fails; the counts of masks by part give every order's numbers.

1. The files of the table are processed as available-now micro-batches of bounded size.
   Filters A to D are read from the text; E (a repeated text) depends on documents that
   may come later.
2. A batch counts all its documents as failing E, by part and mask. Then it corrects its
   counters for the rows of the least id of each text: they pass E, if no earlier batch
   holds a smaller id.
3. The state, keyed by the text's digest, holds the rows of the least id seen. It is a table
   that each batch adds to: of several entries of a text those of the least id count. When
   a smaller id arrives, the earlier rows are retracted: counted out of their mask and in
   again with E.
4. Each micro-batch writes its state rows and counter changes under its own number, so
   that a repeated batch counts once. The changes' sums are the counters; all orders
   follow from 80 pairs of a filter and the set of filters before it.

Rows are counted by (text, id) before they meet by text, and least ids are found with
partial aggregation, so that a text which very many documents share loads no task.
"""

from __future__ import annotations

import itertools
import math
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from threadloom.llm.common import SPACE, shared_dir

FILTERS = "ABCDE"
#: Bits of the mask: the filters in order, then good and toxic.
REPEATED, GOOD, TOXIC = 16, 32, 64
#: Bytes of files that a micro-batch takes for each core of the cluster.
CORE_BYTES = 512 << 20
#: What the state keeps of a text: the rows of its least id.
HELD = "key binary, missing boolean, id long, part string, bits int, n long"
AT = ["key", "missing", "id"]
HELD_KEYS = [*AT, "part", "bits"]


def text_mask(text: Column) -> Column:
    """Bits of the filters A to D for a text that isn't null."""
    words = F.array_remove(F.split(text, f"[{SPACE}]+"), "")
    n = F.size(words)
    return (
        F.when(n < 200, 1).otherwise(0)
        + F.when(100 * F.size(F.array_distinct(words)) < 50 * n, 2).otherwise(0)
        + F.when(100 * F.regexp_count(text, F.lit("[A-Z]")).cast("long") > 2 * F.length(text).cast("long"), 4).otherwise(0)
        + F.when(text.rlike("[#$%&*|]"), 8).otherwise(0)
    )


def masked(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """key, missing, id, part, bits of ``docs(doc_id, text, source)``: the text's digest, its place in the order of ids, its mask without E."""
    marked = labels.groupBy("doc_id").agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    text = F.coalesce("text", F.lit(""))
    read = docs.select("doc_id", F.coalesce("source", F.lit("")).alias("part"), text_mask(text).alias("mask"), F.unhex(F.sha2(text, 256)).alias("key"))
    bits = F.col("mask") + GOOD * F.coalesce("good", F.lit(0)) + TOXIC * F.coalesce("toxic", F.lit(0))
    return read.join(marked, "doc_id", "left").select(
        "key", F.isnull("doc_id").alias("missing"), F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("id"), "part", bits.alias("bits")
    )


def _least(rows: DataFrame) -> DataFrame:
    """The rows of the least id of each text; a null id is behind all others."""
    first = rows.groupBy("key").agg(F.min("missing").alias("missing"), F.min(F.when(~F.col("missing"), F.col("id"))).alias("id"))
    return rows.join(first.withColumn("id", F.coalesce("id", F.lit(0))), AT, "left_semi")


def _moved(rows: DataFrame, passes: bool) -> DataFrame:
    """Counter changes that let rows pass E, or fail it again."""
    sign = 1 if passes else -1
    moves = F.array(F.struct(F.col("bits").alias("bits"), (sign * F.col("n")).alias("n")), F.struct(F.col("bits").bitwiseOR(REPEATED).alias("bits"), (-sign * F.col("n")).alias("n")))
    return rows.select("part", F.inline(moves))


def settle(batch: DataFrame, state: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows that join the state, and the changes (part, bits, n) of the counters, for a batch of counted ``masked`` rows."""
    own = _least(batch)
    touched = state.join(own.select("key").distinct(), "key", "left_semi")
    before = _least(touched).groupBy(*HELD_KEYS).agg(F.sum("n").alias("n"))
    known = before.select("key", F.struct("missing", "id").alias("before")).distinct()
    here = F.struct("missing", "id")
    joins = own.join(known, "key", "left").where(F.col("before").isNull() | (here <= F.col("before"))).drop("before")
    beaten = own.select("key", here.alias("now")).distinct()
    retracted = before.join(beaten, "key").where(F.col("now") < here).select("part", "bits", "n")
    failing = batch.select("part", F.col("bits").bitwiseOR(REPEATED).alias("bits"), "n")
    return joins, failing.unionByName(_moved(joins, True)).unionByName(_moved(retracted, False))


def audit_orders(counters: DataFrame) -> DataFrame:
    """All orders' numbers by part from ``counters(part, bits, n)``."""
    pairs = [
        (1 << i, before, math.factorial(before.bit_count()) * math.factorial(4 - before.bit_count()))
        for i in range(5) for before in range(32) if not before >> i & 1
    ]
    pair = F.explode(F.array(*[F.struct(F.lit(bit).alias("bit"), F.lit(before).alias("before"), F.lit(n).alias("orders")) for bit, before, n in pairs]))
    rows = counters.select("part", "bits", "n", pair.alias("pair")).select("part", "bits", "n", "pair.*")
    mask = F.col("bits").bitwiseAND(31)
    here, fails = mask.bitwiseAND(F.col("before")) == 0, mask.bitwiseAND(F.col("bit")) > 0

    def total(condition: Column) -> Column:
        return F.sum(F.when(condition, F.col("n")).otherwise(0))

    counted = rows.groupBy("part", "bit", "before", "orders").agg(
        total(here & ~fails).alias("kept"),
        total(here & fails).alias("removed"),
        total(~here & fails).alias("redundant"),
        total(mask == F.col("bit")).alias("unique_fails"),
        total(here & fails & (F.col("bits").bitwiseAND(GOOD) > 0)).alias("good_lost"),
        total(here & fails & (F.col("bits").bitwiseAND(TOXIC) > 0)).alias("toxic_lost"),
    )
    counted = counted.withColumn("shapley", F.sum(F.col("removed") * F.col("orders")).over(Window.partitionBy("part", "bit")))
    steps = []
    for order in itertools.permutations(range(5)):
        name = "".join(FILTERS[i] for i in order)
        steps += [(name, k + 1, 1 << i, sum(1 << j for j in order[:k])) for k, i in enumerate(order)]
    orders = counters.sparkSession.createDataFrame(steps, "filter_order string, step int, bit int, before int")
    return counted.join(F.broadcast(orders), ["bit", "before"]).select(
        "part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"
    )


def audit_filters(spark: SparkSession, path: str, labels: DataFrame, batch_bytes: int | None = None) -> DataFrame:
    """How the filters A to E meet, for each part and each order of them.

    ``path`` holds Parquet files of ``documents(doc_id, text, source)``, with integer ids, and
    ``labels(doc_id, quality, toxic)`` marks some of them; columns beyond these are ignored.
    ``batch_bytes`` bounds the files of a micro-batch, ``CORE_BYTES`` for each core by default.
    Returns part, filter_order, step, kept, removed, redundant, unique_fails, good_lost,
    toxic_lost, shapley: 600 rows for each part that has documents.

    A: under 200 words. B: under half of the words distinct. C: over 2 % capital letters. D: any of
    ``#$%&*|``. E: a smaller doc_id has the identical text. A null text is empty (and fails A), a null
    source is the part ''. A row without an id comes behind all ids: it fails E if a row with an id has
    its text. Rows that repeat an id and text both count, and neither is before the other. Of several
    labels of a document any that is set counts. An empty table gives no rows.
    """
    folder = f"{shared_dir(spark)}/audit-{uuid.uuid4().hex}"
    size = batch_bytes or CORE_BYTES * spark.sparkContext.defaultParallelism
    path = path.rstrip("/")
    # As a pattern, the path may also name a single file.
    stream = spark.readStream.schema(spark.read.parquet(path).schema).option("maxBytesPerTrigger", size).parquet(f"{path[:-1]}[{path[-1]}]")

    counters = "part string, bits int, n long"
    for name, schema in (("state", HELD), ("changes", counters)):
        spark.createDataFrame([], schema).write.parquet(f"{folder}/{name}/batch=-1")

    def process(batch: DataFrame, number: int) -> None:
        session = batch.sparkSession
        batch.groupBy(*HELD_KEYS).agg(F.count("*").alias("n")).write.mode("overwrite").parquet(f"{folder}/rows/batch={number}")
        rows = session.read.schema(HELD).parquet(f"{folder}/rows/batch={number}")
        state = session.read.schema(f"{HELD}, batch int").parquet(f"{folder}/state").where(F.col("batch") < number).drop("batch")
        joins, changes = settle(rows, state)
        changes.groupBy("part", "bits").agg(F.sum("n").alias("n")).write.mode("overwrite").parquet(f"{folder}/changes/batch={number}")
        joins.write.mode("overwrite").parquet(f"{folder}/state/batch={number}")

    writer = masked(stream, labels).writeStream.foreachBatch(process).option("checkpointLocation", f"{folder}/checkpoint")
    writer.trigger(availableNow=True).start().awaitTermination()
    changes = spark.read.schema(counters).parquet(f"{folder}/changes")
    return audit_orders(changes.groupBy("part", "bits").agg(F.sum("n").alias("n")))
