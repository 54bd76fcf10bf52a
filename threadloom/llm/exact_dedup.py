"""Exact duplicates by distributed most-significant-digit radix partitioning.

A text is taken as a string of digits: its length in bytes first, then its bytes in
stretches. Round by round, groups that still agree are split by the next digit:

1. The first round splits all documents by their length and their first ``HEAD``
   bytes. Only these narrow keys are shuffled and counted. A document that is alone
   with its key is done; the others are written with the rest of their text and the
   number of their group.
2. Each further round splits the groups by their next stretch of bytes (``WIDTH``,
   growing by ``GROWTH`` up to ``WIDEST``). Stretches are counted on the map side
   before they are shuffled, so a group of any size sends one row from a task. A
   group is done when it has one member or its text has ended: since all members
   have agreed on every byte, they are equal. No digest tells texts apart.

Groups are named, not gathered: members are joined with the row of their group, and
a group of any size is split over tasks by Spark's handling of skewed joins, for
which both sides of a join lie in tables. Joins are sort-merge joins at every size, so
that the plan measured on a small table is the plan of a large one.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadloom.llm.common import SPACE, materialize

#: Bytes of the first split, of the second, their growth by round, and the most of one round.
HEAD, WIDTH, GROWTH, WIDEST = 64, 1 << 10, 16, 1 << 20


def normalised(text: Column) -> Column:
    """The text with each run of white space as one space; null is empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), f"[{SPACE}]+", " ")


def _split(rows: DataFrame, reach: int, name: str) -> DataFrame:
    """Rows with their group split by ``chunk``; ``done`` where the group is single or its text ends within ``reach``."""
    kept = F.coalesce(F.min_by("row", "doc_id"), F.min("row"))
    groups = rows.groupBy("part", "chunk").agg(
        F.min("row").alias("next"), F.count("*").alias("group_size"), F.min("doc_id").alias("keep_id"), kept.alias("keep_row")
    )
    joined = rows.hint("merge").join(materialize(groups, f"{name}-groups"), ["part", "chunk"])
    done = (F.col("group_size") == 1) | (F.col("size") <= reach)
    return materialize(
        joined.select("row", "doc_id", "text_sha256", "size", F.col("next").alias("part"), "group_size", "keep_id", "keep_row", done.alias("done")), name
    )


def exact_duplicates(docs: DataFrame) -> DataFrame:
    """Groups of documents whose texts are equal but for the width of white space.

    ``docs(doc_id, text)``; columns beyond these are ignored. Returns a row for each row
    of ``docs``: doc_id, keep_id (the least doc_id of its group), group_size, kept
    (this row stays), text_sha256 (of the normalised text, in lower-case hexadecimal; for
    the reader, the method doesn't use it).

    Null texts are empty texts, and empty texts are equal. White space at the ends counts as
    one space. Rows without a doc_id belong to groups like others but stay only where no
    row of the group has an id; of repeated rows one stays. An empty table gives no rows.
    """
    text = docs.select("doc_id", normalised(F.col("text")).alias("text"))
    cut = text.select("doc_id", F.sha2("text", 256).alias("text_sha256"), F.octet_length("text").alias("size"), F.col("text").cast("binary").alias("bytes"))
    headed = cut.withColumn("chunk", F.substring("bytes", 1, HEAD))
    shared = headed.groupBy("size", "chunk").agg(F.count("*").alias("n")).where("n > 1").select("size", "chunk", F.monotonically_increasing_id().alias("part"))
    joined = headed.hint("merge").join(materialize(shared, "heads"), ["size", "chunk"], "left")
    rest = F.when(F.col("part").isNotNull(), F.expr(f"substring(bytes, {HEAD + 1})"))
    base = materialize(joined.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text_sha256", "size", "part", rest.alias("rest")), "rests")

    columns = ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    alone = base.where("part is null").withColumns({"keep_id": F.col("doc_id"), "group_size": F.lit(1).cast("long"), "kept": F.lit(True)})
    found, active = [alone.select(columns)], base.where("part is not null")
    at, width = 0, WIDTH
    while not active.isEmpty():
        chunk = F.substring("rest", at + 1, width)
        if at:
            rows = base.where("part is not null").select("row", chunk.alias("chunk")).hint("merge").join(active, "row")
        else:
            rows = active.withColumn("chunk", chunk)
        at += width
        split = _split(rows.select("row", "doc_id", "text_sha256", "size", "part", "chunk"), HEAD + at, f"split-{at}")
        found.append(split.where("done").withColumn("kept", F.col("row") == F.col("keep_row")).select(columns))
        active, width = split.where("not done"), min(width * GROWTH, WIDEST)
    return reduce(DataFrame.unionAll, found)
