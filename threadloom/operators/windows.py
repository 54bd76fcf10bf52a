"""Operators over ordered rows of a document, conversation or source."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_match_per_doc(messages: DataFrame, query: str) -> DataFrame:
    """Each document's first message that contains the query, ignoring case."""
    hits = messages.where(F.lower("content").contains(query.lower()))
    place = F.row_number().over(Window.partitionBy("document_id").orderBy("line_number", "message_id"))
    return hits.withColumn("place", place).where("place = 1").select("document_id", "line_number", F.substring("content", 1, 500).alias("content"))


def preview(messages: DataFrame, n: int = 4) -> DataFrame:
    """The first user and assistant messages of each document."""
    rows = messages.where(F.col("role").isin("user", "assistant"))
    place = F.row_number().over(Window.partitionBy("document_id").orderBy("line_number"))
    return rows.withColumn("place", place).where(F.col("place") <= n)


def number_prompts(messages: DataFrame) -> DataFrame:
    """User messages with their number in the document, from 1."""
    number = F.row_number().over(Window.partitionBy("document_id").orderBy("line_number"))
    return messages.where("role = 'user'").select("document_id", "line_number", number.alias("prompt"))


def prompt_spans(messages: DataFrame, first: int, last: int) -> DataFrame:
    """Lines that the prompts from ``first`` to ``last`` and their answers take up, adjacent spans joined."""
    order = Window.partitionBy("document_id").orderBy("line_number")
    end = F.coalesce(F.lead("line_number").over(order) - 1, F.lit(2**31 - 1))
    spans = number_prompts(messages).withColumn("end_line", end).where(F.col("prompt").between(first, last))
    spans = spans.withColumn("gap", (F.coalesce(F.lag("end_line").over(order), F.lit(-1)) + 1 != F.col("line_number")).cast("int"))
    spans = spans.withColumn("island", F.sum("gap").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return spans.groupBy("document_id", "island").agg(F.min("line_number").alias("start_line"), F.max("end_line").alias("end_line"))


def newest_per_key(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in the given order."""
    return df.withColumn("_place", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_place = 1").drop("_place")


def take_within_budget(df: DataFrame, part: str, order: list[str], text: str, budget: int, cap: int | None = None) -> DataFrame:
    """The ordered prefix of each part whose texts fit a budget of characters; the last one is cut."""
    cut = df.withColumn(text, F.substring(text, 1, cap)) if cap else df
    before = Window.partitionBy(part).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    used = F.coalesce(F.sum(F.length(text)).over(before), F.lit(0))
    return cut.withColumn("used", used).where(F.col("used") < budget).withColumn(text, F.expr(f"substring({text}, 1, cast({budget} - used as int))")).drop("used")


def carry_forward(df: DataFrame, part: str, order: str, column: str) -> DataFrame:
    """Each row with the latest value that was set up to it."""
    window = Window.partitionBy(part).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(column, F.last(column, ignorenulls=True).over(window))


def carry_turn(df: DataFrame, part: str, order: str, starts: Column, ends: Column) -> DataFrame:
    """The number of the open turn: a start opens the next, an end closes it behind its own row."""
    window = Window.partitionBy(part).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    marks = df.withColumn("_n", F.sum(starts.cast("int")).over(window)).withColumn(
        "_last", F.last(F.when(starts, F.lit("s")).when(ends, F.lit("e")), ignorenulls=True).over(window)
    )
    return marks.withColumn("turn_no", F.when((F.col("_last") == "s") | ends & (F.col("_n") > 0), F.col("_n"))).drop("_n", "_last")


def hits_per_group(hits: DataFrame, group: str, order: list[Column], per_group: int = 3, groups: int = 20) -> DataFrame:
    """The best hits of each of the best groups."""
    ranked = hits.withColumn("place", F.row_number().over(Window.partitionBy(group).orderBy(*order)))
    best = ranked.where("place = 1").orderBy(*order).limit(groups).select(group)
    return ranked.where(F.col("place") <= per_group).join(best, group, "left_semi")


def message_window(messages: DataFrame, document_id: int, line: int, before: int, after: int) -> DataFrame:
    """Messages of a document from ``before`` lines above a line to ``after`` lines below it, both included.

    Lines are numbers, not ranks: a line that is missing makes no room for one farther off, and all messages of a line count.
    """
    return messages.where((F.col("document_id") == document_id) & F.col("line_number").between(line - before, line + after))


def latest_assistant_line(messages: DataFrame) -> DataFrame:
    """Each document's last assistant line."""
    return messages.groupBy("document_id").agg(F.max(F.when(F.col("role") == "assistant", F.col("line_number"))).alias("line_number"))


def attention_then_recent(df: DataFrame, attention: Column, order: list[Column], n: int) -> DataFrame:
    """All rows that need attention, and the first n of the others."""
    rest = df.where(~attention).orderBy(*order).limit(n)
    return df.where(attention).unionByName(rest)


def dedup_source_ids(messages: DataFrame, source_id: str, part: str, order: str) -> DataFrame:
    """The first row of each source id in a part; rows without an id all stay."""
    place = F.row_number().over(Window.partitionBy(part, source_id).orderBy(order))
    return messages.withColumn("_place", F.when(F.col(source_id).isNull(), 1).otherwise(place)).where("_place = 1").drop("_place")
