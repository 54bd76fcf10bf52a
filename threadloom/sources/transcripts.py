"""Readers of transcripts, notes and JSON documents, and dated snapshots of tables."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Longest record that is framed, in characters.
MAX_RECORD = 16 << 20

#: What opens a record, and what counts inside one: a whole string (or one that never ends) and braces.
_OPEN = re.compile(r"\{")
_MARKS = re.compile(r'"(?:[^"\\]|\\.)*+(?:"|\\?\Z)|[{}]', re.DOTALL)

#: Rules of a path table at most.
MAX_RULES = 1000


def read_transcripts(spark: SparkSession, path: str) -> DataFrame:
    """file, text and the parsed type, time and title of each non-blank line of JSONL files.

    A malformed line keeps its text; its parsed columns are null.
    """
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("text"))
    record = F.try_parse_json("text")

    def part(name: str):
        return F.try_variant_get(record, f"$.{name}", "string")

    return lines.where(F.trim("text") != "").select(
        "file", "text", part("type").alias("type"), part("timestamp").alias("timestamp"), part("aiTitle").alias("ai_title"), record.isNotNull().alias("valid")
    )


def transcript_files(lines: DataFrame) -> DataFrame:
    """Per file of ``read_transcripts``: lines, types with their counts, first and last time, and latest title."""
    by_type = lines.groupBy("file", "type").agg(
        F.count("*").alias("n"), F.min("timestamp").alias("first_ts"), F.max("timestamp").alias("last_ts"),
        F.max_by("ai_title", F.when(F.col("ai_title").isNotNull(), F.coalesce("timestamp", F.lit("")))).alias("ai_title"),
        F.max(F.when(F.col("ai_title").isNotNull(), F.coalesce("timestamp", F.lit("")))).alias("titled"),
    )
    types = F.map_from_entries(F.array_sort(F.collect_list(F.when(F.col("type").isNotNull(), F.struct("type", "n")))))
    return by_type.groupBy("file").agg(
        F.sum("n").alias("lines"), types.alias("types"), F.min("first_ts").alias("first_ts"), F.max("last_ts").alias("last_ts"),
        F.max_by("ai_title", "titled").alias("ai_title"),
    )


def json_spans(value: str, longest: int | None = MAX_RECORD) -> Iterator[str]:
    """The outermost ``{...}`` of a text; braces inside strings don't count. Only quotes and braces are looked at."""
    depth, start, at = 0, 0, 0
    while mark := (_MARKS if depth else _OPEN).search(value, at):
        at, found = mark.end(), mark[0]
        if found == "{":
            start = start if depth else mark.start()
            depth += 1
        elif found == "}":
            depth -= 1
            if not depth and (longest is None or at - start <= longest):
                yield value[start:at]


def frame_json_objects(df: DataFrame, text: str, longest: int | None = MAX_RECORD) -> DataFrame:
    """The JSON objects that a text holds one after another, however they are broken into lines.

    Adds ``position`` and ``record``. Records that don't parse, or are longer than ``longest`` characters
    (None: no bound), are dropped.
    """
    schema = StructType([*df.schema.fields]).add("position", "integer").add("record", "string")

    def framed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [(*row, i, record) for row in frame.itertuples(index=False) for i, record in enumerate(json_spans(getattr(row, text) or "", longest))]
            yield pd.DataFrame(rows, columns=schema.names)

    return df.mapInPandas(framed, schema).where(F.try_parse_json("record").isNotNull())


def read_markdown_notes(spark: SparkSession, path: str) -> DataFrame:
    """file, title and body of Markdown notes; the title is that of the front matter, the first heading or the file."""
    notes = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("raw"))
    head = F.regexp_extract("raw", r"(?s)\A---\r?\n(.*?)\r?\n---[ \t]*(?:\r?\n|\z)", 1)
    body = F.regexp_replace("raw", r"(?s)\A---\r?\n.*?\r?\n---[ \t]*(?:\r?\n|\z)", "")
    named = F.trim(F.regexp_replace(F.regexp_extract(head, r"(?m)^title:[ \t]*(.*)$", 1), "^[\"']|[\"']$", ""))
    heading = F.trim(F.regexp_extract(body, r"(?m)^# (.*)$", 1))
    stem = F.regexp_replace(F.url_decode(F.element_at(F.split("file", "/"), -1)), r"\.[^.]*$", "")
    return notes.select("file", F.coalesce(F.nullif(named, F.lit("")), F.nullif(heading, F.lit("")), stem).alias("title"), body.alias("body"))


def read_json_documents(spark: SparkSession, path: str) -> DataFrame:
    """file, raw text, whether it parses, and its first 20 top-level keys."""
    docs = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("raw"))
    parsed = F.try_parse_json("raw").isNotNull()
    return docs.select("file", "raw", parsed.alias("parsed"), F.when(parsed, F.slice(F.json_object_keys("raw"), 1, 20)).alias("keys"))


def classify_paths(df: DataFrame, rules: DataFrame) -> DataFrame:
    """``df(path)`` with the tool, category and kind of the first of ``rules`` whose pattern the path meets.

    ``rules(priority, pattern, tool, category, kind, excluded)`` is a short table, which
    becomes one ordered expression; more than ``MAX_RULES`` rules are an error. A path
    whose first rule excludes it, and one that no rule knows, is dropped.
    """
    rows = rules.orderBy("priority", "pattern").limit(MAX_RULES + 1).collect()
    if len(rows) > MAX_RULES:
        raise ValueError(f"more than {MAX_RULES} rules")
    kind = F.lit(None).cast("int")
    for i, r in reversed(list(enumerate(rows))):
        kind = F.when(F.col("path").rlike(r["pattern"]), i).otherwise(kind)
    known = df.withColumn("_rule", kind)
    names = F.array(*[F.struct(*[F.lit(r[c]).cast("string").alias(c) for c in ("tool", "category", "kind")]) for r in rows]) if rows else None
    if names is None:
        return df.where("false").selectExpr("*", "'' AS tool", "'' AS category", "'' AS kind")
    kept = known.where(F.col("_rule").isin([i for i, r in enumerate(rows) if not r["excluded"]]))
    return kept.withColumn("_r", F.element_at(names, F.col("_rule") + 1)).select(*[F.col(c) for c in df.columns], "_r.tool", "_r.category", "_r.kind")


def snapshot_tables(tables: dict[str, DataFrame], date: str, root: str) -> None:
    """Write each table whole under the date."""
    for name, table in tables.items():
        table.write.mode("overwrite").parquet(f"{root}/{name}/date={date}")


def kept_snapshots(dates: DataFrame, today: str, keep_days: int = 14) -> DataFrame:
    """The dates (a column ``date``) that retention keeps."""
    return dates.where(F.datediff(F.lit(today).cast("date"), F.col("date").cast("date")) <= keep_days)


def render_markdown(messages: DataFrame) -> DataFrame:
    """One Markdown text for each conversation: numbered prompts, then what answered them, in order of lines."""
    from pyspark.sql import Window

    order = Window.partitionBy("document_id").orderBy("line_number").rowsBetween(Window.unboundedPreceding, 0)
    number = F.sum((F.col("role") == "user").cast("int")).over(order)
    heading = F.when(F.col("role") == "user", F.format_string("## Prompt %d", number)).otherwise(F.concat(F.lit("### "), F.initcap("role")))
    parts = messages.select("document_id", "line_number", F.concat_ws("\n\n", heading, "content").alias("part"))
    sections = F.transform(F.array_sort(F.collect_list(F.struct("line_number", "part"))), lambda x: x["part"])
    return parts.groupBy("document_id").agg(F.array_join(sections, "\n\n").alias("markdown"))
