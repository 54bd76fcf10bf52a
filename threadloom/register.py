"""The library's expressions as SQL functions, and its splitters as table functions."""

from __future__ import annotations

import inspect
from collections.abc import Callable, Iterator

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

from threadloom.functions import text as T
from threadloom.operators import predicates
from threadloom.operators.search import chunks_of
from threadloom.sources.transcripts import json_spans

#: Expressions over strings, by the name under which SQL finds them.
FUNCTIONS: dict[str, Callable[..., Column]] = {
    "redact": T.redact, "count_secrets": T.count_secrets, "strip_terminal": T.strip_terminal, "strip_system_tags": T.strip_system_tags, "clean_title": T.clean_title,
    "compact_title": T.compact_title, "normalize_query": T.normalize_query, "normalize_status": T.normalize_status, "model_family": T.model_family,
    "anonymize_ip": T.anonymize_ip, "host_name": T.host_name, "platform": T.platform, "host_id": T.host_id, "subagent_root": T.subagent_root,
    "subagent_depth": T.subagent_depth, "safe_filename": T.safe_filename, "safe_int": predicates.safe_int, "has_generated_title": predicates.has_generated_title,
}


class ChunkText:
    def eval(self, content: str) -> Iterator[tuple[int, str]]:
        yield from enumerate(chunks_of(content or ""))


class FrameJson:
    def eval(self, content: str) -> Iterator[tuple[int, str]]:
        yield from enumerate(json_spans(content or ""))


def register(spark: SparkSession, prefix: str = "tl_") -> list[str]:
    """Register all functions in a session, names behind ``prefix``; returns the names.

    Scalar functions are SQL functions: the optimizer sees their expressions, no Python runs. The table
    functions ``chunk_text(content)`` (chunk_index, chunk) and ``frame_json(content)`` (position, record) join laterally.
    Texts without chunks or records drop out of such a join; LEFT JOIN LATERAL keeps them only with ON true (Spark 4.1), which joins by the whole text.
    """
    names = []
    for name, function in FUNCTIONS.items():
        given = [p.name for p in inspect.signature(function).parameters.values() if p.default is p.empty]
        inputs = spark.range(0).select(*[F.lit("").alias(p) for p in given])
        plan = inputs.select(function(*[F.col(p) for p in given]).alias("out"))._jdf.queryExecution().analyzed()
        body = plan.projectList().head().child().sql()
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {prefix}{name}({', '.join(f'{p} STRING' for p in given)}) RETURN {body}")
        names.append(prefix + name)
    for name, made, schema in (("chunk_text", ChunkText, "chunk_index int, chunk string"), ("frame_json", FrameJson, "position int, record string")):
        spark.udtf.register(prefix + name, udtf(made, returnType=schema, useArrow=True))
        names.append(prefix + name)
    return names
