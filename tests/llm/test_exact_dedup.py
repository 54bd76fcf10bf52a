"""Exact duplicates against a plain grouping, on odd rows and on groups that part late."""

import hashlib
import random
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from threadloom.llm import exact_dedup


def plain(rows):
    groups = defaultdict(list)
    for i, text in rows:
        groups[re.sub(r"[\x20\x09-\x0D]+", " ", text or "")].append(i)
    out = []
    for text, ids in groups.items():
        known = [i for i in ids if i is not None]
        keep = min(known) if known else None
        stays = True
        for i in sorted(ids, key=lambda i: (i is None, i)):
            out.append((i, keep, len(ids), stays, hashlib.sha256(text.encode()).hexdigest()))
            stays = False
    return sorted(out, key=repr)


def found(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(1) for c in "row part chunk size rest n kept group_size next".split()})
    return sorted((tuple(r) for r in exact_dedup.exact_duplicates(docs.repartition(3)).collect()), key=repr)


def test_odd_rows(spark):
    rows = [
        (1, None), (2, ""), (3, " \n"), (4, "\t"), (5, "a b"), (6, "a  \r\n b"), (6, "a b"), (6, "a b"), (7, " a b"), (8, "a b"), (9, "A b"),
        (None, "a b"), (None, "only without id"), (None, "only without id"), (10, "ünï 漢字 🙂"), (11, "ünï\t漢字 🙂"), (12, "nul\x00byte"), (13, "nul\x00byte"),
    ]
    assert found(spark, rows) == plain(rows)


@pytest.mark.parametrize("heads", [1, 64, 65, 1088, 1089, 17_000, 40_000])
def test_texts_that_part_at_any_place(spark, heads):
    rng = random.Random(heads)
    head = "".join(rng.choice("abc ") for _ in range(heads))
    rows = [(i, head + tail) for i, tail in enumerate(["x", "y", "x", "", "xy", "yx", "x" * 300, "x" * 300, "x" * 299 + "y"])]
    assert found(spark, rows) == plain(rows)


def test_large_group_and_empty_table(spark):
    rows = [(i, "one text that very many share " * 50) for i in range(3000)] + [(9000 + i, f"text {i}") for i in range(30)]
    assert found(spark, rows) == plain(rows)
    assert found(spark, []) == []
