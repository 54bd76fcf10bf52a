"""The filter audit against plain counting, with documents in many micro-batches and in bad order."""

import itertools
import random
import re
from collections import Counter

from pyspark.sql import functions as F

from threadloom.llm import filter_audit

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(docs, labels):
    least = {}
    for i, text, _ in docs:
        at = (i is None, i or 0)
        least[text or ""] = min(least.get(text or "", at), at)
    good, toxic = {i for i, q, _ in labels if q == 1}, {i for i, _, t in labels if t == 1}
    marked = []
    for i, text, source in docs:
        text = text or ""
        words = WORD.findall(text)
        fails = {
            "A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words), "C": 100 * len(re.findall("[A-Z]", text)) > 2 * len(text),
            "D": bool(re.search(r"[#$%&*|]", text)), "E": least[text] < (i is None, i or 0),
        }
        marked.append((source or "", {f for f, x in fails.items() if x}, i is not None and i in good, i is not None and i in toxic))
    out, shapley = [], Counter()
    for part in {m[0] for m in marked}:
        rows = [m for m in marked if m[0] == part]
        for order in itertools.permutations("ABCDE"):
            for k, f in enumerate(order):
                before = set(order[:k])
                removed = [m for m in rows if f in m[1] and not m[1] & before]
                shapley[part, f] += len(removed)
                out.append([
                    part, "".join(order), k + 1, sum(not m[1] & (before | {f}) for m in rows), len(removed), sum(f in m[1] and bool(m[1] & before) for m in rows),
                    sum(m[1] == {f} for m in rows), sum(m[2] for m in removed), sum(m[3] for m in removed),
                ])
    return sorted((*r, shapley[r[0], r[1][r[2] - 1]]) for r in out)


def body(rng, n, pool=4000):
    return " ".join(f"w{rng.randrange(pool)}" for _ in range(n))


def corpus():
    rng = random.Random(3)
    texts = [body(rng, 250), body(rng, 250, 30), body(rng, 210) + " ABCDEFGH" * 9, body(rng, 230) + " 5 %", "short", "SHORT #", "", None, body(rng, 220)]
    docs = [(i, rng.choice(texts) if rng.random() < 0.7 else body(rng, 205), rng.choice(["a", "b", None])) for i in range(300)]
    docs += [(5, "twice", "a"), (5, "twice", "a"), (5, "twice", "b"), (4, "late", "a"), (None, "late", "b"), (None, "only", None), (None, "only", None), (9, body(rng, 90_000), "b")]
    labels = [(i, i % 2, None if i % 7 == 0 else i % 3 % 2) for i in range(0, 300, 2)] + [(4, 1, 1), (4, 0, 0), (None, 1, 1)]
    return docs, labels


def found(spark, path, labels):
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int").withColumn("text", F.lit("x"))
    return sorted(tuple(r) for r in filter_audit.audit_filters(spark, str(path), marks, batch_bytes=1).collect())


def test_smaller_ids_arrive_late(spark, tmp_path):
    docs, labels = corpus()
    frame = spark.createDataFrame(docs, "doc_id long, text string, source string").withColumns({c: F.lit(1) for c in "key bits n part id missing mask".split()})
    path = tmp_path / "documents.parquet"
    for part in (4, 2, 0, 3, 1):  # files are taken by their time, so most least ids come late
        frame.where(F.coalesce(F.col("doc_id") % 5, F.lit(4)) == part).coalesce(1).write.mode("append").parquet(str(path))
    assert found(spark, path, labels) == plain(docs, labels)


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, source string").write.parquet(str(tmp_path / "none"))
    assert found(spark, tmp_path / "none", []) == []
