"""Ranked search against plain scoring, with blocks, chunks, windows and accumulators of every size."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from threadloom.llm import ranked_search


def terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def plain(docs, items, k=10):
    counted = [(i, Counter(terms(t))) for i, t in docs]
    n_docs, total = sum(bool(c) for _, c in counted), sum(c.total() for _, c in counted)
    df = Counter(t for _, c in counted for t in c)
    out = []
    for item, text in items:
        scored = []
        for i, c in counted:
            m = 10 + 90 * c.total() * n_docs // max(total, 1)
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1000000000 * c[t] // (1000 * c[t] + 8 * m)) for t in set(terms(text)) if t in c)
            if score > 0:
                scored.append((-score, i is None, i or 0, i))
        out += [(item, rank, s[3], -s[0]) for rank, s in enumerate(sorted(scored, key=lambda s: s[:3])[:k], 1)]
    return sorted(out, key=repr)


def corpus(seed, n):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(200)] + ["Ünder", "漢字", "x1"]
    weights = [1 / (i + 1) for i in range(len(words))]
    docs = [(i, rng.choice([" ", "-", "\n"]).join(rng.choices(words, weights, k=rng.randint(1, 60)))) for i in range(n)]
    items = [(100 + i, " ".join(rng.choices(words, k=rng.randint(1, 25)))) for i in range(12)]
    return docs, items


def found(spark, docs, items):
    extra = {c: F.lit(1) for c in "row item n term tf rank block chunk weight".split()}
    a = spark.createDataFrame(docs, "doc_id long, text string").withColumns(extra).repartition(3)
    b = spark.createDataFrame(items, "item_id long, text string").withColumns(extra)
    return sorted((tuple(r) for r in ranked_search.rank_documents(a, b).collect()), key=repr)


@pytest.mark.parametrize("block, chunk", [(1 << 19, 1 << 16), (700, 40)])
def test_equals_plain_scores(spark, monkeypatch, block, chunk):
    monkeypatch.setattr(ranked_search, "BLOCK", block)
    monkeypatch.setattr(ranked_search, "CHUNK", chunk)
    docs, items = corpus(1, 400)
    docs += [(1000 + i, docs[7][1]) for i in range(30)] + [(3, "again w3 w3"), (None, docs[7][1]), (2000, None), (2001, ""), (2002, " . "), (2003, "w1 " * 20000)]
    items += [(500, None), (501, ""), (502, "nowhere"), (503, "W3 w3 漢字"), (504, docs[7][1])]
    assert found(spark, docs, items) == plain(docs, items)


@pytest.mark.parametrize("short", [0, 40, 100_000])
@pytest.mark.parametrize("window", [1, 7, 4096])
def test_skipping_loses_nothing(short, window):
    rng = np.random.default_rng(short + window)
    for _ in range(20):
        lists, total = [], np.zeros(300, np.int64)
        for size in rng.integers(1, 300, 9):
            docs = np.sort(rng.choice(300, size, replace=False))
            scores = rng.integers(0, 30, size) * int(rng.integers(1, 20))
            total[docs] += scores
            lists.append((docs, scores))
        expected = [i for i in np.lexsort((np.arange(300), -total)) if total[i] > 0][:10]
        docs, scores = ranked_search.best_documents(lists, 300, 10, short, window)
        assert docs.tolist() == expected and scores.tolist() == total[expected].tolist()


def test_empty_tables(spark):
    assert found(spark, [], [(1, "a")]) == [] == found(spark, [(1, "a")], [])
    assert found(spark, [(1, None)], [(1, "a")]) == []
