"""The registered queries on the smallest tables against plain versions, and the pipeline's stages at the edges."""

import math
import re
import zlib
from collections import Counter, defaultdict

import corpus_pipeline
import numpy as np
import public_tokenizers
import pytest
import tokenizers
from pyspark.sql import functions as F

from threadloom.llm import queries

DATA = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def texts(spark):
    return {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}


def run(spark, name):
    return queries.QUERIES[name](spark, DATA).collect()


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text))


def test_op1_counts_and_base(spark, texts):
    rows = run(spark, "op1_context_tree")
    held = {i for i in texts if zlib.crc32(str(i).encode()) % 5 == 1}
    known = Counter(t for i, text in texts.items() if i not in held for t in [*words(text), None])
    total, kinds = known.total(), len(known)
    assert {r["doc_id"] for r in rows} == set(texts)
    for r in rows:
        tokens = [*words(texts[r["doc_id"]]), None]
        base = sum(math.log10((known[t] + 0.5) / (total + 0.5 * (kinds + 1))) for t in tokens)
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (r["doc_id"] in held, len(tokens), sum(known[t] > 0 for t in tokens), total)
        assert abs(r["base_score"] - base) < 1e-6 * max(1, -base) and r["score"] < 0


def test_op2_equals_all_pairs(spark, texts):
    sets = {}
    for i, text in texts.items():
        w = words(text)
        sets[i] = {tuple(w[k : k + 3]) for k in range(max(1, len(w) - 2))} if w else set()
    up = {i: i for i in sets}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    ids = sorted(i for i in sets if sets[i])
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            common = len(sets[a] & sets[b])
            if 100 * common >= 85 * (len(sets[a]) + len(sets[b]) - common):
                x, y = root(a), root(b)
                up[max(x, y)] = min(x, y)
    found = {(r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in run(spark, "op2_minhash_dedup")}
    assert found == {(i, len(sets[i]), root(i), root(i) == i) for i in sets}


def test_op3_covers_every_id_once(spark, texts):
    tokenizer = tokenizers.Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in run(spark, "op3_hilbert_packing"):
        pieces[r["doc_id"]].append((r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]))
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    assert set(pieces) == set(texts)
    for i, parts in pieces.items():
        ids = np.array([*tokenizer.encode(texts[i], add_special_tokens=False).ids, 0], "<u4")
        at = 0
        for start, length, crc, n in sorted(parts):
            assert (start, n, crc) == (at, len(ids), zlib.crc32(ids[start : start + length].tobytes()))
            at += length
        assert at == len(ids)
    padding = 0
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        padding += 0 if at & (at - 1) == 0 else 1024 - at
        assert 0 < at <= 1024
    assert padding < 0.01 * 1024 * len(sequences)


def test_op5_counts(spark, texts):
    for r in run(spark, "op5_quality_rules"):
        text = texts[r["doc_id"]]
        w = WORD.findall(text)
        seen = Counter(tuple(w[k : k + 3]) for k in range(len(w) - 2))
        repeated = {k + d for k in range(len(w) - 2) if seen[tuple(w[k : k + 3])] > 1 for d in range(3)}
        lines = [line for line in text.split("\n") if WORD.search(line)]
        failed = len(w) < 50 or 100 * len(repeated) > 50 * len(w)
        expected = (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(repeated), failed)
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) == expected
        assert not (failed and r["kept"])


def test_folds_and_ranges_of_learned_queries(spark, texts):
    for name, folds, fold in (("op6_positive_unlabelled", 5, 0), ("op9_cross_parsing", 4, 2)):
        rows = run(spark, name)
        assert {r["doc_id"] for r in rows} == set(texts)
        assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % folds == fold) and 0 <= r["score"] <= 1 for r in rows)
        if name.startswith("op6"):
            assert all(r["predicted"] == int(r["score"] >= 0.3) for r in rows)


def test_pages_and_findings(spark, texts):
    pages = spark.read.parquet(f"{DATA}/pages.parquet").count()
    rows = run(spark, "op4_page_differencing")
    assert len(rows) == pages and all(r["n_chars"] == len(r["text"]) for r in rows)
    for r in run(spark, "op7_secret_forest"):
        assert 0 < r["length"] <= len(texts[r["doc_id"]])
    for name in ("op8_feistel_pseudonyms", "op10_decontaminate"):
        assert {r["doc_id"] for r in run(spark, name)} <= set(texts)


def test_stages_take_odd_rows(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").limit(0)
    body = " ".join(f"plain{i % 41} word{i % 97}" for i in range(600))
    odd = [(9_000_001, None), (9_000_002, ""), (9_000_003, body), (9_000_003, body), (None, body + " and its own end of some more words"), (None, None), (9_000_004, body * 300)]
    rows = spark.createDataFrame(odd, "doc_id long, text string")
    for table in (docs, docs.unionByName(rows, allowMissingColumns=True)):
        kept = table.withColumns({"node": F.lit(1), "bucket": F.lit("b"), "kept": F.lit(False)})
        for _, stage in corpus_pipeline.STAGES[:-1]:
            before, kept = kept, stage(spark, kept, DATA).cache()
            assert kept.columns == before.columns
            assert kept.count() <= before.count()
        pieces = corpus_pipeline.STAGES[-1][1](spark, kept, DATA)
        assert pieces.select("doc_id").distinct().count() == kept.select("doc_id").distinct().count()
