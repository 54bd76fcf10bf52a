"""The pipeline's stages on the smallest tables."""

import re

import corpus_pipeline
from pyspark.sql import functions as F

DATA = "/root/testdata/sf0.001"


def test_stages_keep_columns_and_do_their_work(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    bench = [" ".join(re.findall(r"\w+", r["text"].lower())) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, kept = kept, stage(spark, kept, DATA).cache()
        assert kept.columns == docs.columns
        ids = {r["doc_id"] for r in kept.collect()}
        assert ids <= {r["doc_id"] for r in before.collect()}
        if name == "quality rules":
            assert kept.where(F.size(F.split("text", r"\s+")) < 50).count() == 0
        if name == "decontamination":
            plain = {r["doc_id"]: " ".join(re.findall(r"\w+", r["text"].lower())) for r in before.collect()}
            assert ids == {i for i, t in plain.items() if not any(b in t for b in bench)}
        if name == "secrets":
            assert kept.count() == before.count()
            assert kept.where(F.col("text").rlike(r"AKIA[0-9A-Z]{16}|password=[0-9a-f]{18}")).count() == 0
    pieces = corpus_pipeline.STAGES[-1][1](spark, kept, DATA)
    assert {r["doc_id"] for r in pieces.select("doc_id").distinct().collect()} == ids
    whole = corpus_pipeline.run(spark, DATA).select("doc_id", "start", "length", "ids_crc32")
    assert sorted(whole.collect()) == sorted(pieces.select("doc_id", "start", "length", "ids_crc32").collect())
