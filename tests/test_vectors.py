from pyspark.sql import functions as F

from threadloom.bindings import bind
from threadloom.operators import vectors


def test_many_queries_meet_all_chunks_in_blocks(spark, monkeypatch):
    chunks = bind(spark, "/root/testdata/sf0.001", "vectors")
    queries = chunks.where("vec_id % 10 = 0").select(F.col("vec_id").alias("query_id"), "tier", F.col("embedding").alias("vector"))

    def rows():
        scores = vectors.score_vectors(queries, chunks)
        assert sorted(scores.columns) == ["chunk_index", "cosine", "document_id", "query_id", "tier", "vec_id"]
        return sorted((r["query_id"], r["vec_id"], round(r["cosine"], 9)) for r in scores.collect())

    broadcast = rows()
    assert len(broadcast) > queries.count()
    monkeypatch.setattr(vectors, "BROADCAST_QUERIES", 3)
    assert rows() == broadcast


def odd(spark):
    """Copies, a zero vector, missing and shorter ones, NaN, a missing document, one large document."""
    rows = [(i, i // 3 if i % 50 else None, i % 2, [float((i * j) % 7 - 3 + 0.1) for j in range(1, 5)]) for i in range(300)]
    rows += [(1000 + i, 500, 1, [1.0, 2.0, 3.0, 4.0]) for i in range(40)]
    rows += [(2000, 600, 0, [0.0] * 4), (2001, 601, 0, None), (2002, 602, 1, [1.0, 2.0]), (2003, 603, 1, [float("nan")] * 4), (2004, 604, None, [1.0] * 4), (2005, 605, 1, [1.0, None, 2.0, 3.0])]
    chunks = spark.createDataFrame(rows, "vec_id long, document_id long, tier int, embedding array<float>").repartition(5)
    return chunks, chunks.where("vec_id % 100 = 0 or vec_id in (1003, 2003)").select(F.col("vec_id").alias("query_id"), "tier", F.col("embedding").alias("vector"))


def plain(frame):
    return sorted(tuple(repr(v) for v in row) for row in frame.collect())


def test_blocks_give_the_same_as_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(vectors, "SLICE", 2)
    chunks, queries = odd(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "17")
    try:
        met = chunks.join(queries, "tier")
        cosine = vectors.dot(vectors.normalized(F.col("vector")), vectors.normalized(F.col("embedding")))
        pairs = met.withColumn("cosine", F.round(cosine, 9)).select("query_id", "document_id", "vec_id", "cosine").cache()
        scored = vectors.score_vectors(queries, chunks).withColumn("cosine", F.round("cosine", 9)).select(pairs.columns)
        assert plain(scored) == plain(pairs)
        best = vectors.best_chunk_per_doc(pairs)
        assert plain(vectors.best_chunks(queries, chunks).select("query_id", "document_id", "vec_id")) == plain(best.select("query_id", "document_id", "vec_id"))
        for k in (1, 7, 1000):
            columns = ["query_id", "document_id", "rank"]
            assert plain(vectors.semantic_search(queries, chunks, k).select(columns)) == plain(vectors.top_k(best, k, tie="document_id").select(columns))
            near = vectors.top_k(pairs.where("vec_id <> query_id"), k).select("query_id", "vec_id", "rank")
            assert plain(vectors.nearest(queries, chunks, k).select("query_id", "vec_id", "rank")) == plain(near)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
