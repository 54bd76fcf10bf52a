"""Embedding search: similarities, best chunks, rankings."""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Queries that go together to each block of chunks; some 100 MB at 1,024 dimensions.
BROADCAST_QUERIES = 10_000
#: Queries whose scores a task computes at once, and pairs that it gives at once.
SLICE, PAIRS = 256, 250_000
#: Where undefined and missing cosines rank: before and behind all others.
UNDEFINED, MISSING = 3.0, -3.0


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def normalized(v: Column) -> Column:
    """The vector at length 1; a zero vector stays."""
    length = F.sqrt(dot(v, v))
    return F.transform(v, lambda x: x.cast("double") / F.when(length == 0, 1.0).otherwise(length))


class _Vectors:
    """A column of vectors as a matrix of rows of length 1 (a zero vector stays), and their numbers of elements, -1 for missing ones."""

    def __init__(self, column: pa.Array):
        lengths = pc.list_value_length(column)
        widest = pc.max(lengths).as_py() or 0
        if not column.null_count and not column.flatten().null_count and pc.min(lengths).as_py() == widest:
            rows, self.lengths = column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), widest).astype(float), np.full(len(column), widest)
        else:
            rows, self.lengths = np.zeros((len(column), widest)), np.full(len(column), -1)
            for i, v in enumerate(column.to_pylist()):
                if v is not None and None not in v:
                    rows[i, : len(v)], self.lengths[i] = v, len(v)
        with np.errstate(invalid="ignore"):
            size = np.sqrt(np.einsum("ij,ij->i", rows, rows))
            self.rows = rows / np.where(size == 0, 1.0, size)[:, None]

    def cosines(self, start: int, end: int, others: _Vectors) -> tuple[np.ndarray, np.ndarray | None]:
        """The cosines of some rows with all ``others``, and where one is missing (None: nowhere)."""
        width = min(self.rows.shape[1], others.rows.shape[1])
        with np.errstate(invalid="ignore"):
            found = self.rows[start:end, :width] @ others.rows[:, :width].T
        ours, theirs = self.lengths[start:end, None], others.lengths[None, :]
        missing = (ours != theirs) | (ours < 0)
        return found, missing if missing.any() else None

    def ranked(self, start: int, end: int, others: _Vectors) -> np.ndarray:
        """The same as numbers to rank by, rounded to 9 places."""
        found, missing = self.cosines(start, end, others)
        keys = np.nan_to_num(np.round(found, 9), nan=UNDEFINED)
        if missing is not None:
            keys[missing] = MISSING
        return keys


def _cosine(keys: np.ndarray) -> pa.Array:
    return pa.array(np.where(keys == UNDEFINED, np.nan, keys), mask=keys == MISSING)


def _by_tier(rows: pa.RecordBatch) -> Iterator[tuple[Any, pa.RecordBatch]]:
    for tier in pc.unique(rows["tier"]):
        yield tier.as_py(), rows.filter(pc.equal(rows["tier"], tier))


class _Best:
    """The ``k`` best rows of each query of a slice, the earlier ones among equals."""

    def __init__(self, size: int, k: int):
        self.k, self.least = k, np.full(size, -np.inf)
        self.query, self.key, self.place, self.rows = np.zeros(0, int), np.zeros(0), np.zeros(0, int), None

    def add(self, keys: np.ndarray, rows: pa.StructArray, place: int) -> None:
        """``keys[query, row]`` of the next rows, which begin at ``place``; what is -inf takes no part."""
        better = keys > self.least[:, None]
        if np.isneginf(self.least).any() and keys.shape[1] > self.k:
            bound = np.partition(keys, -self.k, axis=1)[:, -self.k, None]
            equal = keys == bound
            better &= (keys > bound) | (equal & (np.cumsum(equal, axis=1) <= self.k))
        query, at = np.nonzero(better)
        if not len(query):
            return
        rows = rows.take(pa.array(at))
        query, key, places = (np.concatenate(x) for x in ((self.query, query), (self.key, keys[better]), (self.place, place + at)))
        order = np.lexsort((places, -key, query))
        first = np.searchsorted(query[order], query[order])
        order = order[np.arange(len(order)) - first < self.k]
        self.rows = (pa.concat_arrays([self.rows, rows]) if self.rows is not None else rows).take(pa.array(order))
        self.query, self.key, self.place = query[order], key[order], places[order]
        full = np.bincount(self.query, minlength=len(self.least)) >= self.k
        last = np.searchsorted(self.query, np.arange(len(self.least)), side="right") - 1
        self.least = np.where(full, self.key[last], -np.inf)


def _meet(queries: DataFrame, chunks: DataFrame, key: str, order: list[str], work: Callable, schema: str) -> DataFrame:
    """``work(asked, chunks)`` over each block of chunks, in order, behind the queries.

    Chunks are dealt by ``key`` to as many blocks as there are shuffle partitions, queries go to each block, in groups
    of about ``BROADCAST_QUERIES``. ``asked`` holds (ids, vectors) by tier, ``chunks`` gives batches with tier, vector and row, sorted by tier and ``order``.
    """
    spark = queries.sparkSession
    blocks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    groups = -(-queries.count() // BROADCAST_QUERIES) or 1
    columns = [c for c in chunks.columns if c != "embedding"]
    inner = F.struct(*columns)
    ours = queries.where("tier is not null").select(
        F.explode(F.transform(F.sequence(F.lit(0), F.lit(blocks - 1)), lambda b: b * groups + F.pmod(F.xxhash64("query_id"), F.lit(groups)).cast("int"))).alias("block"),
        F.lit(0).alias("side"), "tier", "query_id", F.col("vector"),
    )
    theirs = chunks.where("tier is not null").select(
        F.explode(F.transform(F.sequence(F.lit(0), F.lit(groups - 1)), lambda g: F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int") * groups + g)).alias("block"),
        F.lit(1).alias("side"), "tier", F.col("embedding").alias("vector"), inner.alias("row"),
    )
    rows = ours.unionByName(theirs, allowMissingColumns=True).repartitionById(blocks * groups, F.col("block"))
    rows = rows.sortWithinPartitions("side", "tier", *[f"row.{c}" for c in order]).drop("block")

    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked: list[pa.RecordBatch] = []
        behind: list[pa.RecordBatch] = []
        for batch in batches:
            own = int(np.count_nonzero(batch["side"].to_numpy() == 0))
            if own:
                asked.append(batch.slice(0, own))
            if own < len(batch):
                behind.append(batch.slice(own))
                break
        if asked and behind:
            table = pa.Table.from_batches(asked).combine_chunks().to_batches()[0]
            by_tier = {t: (q["query_id"], _Vectors(q["vector"])) for t, q in _by_tier(table)}
            yield from work(by_tier, itertools.chain(behind, batches))

    return rows.mapInArrow(met, schema)


def _typed(**columns: tuple[DataFrame, str]) -> str:
    return ", ".join(f"`{c}` {df.schema[source].dataType.simpleString()}" for c, (df, source) in columns.items())


def _nearest_in_blocks(queries: DataFrame, chunks: DataFrame, k: int, by_document: bool) -> DataFrame:
    """query_id, vec_id (or document_id), cosine: each query's ``k`` best chunks, or documents, of each block of chunks."""
    names = ["document_id", "vec_id"] if by_document else ["vec_id"]

    def work(asked: dict, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict = {}
        place = 0
        for batch in _whole_documents(batches) if by_document else batches:
            for tier, rows in _by_tier(batch):
                if tier not in asked:
                    continue
                ids, vectors = asked[tier]
                theirs, columns = _Vectors(rows["vector"]), rows["row"]
                starts = _starts(columns) if by_document else None
                firsts = columns.take(pa.array(starts)) if by_document else None
                for start in range(0, len(ids), SLICE):
                    end = min(start + SLICE, len(ids))
                    kept = best.setdefault((tier, start), _Best(end - start, k))
                    keys = vectors.ranked(start, end, theirs)
                    if by_document:
                        kept.add(np.maximum.reduceat(keys, starts, axis=1), firsts, place)
                    else:
                        keys[ids.slice(start, end - start).to_numpy(zero_copy_only=False)[:, None] == columns.field("vec_id").to_numpy(zero_copy_only=False)[None, :]] = -np.inf
                        kept.add(keys, columns, place)
            place += len(batch)
        for (tier, start), kept in best.items():
            if kept.rows is not None:
                yield pa.RecordBatch.from_arrays([asked[tier][0].take(pa.array(start + kept.query)), kept.rows.field(names[0]), _cosine(kept.key)], ["query_id", names[0], "cosine"])

    schema = _typed(**{"query_id": (queries, "query_id"), names[0]: (chunks, names[0])}) + ", cosine double"
    return _meet(queries, chunks.select("tier", *names, "embedding"), names[0], names, work, schema)


def _starts(columns: pa.StructArray) -> np.ndarray:
    """Where the documents of sorted rows begin."""
    codes = columns.field("document_id").dictionary_encode(null_encoding="encode").indices.to_numpy()
    return np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1]]))


def _best_chunks(keys: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per query and document the best key, and the first row that has it."""
    best = np.maximum.reduceat(keys, starts, axis=1)
    sizes = np.diff([*starts, keys.shape[1]])
    rows = np.where(keys == np.repeat(best, sizes, axis=1), np.arange(keys.shape[1], dtype=np.int32), np.int32(keys.shape[1]))
    return best, np.minimum.reduceat(rows, starts, axis=1)


def _whole_documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted batches cut between documents; the last one's rows wait for the next batch."""
    held = None
    for batch in batches:
        if held is not None:
            batch = pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
        held, begun = batch, _starts(batch["row"])[-1]
        tiers = batch["tier"].dictionary_encode().indices.to_numpy()
        begun = max(begun, int(np.searchsorted(tiers, tiers[-1])))
        if begun:
            yield batch.slice(0, begun)
            held = batch.slice(begun)
    if held is not None:
        yield held


def score_vectors(queries: DataFrame, chunks: DataFrame) -> DataFrame:
    """Cosine of each stated query vector with each chunk of its tier.

    ``queries(query_id, tier, vector)`` is a stated set, ``chunks(vec_id, tier, embedding, ...)``
    is read once, in parallel blocks; queries go to each block, ``BROADCAST_QUERIES`` at a time.
    """
    names = [c for c in chunks.columns if c != "embedding"]

    def work(asked: dict, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for tier, rows in itertools.chain.from_iterable(map(_by_tier, batches)):
            if tier not in asked:
                continue
            ids, vectors = asked[tier]
            theirs, step = _Vectors(rows["vector"]), max(1, PAIRS // len(rows))
            for start in range(0, len(ids), step):
                end = min(start + step, len(ids))
                found, missing = vectors.cosines(start, end, theirs)
                pairs = rows["row"].take(pa.array(np.tile(np.arange(len(rows)), end - start)))
                asked_ids = ids.take(pa.array(np.repeat(np.arange(start, end), len(rows))))
                cosine = pa.array(found.ravel(), mask=None if missing is None else missing.ravel())
                yield pa.RecordBatch.from_arrays([*[pairs.field(n) for n in names], asked_ids, cosine], [*names, "query_id", "cosine"])

    schema = _typed(**{n: (chunks, n) for n in names}, query_id=(queries, "query_id")) + ", cosine double"
    return _meet(queries, chunks, "vec_id", ["vec_id"], work, schema)


def best_chunks(queries: DataFrame, chunks: DataFrame) -> DataFrame:
    """query_id, document_id, vec_id, cosine: per query and document of its tier the most alike chunk, the lowest id among equals.

    Cosines are rounded to 9 places. A document's chunks lie in one block and are compared there, so no pair is shuffled;
    they must fit in a task.
    """

    def work(asked: dict, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for tier, rows in itertools.chain.from_iterable(map(_by_tier, _whole_documents(batches))):
            if tier not in asked:
                continue
            ids, vectors = asked[tier]
            theirs, columns, starts, step = _Vectors(rows["vector"]), rows["row"], _starts(rows["row"]), max(1, PAIRS // len(rows))
            documents, chunk_ids = columns.field("document_id").take(pa.array(starts)), columns.field("vec_id")
            for start in range(0, len(ids), step):
                end = min(start + step, len(ids))
                keys, at = _best_chunks(vectors.ranked(start, end, theirs), starts)
                asked_ids = ids.take(pa.array(np.repeat(np.arange(start, end), len(starts))))
                pairs = documents.take(pa.array(np.tile(np.arange(len(starts)), end - start)))
                yield pa.RecordBatch.from_arrays([asked_ids, pairs, chunk_ids.take(pa.array(at.ravel())), _cosine(keys.ravel())], ["query_id", "document_id", "vec_id", "cosine"])

    schema = _typed(query_id=(queries, "query_id"), document_id=(chunks, "document_id"), vec_id=(chunks, "vec_id")) + ", cosine double"
    return _meet(queries, chunks.select("tier", "document_id", "vec_id", "embedding"), "document_id", ["document_id", "vec_id"], work, schema)


def best_chunk_per_doc(scores: DataFrame) -> DataFrame:
    """Per query and document the most alike chunk, the lowest id among equals."""
    order = Window.partitionBy("query_id", "document_id").orderBy(F.desc("cosine"), "vec_id")
    return scores.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def top_k(scores: DataFrame, k: int, by: str = "cosine", key: str = "query_id", tie: str = "vec_id") -> DataFrame:
    """The k best rows of each query, with their rank."""
    order = Window.partitionBy(key).orderBy(F.desc(by), tie)
    return scores.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def semantic_search(queries: DataFrame, chunks: DataFrame, k: int) -> DataFrame:
    """query_id, document_id, cosine, rank: the k documents nearest to each query, each by its best chunk, equals by id; cosines are rounded to 9 places."""
    return top_k(_nearest_in_blocks(queries, chunks, k, by_document=True), k, tie="document_id")


def nearest(queries: DataFrame, vectors: DataFrame, k: int) -> DataFrame:
    """The k vectors nearest to each stated query vector in its tier, itself left out, with rank and cosine.

    Every vector is compared with every query; equals go by id. Cosines are rounded to 9 places. Only the k best of each
    block of vectors are shuffled.
    """
    best = _nearest_in_blocks(queries, vectors.where("vec_id is not null"), k, by_document=False)
    return top_k(best, k).select("query_id", "vec_id", "rank", "cosine")


def compare_spaces(queries: tuple[DataFrame, DataFrame], spaces: tuple[DataFrame, DataFrame], k: int) -> DataFrame:
    """Per query the overlap (Jaccard) of its k nearest vectors in two embedding spaces."""
    ours, theirs = (nearest(q, v, k).select("query_id", "vec_id", F.lit(i).alias("space")) for i, (q, v) in enumerate(zip(queries, spaces, strict=True)))
    met = ours.unionByName(theirs).groupBy("query_id", "vec_id").agg(F.count_distinct("space").alias("spaces"))
    return met.groupBy("query_id").agg((F.count_if(F.col("spaces") == 2) / F.count("*")).alias("overlap"))


def rrf(rankings: DataFrame, k: int = 60) -> DataFrame:
    """Reciprocal rank fusion of ``rankings(query_id, document_id, rank)``."""
    return rankings.groupBy("query_id", "document_id").agg(F.sum(1.0 / (k + F.col("rank"))).alias("score"))


def validate_vectors(vectors: DataFrame, dimension: int, column: str = "embedding") -> DataFrame:
    """Whether each vector has the dimension and finite numbers only."""
    finite = F.forall(column, lambda x: ~F.isnan(x.cast("double")) & (F.abs(x) < F.lit(float("inf"))))
    return vectors.withColumn("valid", F.coalesce((F.size(column) == dimension) & finite, F.lit(False)))


def changed_chunks(new: DataFrame, stored: DataFrame) -> DataFrame:
    """Chunks that need a vector: there is none for them, or it is of another text."""
    old = stored.select("document_id", "chunk_index", F.col("hash").alias("_hash"))
    return new.join(old, ["document_id", "chunk_index"], "left").where(~F.col("hash").eqNullSafe(F.col("_hash"))).drop("_hash")


def merge_vectors(stored: DataFrame, fresh: DataFrame) -> DataFrame:
    """Stored vectors with the fresh ones in place; chunks beyond a document's new end go."""
    ends = fresh.groupBy("document_id").agg(F.max("chunk_index").alias("_end"))
    kept = stored.join(fresh.select("document_id", "chunk_index"), ["document_id", "chunk_index"], "left_anti")
    kept = kept.join(ends, "document_id", "left").where(F.col("_end").isNull() | (F.col("chunk_index") <= F.col("_end"))).drop("_end")
    return kept.unionByName(fresh)
