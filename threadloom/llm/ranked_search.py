"""Ranked lexical search: accumulators for short lists, document-at-a-time skipping over long ones.

1. The distinct terms of all items are numbered. Texts become postings of these terms
   (document, its length, term, occurrences), written once; a document's other terms
   are dropped where the text is read.
2. Document frequencies give each term's weight.
3. Documents are dealt into blocks of about ``BLOCK`` postings, items into chunks of
   about ``CHUNK`` terms; every block meets every chunk once, with only the postings
   of the chunk's terms. No list of a term is ever in one place.
4. In a block, an item's short lists are summed term at a time into accumulators. The
   accumulators then count as one more sorted iterator with a bound, beside the long
   lists: documents are taken in order, a window of documents whose bounds cannot pass
   the tenth best score is skipped, lists that cannot pass it by themselves propose no
   documents, and are looked up only for documents that still can.
5. The blocks' best are ranked again for each item.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from threadloom.llm.common import materialize

#: Characters outside terms; terms are the runs between them.
BREAKS = r"\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F"
_TERM = re.compile(rb"[0-9A-Za-z\x80-\xff]+")
#: Postings of a block, item terms of a chunk, postings that go to accumulators, documents of a window.
BLOCK, CHUNK, SHORT, WINDOW = 1 << 19, 1 << 16, 2048, 512


def _occurrences(rows: DataFrame) -> DataFrame:
    """A row for each distinct term of each row's ``text``: the other columns, n (terms with repeats), term, tf."""
    keys = [f for f in rows.schema if f.name != "text"]

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                counts = [Counter(_TERM.findall(t.encode("utf-8", "surrogatepass").lower())) if t else Counter() for t in part.column("text").to_pylist()]
                sizes = [len(c) for c in counts]
                source = pa.array(np.repeat(np.arange(len(counts)), sizes))
                terms = pa.array([t for c in counts for t in c], pa.binary()).cast(pa.string())
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(f.name).take(source) for f in keys), pa.array(np.repeat([c.total() for c in counts], sizes)), terms, pa.array([n for c in counts for n in c.values()], pa.int64())],
                    names=[*(f.name for f in keys), "n", "term", "tf"],
                )

    kept = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in keys)
    return rows.mapInArrow(counted, f"{kept}, n long, term string, tf long")


def _windowed(docs: np.ndarray, values: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each window begins in a sorted list, and the greatest value in it (0 where it has none)."""
    cuts = np.searchsorted(docs, edges)
    best = np.zeros(len(edges) - 1, np.int64)
    full = np.flatnonzero(cuts[1:] > cuts[:-1])
    if len(full):
        best[full] = np.maximum.reduceat(values, cuts[full])
    return cuts, best


def accumulate(lists: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """The sum of short lists as one list: ascending documents and their scores."""
    docs = np.concatenate([d for d, _ in lists])
    order = np.argsort(docs, kind="stable")
    docs, scores = docs[order], np.concatenate([s for _, s in lists])[order]
    firsts = np.flatnonzero(np.concatenate([[True], docs[1:] != docs[:-1]]))
    return docs[firsts], np.add.reduceat(scores, firsts)


def best_documents(lists: list[tuple[np.ndarray, np.ndarray]], n_docs: int, k: int, short: int = SHORT, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` documents of highest score above 0 and their scores; equal scores by ascending document.

    A list holds ascending documents (numbers below ``n_docs``) and what they score by it. The
    shortest lists, up to ``short`` postings together, become accumulators.
    """
    lists = sorted(lists, key=lambda x: len(x[0]))
    few = int(np.searchsorted(np.cumsum([len(d) for d, _ in lists]), short, side="right"))
    if few:
        lists = [accumulate(lists[:few]), *lists[few:]]
    edges = np.append(np.arange(0, n_docs, window), n_docs)
    cuts, bounds = (np.stack(x) for x in zip(*(_windowed(d, s, edges) for d, s in lists), strict=True))
    totals = bounds.sum(axis=0)
    top_docs, top_scores, least = np.empty(0, np.int64), np.empty(0, np.int64), 0
    dense = np.zeros(window, np.int64)
    for j in np.flatnonzero(totals > 0):
        if totals[j] <= least:
            continue
        order = np.argsort(bounds[:, j], kind="stable")
        sums = np.cumsum(bounds[order, j])
        idle = int(np.searchsorted(sums, least, side="right")) if least else 0
        dense[:] = 0
        for i in order[idle:]:
            a, b = cuts[i, j], cuts[i, j + 1]
            dense[lists[i][0][a:b] - edges[j]] += lists[i][1][a:b]
        found = np.flatnonzero(dense)
        for place in range(idle - 1, -1, -1):
            found = found[dense[found] + sums[place] > least]
            i = order[place]
            docs, scores = (x[cuts[i, j] : cuts[i, j + 1]] for x in lists[i])
            if len(docs) and len(found):
                at = np.minimum(np.searchsorted(docs, found + edges[j]), len(docs) - 1)
                hit = docs[at] == found + edges[j]
                dense[found[hit]] += scores[at[hit]]
        found = found[dense[found] > least]
        if len(found):
            docs, scores = np.concatenate([top_docs, found + edges[j]]), np.concatenate([top_scores, dense[found]])
            keep = np.lexsort((docs, -scores))[:k]
            top_docs, top_scores = docs[keep], scores[keep]
            least = int(top_scores[-1]) if len(keep) == k else 0
    return top_docs, top_scores


def _search_block(left: pa.Table, right: pa.Table, n_docs: int, n_terms: int, k: int) -> pa.Table:
    """Each item's best documents of one block."""
    rows, first, place = np.unique(left["row"].to_numpy(), return_index=True, return_inverse=True)
    ids = left["doc_id"].take(pa.array(first)).combine_chunks()
    by_id = pc.sort_indices(pa.table({"id": ids, "row": rows}), sort_keys=[("id", "ascending"), ("row", "ascending")], null_placement="at_end").to_numpy()
    number = np.empty(len(rows), np.int64)
    number[by_id] = np.arange(len(rows))
    lengths = left["n"].to_numpy()[first].tolist()
    damp = np.array([8 * (10 + 90 * n * n_docs // n_terms) for n in lengths], np.int64)
    tf, docs, terms = left["tf"].to_numpy(), number[place], left["term_id"].to_numpy()
    shares = 1_000_000_000 * tf // (1000 * tf + damp[place])
    order = np.lexsort((docs, terms))
    docs, shares, terms = docs[order], shares[order], terms[order]
    known, starts = np.unique(terms, return_index=True)
    ends = np.append(starts[1:], len(terms))

    asked = right.select(["item", "term_id", "weight"]).sort_by("item")
    item, term, weight = (c.to_numpy() for c in asked.columns)
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for part in np.split(np.arange(len(item)), np.flatnonzero(np.diff(item)) + 1):
        at = np.minimum(np.searchsorted(known, term[part]), len(known) - 1)
        lists = [(docs[starts[i] : ends[i]], shares[starts[i] : ends[i]] * w) for i, t, w in zip(at, term[part], weight[part], strict=True) if known[i] == t]
        if lists:
            best, scores = best_documents(lists, len(rows), k)
            out.append((np.full(len(best), item[part[0]]), by_id[best], scores))
    items, found, scores = (np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.empty(0, np.int64),) * 3
    return pa.table({"item": items, "doc_id": ids.take(pa.array(found)), "row": rows[found], "score": scores})


def rank_documents(docs: DataFrame, items: DataFrame, k: int = 10) -> DataFrame:
    """The ``k`` best documents for each item.

    ``docs(doc_id, text)`` and ``items(item_id, text)``; columns beyond these are ignored.
    Returns item_id, rank (from 1), doc_id, score (long, above 0), at most ``k`` rows an item.

    Terms are runs of ASCII letters, digits and all characters beyond ASCII, A-Z in lower case. A
    null or empty text has no terms; such items and items whose terms occur nowhere return no rows.
    Repeated rows of ``docs`` are documents of their own, as are repeated rows of ``items``. Equal
    scores are ordered by doc_id, no id last. Empty tables give no rows.
    """
    id_type = docs.schema["doc_id"].dataType.simpleString()
    n_docs, n_terms = docs.select(F.regexp_count("text", F.lit(f"[^{BREAKS}]+")).alias("n")).agg(F.count_if(F.col("n") > 0), F.sum("n")).first()
    row = F.monotonically_increasing_id()
    named = materialize(items.select(row.alias("item"), "item_id", "text"), "items")
    asked = materialize(_occurrences(named.select("item", "text")).select("item", "term"), "item-terms")
    terms = materialize(asked.select("term").distinct().select("term", row.alias("term_id")), "terms")
    postings = _occurrences(docs.select(row.alias("row"), "doc_id", "text")).join(terms, "term")
    postings = materialize(postings.select("row", "doc_id", "n", "term_id", "tf"), "postings")

    weight = F.floor(1000 * F.log((2 * F.lit(n_docs) + 2).cast("double") / (2 * F.col("df") + 1)))
    weights = postings.groupBy("term_id").agg(F.count("*").alias("df")).select("term_id", weight.alias("weight"))
    chunks = -(-asked.count() // CHUNK) or 1
    weighted = asked.join(terms, "term").join(weights, "term_id").select(F.pmod(F.xxhash64("item"), F.lit(chunks)).alias("chunk"), "item", "term_id", "weight")
    weighted = materialize(weighted, "weights")
    blocks = -(-postings.count() // BLOCK) or 1

    dealt = postings.join(weighted.select("chunk", "term_id").distinct(), "term_id").withColumn("block", F.pmod(F.xxhash64("row"), F.lit(blocks)))
    repeated = weighted.toDF(*weighted.columns).withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))

    def searched(left: pa.Table, right: pa.Table) -> pa.Table:
        return _search_block(left, right, n_docs, n_terms, k)

    found = dealt.groupBy("block", "chunk").cogroup(repeated.groupBy("block", "chunk")).applyInArrow(
        searched, f"item long, doc_id {id_type}, row long, score long"
    )
    best = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"), "row")
    ranked = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.join(named.select("item", "item_id"), "item").select("item_id", "rank", "doc_id", "score")
