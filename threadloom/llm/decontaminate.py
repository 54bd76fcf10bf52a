"""Benchmark passages in documents, also reworded ones, by latent semantic retrieval.

1. Documents fall into passages of 16 words. One pass sketches the passages' TF-IDF
   matrix from the left: each passage is added, with a random sign, to one of a few
   rows. The words' document frequencies come from the same pass, and since they
   scale columns only, they are applied to the sketch afterwards. The right singular
   vectors of the sketch approximate those of the matrix.
2. A word's place in latent space is its direction there, weighted by its inverse
   document frequency. Benchmark items and the documents' windows are sums of places.
3. Windows whose cosine with an item is high are candidates. For each, the document's
   words around it are aligned with the item's by longest common subsequence; the
   item counts as found if enough of it is there, and some of its rarest words (the
   answer) are among them.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.llm.common import common_positions, flags, materialize, pieces, word_hashes

#: Hashed words, latent dimensions and rows of the sketch.
BUCKETS, RANK, SKETCH = 1 << 15, 48, 64
#: Leading directions, which tell languages apart and not passages, are left out.
LEADING = 16
#: Words of a passage, words between the starts of two windows, and windows' lengths in such steps.
PASSAGE, STEP, SPANS = 16, 8, (2, 4)
#: Cells of an item's word filter.
CELLS = 1024
#: Items that a task holds at most; a larger benchmark goes in parts of this size.
PART_ITEMS = 50_000
#: Cosines that are computed at once.
AT_ONCE = 1 << 21

#: Marks beyond ASCII that separate words; ASCII separators are all but letters, digits and the underscore.
_MARKS = re.compile("[\u0080-\u00a9\u00ab-\u00b4\u00b6-\u00b9\u00bb-\u00bf\u2000-\u206f\u3000-\u303f]")
_SEPARATORS = flags(bytes(c for c in range(128) if not (chr(c).isalnum() or c == 0x5F)))


def _words(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all texts' words in lower case, and where each text's begin; the last entry is their number."""
    parts = []
    for text in texts:
        text = (text or "").lower()
        parts.append((text if text.isascii() else _MARKS.sub(" ", text)).encode("utf-8", "surrogatepass"))
    starts, _, hashes = word_hashes(np.frombuffer(b"\n".join(parts), np.uint8), _SEPARATORS)
    return hashes, np.searchsorted(starts, np.cumsum([0, *(len(p) + 1 for p in parts)]))


def _laid_out(hashes: np.ndarray, first: np.ndarray, step: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of words, each text filled up to a multiple of ``step`` with ``BUCKETS``; and each text's first step."""
    steps = np.concatenate([[0], np.cumsum(-(-np.diff(first) // step))])
    slots = np.arange(len(hashes)) + np.repeat(steps[:-1] * step - first[:-1], np.diff(first))
    laid = np.full(int(steps[-1]) * step, BUCKETS, np.int32)
    laid[slots] = (hashes & np.uint64(BUCKETS - 1)).astype(np.int32)
    return laid.reshape(-1, step), steps


def latent_space(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Inverse document frequencies of the buckets, and their places in latent space (a last row stands for no word).

    Both have a fixed size whatever the corpus. Tasks send sums by bucket, which
    Spark adds up.
    """

    def sketch(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        rng = np.random.default_rng([161803, TaskContext.get().partitionId()])
        seen, sums, passages = np.zeros(BUCKETS + 1), np.zeros((BUCKETS + 1) * SKETCH, np.float32), 0
        for frame in frames:
            for part in pieces(frame, "text", 1 << 20):
                laid, _ = _laid_out(*_words(part["text"].tolist()), PASSAGE)
                if not len(laid):
                    continue
                laid.sort(axis=1)
                once = np.ones(laid.shape, dtype=bool)
                once[:, 1:] = laid[:, 1:] != laid[:, :-1]
                seen += np.bincount(laid[once], minlength=BUCKETS + 1)
                passages += len(laid)
                sign = rng.integers(0, 2, len(laid)) * 2.0 - 1
                cell = laid.astype(np.int64) * SKETCH + rng.integers(0, SKETCH, len(laid))[:, None]
                sums += np.bincount(cell.ravel(), weights=np.repeat(sign, PASSAGE), minlength=len(sums)).astype(np.float32)
        used = np.flatnonzero(seen[:BUCKETS])
        rows = sums.reshape(-1, SKETCH)[used]
        yield pd.DataFrame({"bucket": np.append(used, -1), "seen": np.append(seen[used], passages), "row": [*rows, np.zeros(SKETCH, np.float32)]})

    sums = [F.sum(F.col("row")[i]).cast("float").alias(f"x{i}") for i in range(SKETCH)]
    rows = docs.select("text").mapInPandas(sketch, "bucket long, seen double, row array<float>")
    table = rows.groupBy("bucket").agg(F.sum("seen").alias("seen"), *sums).toPandas()  # BUCKETS + 1 rows at most
    seen, image = np.zeros(BUCKETS + 1), np.zeros((BUCKETS + 1, SKETCH))
    seen[table["bucket"] + 1] = table["seen"]
    image[table["bucket"] + 1] = table.iloc[:, 2:].to_numpy()
    idf = np.log((1 + seen[0]) / (1 + seen[1:])) + 1
    place = np.linalg.svd(image[1:] * idf[:, None], full_matrices=False)[0][:, LEADING : LEADING + RANK]
    # buckets that no passage holds get directions of their own
    rest = np.random.default_rng(271828).standard_normal((BUCKETS, RANK))
    place = np.where(np.linalg.norm(place, axis=1, keepdims=True) > 1e-12, place, rest)
    place *= (idf / np.linalg.norm(place, axis=1))[:, None]
    return idf, np.vstack([place, np.zeros(RANK)]).astype(np.float32)


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def benchmark_leaks(
    docs: DataFrame, benchmark: DataFrame, min_cosine: float = 0.4, min_overlap: float = 0.6, answer_words: int = 8, min_answer: float = 0.25
) -> DataFrame:
    """Documents that hold a benchmark item or most of it, in its words' order.

    ``docs(doc_id, text)``, ``benchmark(item_id, text)``; other columns are ignored.
    Returns a row for each document and item found: doc_id, item_id, cosine (of the
    best window), overlap (share of the item's words in the common subsequence),
    answer_overlap (share of its ``answer_words`` rarest words among them), start and
    length (in words of the document).

    Every window of every document is compared with every item by cosine; a leak needs
    ``min_overlap`` of the item's words in order and ``min_answer`` of its answer words.

    Null or blank texts on either side match nothing. Equal items are all reported,
    repeated documents each. Tasks hold the benchmark's words: a benchmark of more
    than ``PART_ITEMS`` items is worked through in parts, each a pass over the documents.
    """
    docs = docs.select("doc_id", "text")
    id_type, item_type = (t.schema[c].dataType.simpleString() for t, c in ((docs, "doc_id"), (benchmark, "item_id")))
    schema = f"doc_id {id_type}, item_id {item_type}, cosine double, overlap double, answer_overlap double, start long, length long"
    idf, place = latent_space(docs)
    read = benchmark.select("item_id", "text").where("text is not null")
    parts = max(1, -(-read.count() // PART_ITEMS))
    found: DataFrame | None = None
    for k in range(parts):
        rows = read.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == k).collect()
        search = _Search([(r["item_id"], r["text"]) for r in rows], idf, place, min_cosine, min_overlap, answer_words, min_answer)
        hits = docs.mapInPandas(search, schema)
        found = hits if found is None else found.union(hits)
    return found


class _Search:
    """Looks for the items in batches of documents."""

    def __init__(self, items, idf, place, min_cosine, min_overlap, answer_words, min_answer, min_weight=0.25):
        hashes, first = _words([text for _, text in items])
        words = [hashes[a:b] for a, b in zip(first[:-1], first[1:], strict=True)]
        kept = [i for i, w in enumerate(words) if len(w)]
        self.ids, self.words = [items[i][0] for i in kept], [words[i] for i in kept]
        self.place, self.min_cosine, self.min_overlap = place, min_cosine, min_overlap
        self.sizes = np.array([len(w) for w in self.words])
        self.answers, self.needed = [], []
        self.filter = np.zeros((len(kept), CELLS + 1), np.uint8)
        self.least = np.zeros(len(kept))
        probes: dict[int, list[tuple[int, np.ndarray]]] = {span: [] for span in SPANS}
        for i, own in enumerate(self.words):
            buckets = (own & np.uint64(BUCKETS - 1)).astype(np.int64)
            weights = np.minimum(255, 10 * idf[buckets]).astype(np.uint8)
            np.maximum.at(self.filter[i], buckets % CELLS, weights)
            self.least[i] = min_weight * weights.sum(dtype=float) / len(own)
            distinct, at = np.unique(own, return_index=True)
            rarest = distinct[np.lexsort((distinct, -idf[buckets[at]]))][:answer_words]
            self.answers.append(np.sort(rarest))
            self.needed.append(max(1, int(np.ceil(min_answer * len(rarest)))))
            # an item is looked for by windows of about its length, a long one by several of its stretches
            span = SPANS[0] if len(own) <= 1.5 * STEP * SPANS[0] else SPANS[-1]
            count = max(1, round(len(own) / (1.25 * STEP * span)))
            probes[span] += [(i, place[part].sum(axis=0)) for part in np.array_split(buckets, count)]
        self.probes = {s: (np.array([i for i, _ in p]), _unit(np.array([v for _, v in p]))) for s, p in probes.items() if p}

    def __call__(self, frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames if self.ids else ():
            for part in pieces(frame, "text", 1 << 19):
                hashes, first = _words(part["text"].tolist())
                ids = part["doc_id"].tolist()
                out = [(ids[doc], self.ids[item], *hit) for doc, item, hit in self.leaks(hashes, first)]
                if out:
                    yield pd.DataFrame(out, columns=["doc_id", "item_id", "cosine", "overlap", "answer_overlap", "start", "length"])

    def leaks(self, hashes: np.ndarray, first: np.ndarray) -> Iterator[tuple[int, int, tuple]]:
        laid, steps = _laid_out(hashes, first, STEP)
        if not len(laid):
            return
        of = np.repeat(np.arange(len(first) - 1), np.diff(steps))
        sums = np.zeros((len(laid) + 1, RANK), np.float32)
        np.cumsum(self.place[laid].sum(axis=1), axis=0, out=sums[1:])
        cells = np.where(laid == BUCKETS, CELLS, laid % CELLS)
        found: dict[tuple[int, int], list[tuple[int, int, float]]] = {}
        for span, (item_of, probes) in self.probes.items():
            ends = np.minimum(np.arange(len(laid)) + span, steps[of + 1])
            windows = _unit(sums[ends] - sums[: len(laid)])
            rows = max(1, AT_ONCE // len(probes))
            for at in range(0, len(windows), rows):
                cosine = windows[at : at + rows] @ probes.T
                window, probe = np.nonzero(cosine >= self.min_cosine)
                value, window, item = cosine[window, probe], window + at, item_of[probe]
                # the weight of the window's words that may be the item's
                near = np.minimum(window[:, None] + np.arange(span), len(laid) - 1)
                inside = near < ends[window][:, None]
                weight = (self.filter[item[:, None, None], cells[near]] * inside[:, :, None]).sum(axis=(1, 2))
                good = weight >= self.least[item] * np.minimum(span * STEP, self.sizes[item])
                for w, i, c in zip(window[good].tolist(), item[good].tolist(), value[good].tolist(), strict=True):
                    found.setdefault((int(of[w]), i), []).append((w, span, c))
        for (doc, item), windows in sorted(found.items()):
            if hit := self.best(hashes[first[doc] : first[doc + 1]], int(steps[doc]), item, sorted(windows)):
                yield doc, item, hit

    def best(self, words: np.ndarray, base: int, item: int, windows: list[tuple[int, int, float]]) -> tuple | None:
        """The best alignment around these windows, if it is a leak."""
        wanted, answer, hit, seen = self.words[item], self.answers[item], None, -1
        for window, span, cosine in windows:
            start = (window - base) * STEP
            begin, end = max(0, start - len(wanted)), min(len(words), start + span * STEP + len(wanted))
            if end <= seen:
                continue
            near = words[begin:end]
            if np.isin(wanted, near).sum() < self.min_overlap * len(wanted):
                continue
            seen = start + span * STEP + len(wanted) // 2
            got = [j for _, j in common_positions(wanted, near)]
            overlap = len(got) / len(wanted)
            matched = int(np.isin(answer, near[got]).sum())
            if overlap >= self.min_overlap and matched >= self.needed[item]:
                new = (cosine, overlap, matched / len(answer), begin + got[0], got[-1] - got[0] + 1)
                if hit is None or new[1::-1] > hit[1::-1]:
                    hit = new
            if hit and hit[1] == 1:
                break
        return hit


def leaked_documents(docs: DataFrame, benchmark: DataFrame, **limits: float) -> DataFrame:
    """The distinct doc_id of ``benchmark_leaks``, as a table of its own."""
    return materialize(benchmark_leaks(docs, benchmark, **limits).select("doc_id").distinct(), "leaks")
