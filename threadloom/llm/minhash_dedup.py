"""Near-duplicate documents by one-permutation MinHash with optimal densification.

1. Every text becomes its set of word shingles; equal sets form one class, told by
   a 128-bit sum over the set's hashes. All later work is on the document with the
   least id of each class, its node, so copies cost one row each.
2. A class's sketch takes the least hash of each of ``BINS`` ranges of hash values
   (one permutation); empty ranges copy a full one, picked by a hash of their own.
3. ``BANDS`` bands of the sketch are its buckets. In each bucket the node with the
   least id is the centre, and every other node is its candidate: a star, so
   that a bucket of k nodes gives k - 1 pairs.
4. A node's most alike centre is confirmed on the full sets, and confirmed links
   are joined to components.
5. Buckets that still hold several components are searched whole, in square chunks
   of bounded size: first by sketch, which only marks nodes with a possible
   partner in another component, then on full sets. A chunk gives a forest of its
   links instead of all of them. So no link is lost to the star shape.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.llm.common import WordHashes, bucketed, groups, lower_words, materialize, mix, pieces

BANDS, ROWS = 32, 5
BINS = BANDS * ROWS
#: Nodes of a side of a chunk, and nodes up to which a chunk's pairs are compared one by one.
CHUNK, FEW = 1024, 12
#: Standard deviations by which a sketch may fall short of the threshold.
SLACK = 5.0


def shingle_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the runs of ``size`` words, or of all if there are fewer."""
    if not len(words):
        return np.empty(0, np.uint64)
    size = min(size, len(words))
    runs = len(words) - size + 1
    total = np.full(runs, size, np.uint64)
    for i in range(size):
        total = mix(total + words[i : i + runs])
    total.sort()
    return total[np.concatenate([[True], total[1:] != total[:-1]])]


def _orders() -> np.ndarray:
    """For each bin, the order in which it looks for a full bin when it is empty."""
    rng = np.random.default_rng(314159)
    return np.stack([rng.permutation(BINS) for _ in range(BINS)])


def one_permutation(hashes: np.ndarray, orders: np.ndarray) -> np.ndarray:
    """The densified sketch of a set of sorted hashes, 16 bits a bin."""
    edges = (np.arange(BINS, dtype=np.uint64) << np.uint64(32)) // np.uint64(BINS) << np.uint64(32)
    at = np.searchsorted(hashes, edges)
    full = at < np.append(at[1:], len(hashes))
    least = mix(hashes[np.minimum(at, len(hashes) - 1)]) >> np.uint64(48)
    if not full.all():
        empty = np.flatnonzero(~full)
        donors = orders[empty]
        least[empty] = least[donors[np.arange(len(empty)), full[donors].argmax(axis=1)]]
    return least.astype("<u2")


def band_keys(sketch: np.ndarray) -> np.ndarray:
    """A 64-bit key for each band of a sketch."""
    rows = sketch.reshape(BANDS, ROWS).astype(np.uint64)
    key = np.arange(1, BANDS + 1, dtype=np.uint64)
    for i in range(ROWS):
        key = mix(key * np.uint64(65599) + rows[:, i])
    return key.view(np.int64)


def class_key(hashes: np.ndarray) -> bytes:
    """128 bits that tell a set, whatever the order of its members."""
    with np.errstate(over="ignore"):
        a, b = mix(hashes).sum(dtype=np.uint64), mix(hashes ^ np.uint64(0x9E3779B97F4A7C15)).sum(dtype=np.uint64)
    return int(a).to_bytes(8, "big") + int(b).to_bytes(8, "big")


def _sketches(docs: DataFrame, size: int) -> DataFrame:
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def sketch(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table, orders = WordHashes(), _orders()
        for frame in frames:
            for part in pieces(frame, "text", 2 << 20):
                out = []
                for doc, text in zip(part["doc_id"], part["text"], strict=True):
                    hashes = shingle_hashes(table.of(lower_words(text)), size)
                    if len(hashes):
                        out.append((doc, len(hashes), class_key(hashes), one_permutation(hashes, orders).tobytes()))
                    else:
                        out.append((doc, 0, None, None))
                yield pd.DataFrame(out, columns=["doc_id", "n_shingles", "class", "sketch"])

    return docs.select("doc_id", "text").mapInPandas(
        sketch, f"doc_id {id_type}, n_shingles long, class binary, sketch binary"
    )


def _sets(docs: DataFrame, wanted: DataFrame, size: int) -> DataFrame:
    """node and its sorted shingle hashes, for ``wanted(node)``."""
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def hashed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table = WordHashes()
        for frame in frames:
            for part in pieces(frame, "text", 2 << 20):
                sets = [shingle_hashes(table.of(lower_words(t)), size).tobytes() for t in part["text"]]
                yield pd.DataFrame({"node": part["node"].to_numpy(), "hashes": sets})

    found = docs.select(F.col("doc_id").alias("node"), "text").join(wanted, "node")
    return found.mapInPandas(hashed, f"node {id_type}, hashes binary")


def least_match(shingles: np.ndarray, percent: int) -> np.ndarray:
    """The share of equal bins below which sets of such sizes can't reach the threshold."""
    share = percent / 100
    filled = BINS * -np.expm1(-shingles / BINS)
    return share - SLACK * np.sqrt(share * (1 - share) / np.maximum(filled, 1))


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """100 * intersection >= percent * union, for sorted sets."""
    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    both = np.concatenate([a, b])
    both.sort()
    common = int((both[1:] == both[:-1]).sum())
    return 100 * common >= percent * (len(both) - common)


class _Forest:
    """Joins numbers to sets; tells whether a link joined two of them."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = i = self.up[self.up[i]]
        return i

    def join(self, i: int, j: int) -> bool:
        i, j = self.root(i), self.root(j)
        self.up[max(i, j)] = min(i, j)
        return i != j


def components(edges: DataFrame) -> DataFrame:
    """node and component (its least reachable node) for undirected edges(a, b).

    Large-star and small-star steps in turn, each a grouped minimum and a join; the
    edges are written after each round, and the rounds end when nothing changes.
    """
    now = materialize(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    mark = None
    while True:
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("least"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("least").alias("b"))
        least = large.groupBy("a").agg(F.min("b").alias("least"))
        down = large.join(least, "a")
        small = down.where("b <> least").select(F.col("b").alias("a"), F.col("least").alias("b"))
        now = materialize(small.union(least.select("a", F.col("least").alias("b"))).distinct(), "edges")
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if seen == mark:
            break
        mark = seen
    roots = now.select(F.col("b").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(roots)


def _in_chunks(rows: DataFrame) -> DataFrame:
    """rows(bucket, node, ...) in every square of chunks of their bucket that they belong to."""
    sizes = rows.groupBy("bucket").agg(F.ceil(F.count("*") / CHUNK).alias("chunks"))
    own = rows.join(sizes, "bucket").withColumn("own", F.pmod(F.xxhash64("node"), F.col("chunks")))
    other = own.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    dealt = other.select(
        "*", F.least("own", "other").alias("row"), F.greatest("own", "other").alias("col")
    ).drop("other", "chunks")
    return dealt.repartition("bucket", "row", "col").sortWithinPartitions("bucket", "row", "col")


def _sides(group: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Positions of a square's rows and of its columns."""
    return np.flatnonzero(group["own"] == group["row"][0]), np.flatnonzero(group["own"] == group["col"][0])


def near_duplicates(docs: DataFrame, shingle_words: int = 5, percent: int = 80) -> DataFrame:
    """Components of documents whose word shingles overlap by ``percent`` of the union.

    ``docs(doc_id, text)``; columns beyond these are ignored. Returns a row for each
    row of ``docs``: doc_id, n_shingles, component_id (the least doc_id of its
    component) and kept (it is that document).

    Words are lower-cased in A-Z. A text with fewer than ``shingle_words`` words is
    one shingle; null, empty and blank texts have none, are linked with nothing and
    are kept. Rows without a doc_id are linked with nothing and kept; they have no
    component. Rows with equal ids and texts are alike; with different texts each has
    the component of its own text. A pair at the threshold is missed by all bands with a chance below 1e-8.
    """
    id_type = docs.schema["doc_id"].dataType.simpleString()
    base = materialize(_sketches(docs, shingle_words), "sketches")
    filled = base.where("n_shingles > 0 and doc_id is not null")
    classes = filled.groupBy("class").agg(
        F.min("doc_id").alias("node"), F.first("n_shingles").alias("n"), F.first("sketch").alias("sketch")
    )
    classes = materialize(classes, "classes")

    def banded(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            keys = [band_keys(np.frombuffer(s, "<u2")) for s in frame["sketch"]]
            if keys:
                yield pd.DataFrame({"bucket": np.concatenate(keys), "node": np.repeat(frame["node"].to_numpy(), BANDS)})

    bands = classes.select("node", "sketch").mapInPandas(banded, f"bucket long, node {id_type}")
    stars = bands.groupBy("bucket").agg(F.min("node").alias("centre"), F.count("*").alias("size")).where("size > 1")
    buckets = materialize(bands.join(stars, "bucket").select("bucket", "node", "centre").distinct(), "buckets")

    pairs = buckets.where("node <> centre").select("node", "centre").distinct()
    sketched = classes.select("node", "n", "sketch")
    of_centre = sketched.toDF("centre", "m", "other")

    def matched(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if len(frame):
                a = np.frombuffer(b"".join(frame["sketch"]), "<u2").reshape(-1, BINS)
                b = np.frombuffer(b"".join(frame["other"]), "<u2").reshape(-1, BINS)
                share = (a == b).mean(axis=1)
                good = share >= least_match(np.minimum(frame["n"], frame["m"]).to_numpy(float), percent)
                yield frame.loc[good, ["node", "centre"]].assign(share=share[good])

    close = pairs.join(sketched, "node").join(of_centre, "centre").mapInPandas(
        matched, f"node {id_type}, centre {id_type}, share double"
    )
    best = close.groupBy("node").agg(F.max_by("centre", F.struct("share", "centre")).alias("centre"))
    sets = bucketed(_sets(docs, buckets.select("node").distinct(), shingle_words), "sets", "node")

    def confirmed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            good = [
                linked(np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64), percent)
                for a, b in zip(frame["hashes"], frame["others"], strict=True)
            ]
            yield frame.loc[np.array(good, dtype=bool), ["node", "centre"]].set_axis(["a", "b"], axis=1)

    others = sets.toDF("centre", "others")
    links = best.join(sets, "node").join(others, "centre").mapInPandas(confirmed, f"a {id_type}, b {id_type}")
    links = materialize(links, "links")
    joined = materialize(components(links), "components")

    named = buckets.join(joined, "node", "left").select("bucket", "node", F.coalesce("component", "node").alias("component"))
    split = named.groupBy("bucket").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x <> y")
    open_rows = named.join(split.select("bucket"), "bucket").join(sketched, "node")

    def possible(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found: list[dict[str, np.ndarray]] = []
        for group in groups(frames, ["bucket", "row", "col"]):
            rows, cols = _sides(group)
            sketches = np.frombuffer(b"".join(group["sketch"]), "<u2").reshape(-1, BINS)
            least, component = least_match(group["n"].astype(float), percent), group["component"]
            marked = np.zeros(len(component), dtype=bool)
            for i in rows:
                apart = cols[component[cols] != component[i]]
                if len(apart):
                    share = (sketches[apart] == sketches[i]).mean(axis=1)
                    good = apart[share >= np.minimum(least[apart], least[i])]
                    marked[good] = True
                    marked[i] |= len(good) > 0
            if marked.any():
                found.append({c: group[c][marked] for c in ("bucket", "node", "component")})
            if len(found) >= 1000:
                yield pd.DataFrame({c: np.concatenate([f[c] for f in found]) for c in ("bucket", "node", "component")})
                found = []
        if found:
            yield pd.DataFrame({c: np.concatenate([f[c] for f in found]) for c in ("bucket", "node", "component")})

    marked = _in_chunks(open_rows).mapInPandas(possible, f"bucket long, node {id_type}, component {id_type}").distinct()
    suspects = materialize(marked, "suspects").join(sets, "node")

    def forest(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out: list[tuple] = []
        for group in groups(frames, ["bucket", "row", "col"]):
            rows, cols = _sides(group)
            names = group["node"]
            _, component = np.unique(group["component"], return_inverse=True)
            hashes = [np.frombuffer(h, np.uint64) for h in group["hashes"]]
            known = _Forest(int(component.max()) + 1)
            if len(hashes) <= FEW:
                for i in rows:
                    for j in cols:
                        apart = known.root(component[i]) != known.root(component[j])
                        if apart and linked(hashes[i], hashes[j], percent) and known.join(component[i], component[j]):
                            out.append((names[i], names[j]))
            else:
                sizes = np.array([len(h) for h in hashes])
                where = np.repeat(np.arange(len(hashes)), sizes)
                _, terms = np.unique(np.concatenate(hashes), return_inverse=True)
                order = np.argsort(terms, kind="stable")
                holders, ends = where[order], np.searchsorted(terms[order], np.arange(terms.max() + 2))
                starts = np.concatenate([[0], np.cumsum(sizes)])
                for i in rows:
                    own = terms[starts[i] : starts[i + 1]]
                    common = np.bincount(
                        np.concatenate([holders[ends[t] : ends[t + 1]] for t in own]), minlength=len(hashes)
                    )[cols]
                    good = cols[100 * common >= percent * (sizes[i] + sizes[cols] - common)]
                    out += [(names[i], names[j]) for j in good if known.join(component[i], component[j])]
            if len(out) >= 10_000:
                yield pd.DataFrame(out, columns=["a", "b"])
                out = []
        if out:
            yield pd.DataFrame(out, columns=["a", "b"])

    rest = _in_chunks(suspects).mapInPandas(forest, f"a {id_type}, b {id_type}")
    found = materialize(components(links.union(rest)), "components")
    of_class = classes.select("class", "node").join(found, "node", "left").select("class", F.coalesce("component", "node").alias("component_id"))
    result = base.drop("sketch").join(of_class, "class", "left")
    component = F.coalesce("component_id", "doc_id")
    return result.select(
        "doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), component).alias("component_id"),
        (F.col("doc_id").isNull() | (component == F.col("doc_id"))).alias("kept"),
    )
