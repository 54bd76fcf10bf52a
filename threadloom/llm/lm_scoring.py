"""Code lengths of texts under a context tree over bytes, weighted over all depths.

The model is context-tree weighting with binary decomposition: the eight decisions
that lead to a byte each have a tree of the preceding bytes. A node holds how often
its decision came out 0 and 1 there; its Krichevsky-Trofimov probability Pe and its
weighted probability

    Pw = 1/2 Pe + 1/2 product of the children's Pw      (Pw = Pe at the full depth)

are those of the training texts. A decision's probability mixes the estimates of
the nodes along its context with the weights that Pe and Pw imply.

Everything is counted from (depth + 1)-byte grams. Texts fall into pieces and blocks of
bounded size where they lie; a block sends its distinct grams, the tree is built by
grouping the grams by the nearest bytes of their contexts, and each block's pieces are
read again behind the log-probabilities of the block's grams, as one sorted stream.
So no worker and no driver ever holds the whole model.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadloom.llm.common import block_count, flags, materialize, word_hashes

#: Stands before the first byte and behind the last; never part of UTF-8.
EDGE = 0xFF
#: Length of the contexts whose subtrees lie whole in a partition.
ROOT_BYTES = 3
#: Stands for the hash of the end, which is a token without bytes.
NO_WORD = -1
#: Bytes of a piece of a text, and of pieces whose grams are worked on at once; rows of a batch that leaves a worker.
CHUNK, OUT_ROWS = 1 << 19, 50_000
PIECE = ["block", "row", "doc_id", "training", "piece", "last"]
SCORED = ["row", "doc_id", "training", "natural", "n_tokens", "n_known", "base_score", "n_bytes"]
_SPACE = re.compile(rb"[\x20\x09-\x0D]")
_SEPARATORS = flags(b"\x20\x09\x0A\x0B\x0C\x0D" + bytes([EDGE]))


def _log_gamma(x: Column) -> Column:
    """ln of the gamma function for x >= 1/2, by its asymptotic series shifted by six."""
    z = x + 6
    product = reduce(lambda a, k: a * (x + k), range(1, 6), x)
    tail = 1 / (12 * z) - 1 / (360 * z * z * z) + 1 / (1260 * z * z * z * z * z)
    return (z - 0.5) * F.log(z) - z + 0.5 * math.log(2 * math.pi) + tail - F.log(product)


def _log_kt(zeros: Column, ones: Column) -> Column:
    """ln of the Krichevsky-Trofimov probability of so many zeros and ones."""
    return _log_gamma(zeros + 0.5) + _log_gamma(ones + 0.5) - _log_gamma(zeros + ones + 1.0) - math.log(math.pi)


def _log_kt_array(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """The same for arrays."""

    def log_gamma(x: np.ndarray) -> np.ndarray:
        z = x + 6
        product = np.prod([x + k for k in range(6)], axis=0)
        return (z - 0.5) * np.log(z) - z + 0.5 * math.log(2 * math.pi) + 1 / (12 * z) - 1 / (360 * z**3) + 1 / (1260 * z**5) - np.log(product)

    return log_gamma(zeros + 0.5) + log_gamma(ones + 0.5) - log_gamma(zeros + ones + 1.0) - math.log(math.pi)


def _log_sum(a: Column, b: Column) -> Column:
    return F.greatest(a, b) + F.log1p(F.exp(-F.abs(a - b)))


def _nodes(grams: np.ndarray, n: np.ndarray, depth: int, least: int) -> list[dict]:
    """The tree's nodes for whole subtrees, from depth down to the level ``least``.

    Each level has key (context bytes, then the decision's place in the byte), zeros,
    ones, ln_w and share (weight of the node's own estimate); ``up`` leads from a
    level's nodes to those of the next shorter context. The first level's ``of`` leads
    from each gram's eight decisions to its nodes, ``bit`` has how they came out.
    """
    k = np.arange(8)
    symbol = (grams & 255)[:, None]
    bit = (symbol >> (7 - k)) & 1
    keys, of = np.unique((grams - (grams & 255))[:, None] + ((1 << k) | (symbol >> (8 - k))), return_inverse=True)
    of = of.reshape(-1)
    ones = np.bincount(of, weights=(bit * n[:, None]).ravel(), minlength=len(keys))
    zeros = np.bincount(of, weights=np.repeat(n, 8), minlength=len(keys)) - ones
    ln_e = _log_kt_array(zeros, ones)
    levels = [{"key": keys, "zeros": zeros, "ones": ones, "ln_w": ln_e, "share": np.ones(len(keys)), "of": of, "bit": bit}]
    for d in range(depth - 1, least - 1, -1):
        below = levels[-1]
        keys, up = np.unique(below["key"] & (256 ** (d + 1) - 1), return_inverse=True)
        zeros, ones, product = (np.bincount(up, weights=below[x], minlength=len(keys)) for x in ("zeros", "ones", "ln_w"))
        ln_e = _log_kt_array(zeros, ones)
        ln_w = math.log(0.5) + np.logaddexp(ln_e, product)
        below["up"] = up
        levels.append({"key": keys, "zeros": zeros, "ones": ones, "ln_w": ln_w, "share": np.exp(math.log(0.5) + ln_e - ln_w)})
    return levels


def _runs(frames: Iterator[pd.DataFrame], rows: int = 100_000) -> Iterator[pd.DataFrame]:
    """Stretches of about ``rows`` rows of a sorted partition that end where the subtree ends."""
    kept: list[pd.DataFrame] = []
    for frame in frames:
        kept.append(frame)
        if sum(map(len, kept)) < rows:
            continue
        frame = pd.concat(kept, ignore_index=True)
        roots = frame["root"].to_numpy()
        cut = int(np.searchsorted(roots, roots[-1]))
        if cut:
            yield frame.iloc[:cut]
        kept = [frame.iloc[cut:]]
    if kept and len(frame := pd.concat(kept, ignore_index=True)):
        yield frame


def gram_log_probabilities(grams: DataFrame, depth: int) -> DataFrame:
    """gram and ln_p: the last byte's log-probability after the others.

    ``grams(gram, n)``: distinct grams of depth + 1 bytes as numbers, and how often
    the training texts hold them; a gram with n = 0 is scored only.

    Subtrees below contexts of ``ROOT_BYTES`` bytes lie whole in a partition and are
    worked on there; the few levels above them are grouped and joined as tables.
    """
    root = min(ROOT_BYTES, depth)
    mask = 256**root - 1
    rooted = grams.withColumn("root", F.shiftright("gram", 8).bitwiseAND(mask))

    def upward(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in _runs(frames):
            top = _nodes(frame["gram"].to_numpy(), frame["n"].to_numpy(), depth, root)[-1]
            yield pd.DataFrame({x: top[x] for x in ("key", "zeros", "ones", "ln_w", "share")})

    node = "key long, zeros double, ones double, ln_w double, share double"
    sorted_grams = rooted.repartition("root").sortWithinPartitions("root")
    levels = {root: materialize(sorted_grams.mapInPandas(upward, node), f"level{root}")}
    for d in range(root - 1, -1, -1):
        shorter = F.col("key").bitwiseAND((256 ** (d + 1)) - 1).alias("key")
        level = levels[d + 1].groupBy(shorter).agg(
            F.sum("zeros").alias("zeros"), F.sum("ones").alias("ones"), F.sum("ln_w").alias("below")
        )
        half = math.log(0.5)
        level = level.withColumn("ln_e", _log_kt(F.col("zeros"), F.col("ones")))
        level = level.withColumn("ln_w", half + _log_sum(F.col("ln_e"), F.col("below")))
        level = level.select("key", "zeros", "ones", "ln_w", F.exp(half + F.col("ln_e") - F.col("ln_w")).alias("share"))
        levels[d] = materialize(level, f"level{d}")
    estimate = (F.col("ones") + 0.5) / (F.col("zeros") + F.col("ones") + 1.0)
    path = levels[0].select("key", (F.col("share") * estimate).alias("p"), (1 - F.col("share")).alias("rest"))
    for d in range(1, root + 1):
        above = path.select(F.col("key").alias("above"), F.col("p").alias("p_above"), "rest")
        here = levels[d].withColumn("above", F.col("key").bitwiseAND((256**d) - 1))
        path = here.join(above, "above").select(
            "key",
            (F.col("p_above") + F.col("rest") * F.col("share") * estimate).alias("p"),
            (F.col("rest") * (1 - F.col("share"))).alias("rest"),
        )
    # a subtree's grams and the decisions at its root come together; decisions have n < 0
    decisions = path.select("key", F.lit(-1).cast("long"), F.shiftright("key", 8), "p", "rest").toDF("gram", "n", "root", "p", "rest")
    both = rooted.select("gram", "n", "root", F.lit(0.0).alias("p"), F.lit(0.0).alias("rest")).union(decisions)

    def downward(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in _runs(frames):
            above = frame["n"].to_numpy() < 0
            tops, rows = frame[above].sort_values("gram"), frame[~above]
            gram = rows["gram"].to_numpy()
            levels = _nodes(gram, rows["n"].to_numpy(), depth, root)
            at = np.searchsorted(tops["gram"].to_numpy(), levels[-1]["key"])
            p, rest = tops["p"].to_numpy()[at], tops["rest"].to_numpy()[at]
            for level in reversed(levels[:-1]):
                p, rest = p[level["up"]], rest[level["up"]]
                estimate = (level["ones"] + 0.5) / (level["zeros"] + level["ones"] + 1)
                p, rest = p + rest * level["share"] * estimate, rest * (1 - level["share"])
            p = p[levels[0]["of"]].reshape(-1, 8)
            ln_p = np.log(np.where(levels[0]["bit"] == 1, p, 1 - p)).sum(axis=1)
            yield pd.DataFrame({"gram": gram, "ln_p": ln_p})

    return both.repartition("root").sortWithinPartitions("root").mapInPandas(downward, "gram long, ln_p double")


def _grams(data: np.ndarray, depth: int) -> np.ndarray:
    """The grams that lie in these bytes, one for each byte but the first ``depth``."""
    n = len(data) - depth
    keys = np.zeros(n, np.int64)
    for i in range(depth + 1):
        keys <<= 8
        keys |= data[i : i + n]
    return keys


class _Stretch:
    """Consecutive pieces of a batch: their bytes, one after another, without copying them."""

    def __init__(self, pieces: pa.BinaryArray, last: np.ndarray, depth: int):
        _, offsets, data = pieces.buffers()
        ends = np.frombuffer(offsets, np.int32)[pieces.offset : pieces.offset + len(pieces) + 1].astype(np.int64)
        self.data = np.frombuffer(data, np.uint8)[ends[0] : ends[-1]]
        self.starts, self.ends, self.last, self.depth = ends[:-1] - ends[0], ends[1:] - ends[0], last, depth

    def grams(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Grams, and the numbers of their pieces, ``CHUNK`` bytes at a time."""
        for at in range(0, len(self.data) - self.depth, CHUNK):
            part = self.data[at : at + CHUNK + self.depth]
            stop = at + len(part) - self.depth
            first, final = np.searchsorted(self.ends, [at, stop - 1], side="right")
            sizes = np.diff(np.minimum(self.ends[first : final + 1], stop), prepend=at)
            piece = np.repeat(np.arange(first, final + 1, dtype=np.int32), sizes)
            # the context must lie in the same piece as the byte behind it
            whole = np.arange(at + self.depth, at + len(part)) < self.ends[piece]
            yield _grams(part, self.depth)[whole], piece[whole]

    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Starts, ends and hashes of words, and the numbers of their pieces; contexts have none."""
        data = self.data.copy()
        for i in range(self.depth):
            data[self.starts + i] = EDGE
        starts, ends, hashes = word_hashes(data, _SEPARATORS)
        return starts, ends, hashes.view(np.int64), np.searchsorted(self.ends, starts, side="right")


def _stretches(batch: pa.RecordBatch, first: int, stop: int, depth: int) -> Iterator[tuple[int, int, _Stretch]]:
    """Rows ``first`` to ``stop`` of a batch in stretches of about ``CHUNK`` bytes."""
    sizes = np.cumsum(pc.binary_length(batch.column("piece").slice(first, stop - first)).to_numpy(zero_copy_only=False))
    cuts = np.flatnonzero(np.diff(sizes // CHUNK, prepend=-1)).tolist() + [stop - first]
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        last = batch.column("last").slice(first + a, b - a).to_numpy(zero_copy_only=False).astype(bool)
        yield first + a, first + b, _Stretch(batch.column("piece").slice(first + a, b - a), last, depth)


def _runs_of(batch: pa.RecordBatch) -> Iterator[tuple[int, int, int]]:
    """Blocks of a batch, each with its first row and the one behind it."""
    blocks = batch.column("block").to_numpy()
    cuts = [0, *(np.flatnonzero(blocks[1:] != blocks[:-1]) + 1).tolist(), len(blocks)]
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        if b > a:
            yield int(blocks[a]), a, b


def _split(text: bytes, depth: int, size: int) -> Iterator[tuple[bytes, bool]]:
    """Pieces of about ``size`` bytes that end before white space, each behind ``depth`` bytes of context; whether it is the last.

    The last piece ends with the edge. A word is never cut, however long.
    """
    edge = bytes([EDGE])
    start = 0
    while True:
        space = _SPACE.search(text, start + size) if len(text) - start > size else None
        stop = space.start() if space else len(text)
        context = text[max(0, start - depth) : start]
        yield edge * (depth - len(context)) + context + text[start:stop] + (b"" if space else edge), space is None
        if space is None:
            return
        start = stop


def _sum_by(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys and the sums of their numbers."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[starts], np.add.reduceat(n[order], starts)


class _Counts:
    """Grams and words of one block, with their counts in training texts; words are told by hashes."""

    def __init__(self, block: int):
        self.block = block
        self.grams: list[tuple[np.ndarray, np.ndarray]] = []
        self.words: list[tuple[np.ndarray, np.ndarray]] = []
        self.spelled: list[tuple[np.ndarray, pa.Array]] = []

    def add(self, stretch: _Stretch, training: np.ndarray) -> None:
        for grams, piece in stretch.grams():
            distinct, n = np.unique((grams << 1) | training[piece], return_counts=True)
            self.grams.append(_sum_by(distinct >> 1, n * (distinct & 1)))
        starts, ends, hashes, piece = stretch.words()
        distinct, first, of = np.unique(hashes, return_index=True, return_inverse=True)
        self.words.append((distinct, np.bincount(of, weights=training[piece], minlength=len(distinct)).astype(np.int64)))
        known = self.spelled[0][0] if self.spelled else np.empty(0, np.int64)
        new = ~np.isin(distinct, known, assume_unique=True)
        self.spelled.append((distinct[new], pa.array([stretch.data[a:b].tobytes() for a, b in zip(starts[first[new]], ends[first[new]], strict=True)], pa.binary())))
        self.words.append((np.array([NO_WORD]), np.array([int((training & stretch.last).sum())])))
        if len(self.grams) >= 6:
            self._merge()

    def _merge(self) -> None:
        self.grams = [_sum_by(*map(np.concatenate, zip(*self.grams, strict=True)))]
        self.words = [_sum_by(*map(np.concatenate, zip(*self.words, strict=True)))]
        hashes, first = np.unique(np.concatenate([h for h, _ in self.spelled]), return_index=True)
        self.spelled = [(hashes, pa.concat_arrays([w for _, w in self.spelled]).take(pa.array(first)))]

    def rows(self) -> Iterator[pa.RecordBatch]:
        self._merge()
        (keys, n), (words, times), (hashes, spelled) = self.grams[0], self.words[0], self.spelled[0]
        place = np.searchsorted(hashes, words)
        known = (place < len(hashes)) & (hashes[np.minimum(place, len(hashes) - 1)] == words) if len(hashes) else np.zeros(len(words), bool)
        spelled = spelled.take(pa.array(np.where(known, place, 0), mask=~known)).fill_null(b"")
        for key, word, count in ((keys, None, n), (words, spelled, times)):
            for at in range(0, len(key), OUT_ROWS):
                size = min(OUT_ROWS, len(key) - at)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(size, self.block)), pa.array(key[at : at + size]), pa.nulls(size, pa.binary()) if word is None else word.slice(at, size), pa.array(count[at : at + size])],
                    ["block", "gram", "word", "n"],
                )


class _Table:
    """Numbers by 64-bit key; a key that wasn't added has the number ``other``."""

    def __init__(self, other: float) -> None:
        self.other = other
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []
        self.index: pd.Index | None = None

    def add(self, keys: np.ndarray, values: np.ndarray) -> None:
        self.parts.append((keys, values))

    def get(self, keys: np.ndarray) -> np.ndarray:
        if self.index is None:
            keys_of, values_of = zip((np.empty(0, np.int64), np.empty(0, np.float32)), *self.parts, strict=True)
            known, first = np.unique(np.concatenate(keys_of), return_index=True)
            self.values = np.concatenate(values_of)[first]
            self.index, self.parts = pd.Index(known), []
        at = self.index.get_indexer(keys)
        return np.where(at < 0, self.other, self.values[at]) if len(self.values) else np.full(len(keys), self.other)


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of block, is_word, key and value, many of a block in one row."""
    waiting: list[pa.RecordBatch] = []

    def pack() -> pa.RecordBatch:
        table = pa.Table.from_batches(waiting)
        block, is_word, key, value = (table.column(c).to_numpy() for c in ("block", "is_word", "key", "value"))
        group = block * 2 + is_word.astype(np.int64)
        order = np.argsort(group, kind="stable")
        cuts = np.flatnonzero(np.diff(group[order], prepend=-1)).tolist() + [len(order)]
        parts = [order[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        return pa.RecordBatch.from_arrays(
            [
                pa.array([int(block[p[0]]) for p in parts], pa.int64()),
                pa.array([bool(is_word[p[0]]) for p in parts]),
                pa.array([key[p].tobytes() for p in parts], pa.binary()),
                pa.array([value[p].tobytes() for p in parts], pa.binary()),
            ],
            ["block", "is_word", "keys", "values"],
        )

    for batch in batches:
        waiting.append(batch)
        if sum(b.num_rows for b in waiting) >= 10 * OUT_ROWS:
            yield pack()
            waiting = []
    if any(b.num_rows for b in waiting):
        yield pack()


def context_tree_scores(docs: DataFrame, training: Column, depth: int = 5, block_bytes: int = 64 << 20, piece_bytes: int = CHUNK) -> DataFrame:
    """Score every text by the context tree learned from the rows where ``training`` holds.

    ``depth`` is 6 at most, so that a gram fits a long.

    ``docs(doc_id, text)``; other columns serve ``training`` only. Returns for each
    row: doc_id, training, n_tokens, n_known, train_tokens, base_score, score,
    n_bytes and bits_per_byte (code length, the end included, over the bytes).

    Texts are lower-cased in A-Z. score is the log10 probability of all the text's
    bytes and its end. base_score is that of a word unigram model: words and one end
    each, add-half smoothing over the V training tokens and one unknown.

    A null text counts as empty: it has one token, the end. A null ``training`` is
    false. Without training rows every estimate is 1/2 and every count 0. Repeated
    rows are learned from and scored once each. Long texts fall into pieces of about
    ``piece_bytes`` with the context before them, so that no task holds more than a
    block's distinct grams and words and a batch of pieces.
    """
    id_type = docs.schema["doc_id"].dataType.simpleString()
    read = docs.select("doc_id", "text", F.coalesce(training, F.lit(False)).alias("training"))
    blocks = block_count(read, "text", block_bytes)
    read = read.coalesce(blocks).withColumn("row", F.monotonically_increasing_id())

    def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        first, total = TaskContext.get().partitionId() << 24, 0
        for frame in frames:
            out, size = [], 0
            for row, doc, text, marked in zip(frame["row"], frame["doc_id"], frame["text"], frame["training"], strict=True):
                lowered = text.encode("utf-8", "surrogatepass").lower() if text else b""
                for piece, last in _split(lowered, depth, piece_bytes):
                    out.append((first + total // block_bytes, row, doc, marked, piece, last))
                    total, size = total + len(piece), size + len(piece)
                    if size >= 4 * CHUNK:
                        yield pd.DataFrame(out, columns=PIECE)
                        out, size = [], 0
            if out:
                yield pd.DataFrame(out, columns=PIECE)

    pieces = materialize(read.mapInPandas(cut, f"block long, row long, doc_id {id_type}, training boolean, piece binary, last boolean"), "pieces", "zstd")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: _Counts | None = None
        for batch in batches:
            training = batch.column("training").to_numpy(zero_copy_only=False).astype(bool)
            for block, first, stop in _runs_of(batch):
                if now and now.block != block:
                    yield from now.rows()
                    now = None
                now = now or _Counts(block)
                for a, b, stretch in _stretches(batch, first, stop, depth):
                    now.add(stretch, training[a:b])
        if now:
            yield from now.rows()

    counted = pieces.select("block", "training", "piece", "last").mapInArrow(count, "block long, gram long, word binary, n long")
    counted = materialize(counted, "counted", "zstd")
    grams = counted.where(F.col("word").isNull()).select("block", "gram", "n")
    words = counted.where(F.col("word").isNotNull()).select("block", F.col("gram").alias("hash"), "word", "n")
    ln_p = gram_log_probabilities(materialize(grams.groupBy("gram").agg(F.sum("n").alias("n")), "grams"), depth)
    totals = materialize(words.groupBy("word").agg(F.first("hash").alias("hash"), F.sum("n").alias("n")), "words")
    all_tokens, distinct = totals.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.when(F.col("n") > 0, 1))).first()
    answers = grams.join(ln_p, "gram").select("block", F.lit(False).alias("is_word"), F.col("gram").alias("key"), F.col("ln_p").cast("float").alias("value")).union(
        # most words were learned once: a block isn't told these
        words.select("block", "hash").join(totals.where("n <> 1"), "hash").select("block", F.lit(True), "hash", F.col("n").cast("float"))
    )
    # a block's answers come first, its pieces after them
    both = answers.mapInArrow(_packed, "block long, is_word boolean, keys binary, values binary").unionByName(pieces, allowMissingColumns=True)
    both = both.repartition(4 * blocks, "block").withColumn("is_piece", F.col("piece").isNotNull()).sortWithinPartitions("block", "is_piece")
    rest = math.log10(all_tokens + 0.5 * (distinct + 1))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, ln_p, times = None, _Table(math.nan), _Table(1.0)
        for batch in batches:
            for block, first, stop in _runs_of(batch):
                if block != now:
                    now, ln_p, times = block, _Table(math.nan), _Table(1.0)
                middle = stop - int(batch.column("is_piece").slice(first, stop - first).to_numpy(zero_copy_only=False).sum())
                if middle > first:
                    told = batch.slice(first, middle - first)
                    for is_word, keys, values in zip(*(told.column(c).to_pylist() for c in ("is_word", "keys", "values")), strict=True):
                        (times if is_word else ln_p).add(np.frombuffer(keys, np.int64), np.frombuffer(values, np.float32))
                for a, b, stretch in _stretches(batch, middle, stop, depth):
                    yield scored(batch.slice(a, b - a), stretch, ln_p, times)

    def scored(rows: pa.RecordBatch, stretch: _Stretch, ln_p: _Table, times: _Table) -> pa.RecordBatch:
        n = rows.num_rows
        natural = np.zeros(n)
        for grams, piece in stretch.grams():
            natural += np.bincount(piece, weights=ln_p.get(grams), minlength=n)
        _, _, hashes, piece = stretch.words()
        # each text's end is a token of its own
        piece = np.concatenate([piece, np.flatnonzero(stretch.last)])
        found = times.get(np.concatenate([hashes, np.full(int(stretch.last.sum()), NO_WORD)]))
        tokens = np.bincount(piece, minlength=n)
        known = np.bincount(piece, weights=found > 0, minlength=n).astype(np.int64)
        base = np.bincount(piece, weights=np.log10(found + 0.5), minlength=n) - tokens * rest
        sizes = stretch.ends - stretch.starts - depth - stretch.last
        own = [rows.column(c) for c in ("row", "doc_id", "training")]
        return pa.RecordBatch.from_arrays([*own, *map(pa.array, (natural, tokens, known, base, sizes))], SCORED)

    schema = f"row long, doc_id {id_type}, training boolean, natural double, n_tokens long, n_known long, base_score double, n_bytes long"
    whole = both.mapInArrow(score, schema).groupBy("row", "doc_id", "training").agg(*[F.sum(c).alias(c) for c in SCORED[3:]])
    return whole.select(
        "doc_id", "training", "n_tokens", "n_known", F.lit(all_tokens).cast("long").alias("train_tokens"), "base_score",
        (F.col("natural") / math.log(10)).alias("score"), "n_bytes", (-F.col("natural") / math.log(2) / F.greatest("n_bytes", F.lit(1))).alias("bits_per_byte"),
    )
