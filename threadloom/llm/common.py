"""Small helpers shared by the training-data operators."""

from __future__ import annotations

import functools
import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space that separates words: space, and tab to carriage return.
SPACE = r"\x20\x09-\x0D"
#: A word, as a pattern for Spark's and Python's regular expressions.
WORD = rf"[^{SPACE}]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``.

    Only where that setting is missing and the master is local (tests) a temporary
    folder is taken; on a cluster a missing setting is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named is None:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        named = tempfile.mkdtemp(prefix="spark-")
        spark.sparkContext.setCheckpointDir(named)
        named = spark.sparkContext.getCheckpointDir()
    return named.rstrip("/")


def materialize(df: DataFrame, name: str, codec: str = "snappy") -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it again.

    The table outlives lost executors, and what follows starts from its files.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path, compression=codec)
    return spark.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, name: str, key: str) -> DataFrame:
    """Like ``materialize``, as a table in buckets of ``key``, so that joins on it don't shuffle its rows."""
    spark = df.sparkSession
    table = f"{name}_{uuid.uuid4().hex}"
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.write.format("parquet").bucketBy(buckets, key).option("path", f"{shared_dir(spark)}/{table}").saveAsTable(table)
    return spark.table(table)


def held_out(key: Column, folds: int, fold: int) -> Column:
    """True where crc32 of the key's text leaves the remainder ``fold``; a null key counts as ''."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % folds == fold


def block_count(df: DataFrame, text: str, block_bytes: int) -> int:
    """How many blocks of about ``block_bytes`` the texts fill, at least one."""
    total = df.agg(F.sum(F.octet_length(text))).first()[0] or 0
    return max(1, -(-total // block_bytes))


def lower_words(text: str | None) -> list[bytes]:
    """The words of a text in UTF-8, A-Z in lower case; none for null."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def pieces(frame: pd.DataFrame, text: str, chars: int) -> Iterator[pd.DataFrame]:
    """Consecutive slices of a batch of about ``chars`` characters; a row is never split."""
    ends = frame[text].str.len().fillna(0).cumsum().to_numpy()
    start = 0
    while start < len(frame):
        base = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, base + chars, side="right")))
        yield frame.iloc[start:stop]
        start = stop


def groups(frames: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[dict[str, np.ndarray]]:
    """The groups of equal ``keys`` of a sorted partition, as arrays by column."""
    rest: pd.DataFrame | None = None
    for frame in frames:
        if rest is not None:
            frame = pd.concat([rest, frame], ignore_index=True)
        if not len(frame):
            rest = None
            continue
        arrays = {c: frame[c].to_numpy() for c in frame.columns}
        changed = np.zeros(len(frame), dtype=bool)
        for key in keys:
            changed[1:] |= arrays[key][1:] != arrays[key][:-1]
        cuts = [0, *np.flatnonzero(changed).tolist()]
        for start, stop in zip(cuts[:-1], cuts[1:], strict=True):
            yield {c: a[start:stop] for c, a in arrays.items()}
        rest = frame.iloc[cuts[-1] :]
    if rest is not None and len(rest):
        yield {c: rest[c].to_numpy() for c in rest.columns}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


class WordHashes(dict):
    """64-bit hashes of words, computed once each; forgets all beyond ``limit`` words."""

    def __init__(self, seed: int = 0, limit: int = 400_000):
        import xxhash

        super().__init__()
        self.seed, self.limit, self.hash = seed, limit, xxhash.xxh64_intdigest

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.limit:
            self.clear()
        value = self[word] = self.hash(word, self.seed)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


#: An odd number whose powers weigh a word's bytes, its inverse modulo 2^64, and bytes that are hashed at once.
_BASE = 0x9E6C63D0876A9A47
_INVERSE = pow(_BASE, -1, 1 << 64)
_STRETCH = 1 << 18


@functools.cache
def _powers(base: int) -> np.ndarray:
    return np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(_STRETCH, base, np.uint64)]))


def word_hashes(data: np.ndarray, separators: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and 64-bit hash of each run of bytes that aren't marked in ``separators`` (256 flags).

    Equal runs have equal hashes wherever they stand: sums of weighted bytes are taken
    at the runs' ends, and a difference is divided by the weight of its first byte.
    """
    edges = np.flatnonzero(np.diff(~separators[data], prepend=False, append=False))
    starts, ends = edges[::2], edges[1::2]
    up, down = _powers(_BASE), _powers(_INVERSE)
    sums, weights = np.zeros(len(edges), np.uint64), np.zeros(len(edges), np.uint64)
    total, mask = 0, (1 << 64) - 1
    for at in range(0, len(data), _STRETCH):
        part = data[at : at + _STRETCH]
        local = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(part * up[: len(part)], out=local[1:])
        a, b = np.searchsorted(edges, [at, at + len(part)], side="left")
        b = len(edges) if at + len(part) == len(data) else b
        here = edges[a:b] - at
        scale = pow(_BASE, at, 1 << 64)
        sums[a:b] = np.uint64(total) + np.uint64(scale) * local[here]
        weights[a:b] = np.uint64(pow(_INVERSE, at, 1 << 64)) * down[here]
        total = (total + scale * int(local[-1])) & mask
    return starts, ends, mix((sums[1::2] - sums[::2]) * weights[::2])


def flags(separators: bytes) -> np.ndarray:
    """256 flags, set for these bytes."""
    marked = np.zeros(256, dtype=bool)
    marked[list(separators)] = True
    return marked


def _last_row(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Lengths of the longest common subsequences of ``a`` with each prefix of ``b``."""
    row = np.zeros(len(b) + 1, np.int32)
    for x in a:
        row[1:] = np.maximum.accumulate(np.maximum(row[1:], np.where(b == x, row[:-1] + 1, 0)))
    return row


def common_positions(a: np.ndarray, b: np.ndarray, cells: int = 1 << 22) -> list[tuple[int, int]]:
    """A longest common subsequence of two arrays, as pairs of positions.

    Tables of more than ``cells`` cells are halved by ``a``, so memory grows with the
    lengths and not with their product.
    """
    n, m = len(a), len(b)
    if not n or not m:
        return []
    if n > 1 and (n + 1) * (m + 1) > cells:
        half = n // 2
        at = int((_last_row(a[:half], b) + _last_row(a[half:][::-1], b[::-1])[::-1]).argmax())
        return common_positions(a[:half], b[:at], cells) + [(i + half, j + at) for i, j in common_positions(a[half:], b[at:], cells)]
    table = np.zeros((n + 1, m + 1), np.int32)
    for i in range(1, n + 1):
        table[i, 1:] = np.maximum.accumulate(np.maximum(table[i - 1, 1:], np.where(b == a[i - 1], table[i - 1, :-1] + 1, 0)))
    found, i, j = [], n, m
    while i and j:
        if table[i, j] == table[i - 1, j]:
            i -= 1
        elif table[i, j] == table[i, j - 1]:
            j -= 1
        else:
            found.append((i - 1, j - 1))
            i, j = i - 1, j - 1
    return found[::-1]
