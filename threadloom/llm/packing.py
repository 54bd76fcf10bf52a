"""Packing of tokenised documents into training sequences along a Hilbert curve.

Each document gets a vector (counts of its hashed byte pairs), which a fixed
random projection takes to a few dimensions; its cell on a Hilbert curve through
those dimensions is its sort key. Documents are range-partitioned and sorted by
that key, so that neighbours in a sequence resemble each other, and only then
tokenised: ids never pass through a shuffle.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.llm.common import pieces

PIECES = (
    "doc_id {id_type}, start long, length long, ids_crc32 long, doc_tokens long, "
    "sequence_id long, offset long"
)
#: The curve's dimensions and the bits of each.
DIMS, BITS = 4, 8
#: The curve's stretches by which its bytes are counted: 2**CELL_BITS of equal length.
CELL_BITS = 16
#: Byte pairs are hashed to so many counters before they are projected.
PAIR_BUCKETS = 8192
#: Pieces between spaces whose ids a worker remembers.
REMEMBERED = 400_000
#: A space after and before white space: there a text can't be cut at each space.
_RUNS = re.compile(r"\s \s|^ \s|\s $")


def hilbert_key(cells: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Positions on the Hilbert curve of points with integer coordinates below 2**bits.

    ``cells`` has a row for each point and a column for each dimension. The
    coordinates are turned into the transposed form of the index by undoing, from
    the highest bit down, the exchanges and inversions by which the curve's
    sub-cubes are rotated; a Gray decoding and interleaving of bits follow.
    """
    x = cells.astype(np.int64).T.copy()
    dims = len(x)
    top = 1 << (bits - 1)
    q = top
    while q > 1:
        low = q - 1
        for i in range(dims):
            inverted = (x[i] & q) != 0
            swap = np.where(inverted, 0, (x[0] ^ x[i]) & low)
            x[0] ^= np.where(inverted, low, swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    turn = np.zeros_like(x[0])
    q = top
    while q > 1:
        turn ^= np.where((x[-1] & q) != 0, q - 1, 0)
        q >>= 1
    x ^= turn
    key = np.zeros_like(x[0])
    for bit in range(bits - 1, -1, -1):
        for i in range(dims):
            key = (key << 1) | ((x[i] >> bit) & 1)
    return key


def _projection() -> np.ndarray:
    return np.random.default_rng(20240229).standard_normal((PAIR_BUCKETS, DIMS)).astype(np.float32)


def document_keys(texts: list[str], projection: np.ndarray) -> np.ndarray:
    """The Hilbert key of each text; the empty text's vector is zero."""
    data = [t.encode("utf-8", "surrogatepass") for t in texts]
    sizes = np.array([len(d) for d in data])
    raw = np.frombuffer(b"".join(data), dtype=np.uint8).astype(np.uint32)
    vectors = np.zeros((len(data), DIMS))
    if len(raw) > 1:
        pairs = ((raw[:-1] * np.uint32(257) + raw[1:]) * np.uint32(2654435761)) >> np.uint32(19)
        ends = np.cumsum(sizes)
        for i, (start, stop) in enumerate(zip(ends - sizes, ends, strict=True)):
            if stop - start > 1:
                counts = np.bincount(pairs[start : stop - 1], minlength=PAIR_BUCKETS)
                vectors[i] = counts @ projection / (stop - start - 1)
    norm = np.linalg.norm(vectors, axis=1, keepdims=True)
    unit = vectors / np.where(norm == 0, 1, norm)
    return hilbert_key(np.clip((unit + 1) * (1 << (BITS - 1)), 0, (1 << BITS) - 1).astype(np.int64))


class _Ids(dict):
    """Token ids, as bytes of 32-bit numbers, of the pieces a text falls into before its spaces."""

    def __init__(self, encode):
        super().__init__()
        self.encode = encode

    def __missing__(self, piece: str) -> bytes:
        if len(self) >= REMEMBERED:
            self.clear()
        ids = self[piece] = np.array(self.encode(piece), dtype="<u4").tobytes()
        return ids


class TextTokens:
    """A text's ids under the byte-level BPE of ``name``.json.

    The fast path reads the same vocabulary as ranks. A token never holds a space
    behind other characters, so a text without runs of white space may be cut
    before each space and equal pieces looked up. Texts that name a special token
    go to the tokenizer's own reader.
    """

    def __init__(self, name: str):
        import base64

        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        with open(public_tokenizers.path(f"{name}.tiktoken"), "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        fast = tiktoken.Encoding(name, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.slow = Tokenizer.from_file(public_tokenizers.path(f"{name}.json"))
        self.special = [t.content for t in self.slow.get_added_tokens_decoder().values()]
        self.encode = fast.encode_ordinary
        self.known = _Ids(self.encode)

    def ids(self, text: str) -> np.ndarray:
        if any(s in text for s in self.special):
            return np.array(self.slow.encode(text, add_special_tokens=False).ids, dtype="<u4")
        if not text:
            return np.empty(0, dtype="<u4")
        if _RUNS.search(text):
            return np.array(self.encode(text), dtype="<u4")
        first, *rest = text.split(" ")
        joined = self.known[first] if first else b""
        return np.frombuffer(joined + b"".join(map(self.known.__getitem__, [" " + r for r in rest])), dtype="<u4")


def pack_documents(
    docs: DataFrame,
    sequence_tokens: int = 1024,
    tokenizer: str = "byte_bpe_50k",
    end_id: int = 0,
    partition_bytes: int = 32 << 20,
) -> DataFrame:
    """Cut and pack the documents of ``docs(doc_id, text)`` into full sequences.

    Returns a row for each piece: doc_id, start (its document's ids before it),
    length, ids_crc32 (of its ids as little-endian unsigned 32-bit numbers),
    doc_tokens (with the end id), sequence_id and offset (place in the sequence).

    Every partition is a run of the curve of about ``partition_bytes`` (a stretch of
    the curve that holds more is dealt to several by hash) and is cut every ``sequence_tokens``
    ids. What remains at its end is cut into powers of two, largest first, so that
    no sequence needs padding.

    A null or empty text is its end id alone. Repeated rows are packed once each,
    equal keys are ordered by doc_id and text. No rows give no pieces; columns
    beyond doc_id and text are ignored.
    """
    id_type = docs.schema["doc_id"].dataType.simpleString()
    read = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    read = read.withColumn("draw", F.xxhash64("doc_id", "text"))
    # ids rise within a partition; partitions are told apart by the upper bits
    shift = 1 << 36

    def with_key(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        projection = _projection()
        for frame in frames:
            for part in pieces(frame, "text", 4 << 20):
                yield part.assign(curve=document_keys(part["text"].tolist(), projection))

    def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        tokens = TextTokens(tokenizer)
        sequence, offset = TaskContext.get().partitionId() * shift, 0
        tail: list[tuple] = []  # pieces of the sequence that isn't full yet, with their ids

        def finished(piece: tuple) -> tuple:
            doc, start, ids, total, at = piece
            return doc, start, len(ids), zlib.crc32(ids.tobytes()), total, sequence, at

        columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
        for frame in frames:
            out: list[tuple] = []
            for doc, text in zip(frame["doc_id"], frame["text"], strict=True):
                ids = np.append(tokens.ids(text), np.uint32(end_id)).astype("<u4")
                start = 0
                while start < len(ids):
                    took = ids[start : start + sequence_tokens - offset]
                    tail.append((doc, start, took, len(ids), offset))
                    start, offset = start + len(took), offset + len(took)
                    if offset == sequence_tokens:
                        out += map(finished, tail)
                        tail, sequence, offset = [], sequence + 1, 0
            if out:
                yield pd.DataFrame(out, columns=columns)
        out, left, room, at = [], offset, 0, 0
        for doc, start, ids, total, _ in tail:
            while len(ids):
                if not room:
                    room, at = 1 << (left.bit_length() - 1), 0
                took, ids = ids[:room], ids[room:]
                out.append(finished((doc, start, took, total, at)))
                start, at, room, left = start + len(took), at + len(took), room - len(took), left - len(took)
                if not room:
                    sequence += 1
        if out:
            yield pd.DataFrame(out, columns=columns)

    keyed = read.mapInPandas(with_key, f"doc_id {id_type}, text string, draw long, curve long")
    # bytes of each stretch of the curve, 65,536 of them at most
    stretch = F.shiftright("curve", DIMS * BITS - CELL_BITS).alias("stretch")
    sizes = keyed.groupBy(stretch).agg(F.sum(F.octet_length("text")).alias("size")).orderBy("stretch").toPandas()
    parts = np.maximum(1, np.ceil(sizes["size"].to_numpy(float) / partition_bytes)).astype(np.int64)
    full = np.cumsum(sizes["size"].to_numpy(float)) // partition_bytes
    # small stretches share a range until it is full, a large one has ranges of its own
    alone = parts > 1
    opens = np.concatenate([[True], (full[1:] != full[:-1]) | alone[1:] | alone[:-1]]) if len(sizes) else np.empty(0, bool)
    ends = np.cumsum(np.where(opens, parts, 0)) if len(sizes) else np.empty(0, np.int64)
    first = np.zeros(1 << CELL_BITS, np.int64)
    many = np.ones(1 << CELL_BITS, np.int64)
    first[sizes["stretch"]], many[sizes["stretch"]] = ends - parts, parts
    count = int(ends[-1]) if len(sizes) else 1

    def dealt(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in with_key(frames):
            at = part["curve"].to_numpy() >> (DIMS * BITS - CELL_BITS)
            yield part.drop(columns="draw").assign(range=first[at] + part["draw"].to_numpy() % many[at])

    ranged = read.mapInPandas(dealt, f"doc_id {id_type}, text string, curve long, range int").repartitionById(count, "range")
    return ranged.sortWithinPartitions("curve", "doc_id", "text").mapInPandas(cut, PIECES.format(id_type=id_type))
