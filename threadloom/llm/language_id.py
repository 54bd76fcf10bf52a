"""Language identification by cross-parsing texts against labelled text of each language.

For each language a suffix automaton is built over sampled labelled text. A text is
parsed greedily into the longest phrases that occur in that text; a language in
which few phrases suffice has a low cross entropy. Phrases are counted with the
length of the automaton's text taken into account, and the language with the lowest
normalised count wins. Many segments are parsed side by side: a step moves each by
one character through a table of transitions.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadloom.llm.common import pieces

#: Characters (at most four symbols each) and symbols of the text behind each language's automaton at most.
SAMPLE_CHARS = 40_000
#: Letters with a symbol of their own, a space among them. Any other letter is spelled out: a lead symbol and three digits of 5 bits.
COMMON, LEADS, DIGITS = 96, 8, 32
SYMBOLS = COMMON + LEADS + DIGITS
SPELLED = 255
#: Characters of a segment; a phrase ends with its segment.
SEGMENT = 1024


def _plain(text: str) -> str:
    """Lower case, with one space for everything that isn't a letter."""
    return " ".join("".join(c if c.isalpha() else " " for c in text.lower()).split())


def suffix_automaton(codes: np.ndarray, symbols: int) -> np.ndarray:
    """Transitions by state and symbol of the automaton of all substrings; -1 where there is none."""
    size = 2 * len(codes) + 1
    step = np.full((size, symbols), -1, np.int32)
    link, length = [-1] + [0] * size, [0] * (size + 1)
    last, states = 0, 1
    for c in codes.tolist():
        new, p = states, last
        states += 1
        length[new] = length[last] + 1
        while p != -1 and step[p, c] == -1:
            step[p, c] = new
            p = link[p]
        if p == -1:
            link[new] = 0
        else:
            q = int(step[p, c])
            if length[q] == length[p] + 1:
                link[new] = q
            else:
                copy = states
                states += 1
                length[copy], step[copy], link[copy] = length[p] + 1, step[q], link[q]
                while p != -1 and step[p, c] == q:
                    step[p, c] = copy
                    p = link[p]
                link[q] = link[new] = copy
        last = new
    return step[:states]


class CrossParser:
    """The automata of all languages, side by side in one table."""

    def __init__(self, samples: dict[str, str], sample_symbols: int = SAMPLE_CHARS):
        self.languages = sorted(samples)
        texts = {k: _plain(samples[k]) for k in self.languages}
        counts: dict[str, int] = {}
        for text in texts.values():
            for c in text:
                counts[c] = counts.get(c, 0) + 1
        kept = sorted(counts, key=lambda c: (c != " ", -counts[c], c))
        kept = [" ", *(c for c in kept if c != " ")][:COMMON]
        self.code = np.full(0x110000, SPELLED, np.uint8)
        for i, c in enumerate(kept):  # a space has the code 0
            self.code[ord(c)] = i
        tables, self.roots, at = [], [], 0
        codes = [self.encode(texts[k])[:sample_symbols] for k in self.languages]
        for text in codes:
            table = suffix_automaton(text, SYMBOLS)
            tables.append(np.where(table >= 0, table + at, -1).astype(np.int32))
            self.roots.append(at)
            at += len(table)
        self.step = np.concatenate(tables) if tables else np.empty((0, SYMBOLS), np.int32)
        # fewer phrases are needed against a longer text, by the ratio of the logarithms
        self.weight = np.log2(np.array([max(4, len(text)) for text in codes]))

    def encode(self, plain: str) -> np.ndarray:
        letters = np.frombuffer(plain.encode("utf-32-le", "surrogatepass"), np.uint32)
        codes = self.code[letters]
        spelled = codes == SPELLED
        if not spelled.any():
            return codes
        sizes = np.where(spelled, 4, 1)
        out = np.repeat(codes, sizes)
        first, rare = (np.cumsum(sizes) - sizes)[spelled], letters[spelled]
        out[first] = COMMON + (rare >> 15)  # no letter is beyond 0x3FFFF
        for i, shift in enumerate((10, 5, 0), 1):
            out[first + i] = COMMON + LEADS + (rare >> shift & 31)
        return out

    def phrases(self, plain: list[str]) -> np.ndarray:
        """Phrases of each text (rows) against each language (columns)."""
        segments, of = [], []
        for i, text in enumerate(plain):
            codes = self.encode(text)
            for start in range(0, len(codes), SEGMENT):
                segments.append(codes[start : start + SEGMENT])
                of.append(i)
        total = np.zeros((len(plain), len(self.languages)))
        if not segments:
            return total
        order = sorted(range(len(segments)), key=lambda i: -len(segments[i]))
        sizes = np.array([len(segments[i]) for i in order])
        grid = np.zeros((int(sizes[0]), len(order)), np.uint8)
        for column, i in enumerate(order):
            grid[: len(segments[i]), column] = segments[i]
        active = np.searchsorted(-sizes, -np.arange(len(grid)), side="left")
        flat = self.step.ravel()
        for k, root in enumerate(self.roots):
            state, ended = np.full(len(order), root, np.int32), np.ones(len(order), np.int32)
            start = flat[root * SYMBOLS : (root + 1) * SYMBOLS]
            start = np.where(start < 0, root, start)
            for at, n in enumerate(active.tolist()):
                c = grid[at, :n]
                now = flat[state[:n] * SYMBOLS + c]
                failed = now < 0
                ended[:n] += failed
                state[:n] = np.where(failed, start[c], now)
            total[:, k] = np.bincount(np.array(of)[order], weights=ended, minlength=len(plain))
        return total

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        plain = [_plain(t) if t else "" for t in texts]
        costs = self.phrases(plain) * self.weight
        languages, scores = [], []
        for text, cost in zip(plain, costs, strict=True):
            if not text or not len(cost):
                languages.append("und")
                scores.append(0.0)
                continue
            best = int(cost.argmin())
            # bits for each character saved against the others, as a share among languages
            relative = np.exp2(-(cost - cost[best]) / max(1, len(text)) * 8)
            languages.append(self.languages[best])
            scores.append(float(1 / relative.sum()))
        return languages, scores


def sample_by_language(docs: DataFrame, training: Column, sample_chars: int = SAMPLE_CHARS) -> dict[str, str]:
    """For each language, training texts in the order of their hash, ``sample_chars`` together at most.

    Texts of any length are drawn, each once however many copies it has. Of those
    longer than a tenth of that, as much is taken at an offset given by the hash, so
    that several are. Rows are thinned by hash first, so that few are left to order.
    """
    most = max(1, sample_chars // 10)
    read = docs.where(training).where("lang is not null and text is not null").select("lang", "text", F.xxhash64("text").alias("draw"))
    texts = read.select("lang", "draw", F.least(F.length("text"), F.lit(most)).alias("n")).where("n > 0").distinct()
    # four times what is needed, so that a language without any is out of the question
    shares = texts.groupBy("lang").agg((F.lit(4 * sample_chars) / F.sum("n")).alias("share"))
    drawn = texts.join(shares, "lang").where(F.expr("pmod(xxhash64(draw), 1000000007) / 1000000007") < F.col("share"))
    before = Window.partitionBy("lang").orderBy("draw", "n").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    chosen = drawn.withColumn("total", F.sum("n").over(before)).where(F.col("total") <= sample_chars).select("lang", "draw")
    offset = F.expr(f"1 + pmod(draw, greatest(length(text) - {most}, 0) + 1)").cast("int")
    rows = read.join(F.broadcast(chosen), ["lang", "draw"], "left_semi").withColumn("text", F.substring("text", offset, F.lit(most)))
    samples: dict[str, list[str]] = {}
    for row in rows.distinct().orderBy("lang", "draw", "text").collect():
        samples.setdefault(row["lang"], []).append(row["text"])
    return {lang: "\n".join(found)[:sample_chars] for lang, found in samples.items()}


def identify_languages(docs: DataFrame, training: Column, sample_chars: int = SAMPLE_CHARS) -> DataFrame:
    """doc_id, training, lang_pred and score (0 to 1) for every row of ``docs(doc_id, text, lang)``.

    Automata are built from the rows where ``training`` holds and lang is known. A
    text that is null or has no letters, or any text if there is nothing to learn
    from, gets ``und`` with score 0. Ties go to the language first in order. Texts are
    parsed whole, in segments; other columns are ignored.
    """
    id_type = docs.schema["doc_id"].dataType.simpleString()
    training = F.coalesce(training, F.lit(False))
    samples = sample_by_language(docs, training, sample_chars)

    def predict(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parser = CrossParser(samples, sample_chars)
        for frame in frames:
            for part in pieces(frame, "text", 2 << 20):
                languages, scores = parser.predict(part["text"].tolist())
                yield pd.DataFrame({
                    "doc_id": part["doc_id"].to_numpy(), "training": part["training"].to_numpy(), "lang_pred": languages, "score": scores,
                })

    read = docs.select("doc_id", "text", training.alias("training"))
    return read.mapInPandas(predict, f"doc_id {id_type}, training boolean, lang_pred string, score double")
