"""Text quality from trusted positives and unlabelled text: non-negative PU learning.

The model z adds up weights of binned text measures. With class prior p and means
over trusted positives (P) and unlabelled rows (U), it minimises

    p * mean_P (1 - z)^2 + max(0, mean_U (1 + z)^2 - p * mean_P (1 + z)^2)

whose second term is the negatives' risk, which can't be negative; where a step
finds it below zero, the step undoes the overfit instead. With this loss the risk
depends on the rows only through how often two bins occur together, so it is that of
all rows, which Spark counts, and (1 + z) / 2 estimates the chance of a positive.

The prior comes from the same two kinds of rows: whatever set of texts is taken, the
positives' part of it is at most all of it, so p is at most the set's share of U over
its share of P. The least such ratio over the sets of texts above a score is taken.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadloom.llm.common import materialize, pieces

MEASURES = 16
#: Edges of a measure's bins: evenly many rows between them, more at both tails, and evenly spaced ones.
SHARES = [i / 20 for i in range(1, 20)] + [0.001, 0.003, 0.01, 0.02, 0.98, 0.99, 0.997, 0.999]
SPACED = 7
BINS = len(SHARES) + SPACED + 1
WIDTH = MEASURES * BINS + 1
#: Bins of scores from which the prior is read.
LEVELS = 200
_SYMBOLS, _MARKS = re.compile(r"[^\w\s.,;:!?'\"()-]"), re.compile(r"[!?]")
_UPPER, _DIGITS = re.compile(r"[A-ZÀ-ÖØ-Þ]"), re.compile(r"[0-9]")


def measures(text: str | None) -> list[float]:
    """Numbers that describe a text's form; none depends on a word list or a language."""
    text = text or ""
    raw = text.encode("utf-8", "surrogatepass")
    words, lines = text.split(), [line for line in text.split("\n") if line.strip()]
    n, chars = max(1, len(words)), max(1, len(text))
    counts = Counter(words)
    lengths = np.fromiter(map(len, words), float, len(words)) if words else np.zeros(1)
    return [
        np.log1p(len(words)),
        np.log1p(chars / max(1, len(lines))),
        float(lengths.mean()),
        float(lengths.std()),
        len(_SYMBOLS.findall(text)) / chars,
        len(_MARKS.findall(text)) / n,
        len(_UPPER.findall(text)) / chars,
        len(_DIGITS.findall(text)) / chars,
        text.count(".") / n,
        text.count(",") / n,
        len(counts) / n,
        max(counts.values(), default=0) / n,
        sum(a == b for a, b in zip(words[:-1], words[1:], strict=True)) / n,
        1 - len(set(lines)) / max(1, len(lines)),
        sum(w[0].isupper() for w in words) / n,
        len(zlib.compress(raw, 1)) / max(1, len(raw)),
    ]


def _one_hot(x: np.ndarray, cuts: list[np.ndarray]) -> np.ndarray:
    """For each row the columns of its bins, one for each measure."""
    return np.stack([i * BINS + np.searchsorted(c, x[:, i], side="left") for i, c in enumerate(cuts)], axis=1)


def fit_nnpu(together: np.ndarray, prior: float, positives: int, steps: int = 1500, rate: float = 0.01) -> np.ndarray:
    """Weights of all bins, the last one the intercept.

    ``together`` has for positives and for unlabelled rows how often two bins occur in
    a row, as shares; the intercept occurs in every row. Neighbouring bins lean on each
    other, the more so the fewer ``positives`` there are.
    """
    (of_p, of_u), mean_p, mean_u = together, together[0, -1], together[1, -1]
    rough = np.zeros((WIDTH, WIDTH))
    for i in range(MEASURES):
        for a in range(i * BINS, i * BINS + BINS - 1):
            rough[a : a + 2, a : a + 2] += [[1, -1], [-1, 1]]
    smooth = 10 / (positives + 30) * rough + 0.3 / (positives + 30) * np.eye(WIDTH)
    w, moment, square = np.zeros((3, WIDTH))
    for step in range(1, steps + 1):
        negative_risk = (w @ of_u @ w + 2 * mean_u @ w + 1) - prior * (w @ of_p @ w + 2 * mean_p @ w + 1)
        negative = of_u @ w + mean_u - prior * (of_p @ w + mean_p)
        gradient = prior * (of_p @ w - mean_p) + negative if negative_risk >= 0 else -negative
        gradient = gradient + smooth @ w
        moment, square = 0.9 * moment + 0.1 * gradient, 0.999 * square + 0.001 * gradient**2
        w = w - rate * (1 - step / (steps + 1)) * (moment / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.999**step)) + 1e-8)
    return w


def least_ratio(positive: np.ndarray, unlabelled: np.ndarray, least: float = 0.6) -> float:
    """The least ratio of shares of unlabelled rows and of positives above a level, of levels with enough positives."""
    p, u = (np.cumsum(x[::-1]) / max(1, x.sum()) for x in (positive, unlabelled))
    slack = 1 / np.sqrt(max(1, positive.sum()))
    good = p >= min(1.0, max(least, slack))
    return float(np.clip(np.min((u[good] + slack / 10) / p[good]), 0.01, 0.99))


def score_quality(docs: DataFrame, labels: DataFrame, training: Column, positive: int = 1) -> DataFrame:
    """doc_id, training and score (0 to 1, the chance of label ``positive``) for every row of ``docs(doc_id, text)``.

    ``labels(doc_id, quality)`` gives trusted positives among the rows where
    ``training`` holds; all training rows, their labels unseen, are the unlabelled ones.
    Other labels are not read, and the class prior is estimated from these two. All
    rows of both kinds fit the model. Without positives every score is 1/2.

    Null and empty texts are scored by their measures, which are those of no words.
    Null labels teach nothing; repeated rows are scored alike. Columns beyond the
    named ones are ignored.
    """
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def measure(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for part in pieces(frame, "text", 4 << 20):
                yield part[["doc_id", "training"]].assign(x=[np.array(measures(t), np.float32) for t in part["text"]])

    read = docs.select("doc_id", "text", F.coalesce(training, F.lit(False)).alias("training"))
    table = materialize(read.mapInPandas(measure, f"doc_id {id_type}, training boolean, x array<float>"), "measures")
    trusted = labels.where(F.col("quality") == positive).select("doc_id").distinct().withColumn("good", F.lit(True))
    marked = table.where("training").join(trusted, "doc_id", "left").select("x", F.coalesce("good", F.lit(False)).alias("good"))
    columns = [F.col("x")[i] for i in range(MEASURES)]
    found = marked.agg(
        F.count("*").alias("rows"), F.count_if("good").alias("good"),
        *[F.percentile_approx(c, SHARES, 10_000).alias(f"q{i}") for i, c in enumerate(columns)],
        *[F.struct(F.min(c), F.max(c)).alias(f"m{i}") for i, c in enumerate(columns)],
    ).first()
    if not found["good"]:
        return table.select("doc_id", "training", F.lit(0.5).alias("score"))
    edges = [np.sort([*found[f"q{i}"], *np.linspace(*found[f"m{i}"], SPACED + 2)[1:-1]]) for i in range(MEASURES)]

    def together(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((2, WIDTH, WIDTH))
        for frame in frames:
            good = frame["good"].to_numpy(bool)
            for at in range(0, len(frame), 2000):
                rows = np.stack(frame["x"].to_numpy()[at : at + 2000]).astype(float)
                bins = np.zeros((len(rows), WIDTH), np.float32)
                bins[:, -1] = 1
                np.put_along_axis(bins, _one_hot(rows, edges), 1, axis=1)
                total[1] += bins.T @ bins
                own = bins[good[at : at + 2000]]
                total[0] += own.T @ own
        cell = np.flatnonzero(total[1])
        yield pd.DataFrame({"cell": cell, "p": total[0].ravel()[cell], "u": total[1].ravel()[cell]})

    counted = marked.mapInPandas(together, "cell long, p double, u double").groupBy("cell").agg(F.sum("p").alias("p"), F.sum("u").alias("u"))
    cells = counted.toPandas()  # WIDTH * WIDTH rows at most
    shares = np.zeros((2, WIDTH * WIDTH))
    shares[0, cells["cell"]], shares[1, cells["cell"]] = cells["p"] / found["good"], cells["u"] / found["rows"]
    shares = shares.reshape(2, WIDTH, WIDTH)

    def scored(rows: DataFrame, w: np.ndarray, columns: list[str], schema: str) -> DataFrame:
        def score(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in frames:
                if len(frame):
                    z = w[_one_hot(np.stack(frame["x"].to_numpy()).astype(float), edges)].sum(axis=1) + w[-1]
                    yield frame[columns].assign(score=np.clip((1 + z) / 2, 0, 1))

        return rows.mapInPandas(score, schema)

    level = F.least(F.floor(F.col("score") * LEVELS), F.lit(LEVELS - 1)).cast("int").alias("level")
    first = scored(marked, fit_nnpu(shares, 0.5, found["good"]), ["good"], "good boolean, score double")
    levels = first.groupBy(level).agg(F.count_if("good").alias("p"), F.count("*").alias("u")).toPandas()  # LEVELS rows at most
    of_p, of_u = np.zeros(LEVELS), np.zeros(LEVELS)
    of_p[levels["level"]], of_u[levels["level"]] = levels["p"], levels["u"]
    w = fit_nnpu(shares, least_ratio(of_p, of_u), found["good"])
    return scored(table, w, ["doc_id", "training"], f"doc_id {id_type}, training boolean, score double")
