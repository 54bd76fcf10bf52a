"""Quality rules: decision lists of threshold conjunctions, learned and applied in Spark SQL.

Sequential covering: a rule starts empty and takes, one after another, the
threshold that gains most information about rejected texts among the rows it still
covers; a part of the rows set aside for it decides how much of the rule is kept.
Covered rows leave, and the next rule is grown, until none is precise enough. Each
step reads one table of counts by feature and quantile, whose size is fixed.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadloom.llm.common import SPACE, materialize

#: What the rules may test, each a number of a text.
FEATURES = [
    "n_words", "mean_word", "symbol_share", "upper_share", "mark_share", "digit_share",
    "dup_line_share", "repeat_share", "distinct_share", "words_per_line",
]
#: Quantiles of a feature that serve as thresholds.
QUANTILES = 48


def _repeat_words() -> str:
    """Words inside three-word windows that occur again; ``windows`` holds the windows' 64-bit hashes.

    Equal windows are found next to each other after a sort; each lets its first
    word, and as many of the next two as lie before the next such window, count.
    The outer transforms over one-element arrays bind a sorted array to a name.
    """
    return """
    CASE WHEN size(windows) = size(array_distinct(windows)) THEN 0L ELSE
    transform(array(array_sort(transform(windows, (h, i) -> struct(h AS h, i AS i)))), s ->
        transform(array(array_sort(transform(
            filter(s, (e, j) -> (j > 0 AND s[greatest(j - 1, 0)].h = e.h) OR (j < size(s) - 1 AND s[least(j + 1, size(s) - 1)].h = e.h)),
            e -> e.i))), p ->
            aggregate(transform(p, (q, j) -> least(3, coalesce(get(p, j + 1) - q, 3))), 0L, (a, b) -> a + b))[0]
    )[0] END
    """


def quality_features(docs: DataFrame) -> DataFrame:
    """doc_id, the counts n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, and ``FEATURES``.

    A null text has none of anything. Windows are compared by 64-bit hashes.
    """
    text = F.coalesce("text", F.lit(""))

    def only(pattern: str) -> Column:
        return F.length(F.regexp_replace("text", pattern, "")).cast("long")

    words = docs.select("doc_id", text.alias("text")).select(
        "doc_id",
        F.array_remove(F.split("text", f"[{SPACE}]+"), "").alias("words"),
        F.filter(F.split("text", "\n"), lambda line: line.rlike(f"[^{SPACE}]")).alias("lines"),
        only(f"[{SPACE}]+").alias("word_chars"),
        only("[^#*$%&|<>]+").alias("n_symbols"),
        only("[^A-Z]+").alias("n_upper"),
        only("[^!?]+").alias("n_marks"),
        only("[^0-9]+").alias("n_digits"),
    )
    windows = F.expr(
        "CASE WHEN size(words) < 3 THEN array() ELSE "
        "transform(sequence(0, size(words) - 3), i -> xxhash64(words[i], words[i + 1], words[i + 2])) END"
    )
    counted = words.select(
        "doc_id", "word_chars", "n_symbols", "n_upper", "n_marks", "n_digits",
        F.size("words").cast("long").alias("n_words"),
        F.size(F.array_distinct("words")).alias("n_distinct"),
        F.size("lines").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        windows.alias("windows"),
    )
    counted = counted.withColumn("n_repeat_words", F.expr(_repeat_words())).drop("windows")

    def share(part: str, whole: str) -> Column:
        return F.col(part) / F.greatest(F.col(whole), F.lit(1))

    return counted.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        share("word_chars", "n_words").alias("mean_word"),
        share("n_symbols", "word_chars").alias("symbol_share"),
        share("n_upper", "word_chars").alias("upper_share"),
        share("n_marks", "word_chars").alias("mark_share"),
        share("n_digits", "word_chars").alias("digit_share"),
        share("n_dup_lines", "n_lines").alias("dup_line_share"),
        share("n_repeat_words", "n_words").alias("repeat_share"),
        share("n_distinct", "n_words").alias("distinct_share"),
        share("n_words", "n_lines").alias("words_per_line"),
    )


@dataclass
class DecisionList:
    """Ordered rules; a row that meets all tests of one is rejected by it, and kept if it meets none.

    A test is (feature, above, threshold): the feature exceeds the threshold, or it doesn't.
    """

    rules: list[list[tuple[str, bool, float]]] = field(default_factory=list)

    def rule(self) -> Column:
        """The number of the first rule met, from 1; null if none is."""
        met = F.lit(None).cast("int")
        for number, tests in reversed(list(enumerate(self.rules, 1))):
            met = F.when(covers(tests), F.lit(number)).otherwise(met)
        return met


def covers(tests: list[tuple[str, bool, float]]) -> Column:
    """The conjunction of tests, as a Spark condition."""
    condition = F.lit(True)
    for feature, above, threshold in tests:
        value = F.col(feature)
        condition = condition & (value > threshold if above else value <= threshold)
    return condition


def learn_decision_list(
    rows: DataFrame, reject: str, features: list[str], max_rules: int = 8, max_tests: int = 3, min_precision: float = 0.9, min_rows: int = 5
) -> DecisionList:
    """Learn rules for the rows whose boolean column ``reject`` is true.

    Two thirds of the rows grow rules, the rest prunes them: the first tests of a rule
    are kept that make the largest share of right over wrong rejections there. A rule
    counts if at least ``min_precision`` of what it rejects is right, on either part,
    and it rejects ``min_rows`` rows rightly. Without rejected rows, or rows at all, the list is empty.
    """
    rows = rows.where(F.col(reject).isNotNull()).withColumn("grow", F.pmod(F.xxhash64(*features, reject), F.lit(3)) > 0)
    rows = materialize(rows.select(reject, "grow", *features), "labelled")
    shares = [i / QUANTILES for i in range(QUANTILES)]
    cuts = rows.agg(*[F.percentile_approx(f, shares, 10_000).alias(f) for f in features]).first()
    if cuts[0] is None:
        return DecisionList()
    cuts = {f: sorted(set(cuts[f])) for f in features}

    def place(f: str) -> Column:
        at = F.size(F.filter(F.array(*map(F.lit, map(float, cuts[f]))), lambda cut: F.col(f) > cut))
        return F.struct(F.lit(f).alias("feature"), at.alias("place"))

    right, wrong = F.count_if(F.col(reject)), F.count_if(~F.col(reject))
    placed = materialize(rows.withColumn("places", F.array(*map(place, features))), "placed")
    found = DecisionList()
    while len(found.rules) < max_rules:
        left = placed.where(found.rule().isNull())
        tests: list[tuple[str, bool, float]] = []
        while len(tests) < max_tests:
            inside = left.where("grow").where(covers(tests))
            counts: dict[str, dict[int, tuple[int, int]]] = {f: {} for f in features}
            table = inside.select(reject, F.explode("places").alias("at")).groupBy("at.feature", "at.place").agg(right.alias("right"), wrong.alias("wrong"))
            for feature, at, p, n in table.collect():  # at most a row for each feature and quantile
                counts[feature][at] = (p, n)
            if not any(counts.values()):
                break
            all_p, all_n = (sum(x[i] for x in next(iter(counts.values())).values()) for i in (0, 1))
            if not all_p or not all_n:
                break
            best = (0.0, None)
            for f in features:
                p = n = 0
                for at, cut in enumerate(cuts[f]):  # rows at this place or a lower one don't exceed the cut
                    p, n = p + counts[f].get(at, (0, 0))[0], n + counts[f].get(at, (0, 0))[1]
                    for above, a, b in ((False, p, n), (True, all_p - p, all_n - n)):
                        if a:
                            gain = a * (math.log2(a / (a + b)) - math.log2(all_p / (all_p + all_n)))
                            best = max(best, (gain, (f, above, float(cut))), key=lambda x: x[0])
            if best[1] is None:
                break
            tests.append(best[1])
        if not tests:
            break
        aggregates = []
        for k in range(1, len(tests) + 1):
            for part in (F.col("grow"), ~F.col("grow")):
                for label in (F.col(reject), ~F.col(reject)):
                    aggregates.append(F.count_if(part & label & covers(tests[:k])))
        got = left.agg(*[a.alias(f"c{i}") for i, a in enumerate(aggregates)]).first()
        scored = []
        for k in range(len(tests)):
            grow_p, grow_n, prune_p, prune_n = got[4 * k : 4 * k + 4]
            good = grow_p >= min_precision * (grow_p + grow_n) and prune_p >= min_precision * (prune_p + prune_n)
            if good and grow_p + prune_p >= min_rows:
                scored.append(((prune_p - prune_n) / max(1, prune_p + prune_n), prune_p, -k))
        if not scored:
            break
        found.rules.append(tests[: 1 - max(scored)[2]])
    return found


def apply_quality_rules(docs: DataFrame, labels: DataFrame, min_words: int = 50, max_repeat_percent: int = 50) -> DataFrame:
    """Counts, base rules and the learned verdict for every document.

    ``docs(doc_id, text)``, ``labels(doc_id, quality)``; other columns are ignored.
    Rules are learned from all labelled documents that pass the base rules; quality 0
    is to be rejected. Returns for each row of ``docs``: doc_id, n_words, word_chars,
    n_symbols, n_dup_lines, n_repeat_words, base_failed, kept and rule (the number of
    the learned rule that rejects it).

    Null, empty and blank texts have no words and fail the base rules. Null labels
    teach nothing; with no labels at all the base rules decide alone. Repeated rows
    are judged alike.
    """
    measured = materialize(quality_features(docs), "features")
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))
    measured = measured.withColumn("base_failed", failed)
    marks = labels.select("doc_id", (F.col("quality") == 0).alias("reject")).where("reject is not null").distinct()
    rules = learn_decision_list(measured.where("not base_failed").join(marks, "doc_id"), "reject", FEATURES)
    verdict = measured.withColumn("rule", rules.rule())
    return verdict.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & F.col("rule").isNull()).alias("kept"), F.when(~F.col("base_failed"), F.col("rule")).alias("rule"),
    )
