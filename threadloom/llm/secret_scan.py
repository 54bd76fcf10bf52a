"""Secrets in documents: candidates by pattern, false positives removed by a random forest.

Candidates are issuer formats, private key blocks, values assigned to a secret's
name, and long tokens with digits. Features are a candidate's length, character
classes and transitions between them, its share of dictionary words, signs of paths
around it and its neighbouring words. The forest is trained on labelled findings;
scanning, features and scoring are Spark SQL and Spark ML throughout.
"""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadloom.llm.common import SPACE, materialize

#: Names to which secrets are assigned (fixed list), as a pattern.
NAMES = r"(?:pass(?:word|wd|phrase)?|pwd|secret|token|api[_-]?key|access[_-]?key|private[_-]?key|auth[_-]?key|credentials?)"
#: Issuer formats (fixed patterns). Values of no fixed length run to their end, here and below; possessive, so in one pass.
ISSUED = (
    r"(?:AKIA|ASIA)[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36,}+|xox[abprs]-[A-Za-z0-9-]{10,}+|AIza[0-9A-Za-z_-]{35,}+|"
    r"sk-[A-Za-z0-9_-]{20,}+|glpat-[A-Za-z0-9_-]{20,}+|eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+"
)
#: A private key up to its END, or to the end of the text.
BLOCK = r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----(?:(?!-----END)[\s\S])*+(?:-----END [A-Z ]{0,40}PRIVATE KEY-----)?"
#: A candidate; an assigned value keeps its name in front, which ``PREFIX`` takes off. A quoted value runs to its quote on
#: the line, others to white space, a quote or an angle bracket; commas and semicolons only inside.
PREFIX = rf"(?i:{NAMES}[\"']?[ \t]{{0,3}}(?:=|:|:=|=>)[ \t]{{0,3}}[\"']?)"
#: What stands before the password of a URL.
LOGIN = rf"[A-Za-z][A-Za-z0-9+.-]{{0,30}}+://[^{SPACE}/:@\"'<>]{{0,256}}+:"
VALUE = rf"(?<=\")[^\"\r\n]{{6,}}+(?=\")|(?<=')[^'\r\n]{{6,}}+(?=')|(?=[^{SPACE}\"'<>]{{6}})[^{SPACE}\"'<>,;]++(?:[,;]++[^{SPACE}\"'<>,;]++)*+"
CANDIDATE = (
    rf"{BLOCK}|(?<![A-Za-z0-9]){PREFIX}(?:{BLOCK}|{VALUE})|(?<![A-Za-z0-9]){LOGIN}[^{SPACE}/@\"'<>]{{3,}}+(?=@)|(?<![A-Za-z0-9])(?:{ISSUED})(?![A-Za-z0-9])|"
    r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*+[0-9])[A-Za-z0-9+/_-]{16,}+={0,2}"
)
#: Characters of a candidate's surroundings that features look at, and rows that fit the forest at most.
NEAR, SAMPLE_ROWS = 48, 20_000
FEATURES = [
    "n_chars", "digit_share", "upper_share", "lower_share", "hex_share", "distinct_share", "transitions", "dictionary_share", "issued", "block",
    "named", "quoted", "in_path", "plain_number", "near_words",
]


def find_candidates(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, place, start, length, value, kind, before and after of every candidate.

    place numbers a document's candidates; start and length, in characters, are the
    value's, without the name it is assigned to. text_hash tells apart rows of one id.
    """
    found = docs.select("doc_id", "text").where(F.col("text").rlike(r"[0-9]|PRIVATE KEY|[:=]"))
    found = found.withColumn("matches", F.regexp_extract_all("text", F.lit(CANDIDATE), F.lit(0))).where("size(matches) > 0")
    found = found.withColumn("between", F.split("text", CANDIDATE))
    offset = "aggregate(slice(between, 1, p + 1), 0, (x, t) -> x + length(t)) + aggregate(slice(matches, 1, p), 0, (x, t) -> x + length(t))"
    each = F.expr(
        f"transform(matches, (m, p) -> struct(p AS place, m AS m, {offset} AS at, "
        f"right(between[p], {NEAR}) AS before, left(between[p + 1], {NEAR}) AS after))"
    )
    each = found.select("doc_id", F.xxhash64("text").alias("text_hash"), F.explode(each).alias("c"))
    rows = each.select("doc_id", "text_hash", "c.*")
    name = F.regexp_extract("m", rf"^(?:{PREFIX}|{LOGIN})", 0)
    rows = rows.withColumn("name", F.when(F.col("m").startswith("-----"), "").otherwise(name))
    value = F.expr("substr(m, length(name) + 1)")
    kind = F.when(value.startswith("-----"), "private_key").when(F.col("name").rlike("://[^/]*:$"), "login").when(value.rlike(f"^(?:{ISSUED})$"), "issued").when(F.col("name") != "", "assigned").otherwise("token")
    return rows.select(
        "doc_id", "text_hash", "place", (F.col("at") + F.length("name")).alias("start"), F.length(value).alias("length"), value.alias("value"),
        kind.alias("kind"), F.concat("before", "name").alias("before"), "after",
    )


def dictionary(docs: DataFrame, share: float = 1e-4, least: int = 3) -> DataFrame:
    """The corpus's words of 3 to 20 letters outside candidates, in lower case, that are in this share of the distinct texts.

    Copies of a text count once. ``least`` texts are needed where the share is of less.
    """
    texts = materialize(docs.select("text").where("text is not null").distinct().select(
        F.array_distinct(F.filter(F.split(F.lower(F.regexp_replace("text", CANDIDATE, " ")), r"[^\p{L}]+"), lambda w: F.length(w).between(3, 20))).alias("words")
    ), "texts-words")
    needed = max(least, share * texts.count())
    return texts.select(F.explode("words").alias("word")).groupBy("word").count().where(F.col("count") >= needed).select("word")


def add_features(candidates: DataFrame, words: DataFrame) -> DataFrame:
    """``candidates`` with the columns ``FEATURES``; ``words(word)`` is the dictionary."""

    def share(pattern: str) -> Column:
        return F.length(F.regexp_replace("value", pattern, "")) / F.greatest(F.length("value"), F.lit(1))

    keys = ["doc_id", "text_hash", "place"]
    runs = candidates.select(*keys, F.explode(F.filter(F.split(F.lower("value"), r"[^\p{L}]+"), lambda w: F.length(w) >= 3)).alias("word"))
    covered = runs.join(words, "word").groupBy(*keys).agg(F.sum(F.length("word")).alias("covered"))
    same = [candidates[k].eqNullSafe(covered[k]) for k in keys]
    rows = candidates.join(covered, same, "left").select(candidates["*"], F.coalesce("covered", F.lit(0)).alias("covered"))
    classes = F.regexp_replace(F.regexp_replace(F.regexp_replace("value", "[a-z]+", "a"), "[A-Z]+", "A"), "[0-9]+", "0")

    def flag(c: Column) -> Column:
        return c.cast("double")

    return rows.select(
        "*",
        F.log1p("length").alias("n_chars"),
        share("[^0-9]+").alias("digit_share"),
        share("[^A-Z]+").alias("upper_share"),
        share("[^a-z]+").alias("lower_share"),
        share("[^0-9a-fA-F]+").alias("hex_share"),
        (F.size(F.array_distinct(F.split("value", ""))) / F.least(F.greatest(F.length("value"), F.lit(1)), F.lit(64))).alias("distinct_share"),
        ((F.length(classes) - 1) / F.greatest(F.length("value") - 1, F.lit(1))).alias("transitions"),
        (F.col("covered") / F.greatest(F.length("value"), F.lit(1))).alias("dictionary_share"),
        flag(F.col("kind") == "issued").alias("issued"),
        flag(F.col("kind") == "private_key").alias("block"),
        flag(F.col("before").rlike(rf"(?i){NAMES}.{{0,12}}$")).alias("named"),
        flag(F.col("before").rlike("[\"'`]$")).alias("quoted"),
        flag(F.col("before").rlike(r"(?:://|[\w.-]+[/\\])\S*$") | F.col("after").rlike(r"^\.(?:[a-z]{1,4})\b|^/")).alias("in_path"),
        flag(F.col("value").rlike("^[0-9]+$")).alias("plain_number"),
        F.size(F.filter(F.split(F.concat_ws(" ", "before", "after"), rf"[{SPACE}]+"), lambda w: w.rlike(r"^\p{L}{2,}[.,]?$"))).cast("double").alias("near_words"),
    )


def certain_label() -> Column:
    """1 or 0 where a finding's own form settles what it is, else null.

    Private keys, issuer formats, passwords of URLs, quoted values with digits and random values of 16
    characters or more under a secret's name are secrets; plain numbers without a name, and values made of words, are not.
    """
    mixed = (F.col("digit_share") > 0.2) & (F.col("digit_share") < 1)
    return (
        F.when(F.col("kind").isin("private_key", "issued", "login"), 1)
        .when((F.col("kind") == "assigned") & (F.col("quoted") == 1) & F.col("value").rlike(r"[0-9].* |.* .*[0-9]"), 1)
        .when((F.col("named") == 1) & mixed & (F.col("length") >= 16) & (F.col("dictionary_share") < 0.3), 1)
        .when((F.col("plain_number") == 1) & (F.col("named") == 0), 0)
        .when((F.col("dictionary_share") > 0.6) | (F.col("in_path") == 1) & (F.col("named") == 0), 0)
    )


def train_forest(labelled: DataFrame, trees: int = 20, depth: int = 6) -> PipelineModel | None:
    """A random forest for ``labelled`` findings (``FEATURES`` and label); none unless both labels occur.

    Above ``SAMPLE_ROWS`` findings of a label, those with the lowest hashes are taken.
    """
    drawn = None
    for label in (0, 1):
        rows = labelled.where(F.col("label") == label).orderBy(F.xxhash64("doc_id", "place", "value"), "doc_id", "place").limit(SAMPLE_ROWS)
        drawn = rows if drawn is None else drawn.union(rows)
    drawn = materialize(drawn.select(*FEATURES, F.col("label").cast("double").alias("label")), "findings")
    if drawn.select("label").distinct().count() < 2:
        return None
    assemble = VectorAssembler(inputCols=FEATURES, outputCol="features")
    forest = RandomForestClassifier(numTrees=trees, maxDepth=depth, maxBins=32, seed=7, cacheNodeIds=False)
    return PipelineModel([assemble, forest.fit(assemble.transform(drawn))])


def scan_secrets(docs: DataFrame, labelled: DataFrame | None = None, threshold: float = 0.5) -> DataFrame:
    """Findings of ``docs(doc_id, text)`` with the forest's score, and is_secret where it reaches ``threshold``.

    Returns doc_id, text_hash, place, start, length, value, kind, score, is_secret.
    ``labelled`` has ``FEATURES`` and a label (1: secret); without it the findings
    whose form is certain (``certain_label``) teach the rest, and stay secrets. Where only one label
    occurs no forest can be trained, and certain findings alone are secrets.

    Null, empty and blank texts have no candidates. Each occurrence is a finding, in
    repeated rows too. Other columns are ignored.
    """
    found = materialize(add_features(materialize(find_candidates(docs), "spans"), dictionary(docs)), "candidates")
    forest = train_forest(labelled if labelled is not None else found.withColumn("label", certain_label()).where("label is not null"))
    if forest is None:
        scored = found.withColumn("score", F.coalesce(certain_label(), F.lit(0)).cast("double"))
    else:
        scored = forest.transform(found).withColumn("score", vector_to_array("probability")[1])
        if labelled is None:  # a certain secret stays one, however few of its kind the forest has seen
            scored = scored.withColumn("score", F.when(certain_label() == 1, F.greatest("score", F.lit(threshold))).otherwise(F.col("score")))
    return scored.select("doc_id", "text_hash", "place", "start", "length", "value", "kind", "score", (F.col("score") >= threshold).alias("is_secret"))


def redact_secrets(docs: DataFrame, findings: DataFrame, mask: str = "<secret>") -> DataFrame:
    """``docs`` with the values of findings marked is_secret replaced by ``mask``; all rows and columns stay."""
    spans = findings.where("is_secret").groupBy("doc_id", "text_hash").agg(
        F.array_sort(F.collect_set(F.struct("start", "length"))).alias("_spans")
    )
    spans = spans.withColumnRenamed("doc_id", "_id").withColumnRenamed("text_hash", "_hash")
    on = docs["doc_id"].eqNullSafe(F.col("_id")) & (F.xxhash64(docs["text"]) == F.col("_hash"))
    # each kept piece runs from the end of one span to the start of the next
    pieces = """
        concat(
            array_join(transform(_spans, (s, i) -> substr(text,
                1 + CASE WHEN i = 0 THEN 0 ELSE _spans[i - 1].start + _spans[i - 1].length END,
                s.start - CASE WHEN i = 0 THEN 0 ELSE _spans[i - 1].start + _spans[i - 1].length END)), '{mask}'),
            '{mask}', substr(text, 1 + element_at(_spans, -1).start + element_at(_spans, -1).length))
    """.format(mask=mask.replace("\\", "\\\\").replace("'", "\\'"))
    joined = docs.join(spans, on, "left")
    text = F.when(F.col("_spans").isNull(), F.col("text")).otherwise(F.expr(pieces))
    return joined.withColumn("text", text).select(*docs.columns)
