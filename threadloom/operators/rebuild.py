"""Second looks at stored transcripts: secrets across records, and staged rebuilds."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# What the second pass masks, in this order of places, and what stands in its place.
SECOND_PASS = [
    (r"sk-[a-zA-Z0-9]{20,}+", "[API_KEY_REDACTED]"),
    (r"ghp_[a-zA-Z0-9]{36}", "[GITHUB_TOKEN_REDACTED]"),
    (r"bot\d+:[A-Za-z0-9_-]{35}", "[TELEGRAM_BOT_TOKEN_REDACTED]"),
    (r"-----BEGIN\s+(?:RSA |EC |DSA |OPENSSH )?PRIVATE KEY-----(?:(?!-----END\s+(?:RSA |EC |DSA |OPENSSH )?PRIVATE KEY-----)[\s\S])*+(?:-----END\s+(?:RSA |EC |DSA |OPENSSH )?PRIVATE KEY-----)?", "[PRIVATE_KEY_REDACTED]"),
]


def _parts(text: Column) -> Column:
    """A text without NUL characters in pieces, found in one pass: what stands before a secret, the secret, and so on, then the rest."""
    either = "|".join(p for p, _ in SECOND_PASS)
    return F.split(F.regexp_replace(text, either, "\x00$0\x00"), "\x00")


def _spans(parts: Column) -> Column:
    """start (from 0), length and mask of the secrets among the pieces of a text, in order; null if it has none."""

    def mask(secret: Column) -> Column:
        out = F.lit(SECOND_PASS[-1][1])
        for start, (_, name) in zip(("sk-", "ghp_", "bot"), SECOND_PASS, strict=False):
            out = F.when(secret.startswith(start), name).otherwise(out)
        return out

    def step(done: Column, i: Column) -> Column:
        start = done["at"] + F.length(F.get(parts, i - 1))
        size = F.length(F.get(parts, i))
        row = F.struct(start.alias("start"), size.alias("length"), mask(F.get(parts, i)).alias("mask"))
        return F.struct((start + size).alias("at"), F.concat(done["spans"], F.array(row)).alias("spans"))

    none = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start: int, length: int, mask: string>>").alias("spans"))
    return F.when(F.size(parts) > 1, F.aggregate(F.sequence(F.lit(1), F.size(parts) - 2, F.lit(2)), none, step)["spans"])


def resanitize(records: DataFrame) -> DataFrame:
    """``records(source, record, text)`` with the secrets of each source masked, and ``needs_review`` where its source had any.

    A source's records are one text in their order, without NUL characters, so a secret may run over
    several: the mask stands in the first of them, the others lose their part. A private key that never ends
    runs to the source's end. Null texts stay null. A source is put together in one row, so it must
    fit there as one file does; its records are masked apart, by their place in it. They are shuffled once.
    """
    clean = records.withColumn("text", F.replace("text", F.lit("\x00"), F.lit("")))
    rows = clean.groupBy("source").agg(F.collect_list(F.struct(*[c for c in records.columns if c != "source"])).alias("_rows"))
    keys = F.transform("_rows", lambda r, i: F.struct(r["record"].alias("record"), F.coalesce(r["text"], F.lit("")).alias("text"), i.alias("i")))
    ordered = rows.withColumn("_keys", F.sort_array(keys))
    # the pieces are a column of their own, as each use of an expression would look for secrets again
    split = ordered.withColumn("_parts", _parts(F.array_join(F.transform("_keys", lambda k: k["text"]), "")))
    found = split.withColumn("_spans", _spans(F.col("_parts")))
    each = found.select("source", "_spans", F.posexplode(F.transform("_keys", lambda k: F.get("_rows", k["i"]))).alias("_nth", "_row"))
    before = F.sum(F.length(F.coalesce("text", F.lit("")))).over(Window.partitionBy("source").orderBy("_nth").rowsBetween(Window.unboundedPreceding, -1))
    placed = each.select("source", "_spans", "_nth", "_row.*").withColumn("_from", F.coalesce(before, F.lit(0))).withColumn("_to", F.col("_from") + F.length("text"))
    here = F.filter("_spans", lambda s: (s["start"] < F.col("_to")) & (s["start"] + s["length"] > F.col("_from")))

    def step(done: Column, span: Column) -> Column:
        start = F.greatest(span["start"] - F.col("_from"), F.lit(0))
        kept = F.substr("text", done["at"] + 1, F.greatest(start - done["at"], F.lit(0)))
        own = F.when(span["start"] >= F.col("_from"), span["mask"]).otherwise("")
        return F.struct((span["start"] + span["length"] - F.col("_from")).cast("long").alias("at"), F.concat(done["text"], kept, own).alias("text"))

    done = F.aggregate(here, F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("text")), step)
    masked = F.concat(done["text"], F.substr("text", done["at"] + 1, F.greatest(F.length("text") - done["at"], F.lit(0))))
    review = F.col("_spans").isNotNull()
    return placed.select(*[c for c in records.columns if c != "text"], F.when(review, masked).otherwise(F.col("text")).alias("text"), review.alias("needs_review"))


def stage_rebuild(raw: DataFrame, docs: DataFrame, parse: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, DataFrame]:
    """New rows of the documents whose source is proven, and the manifest (document_id, status, n_rows) of all.

    ``raw(document_id, text)`` is proven by ``docs(document_id, size, hash)``: its bytes and its SHA-256.
    Others, and documents without a source, are incomplete. ``parse`` makes rows with a document_id of ``raw``.
    """
    proof = F.col("text").isNotNull() & (F.octet_length("text") == F.col("size")) & (F.sha2("text", 256) == F.col("hash"))
    proven = docs.join(raw.select("document_id", "text"), "document_id", "left").withColumn("_proven", F.coalesce(proof, F.lit(False)))
    staged = parse(proven.where("_proven").select("document_id", "text"))
    counts = staged.groupBy("document_id").agg(F.count("*").alias("n_rows"))
    status = F.when(F.col("_proven"), "staged").otherwise("incomplete")
    manifest = proven.select("document_id", status.alias("status")).join(counts, "document_id", "left").withColumn("n_rows", F.coalesce("n_rows", F.lit(0)))
    return staged, manifest


def cut_over(stored: DataFrame, staged: DataFrame, manifest: DataFrame, eligible: DataFrame, preserve: bool = False) -> DataFrame:
    """``stored`` with the rows of all staged documents replaced, those of incomplete ones kept if ``preserve``.

    Refused (ValueError) unless staged and preserved documents are exactly ``eligible(document_id)``, each named once, no other
    document stands in the manifest, and each staged document has as many rows as the manifest says. Rows of documents that aren't eligible stay.
    """
    rows = staged.groupBy("document_id").agg(F.count("*").alias("_rows"))
    named = manifest.join(eligible.select("document_id", F.lit(True).alias("_eligible")).distinct(), "document_id", "full").join(rows, "document_id", "full")
    good = F.col("status") == "staged" if not preserve else F.col("status").isin("staged", "incomplete")
    right = F.col("_eligible").isNotNull() & F.coalesce(good, F.lit(False))
    whole = F.coalesce("_rows", F.lit(0)) == F.when(F.col("status") == "staged", F.coalesce("n_rows", F.lit(0))).otherwise(0)
    faults = named.agg(F.count_if(~right).alias("documents"), F.count_if(~whole).alias("rows"), (F.count("*") - F.count_distinct("document_id")).alias("repeated")).first()
    if any(faults):
        raise ValueError(f"cutover needs an exact staged set: {faults['documents']} documents, {faults['rows']} counts of rows, {faults['repeated']} repeated")
    replaced = manifest.where("status = 'staged'").select("document_id")
    return stored.join(replaced, "document_id", "left_anti").select(*stored.columns).unionByName(staged.select(*stored.columns))
