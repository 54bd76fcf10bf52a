"""Queries of the training-data operators over the given tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from threadloom.llm import (
    decontaminate,
    exact_dedup,
    filter_audit,
    html_extract,
    language_id,
    lm_scoring,
    minhash_dedup,
    packing,
    pii,
    quality_classifier,
    quality_rules,
    ranked_search,
    secret_scan,
)
from threadloom.llm.common import held_out


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_context_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    scored = lm_scoring.context_tree_scores(docs, ~held_out(F.col("doc_id"), 5, 1))
    return scored.select(
        "doc_id", (~F.col("training")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", "bits_per_byte"
    )


def op2_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_dedup.near_duplicates(_table(spark, sf_dir, "documents"), shingle_words=3, percent=85)


def op3_hilbert_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_table(spark, sf_dir, "documents"), sequence_tokens=1024)


def op4_page_differencing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract_main_text(_table(spark, sf_dir, "pages"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.apply_quality_rules(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op6_positive_unlabelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = held_out(F.col("doc_id"), 5, 0)
    scored = quality_classifier.score_quality(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"), ~held)
    return scored.select("doc_id", (~F.col("training")).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op7_secret_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.scan_secrets(_table(spark, sf_dir, "documents"))
    return found.where("is_secret").select("doc_id", "start", "length", "kind", "score")


def op8_feistel_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents with personal data: what was found, and the text with pseudonyms."""
    changed = pii.pseudonymise(_table(spark, sf_dir, "documents"), key="threadloom")
    return changed.where(pii.is_private(F.col("pii"))).select("doc_id", F.size("pii").alias("n_found"), "pii", "text")


def op9_cross_parsing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = language_id.identify_languages(_table(spark, sf_dir, "documents"), ~held_out(F.col("doc_id"), 4, 2))
    return found.select("doc_id", (~F.col("training")).alias("held_out"), "lang_pred", "score")


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.benchmark_leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op11_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(_table(spark, sf_dir, "documents"))


def op12_hybrid_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search.rank_documents(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit_filters(spark, f"{sf_dir}/documents.parquet", _table(spark, sf_dir, "labels"))


QUERIES = {
    "op1_context_tree": op1_context_tree,
    "op2_minhash_dedup": op2_minhash_dedup,
    "op3_hilbert_packing": op3_hilbert_packing,
    "op4_page_differencing": op4_page_differencing,
    "op5_quality_rules": op5_quality_rules,
    "op6_positive_unlabelled": op6_positive_unlabelled,
    "op7_secret_forest": op7_secret_forest,
    "op8_feistel_pseudonyms": op8_feistel_pseudonyms,
    "op9_cross_parsing": op9_cross_parsing,
    "op10_decontaminate": op10_decontaminate,
    "op11_exact_dedup": op11_exact_dedup,
    "op12_hybrid_ranking": op12_hybrid_ranking,
    "op13_filter_audit": op13_filter_audit,
    "pipeline": corpus_pipeline.run,
}

ORACLE_SQL: dict[str, str] = {
    "op11_exact_dedup": r"""
        SELECT doc_id, min(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size, doc_id = min(doc_id) OVER same AS kept, sha256(t) AS text_sha256
        FROM (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
        WINDOW same AS (PARTITION BY t)""",
    "op12_hybrid_ranking": r"""
        WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents),
        s AS (SELECT count(*) FILTER (len(terms) > 0) AS n_docs, cast(sum(len(terms)) AS bigint) AS total FROM d),
        o AS (SELECT doc_id, len(terms) AS n, unnest(terms) AS term FROM d),
        p AS (SELECT doc_id, n, term, count(*) AS tf FROM o GROUP BY ALL),
        w AS (SELECT term, cast(floor(1000 * ln(cast(2 * n_docs + 2 AS double) / (2 * count(*) + 1))) AS bigint) AS weight FROM p, s GROUP BY term, n_docs),
        q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
        r AS (SELECT item_id, doc_id, cast(sum(weight * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * n_docs) // total)))) AS bigint) AS score
              FROM q JOIN p USING (term) JOIN w USING (term), s GROUP BY item_id, doc_id)
        SELECT * FROM (SELECT item_id, cast(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS int) AS rank, doc_id, score FROM r WHERE score > 0) WHERE rank <= 10""",
    "op13_filter_audit": r"""
        WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
        l AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id),
        m AS (SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
                     CASE WHEN len(w) < 200 THEN 1 ELSE 0 END + CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN 2 ELSE 0 END
                     + CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 2 * length(t) THEN 4 ELSE 0 END
                     + CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 8 ELSE 0 END
                     + CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY t) THEN 16 ELSE 0 END AS mask
              FROM d LEFT JOIN l USING (doc_id)),
        f AS (SELECT * FROM (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) AS v(letter, bit)),
        o AS (SELECT a.letter || b.letter || c.letter || d.letter || e.letter AS filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits
              FROM f a, f b, f c, f d, f e WHERE a.bit + b.bit + c.bit + d.bit + e.bit = 31 AND a.bit | b.bit | c.bit | d.bit | e.bit = 31),
        s AS (SELECT filter_order, cast(k AS int) AS step, bits[k] AS bit, cast(coalesce(list_sum(bits[1:k - 1]), 0) AS bigint) AS before FROM o, range(1, 6) AS r(k)),
        n AS (SELECT part, mask, good, toxic, count(*) AS n FROM m GROUP BY ALL),
        x AS (SELECT part, filter_order, step, bit,
                     cast(sum(CASE WHEN mask & (before | bit) = 0 THEN n ELSE 0 END) AS bigint) AS kept,
                     cast(sum(CASE WHEN mask & before = 0 AND mask & bit > 0 THEN n ELSE 0 END) AS bigint) AS removed,
                     cast(sum(CASE WHEN mask & before > 0 AND mask & bit > 0 THEN n ELSE 0 END) AS bigint) AS redundant,
                     cast(sum(CASE WHEN mask = bit THEN n ELSE 0 END) AS bigint) AS unique_fails,
                     cast(sum(CASE WHEN mask & before = 0 AND mask & bit > 0 AND good = 1 THEN n ELSE 0 END) AS bigint) AS good_lost,
                     cast(sum(CASE WHEN mask & before = 0 AND mask & bit > 0 AND toxic = 1 THEN n ELSE 0 END) AS bigint) AS toxic_lost
              FROM n, s GROUP BY part, filter_order, step, bit)
        SELECT * EXCLUDE (bit), cast(sum(removed) OVER (PARTITION BY part, bit) AS bigint) AS shapley FROM x""",
}
