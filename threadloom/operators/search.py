"""Lexical search over documents and messages."""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadloom.functions.text import query_tokens, tokens, trigram_similarity
from threadloom.tables import written

SEARCHED_ROLES = ("user", "assistant")
#: Where chunks end, the strongest first.
BREAKS = ("\n\n", "\n", ". ", "。", "；")


def fts_match(docs: DataFrame, query: str, text: str = "content") -> DataFrame:
    """Documents with all tokens of the query; none if it has no tokens."""
    wanted = query_tokens(F.lit(query))
    return docs.where((F.size(wanted) > 0) & (F.size(F.array_except(wanted, tokens(F.col(text)))) == 0))


def boolean_search(messages: DataFrame, all_of: list[str] = (), phrases: list[str] = (), any_of: list[str] = (), none_of: list[str] = ()) -> DataFrame:
    """Messages with every term and phrase, one of any_of if it isn't empty, and none of none_of."""
    rows = messages.withColumn("_t", tokens(F.col("content")))
    condition = F.lit(True)
    for term in all_of:
        condition = condition & F.array_contains("_t", term)
    for phrase in phrases:
        condition = condition & F.concat(F.lit(" "), F.array_join("_t", " "), F.lit(" ")).contains(f" {phrase} ")
    if any_of:
        condition = condition & F.arrays_overlap("_t", F.array(*map(F.lit, any_of)))
    if none_of:
        condition = condition & ~F.arrays_overlap("_t", F.array(*map(F.lit, none_of)))
    return rows.where(condition).drop("_t")


def ilike_contains(column: Column, query: str, everywhere: bool = True) -> Column:
    """Literal containment ignoring case; queries under 3 characters match nothing outside a thread."""
    return F.lit(False) if everywhere and len(query) < 3 else F.lower(column).contains(query.lower())


def _lexical_score(query: str) -> Column:
    """4 for the exact text, 3 for all the query's tokens, else 0."""
    wanted = query_tokens(F.lit(query))
    lexical = (F.size(wanted) > 0) & (F.size(F.array_except(wanted, tokens(F.col("content")))) == 0)
    return F.when(ilike_contains(F.col("content"), query), 4.0).when(lexical, 3.0).otherwise(0.0)


def score_messages(messages: DataFrame, query: str) -> DataFrame:
    """User and assistant messages that match: 4 for the exact text, 3 for all its tokens."""
    scored = messages.where(F.col("role").isin(*SEARCHED_ROLES)).withColumn("score", _lexical_score(query))
    return scored.where("score > 0").withColumn("match_type", F.when(F.col("score") == 4.0, "exact").otherwise("full_text"))


def _density(words: list[str], wanted: list[str]) -> float:
    last, total, begun = dict.fromkeys(wanted, -1), 0.0, -1
    hits = [i for i, w in enumerate(words) if w in last]
    place = {at: n for n, at in enumerate(hits)}
    for end in hits:
        last[words[end]] = end
        begin = min(last.values())
        if begin > begun:  # the stretch that ends here begins behind the one before
            begun = begin
            total += 0.1 / (1 + (end - begin) - (place[end] - place[begin]))
    return total


def cover_density(tokens_: Column, query: list[str]) -> Column:
    """0.1 for each cover of the query's tokens, divided by one more than the other tokens in it.

    A cover is a stretch that holds all the tokens and no shorter stretch that does. More
    and tighter covers rank higher; texts that lack a token rank 0.
    """
    if not query:
        return F.lit(0.0)

    @F.pandas_udf("double")
    def density(lists: pd.Series) -> pd.Series:
        return lists.map(lambda words: 0.0 if words is None else _density(list(words), query))

    return density(tokens_)


def _grams(text: str) -> list[str]:
    """The 3-grams of a text's words in order."""
    words = ["".join(run) for letter, run in itertools.groupby(text.lower(), str.isalnum) if letter]
    return [f"  {w} "[i : i + 3] for w in words for i in range(len(w) + 1)]


def _likeness(text: str, wanted: frozenset[str]) -> float:
    stream, top = _grams(text), 0.0
    for start in (i for i, g in enumerate(stream) if g in wanted):
        seen, shared = set(), 0
        for gram in itertools.islice(stream, start, None):
            if gram not in seen:
                seen.add(gram)
                shared += gram in wanted
                top = max(top, shared / (len(wanted) + len(seen) - shared))
                if len(seen) * top > len(wanted):
                    break
    return top


def word_similarity(query: str, text: Column) -> Column:
    """The best likeness of the query's 3-grams and those of any stretch of the text's 3-grams.

    Likeness is shared over all distinct 3-grams. A stretch with more than ``len(grams) /
    best`` distinct ones can't be better than the best, so the search stays near-linear.
    """
    wanted = frozenset(_grams(query))

    @F.pandas_udf("double")
    def likeness(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: _likeness(t or "", wanted)).astype("float64")

    return likeness(text) if wanted else F.lit(0.0)


def rank_messages(messages: DataFrame, query: str, fuzzy: float | None = None) -> DataFrame:
    """The messages of ``score_messages`` with their cover density added to the score.

    With ``fuzzy`` also those that hold a stretch of at least that likeness, at 1 and the likeness.
    """
    words = messages.sparkSession.range(1).select(query_tokens(F.lit(query)).alias("t")).first()["t"]  # one row of at most 16 tokens
    wanted, least = frozenset(_grams(query)), fuzzy
    rows = messages.where(F.col("role").isin(*SEARCHED_ROLES)).withColumn("score", _lexical_score(query))
    if fuzzy is None:
        rows = rows.where("score > 0")
    rows = rows.withColumn("_t", F.when(F.col("score") > 0, tokens(F.col("content"))))

    def rank(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            extra = [_density(list(t), words) if t is not None else 1 + _likeness(c or "", wanted) for t, c in zip(frame["_t"], frame["content"], strict=True)]
            frame["match_type"] = frame["score"].map({4.0: "exact", 3.0: "full_text", 0.0: "fuzzy"})
            frame["score"] += extra
            yield frame[(frame["match_type"] != "fuzzy") | (frame["score"] >= 1 + (least or 1.0))].drop(columns="_t")

    columns = ", ".join(f"`{c}` {t}" for c, t in messages.dtypes)
    return rows.mapInPandas(rank, f"{columns}, score double, match_type string")


#: Likeness that an unknown token needs, and a known one, and how often its term must occur, at least and for each of its own.
UNKNOWN, KNOWN, OFTEN = 0.45, 0.55, 20


def _by_rarity(words: DataFrame, word: str, counts: DataFrame) -> DataFrame:
    """``words`` with their distinct 3-grams (``grams``, as numbers) in one order for all, those of the fewest terms first."""
    spread = words.select(word, F.explode("codes").alias("code")).join(counts, "code", "left")
    ordered = spread.groupBy(word).agg(F.array_sort(F.collect_list(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "code")))["code"].alias("grams"))
    return words.drop("codes").join(ordered, word)


def _alike(asked: DataFrame, terms: DataFrame, least: float, wanted: Column) -> DataFrame:
    """Pairs of ``asked(token, grams, least, …)`` and ``terms(term, grams, …)`` whose similarity is at least the token's ``least``, itself at least ``least``.

    Such a pair shares at least ``least`` of each one's grams, so one of the rarest that are left when all but one of
    those are taken away; pairs meet there, each once, at the first gram that both have.
    """

    def spread(rows: DataFrame, word: str, bound: Column, side: str) -> DataFrame:
        rarest = F.slice("grams", 1, F.size("grams") - F.ceil(bound * F.size("grams") - 1e-9).cast("int") + 1)
        sized = rows.withColumns({f"_first_{side}": rarest, f"_n_{side}": F.size("grams"), f"_length_{side}": F.length(word)}).withColumnRenamed("grams", f"_grams_{side}")
        # few bytes make many pairs, so the number of tasks can't go by bytes
        return sized.select("*", F.posexplode(f"_first_{side}").alias(f"_at_{side}", "_gram")).repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), "_gram")

    n, m = F.col("_n_a"), F.col("_n_b")
    close = (F.abs(F.col("_length_a") - F.col("_length_b")) <= 2) & (F.col("least") * n <= m + 1e-9) & (F.col("least") * m <= n + 1e-9)
    # what lies before the gram is not shared
    enough = F.least(n - F.col("_at_a"), m - F.col("_at_b")) * (1 + F.col("least")) >= F.col("least") * (n + m) - 1e-9
    once = F.get(F.array_intersect("_first_a", "_first_b"), F.lit(0)) == F.col("_gram")
    met = spread(asked, "token", F.col("least"), "a").join(spread(terms, "term", F.lit(least), "b"), "_gram").where(close & enough & wanted & (F.col("token") != F.col("term")) & once)
    # behind explode, what grams both share is found once for a pair; as an expression each condition on it would find it again
    sized = met.select("*", F.explode(F.array(F.size(F.array_intersect("_grams_a", "_grams_b")))).alias("_shared"))
    alike = sized.withColumn("similarity", F.col("_shared") / (n + m - F.col("_shared"))).where("similarity >= least")
    return alike.drop(*[c for c in alike.columns if c.startswith("_")])


def correct_queries(queries: DataFrame, lexicon: DataFrame) -> DataFrame:
    """For each misspelt token of ``queries(query)``, whole texts, the most alike term of ``lexicon(term, frequency)``.

    Tokens meet terms that share a 3-gram and differ by at most 2 in length. An
    unknown token needs a similarity of 0.45; a known one 0.55, and a term with 20
    occurrences and 20 times its own.
    """
    from threadloom.functions.text import trigrams

    def codes(word: str) -> Column:
        # a code point has 21 bits
        return F.transform(trigrams(F.col(word)), lambda g: reduce(lambda x, i: x * 2**21 + F.ascii(F.substr(g, F.lit(i), F.lit(1))), (1, 2, 3), F.lit(0).cast("long")))

    counted = written(lexicon.select("term", "frequency", codes("term").alias("codes")), "lexicon")
    counts = written(counted.select(F.explode("codes").alias("code")).groupBy("code").agg(F.count("*").alias("n")), "grams")
    terms = written(_by_rarity(counted, "term", counts), "terms")
    asked = queries.select(F.explode(tokens(F.col("query"), bounded=False)).alias("token")).where(F.col("token").rlike("^[\\x00-\\x7F]+$")).distinct()
    # only lengths that terms have, give or take 2, a few rows: a token as long as a text would be spread by all its grams
    length = F.length("term")
    lengths = counted.select(F.explode(F.sequence(length - 2, length + 2)).alias("length")).distinct()
    asked = asked.join(F.broadcast(lengths), F.length("token") == F.col("length"), "left_semi")
    own = counted.select(F.col("term").alias("token"), F.col("frequency").alias("own"))
    asked = asked.join(own, "token", "left").select("token", F.coalesce("own", F.lit(0)).alias("own"), codes("token").alias("codes"))
    asked = written(_by_rarity(asked, "token", counts), "asked")
    first = F.min(F.struct((-F.col("similarity")).alias("s"), (-F.col("frequency")).alias("f"), F.col("term").alias("t"))).alias("best")
    unknown = _alike(asked.where("own = 0").withColumn("least", F.lit(UNKNOWN)), terms, UNKNOWN, F.lit(True)).groupBy("token").agg(first)
    # of the terms that are frequent enough the best stands, unless any term at all comes before it
    known, often = asked.where("own > 0").withColumn("least", F.lit(KNOWN)), terms.where(F.col("frequency") >= OFTEN)
    best = written(_alike(known, often, KNOWN, F.col("frequency") >= OFTEN * F.col("own")).groupBy("token").agg(first), "best")
    rivals = best.join(asked, "token").select("token", "grams", "best", (-F.col("best.s")).alias("least"))
    before = F.struct((-F.col("similarity")).alias("s"), (-F.col("frequency")).alias("f"), F.col("term").alias("t")) < F.col("best")
    beaten = _alike(rivals, terms, KNOWN, F.lit(True)).where(before).select("token").distinct()
    found = unknown.unionByName(best.join(beaten, "token", "left_anti"))
    return found.select("token", F.col("best.t").alias("term"), (-F.col("best.s")).alias("similarity"))


def score_with_correction(messages: DataFrame, query: str, lexicon: DataFrame, enough: int) -> DataFrame:
    """The messages of ``score_messages``; if they are fewer than ``enough``, those of the corrected query behind them.

    A hit of the corrected query alone scores between 1 and 2 and is fuzzy.
    """
    hits = score_messages(messages, query)
    if hits.limit(enough).count() >= enough:
        return hits
    one = messages.sparkSession.range(1)
    words = one.select(query_tokens(F.lit(query)).alias("t")).first()["t"]  # at most 16, as the search looks for
    asked = one.select(F.lit(" ".join(words)).alias("query"))
    better = {r["token"]: r["term"] for r in correct_queries(asked, lexicon).collect()}
    if not better:
        return hits
    again = score_messages(messages, " ".join(better.get(w, w) for w in words))
    fuzzy = again.withColumns({"score": 1 + F.least(F.col("score") - 3, F.lit(0.999999)), "match_type": F.lit("fuzzy")})
    return hits.unionByName(fuzzy.join(hits.select("message_id"), "message_id", "left_anti"))


def replace_lexicon(new: DataFrame, old: DataFrame) -> DataFrame:
    """What a rebuild does to each term: insert, update, keep or delete."""
    joined = new.select("term", "frequency").join(old.select("term", F.col("frequency").alias("before")), "term", "full")
    action = F.when(F.col("frequency").isNull(), "delete").when(F.col("before").isNull(), "insert").when(F.col("frequency") == F.col("before"), "keep").otherwise("update")
    return joined.select("term", "frequency", action.alias("action"))


def _chunk_spans(text: str, size: int, overlap: int) -> Iterator[tuple[int, int]]:
    start = 0
    while start < len(text):
        end = start + size
        if end < len(text):
            window = text[start + size // 2 : end]
            end -= next((len(window) - window.rindex(s) - len(s) for s in BREAKS if s in window), 0)
        yield start, end
        start = end - overlap


def chunks_of(text: str, size: int = 2000, overlap: int = 200, least: int = 50, most: int | None = None) -> list[str]:
    """The chunks of one text, as ``chunk_text`` says."""
    return [text] if 0 < len(text) <= size else [c for c in (text[a:b].strip() for a, b in _chunk_spans(text, size, overlap)) if len(c) > least][:most]


def chunk_text(docs: DataFrame, size: int = 2000, overlap: int = 200, least: int = 50, most: int | None = None) -> DataFrame:
    """document_id, chunk_index (from 0), chunk: overlapping chunks of ``docs(document_id, content)``.

    A chunk of at most ``size`` characters ends behind the last separator in its second
    half, the strongest kind that occurs there; the next one starts ``overlap``
    characters before. Chunks are trimmed; those of ``least`` characters or fewer are
    left out. A text within ``size`` is one chunk as it is, an empty or null one none.
    """
    id_type = docs.schema["document_id"].dataType.simpleString()

    def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            lists = [
                chunks_of(text, size, overlap, least, most)
                for text in frame["content"]
            ]
            counts = np.array([len(chunks) for chunks in lists], dtype=int)
            yield pd.DataFrame({
                "document_id": np.repeat(frame["document_id"].to_numpy(), counts),
                "chunk_index": np.concatenate([np.arange(n, dtype="int32") for n in [0, *counts]]),
                "chunk": [c for chunks in lists for c in chunks],
            })

    return docs.where("content <> ''").select("document_id", "content").mapInPandas(cut, f"document_id {id_type}, chunk_index int, chunk string")


def search_messages(messages: DataFrame, roots: DataFrame, query: str, limit: int, per_root: int = 3, seen: DataFrame | None = None) -> DataFrame:
    """One page of conversations that match, best first, with up to ``per_root`` hits each.

    ``roots(document_id, root)`` folds threads under their conversation; ``seen(root)``
    are the conversations of earlier pages. Conversations go by their best score, its
    newest time and their id; hits likewise.
    """
    hits = score_messages(messages, query).join(roots, "document_id")
    if seen is not None:
        hits = hits.join(seen.select("root"), "root", "left_anti")
    order = Window.partitionBy("root").orderBy(F.desc("score"), F.desc("ts"), "message_id")
    placed = hits.withColumn("place", F.row_number().over(order)).where(F.col("place") <= per_root)
    page = placed.where("place = 1").orderBy(F.desc("score"), F.desc("ts"), "root").limit(limit).select("root")
    return placed.join(F.broadcast(page), "root").select("root", "place", "message_id", "score", "match_type")  # at most ``limit`` rows
