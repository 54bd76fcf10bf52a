"""Corrections against a plain comparison of all pairs."""

import random

from pyspark.sql import functions as F

from threadloom.operators import search


def grams(word):
    return {f"  {word} "[i : i + 3] for i in range(len(word) + 1)}


def test_rare_grams_lose_no_pair(spark):
    rng = random.Random(5)
    lexicon = {"".join(rng.choice(["ab", "ba", "cd", "e", "eé"]) for _ in range(rng.randint(2, 6))): rng.choice([1, 2, 19, 20, 45, 900]) for _ in range(250)}
    asked = [w for w in rng.sample(sorted(lexicon), 60) if w.isascii()] + ["".join(rng.choice("abcde") for _ in range(6)) for _ in range(40)]
    expected = set()
    for token in set(asked):
        near = []
        for term, n in lexicon.items():
            a, b = grams(token), grams(term)
            likeness = len(a & b) / len(a | b)
            if term != token and abs(len(term) - len(token)) <= 2 and likeness >= 0.45:
                near.append((-likeness, -n, term))
        own = lexicon.get(token, 0)
        if near:
            likeness, n, term = min(near)
            if own == 0 or likeness <= -0.55 and -n >= 20 and -n >= 20 * own:
                expected.add((token, term, round(-likeness, 9)))
    queries, terms = spark.createDataFrame([(w,) for w in asked], "query string"), spark.createDataFrame(list(lexicon.items()), "term string, frequency long")
    found = {(r[0], r[1], round(r[2], 9)) for r in search.correct_queries(queries, terms).collect()}
    assert found == expected and len(expected) > 5


def test_words_that_share_only_common_grams_do_not_meet(spark):
    words = [(f"www{i:04d}", list(range(8)) + list(range(10 + 8 * i, 15 + 8 * i))) for i in range(40)]
    # the shared grams come last: among 13 grams, 6 are looked at, of which 5 are a word's own
    frame = spark.createDataFrame([(w, g[8:] + g[:8]) for w, g in words], "term string, grams array<long>")
    asked = frame.select(F.col("term").alias("token"), "grams", F.lit(0.7).alias("least"))
    assert search._alike(asked, frame, 0.7, F.lit(True)).count() == 0


def test_whole_texts_are_corrected(spark):
    terms = spark.createDataFrame([("stream", 40), ("window", 30)], "term string, frequency long")
    # far behind the first tokens, and behind an index entry's 200,000 characters; a token as long as a text takes no part
    texts = [("x1 " * 20 + " ".join(f"n{i}q" for i in range(30)) + " streams",), ("ab " * 80_000 + "windows " + "f" * 100_000,), (None,), ("",)]
    found = search.correct_queries(spark.createDataFrame(texts, "query string"), terms).collect()
    assert sorted((r["token"], r["term"]) for r in found) == [("streams", "stream"), ("windows", "window")]


def test_a_long_query_is_corrected_to_its_end(spark):
    words = [f"word{c}" for c in "abcdefghi"]
    messages = spark.createDataFrame([(1, "user", " ".join(words) + " stream")], "message_id long, role string, content string")
    terms = spark.createDataFrame([(w, 1) for w in words] + [("stream", 40)], "term string, frequency long")
    hits = search.score_with_correction(messages, " ".join(words) + " streams", terms, 1).collect()
    assert [(r["message_id"], r["match_type"]) for r in hits] == [(1, "fuzzy")]
