"""The stored index answers as the single-query operators do, and reads only what a query needs."""

import random

import pytest
from pyspark.sql import functions as F

from threadloom.operators import index, search

WORDS = ["the", "of", "and", "was", "with", "x1", "ünder", "漢字語"]


@pytest.fixture(scope="module")
def texts(spark):
    rng = random.Random(9)
    rows = [(i, " ".join(rng.choices(WORDS, k=rng.randint(0, 12)))) for i in range(120)] + [(500, None), (501, ""), (3, "the of the"), (502, "The-OF (and) the")]
    return spark.createDataFrame(rows, "document_id long, content string").withColumns({c: F.lit(1) for c in ("token", "id", "row", "places")})


@pytest.fixture(scope="module")
def held(spark, texts, tmp_path_factory):
    return index.write_index(texts, str(tmp_path_factory.mktemp("index") / "i"))


def ids(rows, column="id"):
    return sorted(r[column] for r in rows.collect())


@pytest.mark.parametrize("query", ["the of", "The", "漢字", "nowhere the", "", "a"])
def test_all_tokens(texts, held, query):
    assert ids(index.match_all(held, query)) == ids(search.fts_match(texts, query), "document_id")


@pytest.mark.parametrize("terms", [(["the"], ["of the"], ["and", "with"], ["was"]), ([], ["the of the"], [], []), ([], [], ["x1"], []), (["the", "of"], [], [], ["and"]), ([], [], ["nowhere"], [])])
def test_boolean(texts, held, terms):
    assert ids(index.match_boolean(held, *terms)) == ids(search.boolean_search(texts, *terms), "document_id")


def test_what_is_not_held_cannot_be_named(held):
    assert index.match_boolean(held, none_of=["the"]).collect() == []


@pytest.mark.parametrize("query", ["the of", "the", "and of the", "漢字 the", "nowhere"])
def test_cover_density(texts, held, query):
    words = index.tokens_of(texts.sparkSession, query)
    split = texts.select("document_id", search.tokens(F.col("content")).alias("t")).collect()
    plain = [(r["document_id"], round(search._density(list(r["t"] or []), words), 9)) for r in split]
    found = index.cover_density(held, query).collect()
    assert sorted((r["id"], round(r["density"], 9)) for r in found) == sorted(p for p in plain if p[1])


def test_only_the_buckets_of_the_tokens_are_read(held):
    plan = index.match_all(held, "the")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [bucket" in plan.replace("isnotnull(bucket#", "bucket#") or "PartitionFilters: [isnotnull" in plan or "PartitionFilters: [(bucket" in plan
    assert "PushedFilters: [" in plan and "token" in plan.split("PushedFilters: [")[1].split("]")[0]


def test_long_texts_are_held_whole(spark, tmp_path):
    rows = spark.createDataFrame([(1, "word " * 60_000 + "needle")], "document_id long, content string")
    assert ids(index.match_all(index.write_index(rows, str(tmp_path / "a")), "needle word")) == [1]
    assert ids(index.match_all(index.write_index(rows, str(tmp_path / "b"), bounded=True), "needle word")) == []
    assert ids(index.match_all(index.write_index(rows.limit(0), str(tmp_path / "c")), "needle")) == []


def test_postings_are_shuffled_once(spark, texts, tmp_path):
    store = spark.sparkContext._jsc.sc().statusStore()

    def shuffled():
        stages = store.stageList(None, False, False, getattr(store, "stageList$default$4")(), getattr(store, "stageList$default$5")())
        return {stages.apply(i).stageId() for i in range(stages.size()) if stages.apply(i).shuffleWriteBytes()}

    before = shuffled()
    held = index.write_index(texts, str(tmp_path / "once"))
    assert len(shuffled() - before) == 1
    split = texts.select(F.monotonically_increasing_id().alias("row"), index.tokens(F.col("content"), False).alias("tokens"))
    spread = split.select("row", F.posexplode("tokens").alias("place", "token"))
    expected = spread.groupBy("row", "token").agg(F.array_sort(F.collect_list("place")).alias("places"))
    assert sorted(map(tuple, held.postings.select("row", "token", "places").collect())) == sorted(map(tuple, expected.collect()))
