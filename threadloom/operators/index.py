"""A stored index of texts: tokens with their places, written once, read by every search."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from threadloom.functions.text import query_tokens, tokens

#: Folders that an index's tokens are dealt to.
BUCKETS = 64


@dataclass(frozen=True)
class TextIndex:
    """``postings(token, id, places, n_tokens, bucket)``: where each token stands in each text, in buckets of tokens."""

    postings: DataFrame
    buckets: int

    def of(self, wanted: list[str]) -> DataFrame:
        """The postings of some tokens. Only their buckets' folders are read, and in them the row groups that may hold them."""
        spark = self.postings.sparkSession
        named = spark.createDataFrame([(w,) for w in wanted], "token string")
        chosen = [r[0] for r in named.select(_bucket(F.col("token"), self.buckets)).distinct().collect()]  # of one query's tokens
        return self.postings.where(F.col("bucket").isin(chosen) & F.col("token").isin(wanted))


def _bucket(token: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(token), F.lit(buckets)).cast("int")


def write_index(rows: DataFrame, folder: str, text: str = "content", key: str = "document_id", bounded: bool = False, buckets: int = BUCKETS) -> TextIndex:
    """Index the texts of ``rows`` under ``folder``; ids are those of ``key``.

    Unlike the bounded index of the single-query operators this one holds all tokens of whole texts; ``bounded``
    keeps to their bounds. Null and empty texts have no postings. Repeated ids count as one text each.
    """
    split = rows.select(F.col(key).alias("id"), F.monotonically_increasing_id().alias("row"), tokens(F.col(text), bounded).alias("tokens"))
    # a text's tokens are grouped within its row, and each posting is shuffled once
    placed = split.select("id", "row", F.size("tokens").alias("n_tokens"), F.sort_array(F.transform("tokens", lambda t, i: F.struct(t.alias("token"), i.alias("place")))).alias("placed"))
    first = F.transform("placed", lambda p, i: F.when((i == 0) | (F.get("placed", i - 1)["token"] != p["token"]), i))
    starts = placed.withColumn("starts", F.filter(first, lambda i: i.isNotNull()))

    def posting(start: Column, nth: Column) -> Column:
        end = F.coalesce(F.get("starts", nth + 1), F.size("placed"))
        places = F.transform(F.sequence(start, end - 1), lambda j: F.get("placed", j)["place"])
        return F.struct(F.get("placed", start)["token"].alias("token"), places.alias("places"))

    held = starts.select("id", "row", "n_tokens", F.explode(F.transform("starts", posting)).alias("held"))
    dealt = held.select("held.token", "id", "row", "n_tokens", "held.places", _bucket(F.col("held.token"), buckets).alias("bucket")).hint("rebalance", "bucket")
    dealt.sortWithinPartitions("bucket", "token").write.partitionBy("bucket").parquet(folder)
    return read_index(rows.sparkSession, folder, dealt.schema, buckets)


def read_index(spark: SparkSession, folder: str, schema=None, buckets: int = BUCKETS) -> TextIndex:
    reader = spark.read.schema(schema) if schema is not None else spark.read
    return TextIndex(reader.parquet(folder), buckets)


def tokens_of(spark: SparkSession, query: str) -> list[str]:
    """A query's distinct tokens."""
    return spark.range(1).select(query_tokens(F.lit(query)).alias("t")).first()["t"]


def match_all(index: TextIndex, query: str) -> DataFrame:
    """id, row of the texts with all tokens of the query; none if it has none."""
    wanted = tokens_of(index.postings.sparkSession, query)
    found = index.of(wanted).groupBy("id", "row").agg(F.count("*").alias("n"))
    return found.where((F.col("n") == len(wanted)) & F.lit(bool(wanted))).select("id", "row")


def match_boolean(index: TextIndex, all_of: list[str] = (), phrases: list[str] = (), any_of: list[str] = (), none_of: list[str] = ()) -> DataFrame:
    """id, row of the texts with every term and phrase, one of any_of if it isn't empty, and none of none_of.

    A phrase's tokens stand in a row. A query of none_of alone matches nothing, as an index can't name what it doesn't hold.
    """
    wanted = sorted({*all_of, *any_of, *none_of, *(w for p in phrases for w in p.split())})
    held = F.map_from_entries(F.collect_list(F.struct("token", "places")))
    rows = index.of(wanted).groupBy("id", "row").agg(held.alias("held"))

    def has(term: str) -> Column:
        return F.map_contains_key("held", term)

    def in_a_row(phrase: str) -> Column:
        first, *rest = phrase.split()
        follows = F.lit(True)
        for i, w in enumerate(rest, 1):
            follows = follows & has(w)
        return has(first) & follows & F.exists(F.col("held")[first], lambda p: reduce(lambda a, b: a & b, [F.array_contains(F.col("held")[w], p + i) for i, w in enumerate(rest, 1)], F.lit(True)))

    conditions = [has(t) for t in all_of] + [in_a_row(p) for p in phrases] + [~has(t) for t in none_of]
    if any_of:
        conditions.append(reduce(lambda a, b: a | b, map(has, any_of)))
    if not (all_of or phrases or any_of):
        conditions.append(F.lit(False))
    return rows.where(reduce(lambda a, b: a & b, conditions, F.lit(True))).select("id", "row")


def cover_density(index: TextIndex, query: str) -> DataFrame:
    """id, row, density of the texts with all tokens of the query: 0.1 for each cover, divided by one more than the other tokens in it.

    A cover is a stretch that holds all the tokens and no shorter stretch that does. It ends at a token whose stretch, from the
    earliest of the tokens' last places up to there, begins behind that of the token before: windows over the places of
    the query's tokens, without a loop over texts.
    """
    wanted = tokens_of(index.postings.sparkSession, query)
    if not wanted:
        return index.postings.limit(0).select("id", "row", F.lit(0.0).alias("density"))
    hits = index.of(wanted).select("id", "row", "token", F.explode("places").alias("place"))
    order = Window.partitionBy("row").orderBy("place")
    last = [F.last(F.when(F.col("token") == w, F.struct("place", "nth")), ignorenulls=True).over(order) for w in wanted]
    begin = F.when(reduce(lambda a, b: a & b, [c.isNotNull() for c in last]), F.least(*last) if len(last) > 1 else last[0])
    spans = hits.withColumn("nth", F.row_number().over(order)).withColumn("begin", begin)
    covers = spans.where("begin is not null").withColumn("_before", F.lag("begin.place").over(order)).where("_before is null or begin.place > _before")
    others = F.col("place") - F.col("begin.place") - (F.col("nth") - F.col("begin.nth"))
    return covers.groupBy("id", "row").agg(F.sum(0.1 / (1 + others)).alias("density"))
