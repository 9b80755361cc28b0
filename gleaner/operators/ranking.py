"""Ranks, first occurrences and relevance flags.

Ranked items are (query_id, method, rank, item_id, score); judgements are (query_id, item_id), distinct. Where several
sets of queries meet, all tables carry their `source`, and a query is known by both.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DIGITS = 6


def top_k(scores: DataFrame, k: int, by: tuple[str, ...] = ("query_id",), digits: int = DIGITS, item: str = "item_id") -> DataFrame:
    """The k best of each query with ranks from 1: by the rounded score, ties by item id."""
    rounded = scores.withColumn("score", F.round("score", digits))
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(F.col("score").desc(), F.col(item)))
    return rounded.withColumn("rank", rank.cast("long")).where(F.col("rank") <= k)


def query_keys(*tables: DataFrame) -> list[str]:
    """What names a query in all of these tables: its id, and its source if all have one."""
    return [*["source"] * all("source" in t.columns for t in tables), "query_id"]


def first_occurrence(by: tuple[str, ...] = ("query_id", "method"), item: str = "item_id") -> Column:
    """Whether a row is the first of its item in its ranking."""
    return F.row_number().over(Window.partitionBy(*by, item).orderBy("rank")) == 1


def flags_keep(ranked: DataFrame, qrels: DataFrame, item: str = "item_id") -> DataFrame:
    """Adds `flag`: relevant and first of its item. Repeats stay at their rank with 0."""
    keys = query_keys(ranked, qrels)
    judged = qrels.select(*keys, F.col("item_id").alias(item), F.lit(1).alias("hit"))
    seen = ranked.withColumn("_first", first_occurrence((*query_keys(ranked), "method"), item)).join(judged, [*keys, item], "left")
    return seen.withColumn("flag", F.when(F.col("_first") & F.col("hit").isNotNull(), 1).otherwise(0)).drop("_first", "hit")


def flags_drop(ranked: DataFrame, qrels: DataFrame, item: str = "item_id") -> DataFrame:
    """As flags_keep without the repeats: ranks close up."""
    by = (*query_keys(ranked), "method")
    once = ranked.withColumn("_first", first_occurrence(by, item)).where("_first").drop("_first")
    close = F.row_number().over(Window.partitionBy(*by).orderBy("rank")).cast("long")
    return flags_keep(once.withColumn("rank", close), qrels, item)


def relevant_counts(qrels: DataFrame) -> DataFrame:
    return qrels.groupBy(*query_keys(qrels)).agg(F.count("*").alias("relevant"))
