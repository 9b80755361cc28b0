"""Reciprocal rank fusion."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

RRF_K = 60
PREFETCH = 100


def rrf(first: DataFrame, second: DataFrame, k: int = 100, rrf_k: int = RRF_K) -> DataFrame:
    """Fuses two rankings of each query. Ties: items of the first ranking by its rank, then the others by theirs."""
    a = first.select("query_id", "item_id", F.col("rank").alias("rank_a"))
    b = second.select("query_id", "item_id", F.col("rank").alias("rank_b"))
    part = lambda c: F.coalesce(1.0 / (F.lit(rrf_k) + F.col(c)), F.lit(0.0))
    both = a.join(b, ["query_id", "item_id"], "full_outer").withColumn("score", F.round(part("rank_a") + part("rank_b"), 12))
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("rank_a").asc_nulls_last(), F.col("rank_b"))
    return both.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= k).select("query_id", "item_id", "score", "rank")
