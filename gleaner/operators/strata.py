"""Quality by lexical overlap: medians, quartiles, rank correlation, distributions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.functions.tokens import jaccard
from gleaner.operators import curves
from gleaner.operators.lineage import checkpoint
from gleaner.operators.ranges import counts_below, quantiles
from gleaner.operators.ranking import flags_drop, query_keys, relevant_counts

LOWER, UPPER = "lower", "upper"


def pair_jaccard(pairs: DataFrame, tokenizer) -> DataFrame:
    """Adds `jaccard` of the token sets of query_text and target_text."""
    return pairs.withColumn("jaccard", jaccard(tokenizer(F.col("query_text")), tokenizer(F.col("target_text"))))


def query_jaccard(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("query_id").agg(F.avg("jaccard").alias("jaccard"))


def wide_metric(metrics: DataFrame, methods: Sequence[str], value: str = "map", by: Sequence[str] = ("query_id",)) -> DataFrame:
    """Mean of a value, methods by columns."""
    return metrics.groupBy(*by).pivot("method", list(methods)).agg(F.avg(value))


def median_split(per_query: DataFrame, value: str = "jaccard") -> DataFrame:
    """Adds `half`: below the (interpolated) median of all rows or not."""
    per_query = checkpoint(per_query)
    median = quantiles(per_query, value, [0.5]).select(F.col("q")[0].alias("_median"))
    return per_query.crossJoin(F.broadcast(median)).withColumn("half", F.when(F.col(value) < F.col("_median"), LOWER).otherwise(UPPER)).drop("_median")  # broadcast: one row


def split_summary(split: DataFrame, methods: Sequence[str], advantage: tuple[str, str]) -> DataFrame:
    """Counts, range of overlap, means of each method and of the advantage of one method over another, by half."""
    a, b = advantage
    return split.groupBy("half").agg(F.count("*").alias("n"), F.min("jaccard").alias("jaccard_min"), F.max("jaccard").alias("jaccard_max"), F.avg("jaccard").alias("jaccard_mean"), *[F.avg(m).alias(m) for m in methods], F.avg(F.col(a) - F.col(b)).alias("advantage"))


def verdict(summary: DataFrame) -> DataFrame:
    """Whether the advantage is larger where overlap is low."""
    value = lambda h: F.max(F.when(F.col("half") == h, F.col("advantage")))
    return summary.agg((value(LOWER) > value(UPPER)).alias("larger_below"))


def quantile_bins(df: DataFrame, value: str, shares: Sequence[float] = (0.0, 0.25, 0.5, 0.75, 1.0), name: str = "bin") -> DataFrame:
    """Adds the number of the right-closed interval between linear quantiles; the least value is in the first, equal edges become one."""
    df = checkpoint(df)
    edges = quantiles(df, value, shares).select(F.array_distinct("q").alias("_edges"))
    above = F.size(F.filter("_edges", lambda e: e < F.col(value)))
    return df.crossJoin(F.broadcast(edges)).withColumn(name, F.when(F.col(value).isNotNull(), F.greatest(above, F.lit(1)))).drop("_edges")  # broadcast: one row


def average_ranks(df: DataFrame, value: str, name: str) -> DataFrame:
    """Adds ranks from 1, ties sharing their mean rank. Values are counted first."""
    counts = counts_below(df.groupBy(value).agg(F.count("*").alias("_c")), value)
    ranks = counts.select(F.col(value).alias("_v"), (F.col("_b") + (F.col("_c") + 1) / 2).alias(name))
    return df.join(ranks, F.col(value) == F.col("_v")).drop("_v")


def spearman(df: DataFrame, a: str, b: str) -> DataFrame:
    """One row: rank correlation of two columns."""
    pairs = checkpoint(df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(a, b))  # two numbers a row, read several times
    ranked = average_ranks(average_ranks(pairs, a, "_ra"), b, "_rb")
    return ranked.agg(F.corr("_ra", "_rb").alias("spearman"), F.count("*").alias("n"))


def pooled_curves(ranked: DataFrame, qrels: DataFrame, halves: DataFrame, relevant: DataFrame | None = None) -> DataFrame:
    """Interpolated curve of each method and half, over queries that have a half. Repeats of an item are dropped.

    If the rankings and the halves have a `source`, a query is known by both its source and its id.
    """
    keys = query_keys(ranked, halves)
    flagged = flags_drop(ranked, qrels).join(halves.select(*keys, "half"), keys)
    curve = curves.by_threshold(flagged, relevant_counts(qrels) if relevant is None else relevant, ("method", "half"))
    return curves.interpolated(curve, ("method", "half"))


def ecdf(df: DataFrame, value: str) -> DataFrame:
    """(value, share): i / n on sorted values, each tie with a step of its own.

    Distinct values are counted and ranked by ranges, and ties are spread out again.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(value).agg(F.count("*").alias("_c"))
    total = counts.agg(F.sum("_c").alias("_n"))
    steps = counts_below(counts, value).crossJoin(F.broadcast(total)).withColumn("_i", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_c"))))  # broadcast: one row
    return steps.select(F.col(value).alias("value"), ((F.col("_b") + F.col("_i")) / F.col("_n")).alias("share"))


def histogram(df: DataFrame, value: str, bins: int) -> DataFrame:
    """(bin from 1, count) of equal widths between the least and the largest value, which is in the last bin."""
    edges = df.agg(F.min(value).cast("double").alias("_lo"), F.max(value).cast("double").alias("_hi"))
    v = F.col(value).cast("double")
    at = F.when(F.col("_hi") == F.col("_lo"), 1).otherwise(F.least(F.floor((v - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * bins) + 1, F.lit(bins)))
    return df.where(F.col(value).isNotNull()).crossJoin(F.broadcast(edges)).select(at.cast("long").alias("bin")).groupBy("bin").agg(F.count("*").alias("count"))  # broadcast: one row


def box(df: DataFrame, value: str, by: Sequence[str]) -> DataFrame:
    """Least, quartiles and largest value of each group."""
    found = quantiles(df, value, (0.25, 0.5, 0.75), by)
    return found.select(*by, "low", *[F.col("q")[i].alias(name) for i, name in enumerate(("q1", "median", "q3"))], "high")


def extremes(df: DataFrame, value: str, n: int, order: str) -> DataFrame:
    """The n least and the n largest rows, with `side`; the first by `order` wins ties. Rows are made once for both."""
    df = checkpoint(df)
    low = df.orderBy(F.col(value), F.col(order)).limit(n).withColumn("side", F.lit("low"))
    high = df.orderBy(F.col(value).desc(), F.col(order)).limit(n).withColumn("side", F.lit("high"))
    return low.unionByName(high)


def row_mean(*columns: str) -> Column:
    """Mean of the columns that are not null."""
    there = F.filter(F.array(*map(F.col, columns)), lambda x: x.isNotNull())
    return F.aggregate(there, F.lit(0.0), lambda a, x: a + x) / F.nullif(F.size(there), F.lit(0))
