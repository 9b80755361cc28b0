"""Micro-averaged and interpolated precision-recall curves."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleaner.functions.tokens import clamp, finite
from gleaner.operators.lineage import checkpoint
from gleaner.operators.ranges import running
from gleaner.operators.ranking import query_keys
from gleaner.operators.sizes import broadcast_if_small

UP_TO_HERE = (Window.unboundedPreceding, Window.currentRow)


def _points(by: Sequence[str]) -> list[Column]:
    recall = F.coalesce(F.col("hits") / F.nullif(F.col("total"), F.lit(0)), F.lit(0.0))
    return [*map(F.col, by), (F.col("hits") / F.col("returned")).alias("precision"), recall.alias("recall"), F.col("hits").cast("long").alias("hits"), F.col("returned").cast("long").alias("returned")]


def _totals(flagged: DataFrame, relevant: DataFrame, by: Sequence[str]) -> DataFrame:
    """Relevant items of all queries of each method, found or not."""
    keys = query_keys(flagged, relevant)
    return flagged.select(*by, *keys).distinct().join(relevant, keys).groupBy(*by).agg(F.sum("relevant").alias("total"))


def by_rank(flagged: DataFrame, relevant: DataFrame, by: Sequence[str] = ("method",)) -> DataFrame:
    """A point for each rank cutoff, and the leading one (rank 0, precision 1, recall 0)."""
    counts = flagged.groupBy(*by, "rank").agg(F.sum("flag").alias("h"), F.count("*").alias("n"))
    over = Window.partitionBy(*by).orderBy("rank").rowsBetween(*UP_TO_HERE)  # one row for each rank: few
    summed = counts.withColumn("hits", F.sum("h").over(over)).withColumn("returned", F.sum("n").over(over)).join(_totals(flagged, relevant, by), list(by))
    points = summed.select(*_points(by), F.col("rank").cast("long").alias("rank"))
    zero = F.lit(0).cast("long")
    return points.unionByName(flagged.select(*by).distinct().select(*by, F.lit(1.0).alias("precision"), F.lit(0.0).alias("recall"), zero.alias("hits"), zero.alias("returned"), zero.alias("rank")))


def by_threshold(flagged: DataFrame, relevant: DataFrame, by: Sequence[str] = ("method",)) -> DataFrame:
    """A point for each distinct score, tied rows together, and the leading one (null threshold, precision 1, recall 0).

    Rows are added up by score first, so that the running sums see distinct scores only, by ranges if they are many.
    Scores that are null, NaN or infinite are left out.
    """
    return pooled_by_threshold([(flagged, relevant)], by)


def pooled_by_threshold(sets: Sequence[tuple[DataFrame, DataFrame]], by: Sequence[str] = ("method",)) -> DataFrame:
    """The threshold curve of several sets of queries (their flagged rankings and relevant counts) pooled into one: the scores of all
    sets meet in one list, and totals add up. A query that is in two sets counts in both."""
    counts, totals = None, None
    for flagged, relevant in sets:
        flagged = checkpoint(flagged.select(*by, *query_keys(flagged), "score", "flag"))
        n = flagged.where(finite(F.col("score"))).groupBy(*by, "score").agg(F.sum("flag").alias("h"), F.count("*").alias("n"))
        t = _totals(flagged, relevant, by)
        counts, totals = n if counts is None else counts.unionByName(n), t if totals is None else totals.unionByName(t)
    if len(sets) > 1:
        counts = counts.groupBy(*by, "score").agg(F.sum("h").alias("h"), F.sum("n").alias("n"))
        totals = totals.groupBy(*by).agg(F.sum("total").alias("total"))
    totals = checkpoint(totals)
    points = running(counts, "score", {"hits": "h", "returned": "n"}, by, descending=True).join(totals, list(by))
    points = points.select(*_points(by), F.col("score").alias("threshold"), F.col("total").cast("long").alias("total_relevant"))
    zero = F.lit(0).cast("long")
    lead = totals.select(*by, F.lit(1.0).alias("precision"), F.lit(0.0).alias("recall"), zero.alias("hits"), zero.alias("returned"), F.lit(None).cast("double").alias("threshold"), F.col("total").cast("long").alias("total_relevant"))
    return points.unionByName(lead)


def step_ap(curve: DataFrame, by: Sequence[str] = ("method",)) -> DataFrame:
    """Sum of precision times recall gained, over the points of a threshold curve."""
    before = F.lag("recall", 1, 0.0).over(Window.partitionBy(*by).orderBy("returned"))
    gained = curve.withColumn("gain", F.col("recall") - before)
    return gained.groupBy(*by).agg(F.sum(F.when(F.col("gain") > 0, F.col("gain") * F.col("precision")).otherwise(0.0)).alias("ap"))


def interpolated(curve: DataFrame, by: Sequence[str] = ("method",), levels: DataFrame | None = None, digits: int = 9) -> DataFrame:
    """(by, recall, precision): the best precision at this recall or more, at all levels; 0 beyond the last.

    levels: one column `recall`; by default the recalls of all curves, 0 and 1. Points and levels are one list, and
    one running maximum from its end serves both.
    """
    points = checkpoint(curve.groupBy(*by, F.round(clamp(F.col("recall")), digits).alias("recall")).agg(F.max(clamp(F.col("precision"))).alias("p")))
    spark = curve.sparkSession
    ends = spark.range(2).select(F.col("id").cast("double").alias("recall"))
    levels = (points.select("recall").union(ends) if levels is None else levels.select(F.round(clamp(F.col("recall")), digits).alias("recall"))).distinct()
    wanted = points.select(*by).distinct().crossJoin(broadcast_if_small(levels))  # methods are few
    both = points.withColumn("wanted", F.lit(0)).unionByName(wanted.withColumn("p", F.lit(None).cast("double")).withColumn("wanted", F.lit(1)))
    once = both.groupBy(*by, "recall").agg(F.max("p").alias("p"), F.max("wanted").alias("wanted"))
    best = running(once, "recall", {"best": "p"}, by, descending=True, most=True)
    return best.where("wanted = 1").select(*by, "recall", F.coalesce("best", F.lit(0.0)).alias("precision"))


def wide(curve: DataFrame, methods: Sequence[str], column: str = "method") -> DataFrame:
    """Recall levels by rows, methods by columns."""
    return curve.groupBy("recall").pivot(column, list(methods)).agg(F.first("precision"))


def area(curve: DataFrame, by: Sequence[str] = ("method",)) -> DataFrame:
    """Sum of (r_i - r_{i-1}) * p_i over the levels of an interpolated curve."""
    before = F.lag("recall", 1, 0.0).over(Window.partitionBy(*by).orderBy("recall"))
    return curve.withColumn("width", F.col("recall") - before).groupBy(*by).agg(F.sum(F.col("width") * F.col("precision")).alias("auc"))
