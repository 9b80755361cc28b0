"""Ranking metrics by query and method, and their summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gleaner.operators.ranking import flags_drop, flags_keep, relevant_counts

KEYS = ("query_id", "method")


def query_metrics(ranked: DataFrame, qrels: DataFrame, top_k: int = 20, runs: DataFrame | None = None, relevant: DataFrame | None = None) -> DataFrame:
    """One row for each judged query and method.

    Precision at k divides by k, not by what was returned; average precision and recall divide by all relevant items.
    runs: the (query_id, method) pairs to report, so that empty rankings count; those of `ranked` if not given.
    relevant: (query_id, relevant), the number of relevant items of each query; if given, qrels need only hold judged
    items that are in a ranking.
    """
    flagged = flags_keep(ranked, qrels)
    hits = F.sum("flag").over(Window.partitionBy(*KEYS).orderBy("rank").rowsBetween(Window.unboundedPreceding, 0))
    flagged = flagged.withColumn("so_far", hits)
    at = lambda k: F.sum(F.when(F.col("rank") <= k, F.col("flag")).otherwise(0))
    found = flagged.groupBy(*KEYS).agg(
        F.count("*").alias("returned"), F.sum("flag").alias("hits"), F.sum(F.when(F.col("flag") == 1, F.col("so_far") / F.col("rank"))).alias("ap_sum"),
        F.min(F.when(F.col("flag") == 1, F.col("rank"))).alias("first_rank"), *[at(k).alias(f"h{k}") for k in sorted({1, 5, 10, 50, 100, top_k})],
    )
    pairs = (ranked.select(*KEYS).distinct() if runs is None else runs.select(*KEYS).distinct()).join(relevant_counts(qrels) if relevant is None else relevant, "query_id")
    m = pairs.join(found, list(KEYS), "left").fillna(0, [c for c in found.columns if c not in (*KEYS, "first_rank")])
    precision = lambda k, name: (F.col(f"h{k}") / F.lit(float(k))).alias(name)
    recall = lambda c, name: (F.col(c) / F.col("relevant")).alias(name)
    return m.select(
        *KEYS, F.col("relevant").cast("long").alias("relevant"), F.col("returned").cast("long").alias("returned"), F.col("hits").cast("long").alias("hits"), recall("hits", "recall"),
        precision(1, "precision_at_1"), precision(5, "precision_at_5"), precision(10, "precision_at_10"), precision(top_k, "precision_at_k"),
        recall("h10", "recall_at_10"), recall("h50", "recall_at_50"), recall("h100", "recall_at_100"), recall("ap_sum", "map"),
        F.coalesce(1.0 / F.col("first_rank"), F.lit(0.0)).alias("mrr"), "first_rank",
    )


AVERAGED = ("recall", "precision_at_1", "precision_at_5", "precision_at_10", "precision_at_k", "recall_at_10", "recall_at_50", "recall_at_100", "map", "mrr")


def summarize(metrics: DataFrame, outcomes: DataFrame | None = None) -> DataFrame:
    """Macro averages of the successful rows of each method; tested counts all rows."""
    rows = metrics if outcomes is None else outcomes.join(metrics, list(KEYS), "left")
    good = F.lit(True) if outcomes is None else F.col("success")
    n = F.count_if(good)
    out = rows.groupBy("method").agg(F.count("*").alias("tested"), n.alias("successful"), *[F.coalesce(F.sum(F.when(good, F.coalesce(c, F.lit(0.0)))) / F.greatest(n, F.lit(1)), F.lit(0.0)).alias(c) for c in AVERAGED])
    return out.withColumn("failed", F.col("tested") - F.col("successful"))


def ndcg(ranked: DataFrame, qrels: DataFrame, ks: tuple[int, ...] = (10, 100), relevant: DataFrame | None = None) -> DataFrame:
    """Binary NDCG at each k of each judged query and method; repeats of an item are dropped first. relevant: as for query_metrics."""
    flagged = flags_drop(ranked, qrels)
    gain = lambda k: F.sum(F.when((F.col("rank") <= k) & (F.col("flag") == 1), 1.0 / F.log2(F.col("rank") + 1)).otherwise(0.0))
    found = flagged.groupBy(*KEYS).agg(*[gain(k).alias(f"dcg{k}") for k in ks]).join(relevant_counts(qrels) if relevant is None else relevant, "query_id")
    ideal = lambda k: F.aggregate(F.sequence(F.lit(1), F.least(F.col("relevant"), F.lit(k)).cast("int")), F.lit(0.0), lambda a, i: a + 1.0 / F.log2(i + 1))
    return found.select(*KEYS, *[(F.col(f"dcg{k}") / ideal(k)).alias(f"ndcg_at_{k}") for k in ks])


def pooled_mean(parts: list[DataFrame], value: str = "map") -> DataFrame:
    """Mean of all queries of several sets, by method: sets weigh as many queries as they have."""
    rows = parts[0]
    for more in parts[1:]:
        rows = rows.unionByName(more)
    return rows.groupBy("method").agg(F.count("*").alias("n_queries"), F.avg(value).alias(value))
