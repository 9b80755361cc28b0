"""A whole benchmark run: filter, retrieve by every method, evaluate, write."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.operators import corpus as corpora
from gleaner.operators import curves, metrics, ranking, registry
from gleaner.sources import writers


def run_benchmark(
    benchmark: DataFrame, corpus: DataFrame, methods: str | Iterable[str] | None = None, excluded: str | Iterable[str] = (), limit: int = 100, top_k: int = 20,
    max_codes: int | None = 100, codes: list[int] | None = None, timeout_s: float | None = None, path: str | None = None,
) -> dict[str, DataFrame]:
    """Results by name: outcomes, candidates, metrics, summary, rank_curve, threshold_curve, ap, interpolated.

    benchmark: flattened queries (see readers.flatten_benchmark), with `embedding` for dense methods; corpus: (item_id,
    text), likewise. max_codes 0 or None takes all codes. With a path, all tables are written below it.
    """
    chosen = corpora.first_codes(benchmark, most=max_codes, codes=codes)
    extra = [c for c in ("embedding",) if c in chosen.columns]
    queries = chosen.select(F.col("product_id").alias("query_id"), F.col("product_description").alias("text"), *extra)
    qrels = chosen.select(F.col("product_id").alias("query_id"), F.explode("relevant_item_ids").alias("item_id")).distinct()
    ranked, outcomes = registry.run(queries, corpus, registry.parse_methods(methods, excluded), limit, timeout_s)
    flagged, relevant = ranking.flags_keep(ranked, qrels), ranking.relevant_counts(qrels)
    by_query = metrics.query_metrics(ranked, qrels, top_k, runs=outcomes.where("success"))
    threshold = curves.by_threshold(flagged, relevant)
    out = {
        "outcomes": outcomes, "candidates": writers.candidate_rows(ranked, queries, qrels, outcomes), "metrics": outcomes.join(by_query, ["query_id", "method"], "left"), "summary": metrics.summarize(by_query, outcomes),
        "rank_curve": curves.by_rank(flagged, relevant), "threshold_curve": threshold, "ap": curves.step_ap(threshold), "interpolated": curves.interpolated(threshold),
    }
    if path:
        writers.write_candidates(out["candidates"], f"{path}/candidates")
        writers.append_metrics(writers.round_floats(out["summary"]), f"{path}/summary")
        for name in ("rank_curve", "threshold_curve", "interpolated"):
            writers.write_curve(out[name], f"{path}/{name}")
        writers.write_results(path, results=out["metrics"], curves=threshold.select("method", "recall", "precision", "threshold"), ap=out["ap"])
    return out
