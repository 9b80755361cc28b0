"""Retrievers by name, and the runner that turns a failure into rows instead of an end."""

from __future__ import annotations

import contextlib
import time
import uuid
from collections.abc import Callable, Iterable, Iterator
from threading import Event, Thread

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.operators import bm25, dense, fusion
from gleaner.operators.lineage import checkpoint

#: A retriever takes queries (query_id, text, embedding), a corpus (item_id, text, embedding) and k.
Retriever = Callable[[DataFrame, DataFrame, int], DataFrame]

RANKED = "query_id bigint, item_id bigint, score double, rank bigint"


def lexical(queries: DataFrame, corpus: DataFrame, k: int) -> DataFrame:
    return bm25.retrieve(queries, corpus, k)


def semantic(queries: DataFrame, corpus: DataFrame, k: int) -> DataFrame:
    """Blank queries find nothing."""
    return dense.retrieve(queries.where(F.trim(F.coalesce("text", F.lit(""))) != ""), corpus, k)


def hybrid(queries: DataFrame, corpus: DataFrame, k: int, prefetch: int | None = None) -> DataFrame:
    take = prefetch or max(k, fusion.PREFETCH)
    return fusion.rrf(lexical(queries, corpus, take), semantic(queries, corpus, take), k)


def hybrid_mix(queries: DataFrame, corpus: DataFrame, k: int) -> DataFrame:
    """As hybrid with 2k prefetched, over items only if the corpus has a `type`."""
    items = corpus.where(F.col("type") == "item") if "type" in corpus.columns else corpus
    return hybrid(queries, items, k, prefetch=2 * k)


RETRIEVERS: dict[str, Retriever] = {"bm25": lexical, "dense": semantic, "hybrid": hybrid, "hybrid_mix": hybrid_mix}
DEFAULTS = ("bm25", "dense", "hybrid")


def parse_methods(methods: str | Iterable[str] | None, excluded: str | Iterable[str] = ()) -> list[str]:
    """Known names in order, without the excluded; ValueError on an unknown name or an empty list."""
    split = lambda x: [m.strip() for m in x.split(",") if m.strip()] if isinstance(x, str) else list(x)
    wanted, without = split(methods) if methods else list(DEFAULTS), set(split(excluded))
    if unknown := sorted({*wanted, *without} - set(RETRIEVERS)):
        raise ValueError(f"unknown methods: {', '.join(unknown)}")
    chosen = [m for m in dict.fromkeys(wanted) if m not in without]
    if not chosen:
        raise ValueError("no method is left")
    return chosen


def parse_ids(text: str | None) -> list[int]:
    return [int(x) for x in (text or "").split(",") if x.strip()]


@contextlib.contextmanager
def ended_after(spark: SparkSession, timeout_s: float | None) -> Iterator[None]:
    """Cancels the jobs that are started inside once the time is over, those that begin later as well."""
    if not timeout_s:
        yield
        return
    tag, over = f"method-{uuid.uuid4().hex}", Event()

    def watch() -> None:
        late = not over.wait(timeout_s)
        while late:
            spark.sparkContext.cancelJobsWithTag(tag)
            late = not over.wait(0.5)

    spark.sparkContext.addJobTag(tag)
    Thread(target=watch, daemon=True).start()
    try:
        yield
    finally:
        over.set()
        spark.sparkContext.removeJobTag(tag)


def run(queries: DataFrame, corpus: DataFrame, methods: Iterable[str] = DEFAULTS, k: int = 100, timeout_s: float | None = None) -> tuple[DataFrame, DataFrame]:
    """Rankings of all methods (with `method`), and one row (query_id, method, success, error, elapsed_ms) for each query and method.

    A method runs over all queries at once; elapsed_ms is its share of one query. A method that fails, or takes more
    than timeout_s, gives no ranking and rows with success = false.
    """
    spark = queries.sparkSession
    rankings, outcomes = spark.createDataFrame([], f"{RANKED}, method string"), None
    n = max(1, queries.count())
    for method in methods:
        began, error = time.perf_counter(), ""
        try:
            with ended_after(spark, timeout_s):
                ranked = checkpoint(RETRIEVERS[method](queries, corpus, k))
            rankings = rankings.unionByName(ranked.withColumn("method", F.lit(method)).select(*rankings.columns))
        except Exception as e:  # noqa: BLE001  a failed method is a result
            error = f"{type(e).__name__}: {str(e)[:300]}"
        rows = queries.select("query_id").withColumn("method", F.lit(method)).withColumn("success", F.lit(not error)).withColumn("error", F.lit(error)).withColumn("elapsed_ms", F.lit((time.perf_counter() - began) * 1000 / n))
        outcomes = rows if outcomes is None else outcomes.unionByName(rows)
    return rankings, outcomes
