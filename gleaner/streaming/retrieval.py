"""Ranks the queries of a stream against a fixed corpus, one micro-batch at a time."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from gleaner.operators import bm25

Ranker = Callable[[DataFrame, DataFrame, int], DataFrame]


def rank_stream(queries: DataFrame, corpus: DataFrame, path: str, checkpoint: str, k: int = 100, ranker: Ranker = bm25.retrieve, available_now: bool = True) -> StreamingQuery:
    """Writes (query_id, item_id, score, rank) of each micro-batch of `queries` to its own folder, path/batch=n.

    A batch that is tried again overwrites its folder, so each query is ranked once whatever fails between.
    """

    def write(batch: DataFrame, number: int) -> None:
        ranker(batch, corpus, k).withColumn("ranked_at", F.current_timestamp()).write.mode("overwrite").parquet(f"{path}/batch={number}")

    writer = queries.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
