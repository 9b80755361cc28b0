"""Exact dense retrieval: blocks of queries meet vectors, the best of each task kept.

Blocks of queries are broadcast if they are few, a checked number; else vectors are sent to every block of queries by
an exchange that puts the queries of a block before its vectors. Either way vectors come to Python as plain rows and a
block once for a task, so that no batch grows with the input.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.operators.ranking import DIGITS, top_k

QUERY_BLOCK = 4096
#: Blocks of queries that are broadcast; a block of 1,024 dimensions has 32 MB.
BLOCKS_MOST = 8
#: Local candidates beyond k, so that scores which tie once rounded are not cut by chance.
MARGIN = 1e-6
#: Products that a task holds at a time, and rows of a batch that it sends.
PRODUCTS, ROWS = 1 << 20, 1 << 16
FOUND = "query_id bigint, item_id bigint, score double"


def _matrix(column: pa.Array, dims: int | None) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return np.ascontiguousarray(flat.reshape(len(column), -1)[:, :dims])


def _ids(column: pa.Array) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False).astype(np.int64)


def retrieve(queries: DataFrame, corpus: DataFrame, k: int = 100, dims: int | None = None) -> DataFrame:
    """(query_id, item_id, score, rank) by dot product in doubles. queries: (query_id, embedding); corpus: (item_id, embedding).

    Null vectors are left out. A task holds the blocks of queries that it meets, BLOCKS_MOST at most, and a batch of
    vectors at a time, and sends k rows for each of its queries at most, and as many of each tie at their end.
    """
    queries, corpus = (df.where(F.col("embedding").isNotNull()) for df in (queries, corpus))
    asked, items = queries.select(F.col("query_id").alias("id"), "embedding"), corpus.select(F.col("item_id").alias("id"), "embedding")
    blocks = max(1, -(-asked.count() // QUERY_BLOCK))
    if blocks <= BLOCKS_MOST:
        known = asked.toArrow().combine_chunks()  # at most BLOCKS_MOST blocks
        parts = [known.slice(begin, QUERY_BLOCK) for begin in range(0, known.num_rows, QUERY_BLOCK)]
        sent = queries.sparkSession.sparkContext.broadcast([(_ids(x["id"].combine_chunks()), _matrix(x["embedding"].combine_chunks(), dims)) for x in parts])
        found = items.mapInArrow(_best_of_all(sent, k, dims), FOUND)
    else:
        cores = queries.sparkSession.sparkContext.defaultParallelism
        shares = max(1, -(-2 * cores // blocks))  # of the vectors: so that all cores have a block and a share
        every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
        dealt = lambda n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
        left = asked.select(dealt(blocks).alias("block"), every(shares).alias("share"), F.lit(False).alias("item"), "id", "embedding")
        right = items.select(every(blocks).alias("block"), dealt(shares).alias("share"), F.lit(True).alias("item"), "id", "embedding")
        met = left.unionByName(right).select((F.col("block") * shares + F.col("share")).alias("key"), "item", "id", "embedding")
        found = met.repartition(blocks * shares, "key").sortWithinPartitions("key", "item").mapInArrow(_best_by_key(k, dims), FOUND)
    return top_k(found, k)


def _first_of_ties(a: np.ndarray, items: np.ndarray, s: np.ndarray, k: int) -> np.ndarray:
    """Rows that can be among the k best: of scores of a query that are sure to round alike, those of the k smallest ids."""
    scaled = s * 10.0**DIGITS
    whole = np.rint(scaled)
    sure = (np.abs(np.abs(scaled - whole) - 0.5) > 1e-3) & (np.abs(scaled) < 1e11)
    exact = np.where(sure, 0.0, s)  # near a half only equal scores
    order = np.lexsort((items, exact, whole, a))
    keys = [x[order] for x in (a, whole, exact)]
    begins = np.flatnonzero(np.concatenate([[True], np.any([x[1:] != x[:-1] for x in keys], axis=0)]))
    place = np.arange(len(a)) - np.repeat(begins, np.diff([*begins, len(a)]))
    return np.sort(order[place < k])


class Best:
    """The k best items and ties of each query of a block, over all blocks of vectors that a task meets."""

    def __init__(self, ids: np.ndarray, q: np.ndarray, k: int):
        self.ids, self.q, self.k = ids, q, k
        self.least = np.full(len(self.ids), -np.inf)
        self.held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.size, self.most = 0, 2 * k * len(self.ids)

    def meet(self, items: np.ndarray, x: np.ndarray) -> None:
        """Products are made for a slice of the queries at a time."""
        step = max(1, PRODUCTS // max(1, len(items)))
        for begin in range(0, len(self.ids), step):
            s, least = self.q[begin : begin + step] @ x.T, self.least[begin : begin + step]
            found = s >= least[:, None] - MARGIN
            many = np.flatnonzero(np.count_nonzero(found, axis=1) > self.k)
            if len(many):  # no item below the k-th of this block is among the k best
                least[many] = np.maximum(least[many], np.partition(np.where(found[many], s[many], -np.inf), len(items) - self.k, axis=1)[:, len(items) - self.k])
                found[many] = s[many] >= least[many, None] - MARGIN
            a, b = np.nonzero(found)
            self.held.append(((a + begin).astype(np.int32), items[b], s[a, b]))
            self.size += len(a)
            if self.size > self.most:
                self.prune()

    def prune(self) -> None:
        a, items, s = (np.concatenate(x) for x in zip(*self.held, strict=True))
        self.held = [(a, items, s)]
        order = np.lexsort((-s, a))
        a, items, s = a[order], items[order], s[order]
        start = np.searchsorted(a, np.arange(len(self.ids)))
        last = start + self.k - 1
        full = np.bincount(a, minlength=len(self.ids)) >= self.k
        self.least[full] = np.maximum(self.least[full], s[last[full]])
        keep = s >= self.least[a] - MARGIN
        a, items, s = a[keep], items[keep], s[keep]
        if len(a) > 1.5 * self.k * len(self.ids):
            keep = _first_of_ties(a, items, s, self.k)
            a, items, s = a[keep], items[keep], s[keep]
        self.held, self.size = [(a, items, s)], len(a)
        self.most = max(self.most, 2 * self.size)  # then it isn't pruned at each block

    def rows(self) -> Iterator[pa.RecordBatch]:
        if not self.held:
            return
        self.prune()
        a, items, s = self.held[0]
        for begin in range(0, len(a), ROWS):
            part = slice(begin, begin + ROWS)
            yield pa.RecordBatch.from_arrays([pa.array(self.ids[a[part]]), pa.array(items[part]), pa.array(s[part])], ["query_id", "item_id", "score"])


def _best_of_all(sent: Broadcast, k: int, dims: int | None) -> Callable:
    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks = [Best(*block, k) for block in sent.value]
        for batch in batches:
            if batch.num_rows:
                items, x = _ids(batch.column(0)), _matrix(batch.column(1), dims)
                for block in blocks:
                    block.meet(items, x)
        while blocks:
            yield from blocks.pop().rows()

    return best


def _best_by_key(k: int, dims: int | None) -> Callable:
    """Over rows sorted by key, the queries of a key before its vectors."""

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, asked, block = None, [], None
        for batch in batches:
            keys, item = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            edges = [0, *(np.flatnonzero((keys[1:] != keys[:-1]) | (item[1:] != item[:-1])) + 1), batch.num_rows]
            for begin, end in zip(edges, edges[1:]):
                if begin == end:
                    continue
                if keys[begin] != key:
                    if block is not None:
                        yield from block.rows()
                    key, asked, block = keys[begin], [], None
                part = batch.slice(begin, end - begin)
                numbers, x = _ids(part.column(2)), _matrix(part.column(3), dims)
                if not item[begin]:
                    asked.append((numbers, x))
                elif asked or block is not None:
                    if block is None:
                        block, asked = Best(*map(np.concatenate, zip(*asked, strict=True)), k), []
                    block.meet(numbers, x)
        if block is not None:
            yield from block.rows()

    return best


def encode(texts: DataFrame, load: Callable[[], Callable[[list[str]], np.ndarray]], prefix: str = "", text: str = "text") -> DataFrame:
    """Adds `embedding` by a model that each worker loads once: load() gives a function from texts to a matrix."""

    @F.pandas_udf("array<float>")
    def encoded(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load()
        for part in parts:
            vectors = np.asarray(model([prefix + (t or "") for t in part]), np.float32)
            norms = np.linalg.norm(vectors, axis=1, keepdims=True)
            yield pd.Series(list(vectors / np.where(norms == 0, 1, norms)), index=part.index)

    return texts.withColumn("embedding", encoded(F.col(text)))
