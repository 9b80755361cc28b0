"""Shared pieces: Arrow text access, table reading, packed hashes and connected components."""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from gleaner.operators.lineage import checkpoint

TOKENIZER_FILE = "byte_bpe_50k.json"
ROWS_BYTES = 32_000_000


def tokenizer_path(name: str = TOKENIZER_FILE) -> str:
    """Place of a public vocabulary file; resolved where it is called, so on executors too."""
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def groups_for(spark: SparkSession, size: int, group: int) -> int:
    """Groups so that each holds about `group` of `size` bytes; as many as the session's shuffle partitions, and 16, at least."""
    return max(16, int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // group))


def text_list(column: pa.Array | pa.ChunkedArray) -> list[str]:
    """Texts of a column; null counts as empty."""
    return pc.fill_null(column, "").to_pylist()


def byte_list(column: pa.Array | pa.ChunkedArray) -> list[bytes]:
    """UTF-8 bytes of a text column; null counts as empty."""
    return pc.fill_null(column, "").cast(pa.binary()).to_pylist()


def flat_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All texts of a column as one byte array and the bounds of each text in it; null counts as empty."""
    full = pc.fill_null(column, "").cast(pa.large_binary())
    if isinstance(full, pa.ChunkedArray):
        full = full.combine_chunks()
    _, offsets, data = full.buffers()
    bounds = np.frombuffer(offsets, np.int64)[full.offset : full.offset + len(full) + 1]
    if not len(full):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    flat = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return flat[bounds[0] : bounds[-1]], bounds - bounds[0]


def small_batches(batches: Iterable[pa.RecordBatch], column: str, most: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """Slices of each batch with about `most` bytes of `column`, one row at least: bounds a worker's memory."""
    for batch in batches:
        size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        total, begin = np.cumsum(size), 0
        while begin < batch.num_rows:
            done = total[begin - 1] if begin else 0
            end = max(begin + 1, int(np.searchsorted(total, done + most, side="right")))
            yield batch.slice(begin, end - begin)
            begin = end


def counted(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values of a sorted array and how often each occurs."""
    at = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.zeros(0, np.int64)
    return h[at], np.diff(np.append(at, len(h)))


def pack_sorted(h: np.ndarray) -> bytes:
    """Sorted hashes as four-byte differences; the few wider ones have their upper halves apart."""
    d = np.diff(h, prepend=np.uint64(0)).astype("<u8")
    wide = np.flatnonzero(d >> np.uint64(32))
    return len(h).to_bytes(4, "little") + len(wide).to_bytes(4, "little") + (d & np.uint64(0xFFFFFFFF)).astype("<u4").tobytes() + wide.astype("<u4").tobytes() + (d[wide] >> np.uint64(32)).astype("<u4").tobytes()


def unpack_sorted(data: bytes) -> tuple[np.ndarray, bytes]:
    """The hashes, and what stands behind them."""
    n, m = int.from_bytes(data[:4], "little"), int.from_bytes(data[4:8], "little")
    d = np.frombuffer(data, "<u4", n, 8).astype(np.uint64)
    wide = np.frombuffer(data, "<u4", m, 8 + 4 * n)
    d[wide] |= np.frombuffer(data, "<u4", m, 8 + 4 * n + 4 * m).astype(np.uint64) << np.uint64(32)
    return np.cumsum(d, dtype=np.uint64), data[8 + 4 * n + 8 * m :]


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """Connected components of undirected edges (a, b): rows (node, component), component the smallest node.

    Alternates large-star and small-star contraction; each round works on a checkpointed edge list, whose
    length never grows. Nodes without an edge to another node do not occur. Null ends are dropped.
    """
    now = checkpoint(edges.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    for _ in range(most_rounds):
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        lowest = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(lowest, "a").select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        after = checkpoint(small)
        # A forest of stars: no node is both a leaf and a centre, and each leaf has one centre.
        deep = after.join(after.select(F.col("a").alias("b")).distinct(), "b", "left_semi").limit(1).count()
        if not deep and after.groupBy("a").count().where("count > 1").limit(1).count() == 0:
            return after.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(after.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
        now = after
    raise RuntimeError("components: the edges did not contract")


def sealed(batch: pa.RecordBatch) -> bytes:
    """A batch as one compressed blob: rows that travel together shrink far more than rows alone."""
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def opened(blobs: Iterable[bytes]) -> pa.Table:
    """The rows of sealed batches."""
    return pa.concat_tables([pa.ipc.open_stream(b).read_all() for b in blobs])


def deal(batch: pa.RecordBatch, groups: np.ndarray) -> Iterator[tuple[int, bytes]]:
    """Sealed parts of a batch, one for each group that its rows belong to."""
    order = np.argsort(groups, kind="stable")
    bound = np.flatnonzero(np.diff(groups[order])) + 1
    rows = batch.take(pa.array(order))
    for a, b in zip([0, *bound.tolist()], [*bound.tolist(), len(order)], strict=True):
        if b > a:
            yield int(groups[order[a]]), sealed(rows.slice(a, b - a))


def values(table: pa.Table, name: str) -> list:
    """A column's values; none of a side without rows, which comes without columns."""
    return table[name].to_pylist() if table.num_rows else []


def rows_of_ids(rows: DataFrame, ids: DataFrame, key: str, first_by: str) -> DataFrame:
    """The rows whose key is among the distinct, non-null `ids` (one column of that name): one for each, the least by `first_by`.

    Rows travel sealed by groups of keys, which takes about half of a shuffled join's disk, and nothing is sorted. A group
    holds about ROWS_BYTES of the text column `first_by`.
    """
    size = rows.agg(F.coalesce(F.sum(F.octet_length(first_by)), F.lit(0))).first()[0]
    groups = groups_for(rows.sparkSession, size, ROWS_BYTES)
    at = rows.columns.index(key)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            known = batch.filter(pc.is_valid(batch.column(at)))
            key_of = known.column(at).to_numpy(zero_copy_only=False).astype(np.int64)
            made = list(deal(known, (key_of.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(np.int64) % groups)) if len(key_of) else []
            yield pa.RecordBatch.from_arrays([pa.array([g for g, _ in made], pa.int32()), pa.array([d for _, d in made], pa.binary())], ["g", "rows"])

    def send_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key_of = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            group = (key_of.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(np.int64) % groups
            yield pa.RecordBatch.from_arrays([pa.array(group, pa.int32()), pa.array(key_of)], ["g", "id"])

    schema = to_arrow_schema(rows.schema)

    @trimmed
    def choose(held: pa.Table, wanted: pa.Table) -> pa.Table:
        blobs, keep = values(held, "rows"), np.array(values(wanted, "id"), np.int64)
        parts = []
        for blob in blobs:
            part = opened([blob])
            parts.append(part.filter(pa.array(np.isin(part.column(at).to_numpy(), keep))))
        if not parts:
            return schema.empty_table()
        out = pa.concat_tables(parts)
        key_of = out.column(at).to_numpy()
        order = np.argsort(key_of, kind="stable")
        again = np.flatnonzero(np.diff(key_of[order]) == 0)
        if len(again):
            by = out[first_by].to_pylist()
            order = np.array(sorted(range(len(key_of)), key=lambda i: (key_of[i], by[i] is not None, by[i] or "")))
            order = order[np.concatenate([[True], np.diff(key_of[order]) != 0])]
        return out.take(pa.array(order))

    held = rows.mapInArrow(send, "g int, rows binary").repartition(groups, "g").groupBy("g")
    wanted = ids.select(key).mapInArrow(send_ids, "g int, id bigint").repartition(groups, "g").groupBy("g")
    return held.cogroup(wanted).applyInArrow(choose, rows.schema)


def trimmed(f):
    """A function on groups that gives freed memory back to the system when it ends: workers live for many tasks."""

    def ended() -> None:
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(OSError, AttributeError):  # other C libraries have no malloc_trim
            ctypes.CDLL(None).malloc_trim(0)

    def one(table: pa.Table) -> pa.Table:
        try:
            return f(table)
        finally:
            ended()

    def two(left: pa.Table, right: pa.Table) -> pa.Table:
        try:
            return f(left, right)
        finally:
            ended()

    return two if f.__code__.co_argcount == 2 else one  # Spark counts the arguments
