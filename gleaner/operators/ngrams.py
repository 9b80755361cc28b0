"""Document frequencies of n-grams, counted on Arrow batches.

A task numbers the words of a slice of texts, sorts n-grams as whole numbers and sends each once for the slice with its
count, packed by buckets; a bucket's terms then meet in one task. There are as many more buckets as there is more text.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Tokens, bytes to be split and texts of a slice; a text with more is a slice of its own.
TOKENS, SPLIT_BYTES, TEXTS = 1 << 21, 12 << 20, 1 << 16
#: Bytes of text for each bucket; terms of a bucket that are held before they are added up, and rows of a batch of results.
BUCKET_BYTES, HELD, ROWS = 8 << 20, 1 << 20, 1 << 16
FOLD = np.uint64(0x9E3779B97F4A7C15)
Terms = tuple[pa.Array, np.ndarray, np.ndarray]


def document_frequencies(texts: DataFrame, tokenizer: Callable[[Column], Column], n: Sequence[int], min_df: int, split: Callable[[pa.Array], pa.Array] | None = None) -> DataFrame:
    """(term, df) of all n-grams in at least `min_df` texts (text): neighbouring tokens joined by blanks. Null tokens are part of none.

    split: makes lists of tokens of what the tokenizer gives, where that is texts."""
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(texts.sparkSession.sparkContext.defaultParallelism, -(-size // BUCKET_BYTES))
    sent = texts.select(tokenizer(F.col("text")).alias("tokens")).mapInArrow(_counted(sorted(set(n)), buckets, split), "bucket int, terms binary, lengths binary, counts binary")
    return sent.repartitionById(buckets, F.col("bucket")).sortWithinPartitions("bucket").mapInArrow(_added(min_df), "term string, df bigint")


def _slices(column: pa.Array, size: pa.Array, most: int) -> Iterator[pa.Array]:
    """Neighbouring rows of `most` in all, or one row."""
    ends = np.cumsum(size.fill_null(0).to_numpy(), dtype=np.int64)
    begin = 0
    while begin < len(column):
        before = ends[begin - 1] if begin else 0
        end = min(max(begin + 1, int(np.searchsorted(ends, before + most, "right"))), begin + TEXTS)
        yield column.slice(begin, end - begin)
        begin = end


def _hashes(words: pa.Array) -> np.ndarray:
    return pd.util.hash_array(words.to_numpy(zero_copy_only=False).astype(object), categorize=False)


def _distinct(gram: np.ndarray, text: np.ndarray, texts: int) -> tuple[np.ndarray, np.ndarray]:
    """The n-grams, and in how many texts each is."""
    keys = np.sort(gram * texts + text)
    grams = keys[np.diff(keys, prepend=-1) != 0] // max(1, texts)
    begins = np.flatnonzero(np.diff(grams, prepend=-1))
    return grams[begins], np.diff(begins, append=len(grams))


def _frequencies(tokens: pa.Array, n: Sequence[int]) -> Iterator[Terms]:
    """(terms, texts that hold each, hashes) of a slice, for one of `n` after the other. A hash folds those of the pieces between blanks."""
    size = pc.list_value_length(tokens).fill_null(0).to_numpy()
    coded = tokens.flatten().dictionary_encode()
    words, code = coded.dictionary, coded.indices.fill_null(-1).to_numpy().astype(np.int64)
    if pc.any(pc.match_substring(words, " ")).as_py():  # n-grams of unlike n can be equal then
        yield _plainly(tokens, n)
        return
    text, hashed = np.repeat(np.arange(len(size)), size), _hashes(words)
    gram, terms, hashes = code, words, hashed
    for i in range(1, n[-1] + 1):
        if i > 1:  # what begins at a place, and the word i - 1 places on
            last = code[i - 1 :]
            gram = gram[: len(last)]
            gram = np.where((gram >= 0) & (last >= 0) & (text[: len(last)] == text[i - 1 :]), gram * len(words) + last, -1)
        alive = gram >= 0
        found, count = _distinct(gram[alive], text[: len(gram)][alive], len(size))
        if i > 1:
            first, last = np.divmod(found, len(words))
            terms, hashes = pc.binary_join_element_wise(terms.take(pa.array(first)), words.take(pa.array(last)), " "), hashes[first] * FOLD + hashed[last]
            if i < n[-1]:
                gram = np.where(alive, np.searchsorted(found, gram), -1)
        if i in n:
            yield (terms, count, hashes) if i > 1 else (words.take(pa.array(found)), count, hashed[found])


def _plainly(tokens: pa.Array, n: Sequence[int]) -> Terms:
    """The same over each text's set of n-grams as strings."""
    counts: Counter[str] = Counter()
    for row in tokens:
        own = row.as_py() or []
        counts.update({" ".join(own[j : j + i]) for i in n for j in range(len(own) - i + 1) if None not in own[j : j + i]})
    terms = pa.array(counts, pa.string())
    pieces = pc.split_pattern(terms, " ")
    hashed, ends = _hashes(pieces.flatten()), np.cumsum(pc.list_value_length(pieces).to_numpy())
    hashes = np.zeros(len(terms), np.uint64)
    for at, (begin, end) in enumerate(zip([0, *ends], ends)):
        made = 0
        for h in hashed[begin:end].tolist():
            made = (made * int(FOLD) + h) % (1 << 64)
        hashes[at] = made
    return terms, np.fromiter(counts.values(), np.int64, len(counts)), hashes


def _binary(values: np.ndarray, edges: np.ndarray) -> pa.Array:
    """The bytes of the values between one edge and the next."""
    return pa.Array.from_buffers(pa.binary(), len(edges) - 1, [None, pa.py_buffer((edges * values.itemsize).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(values))])


def _counted(n: Sequence[int], buckets: int, split: Callable[[pa.Array], pa.Array] | None) -> Callable:
    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(0)
            lists = map(split, _slices(column, pc.binary_length(column), SPLIT_BYTES)) if split else [column]
            parts = (part for tokens in lists for part in _slices(tokens, pc.list_value_length(tokens), TOKENS))
            for terms, count, hashes in (found for part in parts for found in _frequencies(part, n)):
                bucket = ((hashes >> np.uint64(20)) % np.uint64(buckets)).astype(np.int32)
                order = np.argsort(bucket, kind="stable")
                bucket, count = bucket[order], count[order].astype(np.int32)
                packed = terms.take(pa.array(order))
                ends = np.frombuffer(packed.buffers()[1], np.int32, len(packed) + 1, 4 * packed.offset)
                edges = np.append(np.flatnonzero(np.diff(bucket, prepend=-1)), len(bucket))
                text = np.frombuffer(packed.buffers()[2] or b"", np.uint8)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(bucket[edges[:-1]]), _binary(text, ends[edges]), _binary(np.diff(ends), edges), _binary(count, edges)], ["bucket", "terms", "lengths", "counts"]
                )

    return counted


def _unpacked(batch: pa.RecordBatch) -> tuple[pa.Array, np.ndarray]:
    text, length, count = (b"".join(x.as_buffer() for x in batch.column(i)) for i in (1, 2, 3))
    ends = np.cumsum(np.frombuffer(length, np.int32), dtype=np.int64)
    return pa.Array.from_buffers(pa.large_string(), len(ends), [None, pa.py_buffer(np.concatenate([[0], ends])), pa.py_buffer(text)]), np.frombuffer(count, np.int32).astype(np.int64)


def _summed(held: list[tuple[pa.Array, np.ndarray]]) -> tuple[pa.Array, np.ndarray]:
    terms, counts = zip(*held, strict=True)
    coded = pa.concat_arrays(terms).dictionary_encode()
    total = np.zeros(len(coded.dictionary), np.int64)
    np.add.at(total, coded.indices.to_numpy(), np.concatenate(counts))
    return coded.dictionary, total


def _added(min_df: int) -> Callable:
    """Over rows sorted by bucket: one bucket is held at a time."""

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, most = None, [], HELD

        def over() -> Iterator[pa.RecordBatch]:
            if held:
                terms, total = _summed(held)
                kept = np.flatnonzero(total >= min_df)
                for begin in range(0, len(kept), ROWS):
                    part = kept[begin : begin + ROWS]
                    yield pa.RecordBatch.from_arrays([terms.take(pa.array(part)).cast(pa.string()), pa.array(total[part])], ["term", "df"])

        for batch in batches:
            edges = [*np.flatnonzero(np.diff(batch.column(0).to_numpy(), prepend=-1)), batch.num_rows]
            for begin, end in zip(edges, edges[1:]):
                bucket = batch.column(0)[begin].as_py()
                if bucket != at:
                    yield from over()
                    at, held, most = bucket, [], HELD
                held.append(_unpacked(batch.slice(begin, end - begin)))
                if sum(len(x) for x, _ in held) > most:
                    held = [_summed(held)]
                    most = max(HELD, 2 * len(held[0][0]))
        yield from over()

    return added
