"""Order-preserving packing into windows of at most `size` tokens by dynamic programming.

The tokens of the documents, in the order in which the table's rows are read, form one stream per input split.
A window ends at the end of a document, of a sentence, or, where a sentence leaves no other choice or padding
would cost more, at a free place. The cost of a window is its padding plus a penalty for what its end cuts:
nothing for a document, SENTENCE_CUT or FREE_CUT tokens otherwise. With candidates c_0 < c_1 < ... the least cost
is best[j] = cut[j] + size - c_j + min(best[i] + c_i over c_j - c_i <= size), a sliding minimum that a monotone queue
gives in constant time for each candidate. The last, open window of a batch carries over to the next batch.

Window ids are (split << 32) + number. Only the last window of a split is short; it is padded to a power of
two. A retried task reads the same split and makes the same windows. Null text counts as empty: a document
always has its final id. Repeated rows are packed like any others; further columns are not read. Of cuts that
cost the same, the later one is chosen. A text of any length is packed whole: its tokens, four bytes each, and its
candidates are held by one task. An empty table has no pieces.
"""

from __future__ import annotations

import base64
import json
import zlib
from collections import deque
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from gleaner.llm.bpe import PATTERN, byte_alphabet, encoder
from gleaner.llm.common import small_batches, table, text_list, tokenizer_path
from gleaner.operators.sizes import spread

SIZE = 2048
END_ID = 1
#: Tokens of padding that a cut inside a document at a sentence's end, or at any other token, is worth.
SENTENCE_CUT = 4
FREE_CUT = 24
#: A free place is a candidate at every so many tokens.
FREE_STEP = 32
#: Blanks in a row from which on the pre-token pattern's look-ahead, which goes back blank by blank, is left to `bpe`.
BLANKS_MOST = 50_000
_BLANKS = regex.compile(rf"\s{{{BLANKS_MOST}}}")


class Tokens:
    """Token ids of texts, equal to those of the tokenizers library for the same file, by a faster merge loop."""

    def __init__(self, path: str):
        self.path = path
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        byte_of = byte_alphabet()
        ranks = {bytes(byte_of[c] for c in token): i for token, i in spec["model"]["vocab"].items()}
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.encoding = tiktoken.Encoding("vocabulary", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special)
        #: Whether a token ends a sentence.
        self.ends = np.zeros(max([*ranks.values(), *special.values()]) + 1, bool)
        for token, i in ranks.items():
            self.ends[i] = token.rstrip(b" ")[-1:] in (b".", b"!", b"?", b"\n")

    def encode(self, text: str) -> np.ndarray:
        if len(text) >= BLANKS_MOST and _BLANKS.search(text):
            return np.array(encoder(self.path).encode(text), np.int32)
        return np.array(self.encoding.encode(text, allowed_special="all"), np.int32)


@lru_cache(maxsize=1)
def tokens(path: str) -> Tokens:
    return Tokens(path)


def cut_places(places: np.ndarray, cuts: np.ndarray, size: int) -> list[int]:
    """Chosen window ends among candidate `places` (rising, > 0, gaps at most size); the last is always one.

    cuts: the penalty of each. Padding of the last window is not counted: it stays open.
    """
    at, penalty = [0, *places.tolist()], [0, *cuts.tolist()]
    last = len(at) - 1
    value, came = [0] * len(at), [0] * len(at)  # value: best + place
    queue: deque[int] = deque([0])
    for j in range(1, last + 1):
        here = at[j]
        while here - at[queue[0]] > size:
            queue.popleft()
        i = queue[0]
        came[j] = i
        value[j] = v = value[i] + penalty[j] + size  # best[j] + at[j]: the padding's -at[j] cancels
        while queue and value[queue[-1]] >= v:
            queue.pop()
        queue.append(j)
    out, j = [], last
    while j:
        out.append(at[j])
        j = came[j]
    return out[::-1]


def candidates(ids: np.ndarray, doc_ends: np.ndarray, ends: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Places where a window may end, and the penalty of each."""
    total = len(ids)
    sentence = np.flatnonzero(ends[ids]) + 1
    free = np.arange(FREE_STEP, total + 1, FREE_STEP)
    penalty = np.full(total + 1, -1, np.int16)
    penalty[free] = FREE_CUT
    penalty[sentence] = SENTENCE_CUT
    penalty[doc_ends] = 0
    places = np.flatnonzero(penalty[1:] >= 0) + 1
    return places, penalty[places]


class Packer:
    """Packs the documents of one split, batch by batch."""

    def __init__(self, split: int, size: int, ends: np.ndarray):
        self.split, self.size, self.ends, self.number = split, size, ends, 0
        self.open: list[tuple] = []  # (key, ids left, start, all its ids) of documents in the open window

    def pack(self, docs: list[tuple[object, np.ndarray]], final: bool) -> list[tuple]:
        """Pieces (key, start, length, ids_crc32, doc_tokens, sequence_id, offset)."""
        rows = self.open + [(key, ids, 0, len(ids)) for key, ids in docs]
        if not rows:
            return []
        stream = np.concatenate([r[1] for r in rows])
        doc_ends = np.cumsum([len(r[1]) for r in rows])
        cuts = cut_places(*candidates(stream, doc_ends, self.ends, self.size), self.size)
        kept = cuts if final else cuts[:-1]
        closed = kept[-1] if kept else 0
        self.open, pieces, w, window = [], [], 0, 0
        begin = 0
        for (key, ids, start, full), end in zip(rows, doc_ends.tolist(), strict=True):
            at = begin
            while at < min(end, closed):
                while kept[w] <= at:
                    window, w = kept[w], w + 1
                to = min(end, kept[w])
                pieces.append((key, start + at - begin, to - at, zlib.crc32(stream[at:to].astype("<u4").tobytes()), full, (self.split << 32) + self.number + w, at - window))
                at = to
            if at < end:
                self.open.append((key, ids[at - begin :], start + at - begin, full))
            begin = end
        self.number += len(kept)
        return pieces


def pack(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = SIZE, vocabulary: str | None = None) -> DataFrame:
    """One row per piece: key, start, length, ids_crc32, doc_tokens, sequence_id, offset, padded (its window's size)."""
    kind = docs.schema[key].dataType
    names = ["start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = tokens(vocabulary or tokenizer_path())
        packer, schema = Packer(TaskContext.get().partitionId(), size, tok.ends), None

        def made(docs: list, final: bool) -> pa.RecordBatch:
            columns = list(zip(*packer.pack(docs, final), strict=True)) or [()] * 7
            return pa.RecordBatch.from_arrays([pa.array(columns[0], schema), *(pa.array(x, pa.int64()) for x in columns[1:])], [key, *names])

        for batch in small_batches(batches, text):
            schema = batch.column(0).type
            docs = [(k, np.append(tok.encode(x), np.int32(END_ID))) for k, x in zip(batch.column(0).to_pylist(), text_list(batch.column(1)), strict=True)]
            yield made(docs, False)
        if packer.open:
            yield made([], True)

    return docs.select(key, text).mapInArrow(run, f"`{key}` {kind.simpleString()}, " + ", ".join(f"`{n}` bigint" for n in names))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(spread(table(spark, sf_dir, "documents")))
