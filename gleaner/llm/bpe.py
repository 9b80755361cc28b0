"""Byte-level BPE with forced-boundary splitting.

A pre-token is cut wherever two neighbouring bytes occur inside no vocabulary token: no merge can ever join
them, so the fragments between such cuts are encoded independently and their ids are concatenated. Fragments
repeat far more than pre-tokens do, which makes a bounded memo of fragments pay.

`encode_ids`/`decode_ids` are exact: they give what the tokenizers library gives for the same vocabulary file.
Null text counts as empty and has no ids; repeated rows give repeated results; further columns are not read; an empty
table gives an empty result. A text of any length is encoded whole, a long fragment in n log n; a worker holds the ids
of about four megabytes of text, or of one text. Of pairs of equal rank the leftmost is merged first.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from gleaner.llm.common import byte_list, small_batches, table, text_list, tokenizer_path
from gleaner.operators.sizes import spread

# Fixed value: the published pre-token pattern of byte-level BPE.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Entries after which a worker empties its memo.
MEMO_MOST = 300_000


def byte_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte in vocabulary files, and the byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class ForcedBoundaryBPE:
    """Encoder and decoder of one vocabulary file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        byte_of = byte_alphabet()
        raw = lambda token: bytes(byte_of[c] for c in token)
        self.ids = {raw(token): i for token, i in spec["model"]["vocab"].items()}
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
        self.ranks = {(raw(a), raw(b)): i for i, (a, b) in enumerate(merges)}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.bytes_of = {i: token for token, i in self.ids.items()} | {i: text.encode() for text, i in self.special.items()}
        self.pattern = regex.compile(PATTERN)
        self.split_special = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        inside = {token[i : i + 2] for token in self.ids for i in range(len(token) - 1)}
        #: For each byte, the bytes that may follow it inside a token.
        self.joined = [frozenset(pair[1] for pair in inside if pair[0] == b) for b in range(256)]
        self.memo: dict[bytes, list[int]] = {}
        self.words: dict[str, list[int]] = {}

    def merge(self, fragment: bytes) -> list[int]:
        """Ids of one fragment, by merging the pair of least rank until none is left."""
        if (whole := self.ids.get(fragment)) is not None and len(fragment) == 1:
            return [whole]
        if len(fragment) > 200:
            return self._merge_long(fragment)
        parts = [fragment[i : i + 1] for i in range(len(fragment))]
        ranks = self.ranks
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                rank = ranks.get((parts[i], parts[i + 1]))
                if rank is not None and (best is None or rank < best):
                    best, at = rank, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.ids[p] for p in parts]

    def _merge_long(self, fragment: bytes) -> list[int]:
        """The same merges with a heap and linked neighbours: n log n for very long fragments."""
        import heapq

        parts: list[bytes | None] = [fragment[i : i + 1] for i in range(len(fragment))]
        after, before = list(range(1, len(parts) + 1)), list(range(-1, len(parts) - 1))
        heap = [(r, i, parts[i], parts[i + 1]) for i in range(len(parts) - 1) if (r := self.ranks.get((parts[i], parts[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, left, right = heapq.heappop(heap)
            j = after[i]
            if parts[i] != left or j >= len(parts) or parts[j] != right:
                continue
            parts[i], parts[j] = left + right, None
            after[i] = after[j]
            if after[i] < len(parts):
                before[after[i]] = i
            for a, b in ((before[i], i), (i, after[i])):
                if a >= 0 and b < len(parts) and (r := self.ranks.get((parts[a], parts[b]))) is not None:
                    heapq.heappush(heap, (r, a, parts[a], parts[b]))
        return [self.ids[p] for p in parts if p is not None]

    def fragments(self, token: bytes) -> list[bytes]:
        """The pieces of a pre-token between forced boundaries."""
        joined, cut, out = self.joined, 0, []
        for i in range(1, len(token)):
            if token[i] not in joined[token[i - 1]]:
                out.append(token[cut:i])
                cut = i
        out.append(token[cut:])
        return out

    def encode_word(self, word: str) -> list[int]:
        ids: list[int] = []
        memo = self.memo
        for fragment in self.fragments(word.encode()):
            if (known := memo.get(fragment)) is None:
                if len(memo) >= MEMO_MOST // 3:
                    memo.clear()
                known = self.merge(fragment)
                if len(fragment) <= 64:
                    memo[fragment] = known
            ids += known
        return ids

    def encode(self, text: str) -> list[int]:
        ids: list[int] = []
        words = self.words
        for part in self.split_special.split(text) if self.split_special else [text]:
            if part in self.special:
                ids.append(self.special[part])
                continue
            for word in self.pattern.findall(part):
                known = words.get(word)
                if known is None:
                    if len(words) >= MEMO_MOST:
                        words.clear()
                    known = self.encode_word(word)
                    if len(word) <= 32:
                        words[word] = known
                ids += known
        return ids

    def decode(self, ids) -> str:
        """Text of ids, special tokens included; bytes that are not UTF-8 become U+FFFD."""
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def encoder(path: str) -> ForcedBoundaryBPE:
    """One encoder for each worker process and file."""
    return ForcedBoundaryBPE(path)


def encode_table(docs: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str | None = None) -> DataFrame:
    """One row per input row: the key and `ids`, the token ids of the whole text."""
    key_type = docs.schema[key].dataType.simpleString()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(vocabulary or tokenizer_path())
        for batch in small_batches(batches, text):
            for begin in range(0, batch.num_rows, 500):  # ids are held as numbers of Python: few texts at a time
                part = batch.slice(begin, 500)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([np.array(bpe.encode(x), np.int32) for x in text_list(part.column(1))], pa.list_(pa.int32()))], [key, "ids"])

    return docs.select(key, text).mapInArrow(encode, f"`{key}` {key_type}, ids array<int>")


def decode_table(encoded: DataFrame, key: str = "doc_id", vocabulary: str | None = None) -> DataFrame:
    """One row per input row: the key and the decoded `text`; null ids count as none."""
    key_type = encoded.schema[key].dataType.simpleString()

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(vocabulary or tokenizer_path())
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([bpe.decode(x or ()) for x in batch.column(1).to_pylist()], pa.string())], [key, "text"])

    return encoded.select(key, "ids").mapInArrow(decode, f"`{key}` {key_type}, text string")


def digest_table(docs: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str | None = None) -> DataFrame:
    """One row per input row: n_tokens and the digests of ids and decoded text, without shipping the ids."""
    key_type = docs.schema[key].dataType.simpleString()
    names = ["n_tokens", "ids_sha256", "decoded_sha256"]

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(vocabulary or tokenizer_path())
        for batch in small_batches(batches, text):
            counts, of_ids, of_text = [], [], []
            for whole in text_list(batch.column(1)):
                ids = bpe.encode(whole)
                counts.append(len(ids))
                of_ids.append(hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
                of_text.append(hashlib.sha256(bpe.decode(ids).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_text, pa.string())], [key, *names])

    return docs.select(key, text).mapInArrow(digest, f"`{key}` {key_type}, n_tokens bigint, ids_sha256 string, decoded_sha256 string")


def op5_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest_table(spread(table(spark, sf_dir, "documents")))
