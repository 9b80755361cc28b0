"""Tokenizers, token-set similarity, n-grams and small scalar helpers."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from gleaner.functions.normalize import normalize, single_blanks, words
from gleaner.functions.stopwords import DOMAIN, PORTUGUESE, TOPIC_EXTRA

#: Bytes of simple tokens: those that are characters, and those behind 0xC3.
ASCII, LATIN = (np.isin(np.arange(256), np.frombuffer(x, np.uint8)) for x in (b"0123456789abcdefghijklmnopqrstuvwxyz", bytes({*range(0xA0, 0xC0)} - {0xB7})))


def simple_text(c: Column) -> Column:
    return F.lower(F.coalesce(c, F.lit("")))


def simple_tokens(c: Column) -> Column:
    """Lower-case runs of ASCII and Latin-1 letters and digits."""
    return F.regexp_extract_all(simple_text(c), F.lit("[0-9a-zà-öø-ÿ]+"), 0)


def simple_split(texts: pa.Array) -> pa.Array:
    """The simple tokens of each `simple_text`, by the bytes of all together: what stays of them are the tokens, joined."""
    texts = texts.fill_null("").cast(pa.large_string())
    ends = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, 8 * texts.offset)
    flat = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]]
    kept = ASCII[flat]
    wide = np.flatnonzero(flat[:-1] == 0xC3)  # leads two bytes, as each Latin-1 letter is written
    wide = wide[LATIN[flat[wide + 1]]]
    kept[wide] = kept[wide + 1] = True
    apart = np.zeros(len(flat), bool)  # a token ends where its text does
    apart[(ends[:-1] - ends[0])[ends[:-1] < ends[-1]]] = True
    begins = kept & apart
    begins[:1] |= kept[:1]
    begins[1:] |= kept[1:] & ~kept[:-1]
    closes = kept.copy()
    closes[:-1] &= begins[1:] | ~kept[1:]
    begins, closes = np.flatnonzero(begins), np.flatnonzero(closes)
    before = np.searchsorted(begins, ends - ends[0]).astype(np.int32)
    place = np.concatenate([[0], np.cumsum(closes + 1 - begins)]).astype(np.int32)
    tokens = pa.Array.from_buffers(pa.string(), len(begins), [None, pa.py_buffer(place), pa.py_buffer(flat[kept])])
    return pa.ListArray.from_arrays(pa.array(before), tokens)


def normalized_tokens(c: Column) -> Column:
    return words(normalize(c))


def punctuated_tokens(c: Column) -> Column:
    """Lower-case words, and each punctuation mark as a token of its own."""
    return F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(r"(?U)\w+|[^\w\s]"), 0)


def jaccard(a: Column, b: Column) -> Column:
    """Of two token arrays as sets: 1 if both are empty, 0 if one is."""
    both = F.size(F.array_union(a, b))
    return F.when(both == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / both)


def jaccard_distinct(a: Column, b: Column) -> Column:
    """As jaccard, of arrays that repeat nothing: only what is shared is looked for."""
    shared = F.size(F.array_intersect(a, b))
    both = F.size(a) + F.size(b) - shared
    return F.when(both == 0, F.lit(1.0)).otherwise(shared / both)


def preprocess_base(c: Column) -> Column:
    return F.lower(single_blanks(F.coalesce(c, F.lit(""))))


def preprocess_topics(c: Column, stopwords: Sequence[str] = (*PORTUGUESE, *TOPIC_EXTRA, *DOMAIN)) -> Column:
    """Base form without stopwords, numbers and one-letter tokens."""
    listed = tuple(dict.fromkeys(stopwords))
    keep = lambda w: ~w.isin(*listed) & ~w.rlike(r"^[\d,./\-]+$") & (F.length(w) > 1)
    return F.array_join(F.filter(words(preprocess_base(c)), keep), " ")


def ngrams(tokens: Column, n: int) -> Column:
    """Neighbouring tokens joined by blanks."""
    grams = tokens
    for i in range(2, n + 1):  # pairs up with the tokens i - 1 places on; what has no partner goes
        grams = F.filter(F.zip_with(grams, F.slice(tokens, F.lit(i), F.greatest(F.size(tokens), F.lit(1))), lambda a, b: F.concat(a, F.lit(" "), b)), lambda g: g.isNotNull())
    return grams


def safe_id(c: Column) -> Column:
    """A whole number, or null where there is none."""
    return c.try_cast("bigint")


def tagged_id(c: Column, tag: str) -> Column:
    """The number in `[tag n]`, or null."""
    return safe_id(F.nullif(F.regexp_extract(c, rf"\[{tag} (\d+)\]", 1), F.lit("")))


def first_filled(*columns: Column) -> Column:
    """The first that is neither null nor empty; an empty text otherwise."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in columns], F.lit(""))


def prefixed(c: Column, prefix: str) -> Column:
    return F.concat(F.lit(prefix), c)


def clamp(c: Column) -> Column:
    return F.least(F.greatest(c, F.lit(0.0)), F.lit(1.0))


def finite(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
