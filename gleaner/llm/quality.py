"""Quality classifier: Bradley-Terry scores learnt from preference pairs, a threshold at a score quantile.

Each document gets a strength, linear in one-hot quantile bins of simple text measures. A pair (better, worse)
of labelled documents is won by the better with probability sigmoid(strength difference); the weights minimise
the logistic loss on the differences of their features. The threshold is the quantile of the strengths of the
training documents that separates the labels best; a scale fitted on the same rows maps strengths to scores in
(0, 1), so that the threshold becomes THRESHOLD.

`fit` reads a bounded sample of labelled rows (`most_labelled`, by a hash of the id, all of them if there are
fewer). Scoring reads whole texts and nothing else: not labels, lang, source or ids. Null text counts as empty
and has a score like any other; repeated rows, and texts with equal measures, get equal scores; a text of any length is
measured whole; an empty table, or one whose labels miss a
class, gives a model that accepts everything.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.llm.common import table
from gleaner.operators.sizes import spread

THRESHOLD = 0.3
FOLDS = 5
MOST_LABELLED = 20_000
PAIRS = 60_000
BINS = 12
MEASURES = ("upper", "symbol", "punctuation", "digit", "blank", "other", "word_length", "distinct_words", "top_word", "repeated_next", "distinct_lines", "squeeze", "words")

_CLASS = np.zeros(256, np.uint8)
for _chars, _kind in ((range(65, 91), 1), (b"#$%&*+/<=>@[\\]^_`{|}~!", 2), (b"\"'(),-.:;?", 3), (range(48, 58), 4), (b" \t\n\r\x0b\x0c", 5), (range(128, 256), 6)):
    for _c in _chars:
        _CLASS[_c] = _kind
_CLASS_TABLE = _CLASS.tobytes()


def measures(text: str | None) -> list[float]:
    """The measures of one whole text, in the order of MEASURES."""
    data = (text or "").encode()
    n = max(1, len(data))
    kinds = data.translate(_CLASS_TABLE)
    share = [kinds.count(k) / n for k in range(1, 7)]
    words = data.split()
    w = max(1, len(words))
    counts: dict[bytes, int] = {}
    for word in words:
        counts[word] = counts.get(word, 0) + 1
    lines = data.split(b"\n")
    again = sum(map(bytes.__eq__, words, words[1:])) if words else 0
    return [*share, len(data) / w, len(counts) / w, max(counts.values(), default=0) / w, again / w, len(set(lines)) / len(lines), len(zlib.compress(data, 1)) / (n + 20), float(np.log1p(len(words)))]


@dataclass
class Model:
    edges: list[np.ndarray]  # inner bin edges of each measure
    weights: np.ndarray
    threshold: float
    scale: float

    def design(self, values: np.ndarray) -> np.ndarray:
        return design(values, self.edges)

    def scores(self, values: np.ndarray) -> np.ndarray:
        """Scores of rows of measures."""
        strength = self.design(values) @ self.weights if len(values) else np.zeros(0)
        z = self.scale * (strength - self.threshold) + np.log(THRESHOLD / (1 - THRESHOLD))
        return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def design(values: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    """One-hot bins of each measure."""
    out = np.zeros((len(values), sum(len(e) + 1 for e in edges)))
    begin = 0
    for j, e in enumerate(edges):
        out[np.arange(len(values)), begin + np.searchsorted(e, values[:, j], side="right")] = 1
        begin += len(e) + 1
    return out


def train(values: np.ndarray, labels: np.ndarray, pairs: int = PAIRS, ridge: float = 1e-3, steps: int = 300) -> Model:
    """A model from measures and labels (1 is preferred to 0)."""
    better, worse = np.flatnonzero(labels == 1), np.flatnonzero(labels == 0)
    if not len(better) or not len(worse):
        return Model([np.zeros(0)] * values.shape[1], np.zeros(values.shape[1]), -1.0, 1.0)
    # Extremes set the classes apart: the outer bins are narrow.
    share = np.concatenate([[0.01, 0.03], np.linspace(0.08, 0.92, BINS - 5), [0.97, 0.99]])
    edges = []
    for j in range(values.shape[1]):
        of = [np.quantile(values[rows, j], share) for rows in (better, worse)]
        edges.append(np.unique(np.concatenate(of)))
    x = design(values, edges)
    draw = np.random.default_rng(7)
    d = x[draw.choice(better, pairs)] - x[draw.choice(worse, pairs)]
    weights, speed, step = np.zeros(x.shape[1]), np.zeros(x.shape[1]), 4.0
    for _ in range(steps):  # Nesterov's accelerated descent
        ahead = weights + 0.9 * speed
        lost = 1 / (1 + np.exp(np.clip(d @ ahead, -500, 500)))
        speed = 0.9 * speed + step * 0.1 * (d.T @ lost / pairs - ridge * ahead)
        weights = weights + speed
    strength = x @ weights
    # The quantile of all training strengths with the best weighted accuracy, midway to the next strength.
    order = np.argsort(strength, kind="stable")
    sorted_labels, s = labels[order], strength[order]
    gain = np.cumsum(sorted_labels == 0) / len(worse) - 2 * np.cumsum(sorted_labels == 1) / len(better)  # a good text lost counts double
    gain[:-1][s[:-1] == s[1:]] = -1
    at = int(np.argmax(gain))
    threshold = (s[at] + s[min(at + 1, len(s) - 1)]) / 2
    z0, best = np.log(THRESHOLD / (1 - THRESHOLD)), None
    for scale in np.geomspace(0.05, 5, 60):
        z = scale * (strength - threshold) + z0
        loss = np.mean(np.logaddexp(0, np.where(labels == 1, -z, z)))
        if best is None or loss < best[0]:
            best = (loss, scale)
    return Model(edges, weights, float(threshold), float(best[1]))


def held_out(doc_id: Column) -> Column:
    """Whether a document's labels are never learnt from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == 0, F.lit(True))


def fit(docs: DataFrame, labels: DataFrame, most_labelled: int = MOST_LABELLED) -> Model:
    """Learn from the labelled documents outside the held-out fold, `most_labelled` at most."""
    known = labels.where(F.col("quality").isin(0, 1) & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("quality").alias("quality"))
    # The bound makes this side small whatever the input.
    some = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most_labelled)

    @F.pandas_udf("array<double>")
    def measured(texts: pd.Series) -> pd.Series:
        return texts.map(measures)

    rows = docs.select("doc_id", "text").join(F.broadcast(some), "doc_id").select("doc_id", "quality", measured("text").alias("m")).toPandas()
    if rows.empty:
        return train(np.zeros((0, len(MEASURES))), np.zeros(0))
    rows = rows.sort_values(["doc_id"], kind="stable")
    return train(np.stack(rows["m"].to_numpy()), rows["quality"].to_numpy())


def score(text: Column, model: Model) -> Column:
    """The score of whole texts as a column."""

    @F.pandas_udf("double")
    def scored(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in parts:
            yield pd.Series(model.scores(np.array([measures(t) for t in texts]).reshape(len(texts), len(MEASURES))), index=texts.index)

    return scored(text)


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit(docs, table(spark, sf_dir, "labels"))
    scored = spread(docs).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), score(F.col("text"), model).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
