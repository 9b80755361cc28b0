"""Operators on tables of texts."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from gleaner.operators.sizes import BROADCAST_ROWS

#: Rows whose tokens are held at a time.
ROWS = 1_000


def removed_tokens_table(rows: DataFrame, key: str, before: str = "before", after: str = "after") -> DataFrame:
    """(key, removed) of each row: tokens that `after` lacks as a multiset, in order; of n copies the last are the removed ones.

    Tokens are counted inside their row, so that long texts stay linear and no token leaves its task. str.split() parts
    at the blanks that `words` knows.
    """
    schema = StructType([rows.schema[key], StructField("removed", ArrayType(StringType(), False), False)])

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (whole.slice(begin, ROWS) for whole in batches for begin in range(0, whole.num_rows, ROWS)):
            removed = []
            for old, new in zip(batch.column(1), batch.column(2)):
                left = Counter((new.as_py() or "").split())
                gone = []
                for token in (old.as_py() or "").split():
                    if left.get(token, 0) > 0:
                        left[token] -= 1
                    else:
                        gone.append(token)
                removed.append(gone)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(removed, pa.list_(pa.string()))], [key, "removed"])

    return rows.select(key, before, after).mapInArrow(remove, schema)


def containing(texts: DataFrame, phrases: DataFrame) -> DataFrame:
    """(query_id, item_id) of every text (item_id, text) that contains a phrase (query_id, text). Nulls contain nothing; every
    text contains an empty phrase.

    One pass over each text finds all phrases. They are collected if a count shows at most BROADCAST_ROWS; more are met
    by a join, whose work is texts times phrases.
    """
    known = phrases.where("query_id is not null and text is not null").select("query_id", "text").distinct()
    asked = known.limit(BROADCAST_ROWS + 1).collect()
    rows = texts.where("text is not null").select("item_id", "text")
    if len(asked) > BROADCAST_ROWS:
        return rows.join(known.withColumnRenamed("text", "phrase"), F.col("text").contains(F.col("phrase"))).select("query_id", "item_id").distinct()
    ids: dict[str, list[int]] = {}
    for r in asked:
        ids.setdefault(r["text"], []).append(r["query_id"])
    always = ids.pop("", [])

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = ahocorasick.Automaton()
        for phrase, of in ids.items():
            automaton.add_word(phrase, of)
        automaton.make_automaton()
        for batch in batches:
            found: list[int] = []
            size = []
            for text in batch.column(1).to_pylist():
                own = {q for _, of in automaton.iter(text) for q in of} if ids else set()
                own.update(always)
                found += own
                size.append(len(own))
            items = batch.column(0).take(pa.array([i for i, n in enumerate(size) for _ in range(n)], pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64()), items.cast(pa.int64())], ["query_id", "item_id"])

    return rows.mapInArrow(find, "query_id bigint, item_id bigint").distinct()
