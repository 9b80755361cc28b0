import random
from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from gleaner.functions import tokens as t
from gleaner.operators import ngrams, topics

ODD = ["", None, "a", "a a a", "A-b a", "É è÷ß×à Ãà", "x\u0000y ünḯ ﬁ 𝒳a ÿ", "Kelvin K ÅŸ İi", "a", " b", "b", "long " * 50, "9à9", "÷", "à", "日本a語à"]


def plainly(lists, n, min_df):
    counts = Counter()
    for own in lists:
        counts.update({" ".join(own[j : j + i]) for i in n for j in range(len(own) - i + 1)})
    return {k: v for k, v in counts.items() if v >= min_df}


def test_split_equals_tokens(spark):
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(ODD)], "i int, text string").select("i", t.simple_text(F.col("text")).alias("text"), t.simple_tokens(F.col("text")).alias("tokens")).orderBy("i").collect()
    texts = pa.array([r["text"] for r in rows])
    assert t.simple_split(texts).to_pylist() == [r["tokens"] for r in rows]
    assert t.simple_split(texts.slice(3, 5)).to_pylist() == [r["tokens"] for r in rows[3:8]]
    for few in ([], [""], [None, ""]):
        assert t.simple_split(pa.array(few, pa.string())).to_pylist() == [[] for _ in few]


@pytest.mark.parametrize("n", [(1, 2), (2,), (1, 3), (3, 2, 1)])
@pytest.mark.parametrize("blanks", [False, True])
def test_slices_and_buckets_add_up(monkeypatch, n, blanks):
    """Slices of a few tokens, of which some have n-grams in which unlike pieces give equal texts."""
    monkeypatch.setattr(ngrams, "TOKENS", 7)
    monkeypatch.setattr(ngrams, "HELD", 5)
    draw = random.Random(1)
    words = ["a", "b", "ç", "dd", ""] + ["a b", " "] * blanks
    lists = [draw.choices(words, k=draw.choice([0, 1, 2, 5, 20])) for _ in range(60)]
    batch = pa.RecordBatch.from_arrays([pa.array(lists[:50] + [None], pa.list_(pa.string()))], ["tokens"])
    more = pa.RecordBatch.from_arrays([pa.array(lists[50:], pa.list_(pa.string()))], ["tokens"])
    sent = pa.Table.from_batches(ngrams._counted(sorted(n), 3, None)([batch, more])).sort_by("bucket")
    got = [r for x in ngrams._added(3)(sent.to_batches(max_chunksize=4)) for r in x.to_pylist()]
    assert len(got) == len({r["term"] for r in got})
    assert {r["term"]: r["df"] for r in got} == plainly(lists, n, 3)


def test_vocabulary_sends_counts_not_terms(spark):
    """Terms are counted before they leave their task; no row is made for each n-gram of each text."""
    docs = spark.createDataFrame([(x,) for x in ODD * 2], "text string")
    lists = [r[0] for r in docs.select(t.simple_tokens(F.col("text"))).collect()]
    for made in (topics.vocabulary(docs, t.simple_tokens), topics.vocabulary(docs, t.simple_text, split=t.simple_split)):
        assert {r["term"]: r["df"] for r in made.collect()} == plainly(lists, (1, 2), 3)
        assert "Generate" not in made._jdf.queryExecution().toString()
    assert topics.vocabulary(docs.limit(0), t.simple_tokens).count() == 0
