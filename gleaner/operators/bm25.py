"""BM25 over a corpus (item_id, text) for queries (query_id, text)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleaner.functions.tokens import normalized_tokens
from gleaner.operators.ranking import top_k
from gleaner.operators.sizes import BROADCAST_ROWS

K1, B = 1.5, 0.75
#: Counted terms and scored pairs that a task may hold: an item has at most one pair for each query, and few items have over TERMS_AN_ITEM terms of queries.
ROWS_A_TASK = 4_000_000
TERMS_AN_ITEM = 1_000


def tokenized(corpus: DataFrame, tokenizer: Callable[[Column], Column] = normalized_tokens) -> DataFrame:
    """(item_id, tokens, len)."""
    return corpus.select("item_id", tokenizer(F.col("text")).alias("tokens")).withColumn("len", F.size("tokens"))


def term_stats(tokens: DataFrame) -> DataFrame:
    """(item_id, doc_len, distinct_terms) of each item."""
    return tokens.select("item_id", F.col("len").cast("long").alias("doc_len"), F.size(F.array_distinct("tokens")).cast("long").alias("distinct_terms"))


def term_counts(tokens: Column) -> Column:
    """Array of (token, tf): runs in the sorted tokens, without leaving the row."""

    def counted(s: Column) -> Column:
        n = F.size(s)
        starts = F.filter(F.sequence(F.lit(0), n - 1), lambda i: (i == 0) | (F.get(s, i) != F.get(s, i - 1)))
        # Each array is bound to a name before lambdas use it, or they would make it again for each element.
        return F.transform(F.array(starts), lambda at: F.transform(at, lambda i, k: F.struct(F.get(s, i).alias("token"), (F.coalesce(F.get(at, k + 1), n) - i).alias("tf"))))[0]

    return F.when(F.size(tokens) > 0, F.transform(F.array(F.array_sort(tokens)), counted)[0])


def corpus_stats(tokens: DataFrame) -> DataFrame:
    """One row: n items and avgdl, 0 for an empty corpus."""
    return tokens.agg(F.count("*").alias("n"), F.coalesce(F.avg("len"), F.lit(0.0)).alias("avgdl"))


def idf(tokens: DataFrame) -> DataFrame:
    """(token, df, idf) with idf = ln(1 + (n - df + 0.5) / (df + 0.5)): always above 0."""
    df = tokens.select(F.explode(F.array_distinct("tokens")).alias("token")).groupBy("token").agg(F.count("*").alias("df"))
    return df.crossJoin(F.broadcast(corpus_stats(tokens))).select("token", "df", F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf"))  # broadcast: one row


def scores(queries: DataFrame, corpus: DataFrame, k1: float = K1, b: float = B, tokenizer: Callable[[Column], Column] = normalized_tokens) -> DataFrame:
    """(query_id, item_id, score) of every pair that shares a term; repeated query terms count once.

    The corpus is read and tokenized once, and terms are counted inside the rows. Terms that no query has go before the
    only large shuffle, which is by item: joined terms and sums of an item then stay in one task. An empty term for
    each item rides along and carries the corpus statistics; all three uses share the exchange. Its tasks are as many
    as items times queries ask for: few bytes of terms become many pairs, so its bytes say nothing.
    """
    tokens = tokenized(corpus, tokenizer)
    terms = queries.select("query_id", F.explode(F.array_distinct(tokenizer(F.col("text")))).alias("token"))
    known = terms.limit(BROADCAST_ROWS + 1).count()
    small = known <= BROADCAST_ROWS
    tasks = max(queries.sparkSession.sparkContext.defaultParallelism, -(-corpus.count() * (queries.count() + min(known, TERMS_AN_ITEM)) // ROWS_A_TASK))
    hint = F.broadcast if small else lambda df: df
    vocabulary = terms.select("token").union(queries.sparkSession.range(1).select(F.lit("").alias("token"))).distinct()
    ride = F.array(F.struct(F.lit("").alias("token"), F.lit(1).alias("tf")))
    rows = tokens.select("item_id", "len", F.explode(F.concat(ride, F.coalesce(term_counts(F.col("tokens")), F.slice(ride, 1, 0)))).alias("t")).select("item_id", "len", "t.token", "t.tf")
    tf = rows.join(hint(vocabulary), "token", "left_semi").repartition(tasks, "item_id").groupBy("item_id", "len", "token").agg(F.sum("tf").alias("tf"))
    # All uses ask for all columns of the rows: only then do they share the exchange and what is before it.
    there = F.col("tf") > 0
    whole = there & (F.col("token") == "")
    stats = tf.agg(F.count_if(whole).alias("n"), F.avg(F.when(whole, F.col("len"))).alias("avgdl"))
    df = tf.groupBy("token").agg(F.count_if(there).alias("df"))
    weight = df.crossJoin(F.broadcast(stats)).select("token", "avgdl", F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf"))  # broadcast: one row
    weighted = hint(terms.join(weight, "token"))
    norm = F.col("tf") + k1 * (1 - b + b * F.col("len") / F.col("avgdl"))
    part = F.col("idf") * F.col("tf") * (k1 + 1) / norm
    return tf.join(weighted, "token").groupBy("query_id", "item_id").agg(F.sum(part).alias("score"))


def retrieve(queries: DataFrame, corpus: DataFrame, k: int = 100, **options) -> DataFrame:
    """Ranked items (query_id, item_id, score, rank); ties by item id."""
    return top_k(scores(queries, corpus, **options), k)


def distinct_items(corpus: DataFrame, order: str) -> DataFrame:
    """One row per item id: the last text by `order`."""
    last = F.row_number().over(Window.partitionBy("item_id").orderBy(F.col(order).desc()))
    return corpus.withColumn("_n", last).where("_n = 1").drop("_n")
