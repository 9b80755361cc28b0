"""Topics: clusters of vectors, class-based TF-IDF terms, distributions and quality by topic."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.ml.clustering import BisectingKMeans, KMeans
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleaner.functions.tokens import preprocess_topics
from gleaner.operators.ngrams import document_frequencies
from gleaner.operators.ranking import query_keys
from gleaner.operators.strata import row_mean

OUTLIER = -1


def cluster(vectors: DataFrame, k: int, outlier_share: float = 0.0, seed: int = 42, bisecting: bool = False) -> DataFrame:
    """Adds `topic`; the given share of vectors farthest from their centre become OUTLIER."""
    rows = vectors.withColumn("_v", array_to_vector(F.col("embedding").cast("array<double>")))
    model = (BisectingKMeans if bisecting else KMeans)(k=k, seed=seed, featuresCol="_v", predictionCol="topic").fit(rows)
    out = model.transform(rows)
    if outlier_share > 0:
        centres = vectors.sparkSession.createDataFrame([(i, [float(x) for x in c]) for i, c in enumerate(model.clusterCenters())], "topic int, _c array<double>")
        away = F.aggregate(F.zip_with(vector_to_array("_v"), "_c", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda a, x: a + x)
        out = out.join(F.broadcast(centres), "topic").withColumn("_d", away)  # k rows
        limit = out.agg(F.percentile_approx("_d", 1 - outlier_share, 10_000).alias("_limit"))
        out = out.crossJoin(F.broadcast(limit)).withColumn("topic", F.when(F.col("_d") > F.col("_limit"), OUTLIER).otherwise(F.col("topic"))).drop("_c", "_d", "_limit")
    return out.drop("_v")


def vocabulary(texts: DataFrame, tokenizer: Callable[[Column], Column], n: Sequence[int] = (1, 2), min_df: int = 3, split: Callable | None = None) -> DataFrame:
    """(term, df) of all n-grams in at least `min_df` texts. split: see `document_frequencies`."""
    return document_frequencies(texts, tokenizer, n, min_df, split)


def class_tfidf(texts: DataFrame, tokenizer: Callable[[Column], Column], by: str = "topic", top: int = 10, digits: int = 9) -> DataFrame:
    """(by, term, weight, rank): the top terms of each class by tf * ln(1 + A / f).

    tf: the term's share of the class's tokens; A: mean number of tokens of a class; f: the term's count in all classes.
    """
    # Nulls go first: no join then adds a filter of its own, and all uses of the counts share one exchange.
    terms = texts.select(by, F.explode(tokenizer(F.col("text"))).alias("term")).where(F.col(by).isNotNull() & F.col("term").isNotNull())
    counts = terms.groupBy(by, "term").agg(F.count("*").alias("n"))
    sizes = counts.groupBy(by).agg(F.sum("n").alias("size"))
    mean = sizes.agg(F.avg("size").alias("mean_size"))
    total = counts.groupBy("term").agg(F.sum("n").alias("f"))
    weight = F.round(F.col("n") / F.col("size") * F.log(1 + F.col("mean_size") / F.col("f")), digits)
    scored = counts.join(total, "term").join(sizes, by).crossJoin(F.broadcast(mean)).select(by, "term", weight.alias("weight"))  # broadcast: one row
    rank = F.row_number().over(Window.partitionBy(by).orderBy(F.col("weight").desc(), "term")).cast("long")
    return scored.withColumn("rank", rank).where(F.col("rank") <= top)


def topic_info(items: DataFrame, terms: DataFrame, by: str = "topic", words: int = 5) -> DataFrame:
    """(by, size, keywords): the number of items of each topic and its first terms."""
    sizes = items.groupBy(by).agg(F.count("*").alias("size"))
    listed = terms.where(F.col("rank") <= words).groupBy(by).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "term"))), lambda x: x["term"]), ", ").alias("keywords"))
    return sizes.join(listed, by, "left").fillna("", ["keywords"])


def distribution(rows: DataFrame, by: str = "topic") -> DataFrame:
    """(by, n, pct) of each topic; groups are counted before the total is taken."""
    counts = rows.groupBy(by).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("_t"))
    return counts.crossJoin(F.broadcast(total)).select(by, "n", (100.0 * F.col("n") / F.col("_t")).alias("pct"))  # broadcast: one row


def largest(sizes: DataFrame, n: int, by: str = "topic") -> DataFrame:
    """The n topics with the most rows (by, n, ...); ties by topic."""
    return sizes.orderBy(F.col("n").desc(), by).limit(n)


def long_enough(items: DataFrame, least: int = 3, text: str = "text", prepared: Callable[[Column], Column] = preprocess_topics) -> DataFrame:
    """Items whose prepared text has `least` characters or more."""
    return items.where(F.length(prepared(F.col(text))) >= least)


def attach(rows: DataFrame, item_topics: DataFrame, key: str) -> DataFrame:
    """Adds the topic of an item; OUTLIER where it has none. If both tables have a `source`, an item is known by its source and id."""
    keys = [*["source"] * ("source" in rows.columns and "source" in item_topics.columns), key]
    return rows.join(item_topics.withColumnRenamed("item_id", key).select(*keys, "topic"), keys, "left").fillna(OUTLIER, ["topic"])


def query_topics(benchmark: DataFrame, item_topics: DataFrame, target_rule: str = "relevant") -> DataFrame:
    """(query_id, topic) by the first relevant item, or by the entry's own code."""
    target = F.try_element_at("relevant_item_ids", F.lit(1)) if target_rule == "relevant" else F.col("codigo")
    keys = query_keys(benchmark)
    return attach(benchmark.select(*keys, target.alias("target")), item_topics, "target").select(*keys, "topic")


def code_maps(items: DataFrame) -> DataFrame:
    """(space, code, topic) of both code columns; of rows that repeat a code the last by position counts."""
    rows = items.select("topic", "pos", F.explode(F.array(F.struct(F.lit("left").alias("space"), F.col("code_left").alias("code")), F.struct(F.lit("right").alias("space"), F.col("code_right").alias("code")))).alias("x")).select("topic", "pos", "x.*")
    return rows.where("code is not null").groupBy("space", "code").agg(F.max_by("topic", "pos").alias("topic"))


def quality_by_topic(metrics: DataFrame, topics: DataFrame, methods: Sequence[str], value: str = "map", least: int = 5) -> DataFrame:
    """Means of each method by topic with enough queries, their mean, and the number of queries.

    If both tables have a `source`, a query is known by its source and id.
    """
    keys = query_keys(metrics, topics)
    joined = metrics.join(topics.select(*keys, "topic"), keys)
    means = joined.groupBy("topic").pivot("method", list(methods)).agg(F.avg(value))
    counts = joined.select(*keys, "topic").distinct().groupBy("topic").agg(F.count("*").alias("n_queries"))
    return means.join(counts, "topic", "left").fillna(0, ["n_queries"]).where(F.col("n_queries") >= least).withColumn("mean_quality", row_mean(*methods))


def best_and_worst(table: DataFrame, value: str, n: int = 12, key: str = "topic") -> DataFrame:
    """The n best and the n worst rows, each once."""
    best = table.orderBy(F.col(value).desc(), key).limit(n)
    worst = table.orderBy(F.col(value), key).limit(n)
    return best.unionByName(worst).dropDuplicates([key])
