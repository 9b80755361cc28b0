"""One query for each operator over the star-schema, text and vector tables.

Lexical set: `documents` are the catalogue, `benchmark` the queries, a document that contains a query's text is
relevant. Dense set: vectors whose id divides by twenty are queries against all vectors, an equal label is
relevant; "dense" uses all dimensions, "dense_half" the first 32, "hybrid" fuses both. Documents and vectors with
equal numbers are paired, which is artificial, to join text overlap with dense quality.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.functions.normalize import STEPS, normalize, normalize_report
from gleaner.functions.tokens import jaccard_distinct, preprocess_topics, simple_split, simple_text, simple_tokens
from gleaner.functions.tokens import punctuated_tokens as punctuated
from gleaner.operators import bm25, corpus, curves, dense, fusion, metrics, ranking, strata, text, topics
from gleaner.operators.lineage import checkpoint
from gleaner.operators.sizes import spread
from gleaner.sources.writers import candidate_rows

METHODS = ("dense", "dense_half", "hybrid")
#: Ways of writing that the texts of the tables lack: fractions, decomposed letters, ligatures, full width, units, signs.
VARIANTS = (
    "cano ⅓ e ⅛ pol, ⅔ ⅕ ⅖ ⅗ ⅘", "ac\u0327o inox, corrosa\u0303o, a\u0300 vista", "ﬁo ﬂexível ﬃ", "ＤＮ ５０ ｔｕｂｏ", "10㎜ 5㎏ 3㎡ 2㎞", "¼ ½ ¾ 3½ ⅐ ⅑ ⅒ ⅙ ⅚ ⅜ ⅝ ⅞", "ΣΑΣ Straße X × 2", "1 X 2 – 3 — 4 №5 ™ ²",
)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    found = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(found) if name == "documents" else found


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


# --- lexical set


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("item_id"), "text")


def benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")


def lexical_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bm25.retrieve(benchmark(spark, sf_dir), documents(spark, sf_dir), 100, tokenizer=simple_tokens)


def lexical_qrels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document against the stated set of queries."""
    return text.containing(documents(spark, sf_dir), benchmark(spark, sf_dir))


@query
def bm25_topk(spark, sf_dir):
    return lexical_ranking(spark, sf_dir).select("query_id", "item_id", "score", "rank")


@query
def term_stats(spark, sf_dir):
    return bm25.term_stats(bm25.tokenized(documents(spark, sf_dir), simple_tokens))


@query
def idf_stats(spark, sf_dir):
    return rounded(bm25.idf(bm25.tokenized(documents(spark, sf_dir), simple_tokens)), 9)


@query
def bm25_metrics(spark, sf_dir):
    ranked = lexical_ranking(spark, sf_dir).withColumn("method", F.lit("bm25"))
    runs = benchmark(spark, sf_dir).select("query_id", F.lit("bm25").alias("method"))
    return rounded(metrics.query_metrics(ranked, lexical_qrels(spark, sf_dir), runs=runs))


@query
def bm25_summary(spark, sf_dir):
    ranked = lexical_ranking(spark, sf_dir).withColumn("method", F.lit("bm25"))
    runs = benchmark(spark, sf_dir).select("query_id", F.lit("bm25").alias("method"))
    return rounded(metrics.summarize(metrics.query_metrics(ranked, lexical_qrels(spark, sf_dir), runs=runs)))


@query
def bm25_normalized_topk(spark, sf_dir):
    """BM25 over the tokens of normalised texts, the default."""
    return bm25.retrieve(benchmark(spark, sf_dir), documents(spark, sf_dir), 100).select("query_id", "item_id", "score", "rank")


# --- dense set


def vectors(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    v = table(spark, sf_dir, "embeddings")
    return v.where(F.col("vec_id") % 20 == 0).select(F.col("vec_id").alias("query_id"), "embedding", "label"), v.select(F.col("vec_id").alias("item_id"), "embedding", "label")


def rankings(spark: SparkSession, sf_dir: str, k: int = 100) -> DataFrame:
    """Made once: whatever reads the rankings several times reads what is written."""
    queries, items = vectors(spark, sf_dir)
    full, half = checkpoint(dense.retrieve(queries, items, k)), checkpoint(dense.retrieve(queries, items, k, dims=32))
    parts = {"dense": full, "dense_half": half, "hybrid": fusion.rrf(full, half, k)}
    columns = ["query_id", "method", "rank", "item_id", "score"]
    out = None
    for name, part in parts.items():
        part = part.withColumn("method", F.lit(name)).select(*columns)
        out = part if out is None else out.unionByName(part)
    return checkpoint(out)


def dense_ranking(spark: SparkSession, sf_dir: str, k: int = 100) -> DataFrame:
    queries, items = vectors(spark, sf_dir)
    return dense.retrieve(queries, items, k).select("query_id", "rank", "item_id", "score")


def judged(spark: SparkSession, sf_dir: str, ranked: DataFrame) -> DataFrame:
    """The relevant ones among the pairs of a ranking: labels of both ends are compared, no label's pairs are made."""
    queries, items = vectors(spark, sf_dir)
    pairs = ranked.select("query_id", "item_id").distinct()
    return pairs.join(queries.select("query_id", "label"), "query_id").join(items.select("item_id", F.col("label").alias("item_label")), "item_id").where("label = item_label").select("query_id", "item_id")


def relevant(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The number of relevant items of each query: that of its label."""
    queries, items = vectors(spark, sf_dir)
    return queries.select("query_id", "label").join(items.groupBy("label").agg(F.count("*").alias("relevant")), "label").select("query_id", "relevant")


def quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranked = rankings(spark, sf_dir)
    return metrics.query_metrics(ranked, judged(spark, sf_dir, ranked), relevant=relevant(spark, sf_dir))


def flagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranked = rankings(spark, sf_dir)
    return ranking.flags_keep(ranked, judged(spark, sf_dir, ranked))


def threshold_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curves.by_threshold(flagged(spark, sf_dir), relevant(spark, sf_dir))


@query
def dense_topk(spark, sf_dir):
    return dense_ranking(spark, sf_dir)


@query
def rrf_topk(spark, sf_dir):
    return rankings(spark, sf_dir).where("method = 'hybrid'").drop("method")


@query
def hybrid_topk(spark, sf_dir):
    """Texts and vectors with equal numbers are one item, and one query: BM25 and dense rankings fused."""
    v = table(spark, sf_dir, "embeddings")
    asked = benchmark(spark, sf_dir).join(v, F.col("query_id") == F.col("vec_id")).select("query_id", "embedding")
    found = dense.retrieve(asked, v.select(F.col("vec_id").alias("item_id"), "embedding"), 100)
    return fusion.rrf(lexical_ranking(spark, sf_dir), found, 100)


@query
def dense_metrics(spark, sf_dir):
    return rounded(quality(spark, sf_dir))


@query
def method_summary(spark, sf_dir):
    return rounded(metrics.summarize(quality(spark, sf_dir)))


@query
def ndcg_by_query(spark, sf_dir):
    ranked = rankings(spark, sf_dir)
    return rounded(metrics.ndcg(ranked, judged(spark, sf_dir, ranked), relevant=relevant(spark, sf_dir)))


def repeated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A ranking in which neighbouring items count as one."""
    near = checkpoint(dense_ranking(spark, sf_dir).withColumn("method", F.lit("dense")))
    return near.withColumn("item_id", F.col("item_id") - F.col("item_id") % 3)


def repeated_judged(spark: SparkSession, sf_dir: str, ranked: DataFrame) -> DataFrame:
    """A neighbourhood is relevant if one of its items is."""
    queries, items = vectors(spark, sf_dir)
    labels = items.select((F.col("item_id") - F.col("item_id") % 3).alias("item_id"), "label").distinct()
    pairs = ranked.select("query_id", "item_id").distinct().join(queries.select("query_id", "label"), "query_id")
    return pairs.join(labels, ["item_id", "label"]).select("query_id", "item_id")


@query
def flags_keep_repeats(spark, sf_dir):
    ranked = repeated(spark, sf_dir)
    return ranking.flags_keep(ranked, repeated_judged(spark, sf_dir, ranked)).select("query_id", "rank", "item_id", "flag")


@query
def flags_drop_repeats(spark, sf_dir):
    ranked = repeated(spark, sf_dir)
    return ranking.flags_drop(ranked, repeated_judged(spark, sf_dir, ranked)).select("query_id", "rank", "item_id", "flag")


@query
def pr_by_rank(spark, sf_dir):
    return rounded(curves.by_rank(flagged(spark, sf_dir), relevant(spark, sf_dir)))


@query
def pr_pooled_sets(spark, sf_dir):
    """Two sets of queries, some of them in both, pooled into one curve."""
    rows, counts = flagged(spark, sf_dir), relevant(spark, sf_dir)
    curve = curves.pooled_by_threshold([(rows.where(f"query_id % {n} = 0"), counts.where(f"query_id % {n} = 0")) for n in (40, 60)])
    return curve.select("method", *[F.round(c, 6).alias(c) for c in ("precision", "recall")], "hits", "returned", F.round("threshold", 12).alias("threshold"), "total_relevant")


@query
def pr_by_threshold(spark, sf_dir):
    curve = threshold_curve(spark, sf_dir)
    return curve.select("method", *[F.round(c, 6).alias(c) for c in ("precision", "recall")], "hits", "returned", F.round("threshold", 12).alias("threshold"), "total_relevant")


@query
def ap_from_curve(spark, sf_dir):
    return rounded(curves.step_ap(threshold_curve(spark, sf_dir)))


@query
def pr_interpolated(spark, sf_dir):
    return rounded(curves.wide(curves.interpolated(threshold_curve(spark, sf_dir)), METHODS), 9)


@query
def auc_interpolated(spark, sf_dir):
    return rounded(curves.area(curves.interpolated(threshold_curve(spark, sf_dir))))


@query
def pooled_map(spark, sf_dir):
    q = quality(spark, sf_dir)
    return rounded(metrics.pooled_mean([q.where("query_id % 40 = 0"), q.where("query_id % 40 <> 0")]))


@query
def candidate_lists(spark, sf_dir):
    queries, items = vectors(spark, sf_dir)
    lists = checkpoint(items.groupBy("label").agg(F.array_sort(F.collect_set("item_id")).alias("relevant_item_ids")))
    rows = candidate_rows(rankings(spark, sf_dir), queries.select("query_id", "label", F.col("label").cast("string").alias("text")), None, relevant=lists)
    return rows.select("product_id", "method", "search_terms", F.array_join(F.transform("candidates", lambda c: F.concat_ws(":", c["retrieval_rank"], c["item_id"])), ",").alias("candidates"), F.array_join("relevant_item_ids", ",").alias("relevant"))


# --- strata


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document with its two followers."""
    docs = documents(spark, sf_dir).withColumn("tokens", F.array_distinct(simple_tokens(F.col("text")))).drop("text")
    asked = docs.select(F.col("item_id").alias("query_id"), F.col("tokens").alias("query_tokens"), F.explode(F.array(F.col("item_id") + 1, F.col("item_id") + 2)).alias("target_id"))
    target = docs.select(F.col("item_id").alias("target_id"), F.col("tokens").alias("target_tokens"))
    return asked.join(target, "target_id").select("query_id", "target_id", F.round(jaccard_distinct(F.col("query_tokens"), F.col("target_tokens")), 9).alias("jaccard"))


def overlap_and_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = strata.wide_metric(rounded(quality(spark, sf_dir)), METHODS)
    return strata.query_jaccard(pairs(spark, sf_dir)).withColumn("jaccard", F.round("jaccard", 9)).join(wide, "query_id")


@query
def jaccard_pairs(spark, sf_dir):
    return pairs(spark, sf_dir)


@query
def jaccard_shares(spark, sf_dir):
    return rounded(strata.extremes(pairs(spark, sf_dir), "jaccard", 5, "query_id").groupBy("side").agg(F.count("*").alias("n"), F.sum("jaccard").alias("jaccard_sum")))


@query
def overlap_shares(spark, sf_dir):
    return rounded(corpus.shares(pairs(spark, sf_dir).withColumn("side", F.when(F.col("target_id") == F.col("query_id") + 1, "next").otherwise("second")), "jaccard", "side", 0.1))


@query
def nearest_extremes(spark, sf_dir):
    return strata.extremes(pairs(spark, sf_dir).withColumn("pair", 2 * F.col("query_id") + F.col("target_id") - F.col("query_id")), "jaccard", 5, "pair").drop("pair")


@query
def jaccard_median_split(spark, sf_dir):
    split = strata.median_split(overlap_and_quality(spark, sf_dir))
    return rounded(strata.split_summary(split, METHODS, ("dense", "dense_half")), 9)


@query
def median_split_verdict(spark, sf_dir):
    split = strata.median_split(overlap_and_quality(spark, sf_dir))
    return strata.verdict(strata.split_summary(split, METHODS, ("dense", "dense_half")))


@query
def jaccard_quartiles(spark, sf_dir):
    rows = rounded(quality(spark, sf_dir)).select("query_id", "method", "map").join(strata.query_jaccard(pairs(spark, sf_dir)).withColumn("jaccard", F.round("jaccard", 9)), "query_id")
    binned = strata.quantile_bins(rows, "jaccard").withColumn("bin", F.col("bin").cast("long"))
    return rounded(binned.groupBy("bin", "method").agg(F.count("*").alias("n"), F.min("jaccard").alias("low"), F.max("jaccard").alias("high"), F.avg("map").alias("map")), 9)


@query
def spearman_jaccard_adv(spark, sf_dir):
    rows = overlap_and_quality(spark, sf_dir).withColumn("advantage", F.round(F.col("dense") - F.col("dense_half"), 6))
    return rounded(strata.spearman(rows, "jaccard", "advantage"))


def halves(spark: SparkSession, sf_dir: str) -> DataFrame:
    return strata.median_split(strata.query_jaccard(pairs(spark, sf_dir)).withColumn("jaccard", F.round("jaccard", 9))).select("query_id", "half")


@query
def ndcg_by_half(spark, sf_dir):
    ranked = rankings(spark, sf_dir)
    rows = metrics.ndcg(ranked, judged(spark, sf_dir, ranked), relevant=relevant(spark, sf_dir)).join(halves(spark, sf_dir), "query_id")
    return rounded(rows.groupBy("half", "method").agg(F.count("*").alias("n"), F.avg("ndcg_at_10").alias("ndcg_at_10"), F.avg("ndcg_at_100").alias("ndcg_at_100")), 9)


@query
def pr_by_half(spark, sf_dir):
    ranked = rankings(spark, sf_dir)
    return rounded(strata.pooled_curves(ranked, judged(spark, sf_dir, ranked), halves(spark, sf_dir), relevant(spark, sf_dir)), 9)


@query
def length_ecdf(spark, sf_dir):
    return rounded(strata.ecdf(table(spark, sf_dir, "documents"), "n_chars"), 9)


@query
def length_histogram(spark, sf_dir):
    return strata.histogram(table(spark, sf_dir, "documents"), "n_chars", 40)


@query
def length_box(spark, sf_dir):
    return rounded(strata.box(table(spark, sf_dir, "documents"), "n_chars", ["lang"]))


# --- texts and corpora


def written(df: DataFrame, key: str) -> DataFrame:
    """Texts with a way of writing that they lack behind each."""
    return df.withColumn("text", F.concat("text", F.lit(" "), F.get(F.array(*map(F.lit, VARIANTS)), (F.col(key) % len(VARIANTS)).cast("int"))))


@query
def normalize_text(spark, sf_dir):
    made = written(documents(spark, sf_dir), "item_id").select("item_id", normalize(F.col("text")).alias("t"))
    return made.select("item_id", F.sha2("t", 256).alias("normalized_sha256"), F.length("t").cast("long").alias("normalized_chars"))


@query
def normalize_steps(spark, sf_dir):
    report = written(benchmark(spark, sf_dir), "query_id").select("query_id", F.explode(normalize_report(F.col("text"))["changes"]).alias("c"))
    return report.select("query_id", "c.step", "c.before", "c.after")


@query
def stopword_multiset_diff(spark, sf_dir):
    at = [name for name, _ in STEPS].index("remove_stopwords")
    shared = documents(spark, sf_dir).select("item_id", normalize(F.col("text"), STEPS[:at]).alias("t"))  # made once for both
    both = shared.select("item_id", normalize(F.col("t"), STEPS[at + 1 :]).alias("before"), normalize(F.col("t"), STEPS[at:]).alias("after"))
    return text.removed_tokens_table(both, "item_id").select("item_id", F.size("removed").cast("long").alias("n_removed"), F.array_join("removed", " ").alias("removed"))


@query
def punctuated_tokens(spark, sf_dir):
    tokens = punctuated(F.col("text"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.size(tokens).cast("long").alias("n_tokens"), F.size(F.array_distinct(tokens)).cast("long").alias("n_distinct"))


@query
def topic_preprocess(spark, sf_dir):
    return documents(spark, sf_dir).select("item_id", F.sha2(preprocess_topics(F.col("text")), 256).alias("kept_sha256"))


@query
def length_stats(spark, sf_dir):
    return rounded(corpus.length_stats(table(spark, sf_dir, "documents"), simple_tokens, "lang", short=300))


@query
def vocab_overlap(spark, sf_dir):
    return rounded(corpus.vocabulary_overlap(table(spark, sf_dir, "documents"), simple_tokens, "lang", "en", "fr"))


@query
def corpus_dedup_union(spark, sf_dir):
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("code"), F.concat_ws(" ", F.when(F.col("p_partkey") % 4 < 2, F.upper("p_name")).otherwise(F.col("p_name")), "p_brand").alias("text"), F.col("p_partkey").alias("pos"))
    codes = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("code_left", "code_right")]  # as they are written
    return corpus.combine(parts.where("code % 2 = 0"), parts.where("code % 2 = 1")).select("description", *codes, "source")


def correlations(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines, parts, suppliers = (table(spark, sf_dir, n) for n in ("lineitem", "part", "supplier"))
    return lines.select("l_partkey", "l_suppkey").join(parts, F.col("l_partkey") == F.col("p_partkey")).join(suppliers, F.col("l_suppkey") == F.col("s_suppkey")).select(F.col("l_partkey").alias("ID_Prod"), F.col("p_name").alias("Prod_Desc"), F.col("l_suppkey").alias("ID_Itm"), F.col("s_name").alias("Itm_Desc"))


@query
def qrels_grouping(spark, sf_dir):
    return corpus.group_correlations(correlations(spark, sf_dir)).select(F.col("ID_Prod").alias("product_id"), F.col("Prod_Desc").alias("product_description"), "original_description", F.array_join("relevant_item_ids", ",").alias("relevant_item_ids"))


@query
def unique_item_corpus(spark, sf_dir):
    return corpus.unique_items(correlations(spark, sf_dir).select(F.col("ID_Itm").alias("item_id"), F.col("Itm_Desc").alias("text")))


@query
def different_correlations(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select("p_partkey", "p_name", F.when(F.col("p_size") % 2 == 0, F.col("p_name")).otherwise(F.upper("p_name")).alias("other"))
    return corpus.different_pairs(rows, "p_name", "other")


@query
def first_n_codes(spark, sf_dir):
    return corpus.first_codes(table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("codigo"), F.col("o_orderkey").alias("pos"), "o_orderstatus"), most=100)


# --- topics


def topic_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("item_id"), F.col("source").alias("topic"), "text")


@query
def topic_distribution(spark, sf_dir):
    return rounded(topics.distribution(topic_texts(spark, sf_dir)))


@query
def largest_topics(spark, sf_dir):
    return rounded(topics.largest(topics.distribution(topic_texts(spark, sf_dir)), 3))


@query
def long_enough_texts(spark, sf_dir):
    """Turns that say something once their stopwords and numbers are gone."""
    return topics.long_enough(table(spark, sf_dir, "conversations"), least=100).select("conv_id", "turn")


@query
def ctfidf_terms(spark, sf_dir):
    return topics.class_tfidf(topic_texts(spark, sf_dir), simple_tokens)


@query
def topic_info(spark, sf_dir):
    texts = topic_texts(spark, sf_dir)
    return topics.topic_info(texts, topics.class_tfidf(texts, simple_tokens))


@query
def ngram_vocab(spark, sf_dir):
    return topics.vocabulary(documents(spark, sf_dir), simple_text, split=simple_split)


def by_topic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents are dealt to six topics by number, and so are the queries that share their numbers."""
    dealt = documents(spark, sf_dir).select("item_id", F.pmod(F.floor(F.col("item_id") / 20), F.lit(6)).cast("int").alias("topic"))
    asked = topics.attach(vectors(spark, sf_dir)[0].select("query_id", F.col("query_id").alias("target")), dealt, "target")
    return topics.quality_by_topic(rounded(quality(spark, sf_dir)), asked.select("query_id", "topic"), METHODS, least=2)


@query
def query_topics(spark, sf_dir):
    """Each query's topic by the first of its relevant items."""
    known = topic_texts(spark, sf_dir).select("item_id", F.regexp_extract("topic", r"(\d+)", 1).cast("int").alias("topic"))
    queries, items = vectors(spark, sf_dir)
    firsts = items.groupBy("label").agg(F.array(F.min("item_id")).alias("relevant_item_ids"))  # the rest of a query's items say nothing here
    bench = queries.select("query_id", "label").join(firsts, "label").withColumn("codigo", F.col("query_id"))
    return topics.query_topics(bench, known)


@query
def topic_map_ranked(spark, sf_dir):
    return rounded(by_topic(spark, sf_dir), 9)


@query
def best_worst_topics(spark, sf_dir):
    return rounded(topics.best_and_worst(rounded(by_topic(spark, sf_dir), 9), "mean_quality", 3).select("topic", "n_queries", "mean_quality"), 9)


@query
def topic_clusters(spark, sf_dir):
    """Clusters of vectors; iterative, so without SQL."""
    return topics.cluster(table(spark, sf_dir, "embeddings"), 10, outlier_share=0.05).select("vec_id", "topic")
