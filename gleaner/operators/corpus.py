"""Consolidation of corpora and queries, and statistics of texts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.functions.normalize import clean_upper, single_blanks
from gleaner.operators.lineage import checkpoint
from gleaner.operators.ranges import quantiles, same


def combine(left: DataFrame, right: DataFrame, names: tuple[str, str] = ("left", "right")) -> DataFrame:
    """Union of two corpora (code, text, pos) by their clean text: description, code_left, code_right, source.

    The first text by position, the left corpus before the right, gives the description; the first code of each stays.
    """
    rows = left.select("code", "text", "pos", F.lit(0).alias("side")).unionByName(right.select("code", "text", "pos", F.lit(1).alias("side")))
    code = lambda side: F.min_by(F.when(F.col("side") == side, F.col("code")), F.when(F.col("side") == side, F.col("pos")))
    out = rows.groupBy(clean_upper(F.col("text")).alias("key")).agg(F.trim(F.min_by("text", F.struct("side", "pos"))).alias("description"), code(0).alias("code_left"), code(1).alias("code_right"))
    source = F.when(F.col("code_left").isNotNull() & F.col("code_right").isNotNull(), "both").when(F.col("code_left").isNotNull(), names[0]).otherwise(names[1])
    return out.select("description", "code_left", "code_right", source.alias("source"))


def combined_queries(correlations: DataFrame, benchmark: DataFrame, names: tuple[str, str] = ("left", "right")) -> DataFrame:
    """One schema for both query sets: source, query_id, query_text, target_text, target_id."""
    clean = lambda c: single_blanks(F.coalesce(F.col(c), F.lit("")))
    a = correlations.select(F.lit(names[0]).alias("source"), F.col("ID_Prod").alias("query_id"), clean("Prod_Desc").alias("query_text"), clean("Itm_Desc").alias("target_text"), F.col("ID_Itm").alias("target_id"))
    b = benchmark.select(F.lit(names[1]).alias("source"), F.col("mutation_id").alias("query_id"), clean("product_description").alias("query_text"), clean("original_description").alias("target_text"), F.col("codigo").alias("target_id"))
    return a.unionByName(b)


def group_correlations(correlations: DataFrame) -> DataFrame:
    """One row for each product: sorted relevant items, and the text of the least of them."""
    return correlations.groupBy("ID_Prod", "Prod_Desc").agg(F.array_sort(F.collect_set("ID_Itm")).alias("relevant_item_ids"), F.min_by("Itm_Desc", "ID_Itm").alias("original_description"))


def unique_items(rows: DataFrame, key: str = "item_id", text: str = "text") -> DataFrame:
    """One row for each id; an id with several texts ends the job with an error that names it."""
    out = rows.groupBy(key).agg(F.min(text).alias(text), F.count_distinct(text).alias("_n"))
    bad = F.raise_error(F.concat(F.lit("several texts for one id: "), F.col(key).cast("string")))
    return out.withColumn(text, F.when(F.col("_n") <= 1, F.col(text)).otherwise(bad)).drop("_n")


def different_pairs(rows: DataFrame, a: str, b: str) -> DataFrame:
    """Rows whose raw texts differ literally, before any cleaning."""
    return rows.where(F.col(a) != F.col(b))


def first_codes(rows: DataFrame, most: int | None = None, codes: list[int] | None = None, code: str = "codigo", pos: str = "pos") -> DataFrame:
    """Rows with one of `codes`, if given; then those of the first `most` distinct codes in order of position."""
    chosen = rows.where(F.col(code).isin(codes)) if codes else rows
    if not most:
        return chosen
    first = chosen.where(F.col(code).isNotNull()).groupBy(code).agg(F.min(pos).alias("_p")).orderBy("_p").limit(most).select(code)
    return chosen.join(F.broadcast(first) if most <= 100_000 else first, code, "left_semi")


def length_stats(texts: DataFrame, tokenizer: Callable[[Column], Column], by: str, short: int = 30) -> DataFrame:
    """Number, lengths in tokens and characters, and share of short texts, by group."""
    rows = checkpoint(texts.select(by, F.length("text").alias("chars"), F.size(tokenizer(F.col("text"))).alias("tokens")))
    out = rows.groupBy(by).agg(F.count("*").alias("docs"), F.sum("tokens").cast("long").alias("sum"), F.avg("chars").alias("mean_chars"), F.avg("tokens").alias("mean_tokens"), (100 * F.avg((F.col("chars") <= short).cast("double"))).alias("short_pct"))
    for c in ("chars", "tokens"):
        out = same(out, quantiles(rows, c, [0.5], [by]).select(by, F.col("q")[0].alias(f"median_{c}")), [by])
    return out.select(by, "docs", F.col("sum").alias("tokens"), "mean_chars", "median_chars", "mean_tokens", "median_tokens", "short_pct")


def vocabulary_overlap(texts: DataFrame, tokenizer: Callable[[Column], Column], by: str, a: str, b: str) -> DataFrame:
    """Sizes of two groups' vocabularies, of what they share and of their union, and the overlap in percent."""
    words = texts.where(F.col(by).isin(a, b)).select(by, F.explode(F.array_distinct(tokenizer(F.col("text")))).alias("token"))
    sides = words.groupBy("token").agg(F.max((F.col(by) == a).cast("int")).alias("in_a"), F.max((F.col(by) == b).cast("int")).alias("in_b"))
    n = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    out = sides.agg(n(F.col("in_a")).alias("vocab_a"), n(F.col("in_b")).alias("vocab_b"), n(F.col("in_a") * F.col("in_b")).alias("shared"), F.count("*").alias("united"))
    return out.withColumn("overlap_pct", F.coalesce(100 * F.col("shared") / F.nullif(F.col("united"), F.lit(0)), F.lit(0.0)))


def shares(df: DataFrame, value: str, by: str, high: float = 0.8) -> DataFrame:
    """Share of zeros and of high values, by group."""
    return df.groupBy(by).agg(F.count("*").alias("n"), F.avg((F.col(value) == 0).cast("double")).alias("share_zero"), F.avg((F.col(value) >= high).cast("double")).alias("share_high"))
