"""Writers of candidates, metrics, curves, corpora and reports. Each writes a folder in the usual way of Spark."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gleaner.operators.sizes import broadcast_if_small
from gleaner.sources.readers import CORRELATION


def round_floats(df: DataFrame, digits: int = 6) -> DataFrame:
    """All doubles and floats rounded, ties to even, in structs and arrays too."""

    def rounded(c: Column, kind: T.DataType) -> Column:
        if isinstance(kind, (T.DoubleType, T.FloatType)):
            return F.bround(c, digits)
        if isinstance(kind, T.ArrayType):
            return F.transform(c, lambda x: rounded(x, kind.elementType))
        if isinstance(kind, T.StructType):
            return F.when(c.isNotNull(), F.struct(*[rounded(c[f.name], f.dataType).alias(f.name) for f in kind.fields]))
        return c

    return df.select(*[rounded(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in df.schema.fields])


def candidate_rows(ranked: DataFrame, queries: DataFrame, qrels: DataFrame | None, outcomes: DataFrame | None = None, relevant: DataFrame | None = None) -> DataFrame:
    """One row for each successful query and method, its candidates in the order of their ranks from 1.

    relevant: (label, relevant_item_ids), lists that queries name by their `label`, in place of qrels: a list that many
    queries share is then made once, and the pairs of queries and items never are.
    """
    items = F.transform(F.array_sort(F.collect_list(F.struct(F.col("rank").cast("int").alias("retrieval_rank"), "item_id", F.col("score").alias("retrieval_score")))), lambda x: x)
    lists = ranked.groupBy("query_id", "method").agg(items.alias("candidates"))
    by = "query_id" if relevant is None else "label"
    if relevant is None:
        relevant = qrels.groupBy("query_id").agg(F.array_sort(F.collect_set("item_id")).alias("relevant_item_ids"))
    else:
        relevant = broadcast_if_small(relevant, size=F.size("relevant_item_ids"))
    asked = queries.select(*dict.fromkeys(("query_id", by)), F.col("text").alias("search_terms"))
    out = lists.join(asked, "query_id").join(relevant.select(by, "relevant_item_ids"), by, "left").drop("label")
    if outcomes is not None:
        out = out.join(outcomes.where("success").select("query_id", "method", "elapsed_ms"), ["query_id", "method"])
    return out.withColumn("relevant_item_ids", F.coalesce("relevant_item_ids", F.array().cast("array<bigint>"))).withColumnRenamed("query_id", "product_id")


def write_candidates(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)


def append_metrics(df: DataFrame, path: str) -> None:
    """Semicolon CSV with a header: added to what is there if the columns agree, else in its place."""
    try:
        same = df.sparkSession.read.csv(path, sep=";", header=True).columns == df.columns
    except AnalysisException:
        same = False
    df.write.mode("append" if same else "overwrite").csv(path, sep=";", header=True)


def formatted(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles as fixed-point text; null as ''."""
    return df.select(*[F.coalesce(F.format_string(f"%.{digits}f", F.col(f.name)), F.lit("")).alias(f.name) if isinstance(f.dataType, T.DoubleType) else F.col(f.name) for f in df.schema.fields])


def write_curve(df: DataFrame, path: str, digits: int = 6) -> None:
    formatted(df, digits).write.mode("overwrite").csv(path, sep=";", header=True)


def write_tsv(df: DataFrame, path: str, quote_all: bool = False, order: Sequence[str] = (), line_end: str = "\r\n") -> None:
    (df.orderBy(*order) if order else df).write.mode("overwrite").csv(path, sep="\t", header=True, quoteAll=quote_all, escape="\"", emptyValue="", nullValue="", lineSep=line_end)


def write_different(rows: DataFrame, path: str) -> None:
    """Correlations whose texts differ (see readers.read_correlations), all values quoted."""
    write_tsv(rows.where("different").select(*CORRELATION), path, quote_all=True)


def write_items(items: DataFrame, path: str) -> None:
    """Catalogue (item_id, text) by rising id."""
    write_tsv(items.select(F.col("item_id").alias("codigo"), F.col("text").alias("descricao")), path, order=("codigo",))


def in_documents(rows: DataFrame, field: str, order: Sequence[str] = (), most: int = 1000) -> DataFrame:
    """Rows as elements of an array `field`, in documents of about `most` elements, so that no document holds all."""
    documents = max(1, -(-rows.count() // most))
    element = F.struct(*rows.columns)
    dealt = rows.withColumn("_d", F.pmod(F.xxhash64(F.to_json(element)), F.lit(documents)))
    listed = F.array_sort(F.collect_list(F.struct(*order, element.alias("_e"))))
    return dealt.groupBy("_d").agg(F.transform(listed, lambda x: x["_e"]).alias(field)).drop("_d")


def write_benchmark(grouped: DataFrame, path: str) -> None:
    """Grouped correlations as benchmark documents `{"items": [entries]}`, one a line, as readers.read_benchmark reads them."""
    mutation = F.struct(F.col("ID_Prod").alias("mut_ID"), F.col("Prod_Desc").alias("descricao_mutada"), "relevant_item_ids")
    entries = grouped.select(F.col("ID_Prod").alias("codigo"), F.col("original_description").alias("descricao_original"), F.array(mutation).alias("mutations"))
    in_documents(entries, "items", order=("codigo",)).write.mode("overwrite").json(path)


def write_results(path: str, results: DataFrame | None = None, curves: DataFrame | None = None, **tables: DataFrame) -> None:
    """Tables as JSON in folders below `path`, doubles rounded to six digits.

    `results` (query_id, method, success, map, ...) and `curves` (method, recall, precision, threshold) are documents
    `{"results": [...]}` and `{"precision_recall": [...]}`, as readers.read_results and read_curves read them; further
    tables have a row a line.
    """
    if results is not None:
        in_documents(round_floats(results.withColumnRenamed("query_id", "product_id")), "results", order=("product_id", "method")).write.mode("overwrite").json(f"{path}/results")
    if curves is not None:
        in_documents(round_floats(curves), "precision_recall", order=("method", "recall")).write.mode("overwrite").json(f"{path}/curves")
    for name, df in tables.items():
        round_floats(df).write.mode("overwrite").json(f"{path}/{name}")


def markdown(df: DataFrame, title: str = "", digits: int = 4, most: int = 1000) -> str:
    """A report table of a small result; ValueError if it has more than `most` rows."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"a report has at most {most} rows")
    show = lambda v: "" if v is None else f"{v:.{digits}f}" if isinstance(v, float) else str(v).replace("|", "\\|")
    lines = [f"## {title}", ""] * bool(title) + ["| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
    return "\n".join([*lines, *("| " + " | ".join(map(show, r)) + " |" for r in rows)]) + "\n"
