"""Readers of catalogues, benchmarks, correlations, results and candidate dumps.

Schemas are fixed and checked on read. Ids that are no whole numbers become null and their rows go, as do blank texts.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.functions.normalize import single_blanks
from gleaner.functions.tokens import safe_id

ENCODINGS = ("utf-8", "windows-1252", "iso-8859-1")

C1 = "".join(c for c in map(chr, range(0x80, 0xA0)) if bytes([ord(c)]).decode("cp1252", "ignore"))
C1_WINDOWS = "".join(bytes([ord(c)]).decode("cp1252") for c in C1)

MUTATION = "struct<mut_ID:string,descricao_mutada:string,relevant_item_ids:array<string>>"
BENCHMARK = f"items array<struct<codigo:string,descricao_original:string,lf:string,note:string,mutations:array<{MUTATION}>>>, labeling_functions map<string,string>"
CORRELATION = ("ID_Sup", "ID_Prod", "Prod_Desc", "ID_Itm", "Itm_Desc")
CANDIDATE = "struct<item_id:bigint,evaluation_item_id:bigint,description:string,description_norm:string,supplier_id:bigint,retrieval_score:double,retrieval_backend:string,retrieval_rank:int>"
CANDIDATES = f"run_id string, started_at string, product_id bigint, search_terms string, method string, relevant_item_ids array<bigint>, elapsed_ms double, candidates array<{CANDIDATE}>"
RESULTS = "results array<struct<product_id:bigint,method:string,success:boolean,map:double,elapsed_ms:double>>"
CURVES = "precision_recall array<struct<method:string,recall:double,precision:double,threshold:double>>"


def require(df: DataFrame, columns: Sequence[str], what: str) -> DataFrame:
    if missing := sorted(set(columns) - set(df.columns)):
        raise ValueError(f"{what}: missing columns {', '.join(missing)}")
    return df


def read_tsv(spark: SparkSession, path: str, columns: Sequence[str] = (), encoding: str = "utf-8") -> DataFrame:
    """A tab-separated file with a header, all columns text, null as ''."""
    latin = encoding.lower() in ("windows-1252", "cp1252", "iso-8859-1", "latin-1")
    df = spark.read.csv(path, sep="\t", header=True, quote='"', escape='"', encoding="ISO-8859-1" if latin else encoding)
    df = df.toDF(*[c.lstrip("\ufeff") for c in df.columns])
    if encoding.lower() in ("windows-1252", "cp1252"):  # differs from ISO-8859-1 in 0x80 to 0x9F only
        df = df.select(*[F.translate(c, C1, C1_WINDOWS).alias(c) for c in df.columns])
    return require(df, columns, path).fillna("")


def detect_encoding(spark: SparkSession, path: str, encodings: Sequence[str] = ENCODINGS) -> str:
    """UTF-8 if every line is valid in it, else the first one-byte encoding that has a character for every byte."""
    lines = spark.read.text(path)
    if not lines.where(~F.is_valid_utf8("value")).limit(1).count():
        return encodings[0]
    missing = "".join(f"{b:02X}" for b in range(0x80, 0xA0) if not bytes([b]).decode("cp1252", "ignore"))
    # In pairs of hexadecimal digits: a byte that Windows-1252 has no character for.
    pairs = "|".join(missing[i : i + 2] for i in range(0, len(missing), 2))
    unknown = lines.where(F.hex(F.col("value").cast("binary")).rlike(f"^(?:..)*(?:{pairs})")).limit(1).count()
    return encodings[2] if unknown else encodings[1]


def read_items(spark: SparkSession, path: str, encoding: str | None = None) -> DataFrame:
    """Catalogue (item_id, description, supplier_id) from `codigo` and `descricao`; ValueError if no row is usable."""
    df = read_tsv(spark, path, ("codigo", "descricao"), encoding or detect_encoding(spark, path))
    items = df.select(safe_id(F.col("codigo")).alias("item_id"), F.trim("descricao").alias("description"), F.lit(None).cast("bigint").alias("supplier_id"))
    items = items.where("item_id is not null and description <> ''")
    if items.isEmpty():
        raise ValueError(f"{path}: no usable item")
    return items


def relevant_ids(raw: Column, code: Column) -> Column:
    """Distinct whole numbers in order; the entry's code where the list is missing."""
    ids = F.filter(F.transform(raw, safe_id), lambda x: x.isNotNull())
    return F.array_sort(F.array_distinct(F.coalesce(ids, F.array(code))))


def flatten_benchmark(nested: DataFrame) -> DataFrame:
    """Queries of a benchmark (`items` as in BENCHMARK): product_id, mutation_id, codigo, texts, relevant_item_ids, pos.

    Mutations without a number, text or relevant item are skipped; an entry without code or text ends the job.
    """
    entry = nested.select(F.posexplode("items").alias("entry", "e"))
    code, text = safe_id(F.col("e.codigo")), F.trim(F.coalesce(F.col("e.descricao_original"), F.lit("")))
    fail = lambda what: F.raise_error(F.concat(F.lit(f"{what} at entry "), F.col("entry").cast("string")))
    entry = entry.select("entry", F.when(code.isNotNull(), code).otherwise(fail("no code")).alias("codigo"), F.when(text != "", text).otherwise(fail("no text")).alias("original_description"), "e.mutations")
    m = entry.select("entry", "codigo", "original_description", F.posexplode("mutations").alias("pos_in_entry", "m"))
    number = safe_id(F.col("m.mut_ID"))
    out = m.select(number.alias("product_id"), number.alias("mutation_id"), "codigo", F.trim("m.descricao_mutada").alias("product_description"), "original_description", relevant_ids(F.col("m.relevant_item_ids"), F.col("codigo")).alias("relevant_item_ids"), (F.col("entry").cast("long") * 1_000_000 + F.col("pos_in_entry")).alias("pos"))
    return out.where("mutation_id is not null and product_description <> '' and size(relevant_item_ids) > 0")


def documents_of(spark: SparkSession, path: str, schema: str, field: str) -> DataFrame:
    """JSON documents that hold the field: a document a line, as the writers write them, or one a file."""
    lines = spark.read.schema(schema).json(path)
    if not lines.where(F.col(field).isNotNull()).limit(1).count():
        lines = spark.read.schema(schema).json(path, multiLine=True, encoding="utf-8")
    return lines.where(F.col(field).isNotNull())


def read_benchmark(spark: SparkSession, path: str) -> DataFrame:
    """Queries of a benchmark; `pos` orders those of one document."""
    out = flatten_benchmark(documents_of(spark, path, BENCHMARK, "items"))
    if out.isEmpty():
        raise ValueError(f"{path}: no usable query")
    return out


def read_correlations(spark: SparkSession, path: str, supplier: int = 295) -> DataFrame:
    """Quoted rows of one supplier with whole ids; `different` compares the raw texts, which then are cleaned."""
    df = read_tsv(spark, path, CORRELATION)
    ids = {c: safe_id(F.col(c)) for c in ("ID_Sup", "ID_Prod", "ID_Itm")}
    fail = F.raise_error(F.concat_ws(" ", F.lit("bad ids:"), *ids))
    good = (ids["ID_Sup"] == supplier) & ids["ID_Prod"].isNotNull() & ids["ID_Itm"].isNotNull()
    return df.select(
        F.when(good, ids["ID_Sup"]).otherwise(fail).alias("ID_Sup"), ids["ID_Prod"].alias("ID_Prod"), single_blanks(F.col("Prod_Desc")).alias("Prod_Desc"),
        ids["ID_Itm"].alias("ID_Itm"), single_blanks(F.col("Itm_Desc")).alias("Itm_Desc"), (F.col("Prod_Desc") != F.col("Itm_Desc")).alias("different"),
    )


def read_results(spark: SparkSession, path: str, methods: Sequence[str] | None = None, successful_only: bool = True) -> DataFrame:
    """(query_id, method, map) of the result rows of a run."""
    rows = documents_of(spark, path, RESULTS, "results").select(F.explode("results").alias("r")).select("r.*")
    if methods:
        rows = rows.where(F.col("method").isin(list(methods)))
    if successful_only:
        rows = rows.where("success")
    return rows.select(F.col("product_id").alias("query_id"), "method", "map")


def read_candidates(spark: SparkSession, path: str, evaluation_ids: bool = False) -> tuple[DataFrame, DataFrame]:
    """Rankings (query_id, method, rank, item_id, score) and judgements (query_id, item_id) of a candidate dump.

    With evaluation_ids the item is evaluation_item_id, null where that is null.
    """
    rows = spark.read.schema(CANDIDATES).json(path)
    item = F.col("c.evaluation_item_id" if evaluation_ids else "c.item_id")
    ranked = rows.select(F.col("product_id").alias("query_id"), "method", F.posexplode("candidates").alias("p", "c")).select("query_id", "method", (F.col("p") + 1).cast("long").alias("rank"), item.alias("item_id"), F.col("c.retrieval_score").alias("score"))
    qrels = rows.select(F.col("product_id").alias("query_id"), F.explode("relevant_item_ids").alias("item_id")).distinct()
    return ranked, qrels


def read_halves(spark: SparkSession, path: str) -> DataFrame:
    df = read_tsv(spark, path, ("source", "query_id", "half"))
    return df.select("source", safe_id(F.col("query_id")).alias("query_id"), "half")


def read_curves(spark: SparkSession, path: str) -> DataFrame:
    out = documents_of(spark, path, CURVES, "precision_recall").select(F.explode("precision_recall").alias("p")).select("p.*")
    if out.isEmpty():
        raise ValueError(f"{path}: no curve")
    return out


def cached_embeddings(spark: SparkSession, path: str, texts: DataFrame, model: str, mode: str, encode) -> DataFrame:
    """Embeddings (item_id, embedding) of `texts` (item_id, text): those stored under the same model, mode and text; the rest by `encode`, and stored."""
    keyed = texts.withColumn("key", F.sha2(F.concat_ws("\x1f", F.lit(model), F.lit(mode), "text"), 256))
    try:
        known = spark.read.schema("key string, embedding array<float>").parquet(path)
    except AnalysisException:
        known = spark.createDataFrame([], "key string, embedding array<float>")
    missing = keyed.join(known, "key", "left_anti").dropDuplicates(["key"])
    if not missing.isEmpty():
        encode(missing).select("key", "embedding").write.mode("append").parquet(path)
    return keyed.join(spark.read.parquet(path).dropDuplicates(["key"]), "key").select("item_id", "embedding")
