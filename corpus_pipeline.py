"""A training corpus from documents in stages, each written as Parquet and read again by the next.

Every stage takes nulls in any column, empty and very long texts, repeated rows, empty tables and further columns, whatever
their names; all but the last give the columns of their input back. What such cases give:

* null text counts as empty. An empty or blank text is judged by the quality model like any other, has no near
  copies, repeats or secrets, and is packed as its final token.
* Rows that repeat an id: equal texts are copies, of which the near-duplicate stage keeps one; unlike texts are documents
  of their own there. Rows without an id are documents like others but never stand for a class with an id.
* Of ties in a class of near-duplicates the smallest id stays, of equal rows any.
* An empty table stays empty, a table without labels keeps all documents at the quality stage.
* Texts of any length go through whole.

The folders of the stages lie below spark.checkpoint.dir; each is removed when the next stage has been written. The last
holds the rows that `run` returns and stays.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.llm import minhash, packing, quality, secrets, suffixes
from gleaner.llm.common import rows_of_ids, table
from gleaner.operators.lineage import checkpoint, shared_folder
from gleaner.operators.sizes import broadcast_if_small

#: Keys of documents that have no id of their own begin here.
OWN_KEYS = 1 << 62


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score reaches the threshold."""
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    return docs.where(quality.score(F.col("text"), model) >= quality.THRESHOLD)


def keyed(docs: DataFrame, key: str) -> DataFrame:
    """Documents with a key: their id, or a number of their own if they have none or if unlike texts share it."""
    digest = F.md5(F.coalesce("text", F.lit("")).cast("binary"))
    unlike = checkpoint(docs.groupBy("doc_id").agg(F.min(digest).alias("a"), F.max(digest).alias("b")).where("a <> b or doc_id is null").select(F.col("doc_id").alias(f"{key}_of"), F.lit(True).alias(f"{key}_own")))
    if not unlike.limit(1).count():
        return docs.withColumn(key, F.col("doc_id").cast("long"))
    marked = docs.join(broadcast_if_small(unlike), F.col("doc_id").eqNullSafe(F.col(f"{key}_of")), "left")
    own = F.lit(OWN_KEYS) + F.monotonically_increasing_id()
    return checkpoint(marked.withColumn(key, F.when(F.col(f"{key}_own"), own).otherwise(F.col("doc_id").cast("long"))).drop(f"{key}_of", f"{key}_own"))


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near-duplicates the document with the smallest id."""
    key = next(name for name in map("key{}".format, range(len(docs.columns) + 1)) if not any(c.startswith(name) for c in docs.columns))
    rows = keyed(docs, key)
    kept = minhash.near_duplicates(rows, key=key).where("kept").select(key).distinct()
    return rows_of_ids(rows, kept, key, "text").drop(key)


def drop_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the bytes that repeat earlier strings; characters cut in two go as well."""
    left = suffixes.remove_repeats(docs, as_text=True, carry=[c for c in docs.columns if c not in ("text", "n_chars")])
    made = {"text": F.col("kept"), "n_chars": F.length("kept").cast("long")}
    return left.select(*(made.get(c, F.col("rest")[c]).alias(c) for c in docs.columns))


def hide_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with each secret replaced by a mask; n_chars follows the text."""
    return docs.withColumn("text", secrets.redacted(F.col("text"))).withColumn("n_chars", F.length("text").cast("long"))


def pack_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in windows of tokens."""
    return packing.pack(docs)


STAGES = [("quality classifier", keep_quality), ("near duplicates", keep_one_of_near_copies), ("repeated strings", drop_repeats), ("secret scans", hide_secrets), ("packing", pack_windows)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; returns the last one's rows."""
    folder, docs = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}", table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{i}")
        docs = spark.read.parquet(f"{folder}/{i}")
        if i:  # no later stage reads what came before
            before = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{i - 1}")
            before.getFileSystem(spark._jsc.hadoopConfiguration()).delete(before, True)
    return docs
