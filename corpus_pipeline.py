"""The training-data pipeline: stages over ``documents``, each written and read again.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame.  All but the last return the
columns of ``documents``.  A stage begins when the results of the one before it are written, so it
first deletes that stage's working tables.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelwright.llm import common, decontam, line_dedup, near_dup, packing, quality
from panelwright.llm.queries import vocabulary

SCOPE = "pipeline"


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    common.release(spark, SCOPE)
    with common.scope(SCOPE):
        return quality.keep_good(docs)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later repeated runs of three lines or of more than 50 words go; a document of nothing else goes as a whole.  n_chars follows the text."""
    common.release(spark, SCOPE)
    with common.scope(SCOPE):
        got = line_dedup.dedup_lines(docs, long_words=line_dedup.LONG_WORDS).filter("n_removed < n_lines OR n_removed = 0")
    length = F.when(F.col("n_removed") > 0, F.length("text")).otherwise(F.col("n_chars"))
    return got.withColumn("n_chars", length.cast(docs.schema["n_chars"].dataType)).select(docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays: that with the smallest doc_id, null last."""
    common.release(spark, SCOPE)
    with common.scope(SCOPE):
        keyed = docs.withColumn("_row", near_dup.row_id())
        kept = near_dup.near_duplicates(keyed.select(F.col("_row").alias("doc_id"), "text")).filter("kept").select(F.col("doc_id").alias("_row"))
    return keyed.join(kept, "_row", "left_semi").select(docs.columns)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain a benchmark item go."""
    common.release(spark, SCOPE)
    with common.scope(SCOPE):
        return decontam.drop_leaks(docs, common.read(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places of all pieces in sequences of 1024 tokens."""
    common.release(spark, SCOPE)
    with common.scope(SCOPE):
        return packing.pack_documents(docs, vocabulary("byte_bpe_50k.json"), end_id=2, with_ids=False)


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", dedup_lines),
    ("minhash_near_dedup", near_dedup),
    ("benchmark_decontamination", decontaminate),
    ("best_fit_packing", pack),
]

#: The quality stage's robust estimates and the tokenizer are beyond SQL; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written into the shared folder and read again."""
    docs = common.read(spark, sf_dir, "documents")
    base, last = f"{common.shared_dir(spark)}/pipeline-{uuid.uuid4().hex}", None
    for k, (name, stage) in enumerate(STAGES):
        path = f"{base}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if last:
            common.delete(spark, last)
        last = path
    common.release(spark, SCOPE)
    return docs
