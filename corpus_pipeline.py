"""The corpus pipeline: quality classifier, near-duplicate removal, substring deduplication, decontamination, packing.

Every stage takes what the one before it kept, written as Parquet and read again, and returns the columns of the
documents; the last returns the pieces of the packed sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import cdc, decontam, near_copies, packing, qda
from tidemark.llm.common import small_batches, work_path
from tidemark.llm.tokens import vocabulary_path


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    small_batches(spark)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    rows = qda.measured(docs)
    model = qda.fit(rows, labels)
    return qda.keep(docs, model)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of exact or near copies stays (5-word shingles, Jaccard 0.8 or more)."""
    small_batches(spark)
    return near_copies.keep_one(docs)


def substring_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 words or more stay in their first document and are cut from the others."""
    small_batches(spark)
    cut = cdc.remove_passages(docs, cdc.repeated_passages(docs))
    return cut.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.char_length("text").cast("long")).otherwise(F.col("n_chars")))


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose texts hold a benchmark item go, whatever their doc_id is."""
    small_batches(spark)
    return decontam.remove(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, as pieces of sequences of 2048 tokens."""
    small_batches(spark)
    return packing.pack(docs, vocabulary_path("byte_bpe_50k.json"), end_id=0, capacity=2048)


STAGES = [
    ("quality classifier", quality_stage),
    ("near duplicates", near_duplicate_stage),
    ("substring dedup", substring_stage),
    ("decontamination", decontamination_stage),
    ("packing", packing_stage),
]

#: The stages are not expressible in SQL. Tests hold near duplicates and substring dedup against brute-force versions, packing
#: against its operator's, and run the others' operators on planted cases.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents; each stage's rows are a table in the shared folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        found = stage(spark, docs, sf_dir)
        if k == len(STAGES) - 1:
            return found
        path = work_path(spark, f"stage-{k}")
        found.write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
