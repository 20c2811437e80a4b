"""The corpus pipeline: quality filter, near-duplicate removal, PII redaction, packing.

Each stage takes (spark, docs, sf_dir), works on all rows that its predecessor kept, and returns the columns of
documents; the last returns the pieces of the packed sequences. Stages are written as Parquet and read again in between.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from synthframe.llm.ngram_join import ngram_jaccard_join
from synthframe.llm.packing import best_fit_packing
from synthframe.llm.pii import redact_pii
from synthframe.llm.quality import keep_good
from synthframe.llm.word_tokens import vocabulary
from synthframe.session import cut


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier doesn't reject; it learns from the labelled documents of sf_dir.

    Null and empty texts get one score and stay or go together; repeated rows too; an empty table stays empty."""
    return keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays: that with the smallest doc_id.

    Five-word n-grams, a similarity of 0.8. Documents without a doc_id can't be told apart and all stay; rows that repeat
    the doc_id which stays all stay."""
    joined = ngram_jaccard_join(docs, n=5, percent=80)
    gone = joined.where("component_id <> doc_id").select(F.col("doc_id").alias("gone_id")).distinct()
    return docs.join(gone, docs["doc_id"] == gone["gone_id"], "left_anti")


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with personal data replaced by its kind. Null texts stay null, empty ones empty; every row stays."""
    return redact_pii(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 4096 tokens in their sequences. A null or empty text is one piece of the end token alone; repeated
    rows and rows without a doc_id are documents of their own; an empty table gives no pieces."""
    return best_fit_packing(docs, vocabulary("word_bpe_49k.json"), 4096, 1)


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("pii", pii), ("packing", packing)]
#: SQL can express neither the classifier nor the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = cut(docs, f"pipeline-{name}")
    return docs
