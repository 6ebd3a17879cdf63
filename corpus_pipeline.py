"""Corpus pipeline: quality rules, quality classifier, line dedup, SimHash near-dedup, packing.

Each stage takes (spark, docs, sf_dir) and works on all its predecessor kept;
``run`` writes a stage's rows as Parquet in the shared folder and reads them
again for the next.  All stages but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.llm import decision_rules, importance, line_dedup, packing, shingle_sets
from strandlake.llm.common import table, written


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the base rule or a learned rule covers."""
    rules = decision_rules.learn(docs, table(spark, sf_dir, "labels"))
    return decision_rules.keep_good(docs, rules)


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents that importance resampling draws."""
    return importance.keep_sampled(docs, table(spark, sf_dir, "labels"))


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes out lines that are similar to a line before them; every document stays."""
    return line_dedup.without_similar_lines(docs)


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of similar documents (five-word shingles, similarity 0.8)."""
    return shingle_sets.keep_one(docs, shingle=5, least=0.8)


def length_buckets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Deals the documents into padded batches."""
    return packing.pack(docs, packing.word_length(F.col("text")), buckets=16, budget=65_536)


STAGES = [
    ("quality_rules", quality_rules),
    ("quality_classifier", quality_classifier),
    ("line_dedup", line_dedup_stage),
    ("simhash_dedup", simhash_dedup),
    ("length_buckets", length_buckets),
]

#: SQL cannot express the learned rules, the resampling or the bucket search.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
