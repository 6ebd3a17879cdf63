"""Queries over the given tables, one per operator, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.llm import bpe, decision_rules, importance, license_index, line_dedup, link_trust, packing, prefix_trie, rabitq, simhash, token_counts, warc, whitening
from strandlake.llm.common import table

PIECE_MODEL = "piece_bpe_32k.model"
WORD_VOCAB = "word_bpe_49k.json"


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_length_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return packing.pack(docs, packing.word_length(F.col("text")), buckets=16, budget=65_536)


def op2_warc_bundles(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = warc.round_trip(table(spark, sf_dir, "pages"), min_bytes=0)
    return read.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op3_one_bit_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rabitq.nearest(table(spark, sf_dir, "embeddings"), every=20, k=20)


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return token_counts.count_tokens(docs, tokenizer_file(PIECE_MODEL), limit=4096)


def op5_quality_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return bpe.encoding_digest(docs, tokenizer_file(WORD_VOCAB))


def op7_simhash_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"), shingle=4, seed=42, radius=4)


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return decision_rules.judge(docs, decision_rules.learn(docs, table(spark, sf_dir, "labels")))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.report(table(spark, sf_dir, "documents"))


def op10_url_trust(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = link_trust.judge(table(spark, sf_dir, "pages"), link_trust.RULES)
    return found.select("page_id", "host", "path", "rule", "verdict")


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.prefix_trie(table(spark, sf_dir, "conversations"))


def op12_license_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_index.scan(table(spark, sf_dir, "documents"))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_length_buckets": op1_length_buckets,
    "op2_warc_bundles": op2_warc_bundles,
    "op3_one_bit_neighbours": op3_one_bit_neighbours,
    "op4_token_counts": op4_token_counts,
    "op5_quality_resampling": op5_quality_resampling,
    "op6_bpe_round_trip": op6_bpe_round_trip,
    "op7_simhash_components": op7_simhash_components,
    "op8_quality_rules": op8_quality_rules,
    "op9_line_dedup": op9_line_dedup,
    "op10_url_trust": op10_url_trust,
    "op11_prefix_trie": op11_prefix_trie,
    "op12_license_index": op12_license_index,
    "op13_whitening": op13_whitening,
}

ORACLE_SQL: dict[str, str] = {}
