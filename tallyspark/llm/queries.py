"""The numbered queries: each applies its operator to a whole table and returns its full result."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tallyspark.llm import (
    bm25_packing, common, conversation_repair, exact_dedup, language_id, mixing, near_dedup, prefix_trie, quality_crf, secret_scan, sharding,
    token_counts, topk_nra, warc,
)
from tallyspark.llm.oracle import ORACLE_SQL  # noqa: F401  (registered beside QUERIES)

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

PACKING_TOKENIZER, PACKING_END_ID = "word_bpe_49k.json", 2
COUNTING_TOKENIZER = "piece_bpe_32k.model"


def registered(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return common.table(spark, sf_dir, "documents")


@registered
def op1_topk_nra(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk_nra.top_k(common.table(spark, sf_dir, "embeddings"))


@registered
def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = warc.round_trip(spark, common.table(spark, sf_dir, "pages"), f"{common.scratch(spark)}/warc")
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@registered
def op3_quality_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_crf.score_quality(_documents(spark, sf_dir), common.table(spark, sf_dir, "labels"))


@registered
def op4_bm25_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bm25_packing.pack(_documents(spark, sf_dir), public_tokenizers.path(PACKING_TOKENIZER), PACKING_END_ID)


@registered
def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    cache = f"{common.scratch(spark)}/token-counts"
    return token_counts.count_tokens(_documents(spark, sf_dir), public_tokenizers.path(COUNTING_TOKENIZER), cache)


@registered
def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.find_secrets(_documents(spark, sf_dir))


@registered
def op7_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(_documents(spark, sf_dir))


@registered
def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(_documents(spark, sf_dir))


@registered
def op9_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(_documents(spark, sf_dir), shingle_words=4)


@registered
def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify_languages(_documents(spark, sf_dir))


@registered
def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_repair.audit_conversations(common.table(spark, sf_dir, "conversations"))


@registered
def op12_shard_shuffle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(_documents(spark, sf_dir))


@registered
def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.conversation_trie(common.table(spark, sf_dir, "conversations"))
