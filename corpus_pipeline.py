"""A corpus from raw documents: language ID, exact and near dedup, mixing to weights, packing."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from tallyspark.llm import bm25_packing, common, exact_dedup, language_id, mixing, near_dedup
from tallyspark.sources import store

TOKENIZER, END_ID = "word_bpe_49k.json", 2


def _with_ids(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    ids = wanted.select(F.col("doc_id").alias("_wanted"))
    return docs.join(ids, F.col("doc_id").eqNullSafe(F.col("_wanted")), "left_semi")


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are NULL or have no letter go. Score 0 means that there was no language to learn; such documents stay."""
    found = language_id.identify_languages(docs)
    return _with_ids(docs, found.filter((F.col("lang_pred") != language_id.UNDETERMINED) | (F.col("score") == 0)))


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of equal texts stays, also where whole rows are repeated."""
    kept = store.staged(exact_dedup.exact_duplicates(docs).filter("kept").select("doc_id"), common.scratch(spark), "kept")
    single = _with_ids(docs, kept)
    twice = kept.groupBy("doc_id").count().filter("count > 1").select("doc_id")
    if twice.isEmpty():
        return single
    again = _with_ids(single, twice).withColumn("_text", common.ascii_lower(F.coalesce("text", F.lit(""))))
    once = single.join(twice.withColumnRenamed("doc_id", "_twice"), F.col("doc_id").eqNullSafe(F.col("_twice")), "left_anti")
    return once.unionByName(again.dropDuplicates(["doc_id", "_text"]).drop("_text"))


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays."""
    return _with_ids(docs, near_dedup.near_duplicates(docs, shingle_words=5).filter("kept"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document holds the words that the mix takes of it; documents of which it takes none go."""
    mixed = mixing.mixed_documents(docs)
    return mixed.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else mixed


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of documents in training windows."""
    return bm25_packing.pack(docs, public_tokenizers.path(TOKENIZER), END_ID)


STAGES = [
    ("language ID", language_stage),
    ("exact dedup", exact_stage),
    ("MinHash near-dedup", near_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]

#: Language ID, signatures and packing have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over the documents table, each written and read again before the next."""
    folder, docs = common.scratch(spark), common.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = store.staged(stage(spark, docs, sf_dir), folder, name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
