"""Token counts with a cache keyed by content digest and tokenizer version."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from tallyspark.llm import common
from tallyspark.sources import store


def tokenizer_version(path: str) -> str:
    """Digest of the vocabulary file and the library's name and version: counts of another version never mix."""
    if path.endswith(".model"):
        import sentencepiece as library
    else:
        import tokenizers as library
    with open(path, "rb") as f:
        content = f.read()
    return hashlib.sha256(f"{library.__name__} {library.__version__} ".encode() + content).hexdigest()


@lru_cache(maxsize=2)
def _counter(content: bytes, sentencepiece_model: bool):
    if sentencepiece_model:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_proto=content)
        return lambda texts: [len(ids) for ids in model.encode(texts, num_threads=1)]
    from tokenizers import Tokenizer

    model = Tokenizer.from_buffer(content)
    model.no_truncation()
    model.no_padding()
    return lambda texts: [len(model.encode(t, add_special_tokens=False).ids) for t in texts]


def count_tokens(
    docs: DataFrame, tokenizer_path: str, cache: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 4096
) -> DataFrame:
    """One row per row of `docs`: id, n_bytes, n_tokens, over_limit (n_tokens > `limit`).

    Content is normalised only as far as no count can change: NULL becomes the empty text. Digests of the whole texts
    are joined to the stored counts in the folder `cache`; of every digest without a count one text is encoded,
    and the new counts are appended. Texts are encoded whole, without begin, end or other special tokens.

    Copies are encoded once. Repeated rows and ids are each returned; an empty table gives no rows and leaves the
    cache as it is. Other columns are ignored. The vocabulary file is read on the driver and broadcast (its size is fixed).
    """
    spark, folder = docs.sparkSession, common.scratch(docs.sparkSession)
    version = tokenizer_version(tokenizer_path)
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(text_col, F.lit("")).alias("text"))
    keyed = store.staged(
        texts.select(
            "id", F.sha2(F.col("text").cast("binary"), 256).alias("digest"), F.octet_length("text").cast("long").alias("n_bytes")
        ),
        folder, "digests",
    )
    distinct = keyed.groupBy("digest").agg(F.min("id").alias("first_id"))
    misses = store.staged(distinct.join(_stored(spark, cache, version), "digest", "left_anti"), folder, "misses")
    if not misses.isEmpty():
        ids = misses.select("first_id").distinct().hint("shuffle_hash")
        wanted = texts.join(ids, F.col("id").eqNullSafe(F.col("first_id")), "left_semi").select("text")
        counted = wanted.mapInArrow(_encoder(spark, tokenizer_path), "digest string, n_tokens long")
        fresh = counted.dropDuplicates(["digest"]).join(misses.select("digest"), "digest", "left_semi")
        fresh.withColumn("version", F.lit(version)).write.mode("append").parquet(cache)
    counts = _stored(spark, cache, version)
    return keyed.join(counts, "digest").select(
        F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit")
    )


def _stored(spark: SparkSession, cache: str, version: str) -> DataFrame:
    """One count per digest, also after two runs have added the same one."""
    schema = "digest string, n_tokens long, version string"
    path, fs = store.file_system(spark, cache)
    found = spark.read.schema(schema).parquet(cache) if fs.exists(path) else spark.createDataFrame([], schema)
    return found.filter(F.col("version") == version).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))


def _encoder(spark: SparkSession, path: str):
    with open(path, "rb") as f:
        content = spark.sparkContext.broadcast(f.read())
    is_model = path.endswith(".model")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = _counter(content.value, is_model)
        for whole in batches:
            for batch in common.pieces(whole, 0, 4_000_000):
                texts = batch.column(0).to_pylist()
                digests = [hashlib.sha256(t.encode()).hexdigest() for t in texts]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(digests, pa.string()), pa.array(count(texts), pa.int64())], ["digest", "n_tokens"]
                )

    return encode
