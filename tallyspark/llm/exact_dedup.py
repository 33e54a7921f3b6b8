"""Exact duplicates found by two passes over a Bloom filter; columns and SQL functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tallyspark.llm import common
from tallyspark.sources import store

#: 64-bit words of the filter that one round builds and broadcasts (64 MB at most, as every word has one row at most).
ROUND_WORDS = 1 << 22


def exact_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", slots_per_row: int = 16, hashes: int = 2
) -> DataFrame:
    """One row per row of `docs`: id, keep_id, group_size, kept, text_sha256.

    Texts are equal when they are the same after A to Z are lower-cased; of equal texts the row with the
    largest id stays. Equality is that of the SHA-256 digest.

    Pass 1 counts, for every slot of a blocked Bloom filter (`hashes` bits within one 64-bit word per row,
    `slots_per_row` slots a row), how many rows set it, and keeps the bits that were set more than once. Pass 2
    looks every row up: a row with a bit that only it has set is unique and goes straight to the result. The other
    rows, repeated ones and a few false alarms, are shuffled by digest and settled exactly.

    A filter of more than ROUND_WORDS words is built in rounds, one range of words after the other. Digests are written
    into one folder per range, so each round reads its own rows only, broadcasts its own part of the filter and
    shuffles nothing but slots and possible repeats, as on a small table.

    NULL counts as the empty text. Rows with equal text and the same id are all marked kept; a NULL id stays only
    where the whole group has no id. Other columns are ignored, and an empty table gives no rows.
    """
    folder = common.scratch(docs.sparkSession)
    digest = F.sha2(common.ascii_lower(F.coalesce(text_col, F.lit(""))).cast("binary"), 256)
    digests = docs.select(F.col(id_col).cast("long").alias("id"), digest.alias("text_sha256"))
    keyed = store.staged(digests, folder, "digests")
    words = max(1, keyed.count() * slots_per_row // 64)
    rounds = -(-words // ROUND_WORDS)
    keyed = keyed.withColumn("word", F.pmod(F.xxhash64("text_sha256"), F.lit(words)))
    if rounds > 1:
        keyed = _by_round(keyed, f"{folder}/rounds")
    for n in range(rounds):
        rows = keyed.filter(F.col("round") == n) if rounds > 1 else keyed
        seen_twice = store.staged(_seen_twice(rows, hashes), folder, "filter")
        _probed(rows, seen_twice, hashes).write.parquet(f"{folder}/probed/part={n}")
    probed = docs.sparkSession.read.parquet(f"{folder}/probed")
    unique = probed.filter("not maybe").select(
        "id", F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "text_sha256"
    )
    maybe = probed.filter("maybe").select("id", "text_sha256")
    groups = maybe.groupBy("text_sha256").agg(F.max("id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    repeated = maybe.join(groups, "text_sha256").select(
        "id", "keep_id", "group_size", F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256"
    )
    return unique.unionByName(repeated).withColumnRenamed("id", id_col)


def _by_round(keyed: DataFrame, path: str) -> DataFrame:
    """The rows in one folder per range of words. Nothing is shuffled; a task writes a file per range it meets."""
    ranged = keyed.withColumn("round", F.floor(F.col("word") / ROUND_WORDS).cast("int"))
    ranged.write.partitionBy("round").parquet(path)
    return keyed.sparkSession.read.schema(ranged.schema).parquet(path)


def _probed(rows: DataFrame, seen_twice: DataFrame, hashes: int) -> DataFrame:
    """The rows of one round, with `maybe` for those that its part of the filter takes for repeats."""
    mask = _mask(hashes)
    return rows.join(F.broadcast(seen_twice), "word", "left").select(
        "id", "text_sha256", F.coalesce(F.col("bits").bitwiseAND(mask) == mask, F.lit(False)).alias("maybe")
    )


def _bits(hashes: int) -> list[Column]:
    """The positions a row sets within its word; each hash has its own part of the word, so they differ."""
    width = 64 // hashes
    return [F.pmod(F.xxhash64("text_sha256", F.lit(i)), F.lit(width)).cast("int") + i * width for i in range(1, hashes)] + [
        F.pmod(F.xxhash64("text_sha256", F.lit(0)), F.lit(width)).cast("int")
    ]


def _power(bit: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), bit)


def _mask(hashes: int) -> Column:
    mask = F.lit(0).cast("long")
    for bit in _bits(hashes):
        mask = mask.bitwiseOR(_power(bit))
    return mask


def _seen_twice(rows: DataFrame, hashes: int) -> DataFrame:
    slots = rows.select("word", F.explode(F.array(*_bits(hashes))).alias("bit")).groupBy("word", "bit").count()
    return slots.filter("count > 1").groupBy("word").agg(F.bit_or(_power(F.col("bit"))).alias("bits"))
