"""The communication matrix, its law, and the shuffle."""

import math
import zlib
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from tallyspark.llm import sharding


def test_draws_follow_the_hypergeometric_law(spark):
    n = 20_000
    long = lambda x: F.lit(x).cast("bigint")
    for total, good, take in ((50, 20, 12), (30, 29, 15), (7, 0, 3), (9, 9, 4), (1000, 500, 400), (10, 3, 0), (0, 0, 0)):
        u = (F.col("id") + 0.5) / n
        got = Counter(r[0] for r in spark.range(n).select(sharding.hypergeometric(long(total), long(good), long(take), u)).collect())
        for k in range(take + 1):
            want = math.comb(good, k) * math.comb(total - good, take - k) / math.comb(total, take)
            assert abs(got[k] / n - want) <= 1.5 / n, (total, good, take, k)


def test_draws_of_billions_stay_near_their_mean(spark):
    long = lambda x: F.lit(x).cast("bigint")
    got = spark.range(50).select(
        sharding.hypergeometric(long(16_000_000_000), long(1_000_000_000), long(8_000_000_000), F.rand(1)).alias("k")).collect()
    spread = math.sqrt(8e9 / 16 * 15 / 16 / 2)
    assert all(abs(r.k - 5e8) < 7 * spread for r in got) and len({r.k for r in got}) == 50


def test_margins_of_the_matrix(spark):
    counts = [(p, (p * 37) % 211 if p % 7 else 0) for p in range(300)]
    total = sum(n for _, n in counts)
    sizes = [total // 5 + (s < total % 5) for s in range(5)]
    rows = sharding.communication_matrix(spark.createDataFrame(counts, "part long, n long"), sizes).collect()
    assert {r.part: sum(r.sent) for r in rows} == dict(counts)
    assert [sum(r.sent[s] for r in rows) for s in range(5)] == sizes and min(min(r.sent) for r in rows) >= 0
    again = sharding.communication_matrix(spark.createDataFrame(counts, "part long, n long"), sizes).collect()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, again))


def check(rows, got, shards=16):
    texts = defaultdict(list)
    for doc_id, text, *_ in rows:
        texts[doc_id].append(text or "")
    assert Counter(r.doc_id for r in got) == Counter(r[0] for r in rows)
    slots = defaultdict(list)
    for r in got:
        assert (r["size"], r.text_crc32) in [(len(t.encode()) + 1, zlib.crc32(t.encode())) for t in texts[r.doc_id]]
        assert r.law == "rows" and r.grown_shard is None
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    counts = [len(slots[s]) for s in range(shards)]
    assert max(counts) - min(counts) <= 1 and sum(counts) == len(rows)


def test_documents(spark, odd_docs, odd_rows, no_docs):
    got = sharding.shard_documents(odd_docs)
    assert got.columns == ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"]
    check(odd_rows, got.collect())
    assert sharding.shard_documents(no_docs).count() == 0
    hot = [(5, "the same")] * 700 + [(None, None)] * 30 + [(i, f"text {i}") for i in range(900)]
    check(hot, sharding.shard_documents(spark.createDataFrame(hot, "doc_id long, text string").repartition(7)).collect())


def test_a_uniform_shuffle(spark):
    """Every place of the input reaches every shard and slot alike: chi-squared over seeds, by halves of the input."""
    rows = spark.range(64).repartition(4)
    where, neighbours = Counter(), 0
    for seed in range(12):
        got = {r.id: (r.shard, r.slot) for r in sharding.shard_rows(rows, 4, seed).collect()}
        assert sorted(got.values()) == [(s, i) for s in range(4) for i in range(16)]
        where.update((i // 32, got[i][0]) for i in range(64))
        neighbours += sum(got[i + 1] == (got[i][0], got[i][1] + 1) for i in range(63))
    assert sum((where[h, s] - 96) ** 2 / 96 for h in range(2) for s in range(4)) < 24 and neighbours < 12 * 6


def test_written_shards_hold_their_slots_in_order(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"t{i}", 3) for i in range(100)], "doc_id long, text string, shard int")
    sharding.write_shards(docs, f"{tmp_path}/out", 4)
    found = spark.read.parquet(f"{tmp_path}/out")
    assert found.count() == 100 and {r.doc_id: r.text for r in found.collect()} == {i: f"t{i}" for i in range(100)}
    assert sorted(r["count"] for r in found.groupBy("shard").count().collect()) == [25] * 4
