"""Top-k search against full scoring; WARC round trips, rerun equality and recovery."""

import base64
import gzip
import hashlib
import math
import os
import random

import numpy as np
import pyarrow as pa
import pytest

from tallyspark.llm import common, topk_nra, warc


def top_by_hand(rows, k, every):
    sound = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for at, (i, q) in enumerate(sound):
        if i % every == 0:
            scores = sorted((-sum(a * b for a, b in zip(q, v)), j) for p, (j, v) in enumerate(sound) if p != at)[:k]
            out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(scores)]
    return sorted(out)


@pytest.fixture(scope="module")
def vectors():
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(0, 0.2, 8).tolist()) for i in range(400)]
    rows += [(1000 + i, rows[7][1]) for i in range(130)]  # ties
    rows += [(2000, None), (2050, [1.0, None] + [0.0] * 6), (2100, [float("nan")] * 8), (2150, [float("inf")] + [0.0] * 7), (None, [0.1] * 8)]
    rows += [(100, rows[100][1]), (100, rows[3][1]), (150, rows[150][1])]  # repeated ids, of queries
    return rows + [(2200, [0.0] * 8), (2250, [0.5, -0.5]), (2300, [])]


@pytest.mark.parametrize("shard, block, k", [(8192, 2048, 5), (50, 3, 5), (64, 2, 1)])
def test_top_k(spark, vectors, monkeypatch, shard, block, k):
    monkeypatch.setattr(topk_nra, "SHARD_ROWS", shard)
    monkeypatch.setattr(topk_nra, "QUERY_BLOCK", block)
    df = spark.createDataFrame([(i, v, 1, 1) for i, v in vectors], "vec_id long, embedding array<float>, block long, row long")
    rows = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in vectors]
    got = topk_nra.top_k(df, k=k)
    assert got.columns == ["query_id", "rank", "vec_id", "score"]
    assert sorted(map(tuple, got.collect())) == top_by_hand(rows, k, 50)


def test_top_k_few_rows(spark):
    df = spark.createDataFrame([(0, [1.0]), (50, [2.0])], "vec_id long, embedding array<float>")
    assert sorted(map(tuple, topk_nra.top_k(df).collect())) == [(0, 1, 50, 512 * 256), (50, 1, 0, 512 * 256)]
    assert topk_nra.top_k(df.limit(0)).collect() == [] and topk_nra.top_k(df.filter("vec_id = 0")).collect() == []


@pytest.mark.parametrize("high", [1 << 14, 1 << 25, 1 << 29, 1 << 31])
def test_large_components_are_scored_exactly(high):
    """Wide lists beside narrow ones; sums up to and beyond 63 bits on the way to scores that fit."""
    rng = np.random.default_rng(7)
    values = rng.integers(-high, high, (300, 64)) * rng.choice([1, -1], 64)
    values[5] = values[9]  # a tie
    lists = topk_nra.SortedLists(np.arange(300), values)
    for own in (0, 5, 9):
        q = values[own]
        want = sorted((-sum(a * b for a, b in zip(q.tolist(), v)), j) for j, v in enumerate(values.tolist()) if j != own)[:5]
        if -want[0][0] < 1 << 63:
            at, scores = lists.best(q, 5, np.arange(300) == own)
            assert [(-int(s), int(p)) for p, s in zip(at, scores)] == want
        else:
            with pytest.raises(OverflowError):
                lists.best(q, 5, np.arange(300) == own)


def test_integer_reads_stop_early_and_agree_with_doubles():
    rng = np.random.default_rng(8)
    values = rng.integers(-9, 9, (4000, 3))
    values[17] = 1000
    small, large = topk_nra.SortedLists(np.arange(4000), values), topk_nra.SortedLists(np.arange(4000), values << 44)
    q, none = np.array([5, 2, 3]), np.zeros(4000, bool)
    at, scores = large.best(q, 1, none)
    assert (at.tolist(), scores.tolist()) == ([17], [10000 << 44]) == (small.best(q, 1, none)[0].tolist(), [10000 << 44])
    lists = np.arange(3)
    last = large._integers(lists, -1, np.int64) * q
    seen, _ = large._read_integers(q, lists, last, ~none, 1)
    assert seen.sum() < 3 * 4000


def test_no_join_key_gathers_all_shards(spark, vectors, monkeypatch):
    monkeypatch.setattr(topk_nra, "SHARD_ROWS", 50)
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<float>")
    plan = topk_nra.top_k(df)._jdf.queryExecution().toString()
    assert "hashpartitioning(block" in plan and ", shard" in plan.split("hashpartitioning(block")[1][:40]


def test_reading_stops_early_where_bounds_allow(monkeypatch):
    """A clear winner in few lists: most of the lists stays unread, and the result is right."""
    reads = []
    real = np.bincount
    monkeypatch.setattr(topk_nra.np, "bincount", lambda x, *a, **b: (reads.append(len(x)), real(x, *a, **b))[1])
    rng = np.random.default_rng(5)
    values = rng.integers(0, 10, (4000, 3))
    values[17] = 1000
    lists = topk_nra.SortedLists(np.arange(4000), values)
    at, scores = lists.best(np.array([1, 2, 3]), 1, np.zeros(4000, bool))
    assert (at.tolist(), scores.tolist()) == ([17], [6000.0])
    assert sum(reads) <= 3 * 4000 / 8


def test_a_block_of_queries_shares_its_reads(monkeypatch):
    """Each list is read once for all queries of a block, not once for each; results are those of full scoring."""
    reads = []
    for name in ("bincount", "put_along_axis"):
        def counted(*a, real=getattr(np, name), at=("bincount", "put_along_axis").index(name), **b):
            reads.append(np.size(a[at]))
            return real(*a, **b)
        monkeypatch.setattr(topk_nra.np, name, counted)
    rng = np.random.default_rng(9)
    values = rng.integers(-40, 40, (1500, 16))
    values[200:240], values[7] = values[3], 0  # copies, and a query without weights
    df_rows = [(i, [x / 256 for x in v]) for i, v in enumerate(values.tolist())]
    own = np.arange(0, 1500, 10)
    cell = {"block": 0, "ids": np.arange(1500).tobytes(), "rows": np.arange(1500).tobytes(), "values": values.tobytes(),
            "query_ids": own.tobytes(), "query_rows": own.tobytes(), "queries": values[own].tobytes()}
    batches = topk_nra._reader(5, 16)(iter([pa.RecordBatch.from_pylist([cell])]))
    got = [(r["query_id"], r["vec_id"], r["score"]) for b in batches for r in b.to_pylist()]
    assert sorted(got) == sorted((i, j, s) for i, _, j, s in top_by_hand(df_rows, 5, 10))
    assert sum(reads) <= 4 * values.size  # values and marks, from both ends, whatever the number of queries


def test_queries_of_a_block_settle_at_their_own_depth(monkeypatch):
    """Queries that settle at once leave the block; lists are read on only for others, and not at all without any."""
    depths = []
    real = np.put_along_axis
    monkeypatch.setattr(topk_nra.np, "put_along_axis", lambda a, at, *x, **y: (depths.append(at.shape[1]), real(a, at, *x, **y))[1])
    rng = np.random.default_rng(10)
    values = rng.integers(-9, 10, (4000, 3))
    values[17], values[18] = 1000, -1000
    lists, places = topk_nra.SortedLists(np.arange(4000), values), np.arange(4000)
    queries = np.array([[1, 2, 3], [-1, -2, -3], [0, 0, 0], [0, 5, 0]])
    found = lists.best_of(queries, 1, places, np.array([-1, -1, 0, -1]))
    assert [(at.tolist(), scores.tolist()) for at, scores in found] == [([17], [6000]), ([18], [6000]), ([1], [0]), ([17], [5000])]
    assert depths == [500, 500]
    depths.clear()
    queries = np.concatenate([queries, [[1, -1, 1]]])  # no row is the best in all of these lists
    scores = queries[4] @ values.T
    found = lists.best_of(queries, 1, places, np.full(5, -1))
    assert (found[0][0].tolist(), found[4][1].tolist()) == ([17], [scores.max()]) and found[4][0][0] == scores.argmax()
    assert sum(depths) > 1000


@pytest.mark.parametrize("high", [200, 1 << 14, 1 << 25])
def test_blocks_of_queries_of_any_size_of_components(high, monkeypatch):
    """Single precision, doubles and integers side by side in one block, as the size of the sums demands."""
    monkeypatch.setattr(topk_nra, "LOOK_QUERIES", 3)
    rng = np.random.default_rng(11)
    values = rng.integers(-high, high, (130, 8))
    values[5], values[60:70] = values[9], values[11]
    values[40] = 0
    values[41, 1:] = 0
    own = np.arange(0, 130, 7)
    queries = values[own] * np.where(np.arange(len(own)) % 3 == 0, 1 << 10, 1)[:, None]
    found = topk_nra.SortedLists(np.arange(130)[::-1], values).best_of(queries, 5, np.arange(130), own)
    for (at, scores), q, skip in zip(found, queries.tolist(), own):
        want = sorted((-sum(a * b for a, b in zip(q, v)), 129 - j) for j, v in enumerate(values.tolist()) if j != skip)[:5]
        assert [(-int(s), 129 - int(p)) for p, s in zip(at, scores)] == want


@pytest.fixture(scope="module")
def pages(spark):
    rng = random.Random(6)
    rows = [(i, f"http://h{i % 5}/é {i}", None if i % 31 == 0 else "<p>" + "ü x" * rng.randrange(0, 400) + str(i % 40)) for i in range(300)]
    rows += [(1000 + i, None, "same") for i in range(100)] + [(None, "u", "same"), (5, "twice", "own"), (2000, "u", "")]
    rows += [(None, "u", "of no id"), (None, None, "of no id"), (-7, "u", "of no id, but once"), (-(1 << 63), "u", "x")]
    return spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, shard long").repartition(7)


def want(pages):
    rows = [(r.page_id, (r.html or "").encode()) for r in pages.collect()]
    first = {}
    for i, p in rows:
        if i is not None:
            first[p] = min(first.get(p, i), i)
    return sorted(
        (i if i is not None else -1, len(p), base64.b32encode(hashlib.sha1(p).digest()).decode(),
         "response" if i == first.get(p) else "revisit", None if i == first.get(p) else first[p]) for i, p in rows
    )


@pytest.mark.parametrize("options", [{}, {"shard_records": 16, "roll_bytes": 2000}, {"shard_bytes": 3000}])
def test_warc_round_trip(spark, pages, options):
    folder = f"{common.scratch(spark)}/warc"
    manifest = warc.write_warc(pages, folder, **options)
    got = warc.read_warc(manifest, folder).drop("url").collect()
    assert sorted((-1 if r[0] is None else r[0], *r[1:]) for r in got) == want(pages)
    assert manifest.selectExpr("sum(records)").first()[0] == pages.count()


def listing(folder):
    return {n: open(f"{folder}/files/{n}", "rb").read() for n in os.listdir(f"{folder}/files") if n.endswith(".gz")}


def test_warc_rerun_writes_the_same_files_and_ignores_leftovers(spark, pages):
    one, two = (f"{common.scratch(spark)}/warc" for _ in range(2))
    options = {"shard_records": 50, "roll_bytes": 4000}
    manifest = warc.write_warc(pages, one, **options)
    warc.write_warc(pages.repartition(2), two, **options)
    files = listing(one)
    assert len(files) > 6 and files == listing(two)
    entries = {r.file: r for r in manifest.collect()}
    assert set(entries) == set(files)
    assert all(hashlib.sha256(files[n]).hexdigest() == e.sha256 and len(files[n]) == e.bytes for n, e in entries.items())
    assert max(e.records for e in entries.values()) <= 54
    open(f"{one}/files/_part-00000000-00000.warc.gz.lost", "wb").write(b"half a file")
    open(f"{one}/files/part-99999999-00000.warc.gz", "wb").write(b"not listed")
    assert warc.read_warc(manifest, one).count() == pages.count()


def test_warc_records_are_well_formed():
    data = warc.record(7, "http://a/\r\nb c", "é".encode(), None)
    head, _, rest = data.partition(b"\r\n\r\n")
    assert head.startswith(b"WARC/1.1\r\n") and b"WARC-Target-URI: http://a/%0D%0Ab%20c\r\n" in head
    assert rest.endswith("é".encode() + b"\r\n\r\n") and f"Content-Length: {len(rest) - 4}".encode() in head
    packed = gzip.compress(data) + gzip.compress(warc.record(9, None, "é".encode(), 7))
    (_, _), (headers, block) = warc.read_records(packed)
    assert headers["WARC-Type"] == "revisit" and headers["WARC-Refers-To"] == f"<urn:uuid:{warc.record_id(7, warc.base32_sha1('é'.encode()))}>"
    with pytest.raises(ValueError):
        list(warc.read_records(gzip.compress(data.replace("é".encode(), b"xx"))))


def test_warc_hot_id_and_large_page(spark):
    """Rows without an id, and rows that repeat one, are cut into shards like others; a large page is a record of its own."""
    rows = [(i, f"u{n}", f"page {n}") for n in range(600) for i in (None, 5)] + [(6, "large", "xyz " * 5_000_000)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(5)
    folder = f"{common.scratch(spark)}/warc"
    manifest = warc.write_warc(df, folder, shard_records=100, shard_bytes=1 << 20)
    assert {r["count"] for r in manifest.groupBy("shard").agg({"records": "sum"}).withColumnRenamed("sum(records)", "count").collect()} <= {100, 1}
    assert manifest.select("shard").distinct().count() >= 12
    got = warc.read_warc(manifest, folder)
    assert got.filter("page_id is null and record_type = 'revisit' and refers_to = 5").count() == 600
    assert got.filter("page_id = 5 and record_type = 'response' and refers_to is null").count() == 600
    assert got.filter("page_id = 6").first().payload_bytes == 20_000_000


def test_warc_empty(spark, pages):
    assert warc.round_trip(spark, pages.limit(0), f"{common.scratch(spark)}/warc").collect() == []
