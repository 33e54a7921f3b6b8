"""Token counts and packing against the libraries themselves."""

import inspect
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from tokenizers import Tokenizer

from tallyspark.llm import bm25_packing, common, token_counts

PIECES, WORDS = public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.path("word_bpe_49k.json")
NASTY = [
    "<|endoftext|> a<|startoftext|>b", "a b c\u0085d\x1ce\x1df", "İstanbul ΣΑΣ Σ", "é ́x", "don't I'LL we've", "ﬁ Å Å", "x" * 3000,
    "​ ﻿", "1234567 ½ ² ⅷ", "\U0001F468‍\U0001F469 漢字かな", "a\tb\x0bc\x0cd\r\ne", "Ⅷ ǅ ß ẞ", "ẛ̣ q̣̇",
]


def test_counts_and_cache(spark, odd_docs, odd_rows):
    model = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    want = sorted(
        (i, len((t or "").encode()), n := len(model.encode(t or "")), n > 100) for i, t, *_ in odd_rows
    )
    cache = f"{common.scratch(spark)}/cache"
    got = token_counts.count_tokens(odd_docs, PIECES, cache, limit=100)
    assert got.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"]
    assert sorted(map(tuple, got.collect())) == want
    stored = spark.read.parquet(cache)
    assert stored.count() == len({t or "" for _, t, *_ in odd_rows})
    files = set(stored.inputFiles())
    assert sorted(map(tuple, token_counts.count_tokens(odd_docs, PIECES, cache, limit=100).collect())) == want
    assert set(spark.read.parquet(cache).inputFiles()) == files  # nothing was encoded again
    more = spark.createDataFrame([(1, "quite new"), (2, None)], "doc_id long, text string")
    token_counts.count_tokens(more, PIECES, cache).collect()
    fresh = set(spark.read.parquet(cache).inputFiles()) - files
    assert spark.read.parquet(*fresh).count() == 1
    other = {r.doc_id: r.n_tokens for r in token_counts.count_tokens(more, WORDS, cache).collect()}
    assert other == {1: len(Tokenizer.from_file(WORDS).encode("quite new", add_special_tokens=False).ids), 2: 0}


def test_counts_trust_the_cache_but_not_another_version(spark):
    cache = f"{common.scratch(spark)}/cache"
    docs = spark.createDataFrame([(1, "abc def")], "doc_id long, text string")
    token_counts.count_tokens(docs, PIECES, cache).collect()
    stored = spark.read.parquet(cache).first()
    spark.createDataFrame([(stored.digest, 999, "old")], "digest string, n_tokens long, version string").write.mode("append").parquet(cache)
    assert token_counts.count_tokens(docs, PIECES, cache).first().n_tokens == stored.n_tokens


def test_counts_nasty_and_empty(spark, no_docs):
    model = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    docs = spark.createDataFrame(list(enumerate(NASTY)), "doc_id long, text string")
    got = token_counts.count_tokens(docs, PIECES, f"{common.scratch(spark)}/cache")
    assert {r.doc_id: r.n_tokens for r in got.collect()} == {i: len(model.encode(t)) for i, t in enumerate(NASTY)}
    assert token_counts.count_tokens(no_docs, PIECES, f"{common.scratch(spark)}/cache").collect() == []


def whole_ids(text):
    return Tokenizer.from_file(WORDS).encode(text or "", add_special_tokens=False).ids + [2]


def check_pieces(rows, pieces, window):
    """Pieces cover every document once, their checksums hold, and sequences have no gaps and need no padding."""
    ids = defaultdict(list)
    for i, t, *_ in rows:
        ids[i].append(whole_ids(t))
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for p in pieces:
        by_doc[p.doc_id].append(p)
        by_sequence[p.sequence_id].append(p)
    assert set(by_doc) == set(ids)
    for i, copies in ids.items():
        covered = sorted((p.start, p.length) for p in by_doc[i])
        want = copies[0]
        for p in by_doc[i]:
            part = np.array(want[p.start : p.start + p.length], "<u4").tobytes()
            assert p.doc_tokens == len(want) and p.ids_crc32 == zlib.crc32(part) and p.length > 0
        assert sum(n for _, n in covered) == len(want) * len(copies)
        if len(copies) == 1:
            assert [s for s, _ in covered] == [sum(n for _, n in covered[:k]) for k in range(len(covered))]
    for parts in by_sequence.values():
        parts.sort(key=lambda p: p.offset)
        assert [p.offset for p in parts] == [sum(q.length for q in parts[:k]) for k in range(len(parts))]
        total = sum(p.length for p in parts)
        assert total == window or total < window and total & (total - 1) == 0


@pytest.mark.parametrize("window, shard", [(4096, 2048), (64, 16), (16, 7)])
def test_packing(odd_docs, odd_rows, window, shard):
    got = bm25_packing.pack(odd_docs, WORDS, 2, window=window, shard_docs=shard)
    assert got.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    pieces = got.collect()
    check_pieces(odd_rows, pieces, window)
    again = bm25_packing.pack(odd_docs.repartition(2), WORDS, 2, window=window, shard_docs=shard).collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, pieces))


def test_words_give_the_ids_of_whole_texts(spark, no_docs):
    encoder = bm25_packing.WordEncoder(open(WORDS, "rb").read())
    model = Tokenizer.from_file(WORDS)
    texts = NASTY + [" ".join(NASTY), "\n".join(NASTY), ""]
    got = [np.frombuffer(b, encoder.kind).tolist() for b in encoder.encode([t.encode() for t in texts])]
    assert got == [model.encode(t, add_special_tokens=False).ids for t in texts]
    assert bm25_packing.pack(no_docs, WORDS, 2).collect() == []


def test_marks_behind_letters_need_no_full_way():
    encoder, library = bm25_packing.WordEncoder(open(WORDS, "rb").read()), Tokenizer.from_file(WORDS)
    marks = ["!!", "###", "$$$", "'.", ".'", "&&&", "***", "...", ",!!", "=>", "^`~", "</w>"[:2], "<|", "|>", "'"]
    words = [w + m for w in ("heen", "Été", "ßx", "don", "q") for m in marks]
    want = [library.encode(w, add_special_tokens=False).ids for w in words]
    real, full = encoder._full, []
    encoder._full = lambda ws: full.extend(ws) or real(ws)
    assert [np.frombuffer(b, encoder.kind).tolist() for b in encoder.encode([w.encode() for w in words])] == want
    assert full == []
    odd = ["don't!!", "a1b..", "12!", "İ!!", "漢字!!", "\U0001F600!!", "é\u0301..", "=\u0338!", "!!a!!", "(ab)"]
    got = encoder.encode([" ".join(odd).encode()])[0]
    assert np.frombuffer(got, encoder.kind).tolist() == library.encode(" ".join(odd), add_special_tokens=False).ids


MARKED = [
    "heen, heen. heen heen", "Été, été. é, ÷, ×. a÷. b×, ß.", "a., b ,c x…, 9, ab,cd. é\u0301, don't, i'll.", ".", "a", ", b", "é", ". x", ",",
    "<|startoftext|>, A, É. <|endoftext|. É,", "", " ", "  a,  b.\n\nc,\td.\x0b", "ª, µ. º, Ā, ŉ. İ, ſ.", "ÀÉ, Öö.", "!!", "(ab), [é].",
]


@pytest.mark.parametrize("short", [True, False])
def test_marks_at_the_end_of_words(short):
    encoder, library = bm25_packing.WordEncoder(open(WORDS, "rb").read()), Tokenizer.from_file(WORDS)
    assert encoder.short
    encoder.short = short
    for texts in (MARKED, MARKED[::-1], [" ".join(MARKED)], MARKED[:1], []):
        got = [np.frombuffer(b, encoder.kind).tolist() for b in encoder.encode([t.encode() for t in texts])]
        assert got == [library.encode(t, add_special_tokens=False).ids for t in texts]


def test_a_word_with_and_without_a_mark_is_kept_once():
    encoder = bm25_packing.WordEncoder(open(WORDS, "rb").read())
    encoder.encode("heen, heen. heen heen, Été, été. été qui".encode().split(b"\n"))
    assert set(encoder.known) - {b"", b",", b"."} == {"heen".encode(), "Été".encode().lower(), "été".encode(), b"qui"}


def test_words_outlive_a_full_memory(monkeypatch):
    monkeypatch.setattr(bm25_packing, "CACHED_WORDS", 4)
    encoder = bm25_packing.WordEncoder(open(WORDS, "rb").read())
    first = encoder.encode([b"sun sea oak fog"])
    asked, real = [], encoder._merged
    encoder._merged = lambda words: asked.extend(words := list(words)) or real(words)
    assert encoder.encode([b"sun sea oak fog"]) == first and asked == []
    encoder.encode([b"ice gem elm ash"])
    encoder.encode([b"yew ivy fig"])
    assert len(encoder.known) + len(encoder.older) <= 8


def test_a_worker_gives_its_words_back_after_tokenizing(spark, monkeypatch):
    """Workers are reused: what they hold adds to the memory of every later stage."""
    held = []  # encoders at each release
    monkeypatch.setattr(common, "release_memory", lambda: held.append(bm25_packing._encoder.cache_info().currsize))
    bm25_packing._encoder.cache_clear()
    rows = pa.RecordBatch.from_pydict({"id": [1, 2], "text": [b"sun sea oak fog", b"ice gem"], "draw": [5, 6]})
    coded = pa.Table.from_batches(bm25_packing._splitter(spark, WORDS, 2, 64)(iter([rows])))
    assert {b"sun", b"gem"} <= set(bm25_packing._encoder(open(WORDS, "rb").read()).known)  # for later tasks of the step
    assert held == [1]
    placed = coded.append_column("row", pa.array([0, 1])).append_column("leaf", pa.array([0, 0])).to_batches()
    cut = bm25_packing._sharder(spark.sparkContext.broadcast([]))
    assert sum(b.num_rows for b in cut(iter(placed))) == 2
    assert held == [1, 0, 0]


def test_used_documents_leave_the_postings():
    rng = np.random.default_rng(6)
    docs = [rng.zipf(1.3, rng.integers(20, 90)) % 300 for _ in range(200)]
    index, whole = bm25_packing.Bm25(docs), bm25_packing.Bm25(docs)
    size = len(index.doc)
    for seed in range(0, 190, 10):
        index.unused[seed : seed + 10] = whole.unused[seed : seed + 10] = False
        whole._forget_used = lambda: None
        assert index.neighbours(seed).tolist() == whole.neighbours(seed).tolist()
        few = next(index.nearest(seed))
        assert few.tolist() == whole.neighbours(seed)[: len(few)].tolist() and (len(few) < 64 or seed > 130)
    assert len(index.doc) < size / 4


def test_a_term_counts_once_per_document(spark):
    rows = [([5, 5, 7],), ([5],), ([9] * 40,)]
    coded = spark.createDataFrame([(np.array(r[0], "<u2").tobytes(), len(r[0])) for r in rows], "ids binary, length long")
    found = bm25_packing.collection_statistics(coded, "<u2", 12)
    assert found.frequency.tolist() == [0, 0, 0, 0, 0, 2, 0, 1, 0, 1, 0, 0] and found.docs == 3


def test_neighbours_are_the_best_by_bm25():
    rng = np.random.default_rng(8)
    docs = [rng.zipf(1.5, rng.integers(3, 60)) % 200 for _ in range(50)]
    index = bm25_packing.Bm25(docs, 500)
    index.unused[[3, 9]] = False
    mean = np.mean([len(d) for d in docs])
    scores = []
    for d in docs:
        score = 0.0
        for t in set(docs[3].tolist()):
            df, tf = sum(t in x for x in docs), int((d == t).sum())
            idf = np.log1p((50 - df + 0.5) / (df + 0.5))
            score += idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(d) / mean))
        scores.append(score)
    got = index.neighbours(3)
    assert 3 not in got and 9 not in got and len(got) == 48
    assert np.allclose(np.array(scores)[got], sorted(np.delete(scores, [3, 9]), reverse=True))


def test_windows_gather_related_documents(spark):
    """Two vocabularies, shuffled: packed windows hold mostly one of them."""
    rng = np.random.default_rng(4)
    rows = [(i, " ".join(rng.choice([f"{'cat dog'.split()[i % 2]}{j}" for j in range(30)], 40))) for i in range(200)]
    pieces = bm25_packing.pack(spark.createDataFrame(rows, "doc_id long, text string"), WORDS, 2, window=1024).collect()
    by_sequence = defaultdict(lambda: [0, 0])
    for p in pieces:
        by_sequence[p.sequence_id][p.doc_id % 2] += p.length
    assert np.mean([max(c) / sum(c) for c in by_sequence.values()]) > 0.8


def bm25_by_hand(docs, seed, frequency, n, mean):
    scores = []
    for d in docs:
        score = 0.0
        for t in set(docs[seed].tolist()):
            tf = int((d == t).sum())
            score += np.log1p((n - frequency[t] + 0.5) / (frequency[t] + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(d) / mean))
        scores.append(score)
    return np.array(scores)


def test_all_terms_of_a_long_seed_count():
    """Terms that the seed alone has do not push out those that it shares; more than 128 shared ones all count."""
    query_terms = inspect.signature(bm25_packing.pack).parameters["query_terms"].default
    rng = np.random.default_rng(2)
    docs = [np.arange(1000, 1300), *(rng.permutation(3000)[: rng.integers(150, 600)] for _ in range(40))]
    docs[0] = np.concatenate([docs[0], np.arange(5000, 5200)])  # 200 ids of its own
    frequency = np.bincount(np.concatenate(docs))
    want = bm25_by_hand(docs, 0, frequency, len(docs), np.mean([len(d) for d in docs]))
    index = bm25_packing.Bm25(docs, query_terms)
    index.unused[0] = False
    got = index.neighbours(0)
    assert want[got].min() > 0 and np.allclose(want[got], sorted(want[1:], reverse=True))


def test_related_documents_meet_in_many_shards(spark):
    """Eight vocabularies over sixteen shards: packed windows hold mostly one of them."""
    rng = np.random.default_rng(4)
    names = "cat dog sun sea oak fog ice gem".split()
    rows = [(i, " ".join(rng.choice([f"{names[i % 8]}{chr(97 + j)}" for j in range(26)], 40))) for i in range(800)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    pieces = bm25_packing.pack(docs, WORDS, 2, window=512, shard_docs=50).collect()
    check_pieces(rows, pieces, 512)
    by_sequence = defaultdict(lambda: [0] * 8)
    for p in pieces:
        by_sequence[p.sequence_id][p.doc_id % 8] += p.length
    assert np.mean([max(c) / sum(c) for c in by_sequence.values()]) > 0.8
    assert len({p.sequence_id >> 32 for p in pieces}) == 16


def test_statistics_are_those_of_all_documents(spark):
    rng = np.random.default_rng(9)
    docs = [rng.integers(0, 50, rng.integers(1, 40)).astype("<u2") for _ in range(60)]
    rows = [(len(d), d.tobytes()) for d in docs] + [(4096, None)]
    encoded = spark.createDataFrame(rows, "length long, ids binary").repartition(5)
    found = bm25_packing.collection_statistics(encoded, "<u2", 60)
    frequency = np.bincount(np.concatenate([np.unique(d) for d in docs]), minlength=60)
    assert found.docs == 60 and np.isclose(found.mean_length, np.mean([len(d) for d in docs]))
    assert found.frequency.tolist() == frequency.tolist()
    part = [d.astype(int) for d in docs[:9]]  # a shard of them
    index = bm25_packing.Bm25(part, None, found)
    index.unused[0] = False
    want = bm25_by_hand(part, 0, frequency, 60, found.mean_length)
    assert np.allclose(want[index.neighbours(0)], sorted(want[1:], reverse=True))
