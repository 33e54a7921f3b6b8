"""Learned operators on held-out rows and odd rows; the pipeline against its stages."""

import itertools
import zlib

import numpy as np
import pytest

import corpus_pipeline
from tallyspark.llm import language_id, quality_crf

SF = "/root/testdata/sf0.01"


def fold(i, n):
    return zlib.crc32(("" if i is None else str(i)).encode()) % n


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def test_languages_held_out(documents):
    got = language_id.identify_languages(documents)
    assert got.columns == ["doc_id", "held_out", "lang_pred", "score"]
    truth = {r.doc_id: r.lang for r in documents.collect()}
    rows = got.collect()
    assert len(rows) == len(truth) and all(r.held_out == (fold(r.doc_id, 4) == 2) and 0 <= r.score <= 1 for r in rows)
    held = [r for r in rows if r.held_out]
    assert np.mean([r.lang_pred == truth[r.doc_id] for r in held]) > 0.97


def test_languages_odd_rows(spark, odd_docs, odd_rows, no_docs):
    rows = language_id.identify_languages(odd_docs).collect()
    assert len(rows) == len(odd_rows)
    text = {r[0]: r[1] for r in odd_rows}
    assert all((r.lang_pred == "und") == (not any(map(str.isalpha, text[r.doc_id] or ""))) for r in rows)
    assert language_id.identify_languages(no_docs).collect() == []
    unknown = spark.createDataFrame([(None, "abc", None), (2, None, "en")], "doc_id long, text string, lang string")
    assert sorted((r.lang_pred, r.score) for r in language_id.identify_languages(unknown).collect()) == [("und", 0.0), ("und", 1.0)]


def test_languages_ignore_lang_of_held_out_rows(spark, documents):
    changed = documents.selectExpr("doc_id", "text", "if(crc32(cast(doc_id as string)) % 4 = 2, 'xx', lang) as lang")
    key = lambda df: sorted(map(tuple, df.collect()))
    assert key(language_id.identify_languages(changed)) == key(language_id.identify_languages(documents))


def test_language_kernel_is_presence_of_ngrams():
    rows = np.zeros((2, language_id.BUCKETS), np.uint8)
    language_id.set_presence("abab", rows[0])
    language_id.set_presence("ABAB" * 50, rows[1])
    assert rows[0].sum() == 6 and (rows[0] == rows[1]).all()  # a b ab ba aba bab


def test_quality_held_out(spark, documents):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    got = quality_crf.score_quality(documents, labels)
    assert got.columns == ["doc_id", "held_out", "score", "predicted"]
    truth = {r.doc_id: r.quality for r in labels.collect()}
    rows = got.collect()
    assert all(r.held_out == (fold(r.doc_id, 3) == 1) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    held = [r for r in rows if r.held_out and r.doc_id in truth]
    assert np.mean([r.predicted == truth[r.doc_id] for r in held]) > 0.9
    good, bad = ([r.score for r in held if truth[r.doc_id] == y] for y in (1, 0))
    assert np.mean([g > b for g in good for b in bad]) > 0.95


def test_quality_ignores_other_columns_and_held_out_labels(spark, documents):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    want = {r.doc_id: r.score for r in quality_crf.score_quality(documents, labels).collect()}
    flipped = labels.selectExpr("doc_id", "if(crc32(cast(doc_id as string)) % 3 = 1, 1 - quality, quality) as quality")
    bare = documents.selectExpr("doc_id", "text", "'x' as lang", "doc_id as label", "doc_id as id")
    assert {r.doc_id: r.score for r in quality_crf.score_quality(bare.repartition(3), flipped).collect()} == want


def test_quality_odd_rows(spark, odd_docs, odd_rows, no_docs):
    labels = spark.createDataFrame([(i, i % 2) for i in range(4, 80)] + [(5, 0), (None, 1), (6, None)], "doc_id long, quality int")
    rows = quality_crf.score_quality(odd_docs, labels).collect()
    assert len(rows) == len(odd_rows) and all(0 <= r.score <= 1 for r in rows)
    assert quality_crf.score_quality(no_docs, labels).collect() == []
    assert {r.score for r in quality_crf.score_quality(odd_docs, labels.limit(0)).collect()} == {0.5}


def test_field_marginals_by_enumeration():
    rng = np.random.default_rng(1)
    field = quality_crf.LineField(rng.normal(0, 1, quality_crf.FEATURES), rng.normal(0, 1, (2, 2)), 1.0, 0.0)
    texts = [b"Some words.\nMORE WORDS!!\n\nand 12 more", b"", b"x"]
    x, _, counts = quality_crf.line_features(texts)
    got, at = quality_crf.marginals(field, x, counts), 0
    for n in counts:
        gain = x[at : at + n] @ field.weights
        total, good = 0.0, np.zeros(n)
        for y in itertools.product((0, 1), repeat=int(n)):
            p = np.exp(sum(g for g, v in zip(gain, y) if v) + sum(field.moves[a, b] for a, b in zip(y, y[1:])))
            total, good = total + p, good + p * np.array(y)
        assert np.allclose(got[at : at + n], good / total)
        at += n


def test_lines_see_their_neighbours():
    x, weight, counts = quality_crf.line_features([b"ab\nCD", b"12"])
    own = quality_crf.OWN
    assert counts.tolist() == [2, 1] and weight.tolist() == [3, 3, 3]
    assert (x[0, own : 2 * own] == 0).all() and (x[1, own : 2 * own] == x[0, :own]).all() and (x[0, 2 * own : 3 * own] == x[1, :own]).all()
    assert (x[1, 2 * own : 3 * own] == 0).all() and (x[2, own : 3 * own] == 0).all()


def test_pipeline_stages(spark, odd_docs, odd_rows, no_docs):
    """Each stage on the rows that the one before it kept."""
    docs, columns = odd_docs, odd_docs.columns
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["language ID", "exact dedup", "MinHash near-dedup", "mixing", "packing"]
    text = {r[0]: r[1] for r in odd_rows}
    for name, stage in corpus_pipeline.STAGES:
        before = sorted(r.doc_id for r in docs.collect())
        assert stage(spark, no_docs, SF).collect() == []
        docs = stage(spark, docs, SF)
        after = sorted(r.doc_id for r in docs.collect())
        if name != "packing":
            assert docs.columns == columns and set(after) <= set(before)
        if name == "language ID":
            assert after == [i for i in before if any(map(str.isalpha, text[i] or ""))]
        if name == "exact dedup":
            assert 13 in after and len(after) == len(set(after)) and 5 in after and 4 not in after and 8 in after and 7 not in after
        if name == "MinHash near-dedup":
            assert 8 in after and 9 not in after and 10 not in after
    assert docs.columns[0] == "doc_id" and set(after) == set(before)


def test_language_stage_keeps_texts_where_no_language_is_known(spark):
    """No row has a language; then only those of the held-out fold have one."""
    held = next(i for i in range(100) if fold(i, 4) == 2)
    for lang in (None, "en"):
        rows = [(held, "some words", lang), (1000, "other words", None), (1001, None, None), (1002, "12 34", None)]
        docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
        assert sorted(r.doc_id for r in corpus_pipeline.language_stage(spark, docs, SF).collect()) == [held, 1000]


def test_pipeline_run(spark):
    got = corpus_pipeline.run(spark, "/root/testdata/sf0.001").collect()
    assert got and all(r.length > 0 for r in got)
