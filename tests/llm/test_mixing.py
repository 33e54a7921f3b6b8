"""Source mixing: targets, apportionment, exact word counts and the texts that come out."""

import random
import re
from fractions import Fraction

import pytest

from tallyspark.llm import common, mixing

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def targets_by_hand(sizes, most=3):
    """sizes: size by source, in order. Shares by weight, the excess over a cap reshared until none is above."""
    weight = {s: i % 3 + 1 for i, s in enumerate(sizes)}
    target, left, open_ = {}, Fraction(sum(sizes.values())), set(sizes)
    while open_:
        rate = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if rate * weight[s] > most * sizes[s]}
        if not full:
            return target | {s: rate * weight[s] for s in open_}
        for s in full:
            target[s] = Fraction(most * sizes[s])
        left, open_ = left - sum(target[s] for s in full), open_ - full
    return target


def check(rows, got):
    sizes = {}
    for _, text, _, source in sorted(rows, key=lambda r: (r[3] is None, (r[3] or "").encode())):
        sizes[source] = sizes.get(source, 0) + len(WORD.findall(text or ""))
    target = targets_by_hand(sizes)
    source_of = {r[0]: r[3] for r in rows}
    taken = dict.fromkeys(sizes, 0)
    for r in got:
        s = source_of[r.doc_id]
        assert r.source_size == sizes[s] and r.target == pytest.approx(float(target[s]))
        assert 0 <= r.taken <= 3 * r.size
        taken[s] += r.taken
    for s in sizes:
        assert abs(taken[s] - target[s]) <= 1
    return taken


def test_mix(odd_docs, odd_rows):
    got = mixing.mix_sources(odd_docs)
    assert got.columns == ["doc_id", "size", "source_size", "target", "taken"]
    rows = got.collect()
    assert len(rows) == len(odd_rows)
    check(odd_rows, rows)
    again = mixing.mix_sources(odd_docs.repartition(3)).collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, rows))


def test_many_shards_and_a_hot_source(spark):
    rng = random.Random(3)
    rows = [(i, "w " * rng.randrange(0, 300), None, "hot" if i % 3 == 0 else f"s{i % 11}") for i in range(900)]
    docs = spark.createDataFrame([(r[0], r[1], r[3]) for r in rows], "doc_id long, text string, source string")
    got = mixing.mix_sources(docs, shard_words=5_000).collect()
    check(rows, got)


def test_texts_hold_the_taken_words(odd_docs, odd_rows):
    plan = {}
    for r in mixing.mix_sources(odd_docs).collect():
        plan.setdefault(r.doc_id, []).append(r.taken)
    mixed = mixing.mixed_documents(odd_docs)
    assert mixed.columns == odd_docs.columns
    seen = {}
    for r in mixed.collect():
        seen.setdefault(r.doc_id, []).append(len(WORD.findall(r.text)))
    assert {i: sorted(t for t in ts if t) for i, ts in plan.items() if any(ts)} == {i: sorted(ts) for i, ts in seen.items()}
    vocabulary = {w for r in odd_rows for w in WORD.findall(r[1] or "")}
    assert all(set(WORD.findall(r.text)) <= vocabulary for r in mixed.collect())


def test_empty_and_wordless(spark, no_docs):
    assert mixing.mix_sources(no_docs).collect() == []
    blank = spark.createDataFrame([(1, None, "a"), (2, " ", None)], "doc_id long, text string, source string")
    assert [(r.size, r.target, r.taken) for r in mixing.mix_sources(blank).collect()] == [(0, 0.0, 0)] * 2


def test_apportionment_is_sainte_lague(spark):
    rng = random.Random(4)
    weights = [(i, rng.choice([0.0, 1.0, 1.0, 3.5, 80.0, 900.0, rng.random() * 5000])) for i in range(40)]
    for seats in (0, 1, 7, 333):
        units = spark.createDataFrame([(1, i, w, seats) for i, w in weights], "g int, u int, w double, seats long")
        offers = sorted(((-w / (2 * k + 1), i, k) for i, w in weights if w for k in range(seats)))[:seats]
        want = {i: sum(o[1] == i for o in offers) for i, _ in weights}
        for group in (None, "g"):
            got = mixing.apportion(units, common.scratch(spark), group, "u", "w", "seats")
            assert {r.u: r.quota for r in got.collect()} == want


def test_sources_of_a_few_words_come_near_their_targets(spark):
    """Sources of 0 to 60 words beside a large one, and the texts that come out."""
    rows = [(i, "w " * i, None, f"s{i:02d}") for i in range(61)] + [(100 + i, "big " * 500, None, "big") for i in range(30)]
    docs = spark.createDataFrame([(r[0], r[1], r[3]) for r in rows], "doc_id long, text string, source string")
    taken = check(rows, mixing.mix_sources(docs).collect())
    assert all(n > 0 for s, n in taken.items() if s != "s00")
    sizes = {s: 0 for s in taken}
    for r in mixing.mixed_documents(docs).collect():
        sizes[r.source] += len(WORD.findall(r.text))
    assert sizes == taken
