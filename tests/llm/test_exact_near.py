"""Exact and near deduplication against brute force."""

import hashlib
from collections import defaultdict

import numpy as np
import pytest

from tallyspark.llm import exact_dedup, shingles
from tallyspark.llm.components import connected_components
from tallyspark.llm.exact_dedup import exact_duplicates
from tallyspark.llm.near_dedup import near_duplicates
from tallyspark.llm import common

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def test_exact(odd_docs, odd_rows):
    groups = defaultdict(list)
    for i, text, *_ in odd_rows:
        groups[hashlib.sha256((text or "").translate(LOWER).encode()).hexdigest()].append(i)
    want = sorted((i, max(ids), len(ids), i == max(ids), sha) for sha, ids in groups.items() for i in ids)
    got = exact_duplicates(odd_docs)
    assert got.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    assert sorted(map(tuple, got.collect())) == want


@pytest.mark.parametrize("slots", [1, 64])
def test_exact_does_not_depend_on_the_filter_size(odd_docs, slots):
    assert sorted(exact_duplicates(odd_docs, slots_per_row=slots).collect()) == sorted(exact_duplicates(odd_docs).collect())


def test_exact_in_rounds_shuffles_possible_repeats_only(spark, odd_docs, monkeypatch):
    want = sorted(exact_duplicates(odd_docs).collect())
    seen = []
    real = exact_dedup._probed
    monkeypatch.setattr(exact_dedup, "_probed", lambda *a: (seen.append(a[:2]), real(*a))[1])
    monkeypatch.setattr(exact_dedup, "ROUND_WORDS", 4)
    assert sorted(exact_duplicates(odd_docs).collect()) == want
    assert len(seen) > 3 and all(twice.count() <= 4 for _, twice in seen)
    assert sum(rows.count() for rows, _ in seen) == odd_docs.count()  # every row is in one round
    plan = real(*seen[1], 2)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "hashpartitioning" not in plan and "PartitionFilters: [isnotnull(round" in plan


def test_exact_empty_and_null_ids(spark, no_docs):
    assert exact_duplicates(no_docs).collect() == []
    got = exact_duplicates(spark.createDataFrame([(None, "a"), (None, "A"), (None, "b"), (3, "b")], "doc_id long, text string"))
    assert sorted((r.doc_id or 0, r.keep_id or 0, r.group_size, r.kept) for r in got.collect()) == [
        (0, 0, 2, True), (0, 0, 2, True), (0, 3, 2, False), (3, 3, 2, True)
    ]


def near_by_hand(rows, k, pct):
    def shingled(text):
        w = _ascii_words((text or "").translate(LOWER))
        return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())

    sets = [(i, shingled(t)) for i, t, *_ in rows]
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            inter = len(sets[a][1] & sets[b][1])
            if inter and 100 * inter >= pct * (len(sets[a][1]) + len(sets[b][1]) - inter):
                root[find(a)] = find(b)
    least = defaultdict(list)
    for a, (i, _) in enumerate(sets):
        least[find(a)].append(i)
    return sorted((i, len(s), min(least[find(a)]), i == min(least[find(a)])) for a, (i, s) in enumerate(sets))


def _ascii_words(text):
    for c in "\t\n\x0b\x0c\r":
        text = text.replace(c, " ")
    return [w for w in text.split(" ") if w]


@pytest.mark.parametrize("k", [4, 5])
def test_near(odd_docs, odd_rows, k):
    got = near_duplicates(odd_docs, shingle_words=k)
    assert got.columns == ["doc_id", "n_shingles", "component_id", "kept"]
    assert sorted(map(tuple, got.collect())) == near_by_hand(odd_rows, k, 80)


def test_near_chain_of_edits_and_a_dense_bucket(spark, monkeypatch):
    """Neighbours in a chain are close, its ends are not; small blocks force the dense path and several tiles."""
    import tallyspark.llm.near_dedup as nd

    monkeypatch.setattr(nd, "BLOCK", 4)
    base = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(60):
        w = list(base)
        w[i % 60] = w[(i * 7) % 60] = f"x{i}"
        rows.append((100 + i, " ".join(w), None, None))
    for i in range(1, 40):
        rows.append((300 + i, " ".join([f"y{j}" for j in range(i)] + base[i:] + base[:i]), None, None))
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    for pct in (80, 88):
        assert sorted(map(tuple, near_duplicates(docs, shingle_words=4, similarity_pct=pct).collect())) == near_by_hand(rows, 4, pct)


def test_near_empty(no_docs):
    assert near_duplicates(no_docs).collect() == []


def test_signature_is_an_unbiased_and_tighter_estimate():
    rng = np.random.default_rng(1)
    errors = []
    for _ in range(300):
        both, mine, yours = (rng.integers(0, 2**63, n).astype(np.uint64) for n in (60, 20, 20))
        a, b = shingles.superminhash([np.concatenate([both, mine]), np.concatenate([both, yours])], 128)
        errors.append((a == b).mean() - 0.6)
    assert abs(np.mean(errors)) < 0.006
    assert np.std(errors) < 0.9 * np.sqrt(0.6 * 0.4 / 128)


def test_signature_follows_its_definition():
    """Against one element at a time with a full Fisher-Yates permutation."""
    rng = np.random.default_rng(2)
    sets = [rng.integers(0, 2**63, n).astype(np.uint64) for n in (1, 3, 50, 700)]
    for s, got in zip(sets, shingles.superminhash(sets, 16)):
        want = [2**64] * 16
        for x in s:
            order = list(range(16))
            for j in range(16):
                r = int(shingles.mix(np.array([x], np.uint64) + np.array([j + 1], np.uint64) * np.uint64(0x9E3779B97F4A7C15))[0])
                k = j + ((r >> 32) * (16 - j) >> 32)
                order[j], order[k] = order[k], order[j]
                want[order[j]] = min(want[order[j]], (j << 32) | (r & 0xFFFFFFFF))
        assert got.tolist() == want


def test_components_of_a_long_path(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(0, 200) if i != 100], "a long, b long")
    got = {r.node: r.root for r in connected_components(links, common.scratch(spark)).collect()}
    assert got == {i: 0 if i <= 100 else 101 for i in range(201)}
    assert connected_components(links.limit(0), common.scratch(spark)).collect() == []
