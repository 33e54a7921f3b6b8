"""Conversation repair and prefix trie: their SQL on odd tables, block levels, bursts, and the auction against brute force."""

import heapq
import random

import duckdb
import pytest

from tallyspark.llm import conversation_repair as repair, lattice, prefix_trie
from tallyspark.llm.oracle import ORACLE_SQL

SCHEMA = "conv_id long, turn long, role string, text string, block long, seq long, head long, _at long, cost string"


def table(spark, rows):
    return spark.createDataFrame([(*r, 7, 7, 7, 7, "x") for r in rows], SCHEMA).repartition(4)


def sorted_rows(rows):
    return sorted(map(tuple, rows), key=lambda r: tuple((v is None, v) for v in r))


def twin(rows, name):
    con = duckdb.connect()
    con.execute("CREATE TABLE conversations (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    if rows:
        con.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", rows)
    found = con.execute(ORACLE_SQL[name])
    return [d[0] for d in found.description], found.fetchall()


def odd_conversations():
    """NULLs in every column, ties, repeated rows, blank, very long, foreign and empty roles, copies, a family without its first."""
    rng = random.Random(11)
    say = lambda: rng.choice(["Yes.", "no", "Why?\n", " \t", "", "Fine!", "and then", "é 漢字.", "Ok. " * rng.randrange(1, 9)])
    role = lambda: rng.choice(["user", "assistant", "user", "assistant", "system", "", None, "umpire", "tool"])
    rows = [(c, t, role(), say()) for c in range(100, 160) for t in range(rng.randrange(1, 12))]
    rows += [(c, t, "ua"[t % 2] + "x", f"same {t}.") for c in (205, 207, 301, 399) for t in range(6)]  # 200 and 300 are absent
    rows += [(None, 1, "user", "Lost."), (None, None, "assistant", None), (7, None, "user", "First."), (7, None, "user", "First.")]
    rows += [(8, 3, "user", "Tie b."), (8, 3, "user", "Tie a."), (8, 3, "assistant", "Tie a."), (9, 0, "user", "word " * 200_000)]
    return rows + [(10, t, "user", "One and the same.") for t in range(90)] + [(11, t, role(), say()) for t in range(150)]


@pytest.mark.parametrize("block", [2, 32])
def test_repair_equals_its_twin_at_any_block_size(spark, block):
    rows = odd_conversations()
    names, want = twin(rows, "op11_conversation_repair")
    got = repair.audit_conversations(table(spark, rows), block)
    assert got.columns == names and sorted_rows(got.collect()) == sorted_rows(want)


def test_repaired_rows_follow_the_grammar(spark):
    rows = odd_conversations()
    found = repair.repair_conversations(table(spark, rows)).orderBy("conv_id", "block", "step").collect()
    assert sum(r.edit in "KRD" for r in found) == len(rows)
    by_id = {}
    for r in found:
        by_id.setdefault(r.conv_id, "")
        by_id[r.conv_id] += "" if r.edit == "D" else r.role[:1]
    for roles in by_id.values():
        body = roles[1:] if roles[:1] == "s" else roles
        assert body == "ua" * (len(body) // 2) and (body or not roles)


@pytest.mark.parametrize("capacity", [1, 30, 4096])
def test_trie_equals_its_twin_at_any_capacity(spark, capacity):
    rows = odd_conversations()
    names, want = twin(rows, "op13_prefix_trie")
    got = prefix_trie.conversation_trie(table(spark, rows), capacity)
    assert got.columns == names and sorted_rows(got.collect()) == sorted_rows(want)


def test_no_conversations(spark):
    assert repair.audit_conversations(table(spark, [])).count() == prefix_trie.conversation_trie(table(spark, [])).count() == 0
    only_null = [(None, 1, None, None)]
    for name, run in (("op11_conversation_repair", repair.audit_conversations), ("op13_prefix_trie", prefix_trie.conversation_trie)):
        assert sorted_rows(run(table(spark, only_null)).collect()) == sorted_rows(twin(only_null, name)[1])


def test_a_long_shared_run_is_one_burst(spark, monkeypatch):
    """Two conversations that part at their last turn: rounds follow the branches, not the depth."""
    rows = [(c, t, "user", f"{t}" if t < 120 else f"end {c}") for c in (1, 2) for t in range(121)]
    rounds, burst = [], prefix_trie._burst
    monkeypatch.setattr(prefix_trie, "_burst", lambda *a: rounds.append(1) or burst(*a))
    got = prefix_trie.conversation_trie(table(spark, rows), 20)
    assert sorted_rows(got.collect()) == sorted_rows(twin(rows, "op13_prefix_trie")[1]) and len(rounds) <= 2


def distance(arcs, origin, target):
    best, waiting = {origin: 0}, [(0, origin)]
    while waiting:
        d, node = heapq.heappop(waiting)
        for _, cost, nxt in arcs[node]:
            if d + cost < best.get(nxt, 1 << 60):
                best[nxt] = d + cost
                heapq.heappush(waiting, (d + cost, nxt))
    return best.get(target)


def test_auction_prices_are_distances_and_the_trace_is_least():
    rng = random.Random(3)

    def all_paths(arcs, node, target, budget):
        if node == target and budget == 0:
            yield ""
        for label, cost, nxt in arcs[node]:
            if cost <= budget:
                for rest in all_paths(arcs, nxt, target, budget - cost):
                    yield label + rest

    for _ in range(60):
        rows = [(rng.choice("suaax"), rng.randrange(3)) for _ in range(rng.randrange(1, 7))]
        last = rng.random() < 0.5
        arcs, start, exits = repair.edit_lattice(rows, last)
        for leave in range(4):
            prices = lattice.towards(arcs, start, exits + leave)
            for entry in range(4):
                want = distance(arcs, entry, exits + leave)
                assert lattice.auction(arcs, prices, entry, exits + leave) == (want is not None)
                if want is not None:
                    assert prices[entry] == want
                    path = lattice.least_tight_path(arcs, prices, entry, exits + leave)
                    assert "".join(p[0] for p in path) == min(all_paths(arcs, entry, exits + leave, want))
                    assert sum(p[1] for p in path) == want
