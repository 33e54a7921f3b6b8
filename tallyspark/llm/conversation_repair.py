"""Cheapest repair of conversations by an auction shortest-path search over the lattice of edits.

A node of the lattice is a place between two rows and the state of the role grammar; arcs keep, re-role or delete the next
row, or insert one. A conversation is cut into blocks of rows. A block is searched alone; the costs from each of its entry
states to each exit state are the arcs of a coarser lattice, blocks of blocks of a coarser one still, until one block
spans the conversation. Entry and exit states then come back down, so no task ever holds more than one block.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tallyspark.llm import common
from tallyspark.llm.conversations import batched, runs_of, with_positions, written_in_order
from tallyspark.llm.lattice import auction, least_tight_path, towards
from tallyspark.sources import store

#: Rows in a block, and blocks in a block of the next level.
BLOCK = 32
WHITE = " \t\n\x0b\x0c\r"

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
#: States of (s?(ua)+)?: nothing yet, after s, after u, after a.
START, AFTER_S, AFTER_U, AFTER_A = STATES = range(4)
ACCEPTING = (START, AFTER_A)
_KEPT = {(START, "s"): AFTER_S, (START, "u"): AFTER_U, (AFTER_S, "u"): AFTER_U, (AFTER_U, "a"): AFTER_A, (AFTER_A, "u"): AFTER_U}
SOUND, CUT_OFF, DOOMED = range(3)


def _key(name: str) -> Column:
    return F.when(F.col(name).isNull(), "-").otherwise(F.concat(F.lit("="), F.col(name).cast("string")))


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text with one row in twenty lost, emptied, stripped of sentence ends, doubled or given to the user.

    NULLs count as one space, in the checksum that decides as in role and text; `turn` itself stays NULL.
    """
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fate = F.crc32(F.concat(name("conv_id"), F.lit(":"), name("turn"))) % 20
    text = F.when(fate == 1, "").when(fate == 2, F.regexp_replace(name("text"), "[.!?]", "")).otherwise(name("text"))
    rows = conversations.select(
        "conv_id", "turn", F.when(fate == 4, "user").otherwise(name("role")).alias("role"), text.alias("text"), fate.alias("_fate"))
    copies = F.explode(F.when(F.col("_fate") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("_copy")
    return rows.filter("_fate <> 0").select("conv_id", "turn", "role", "text", copies).drop("_copy")


def _ordered(rows: DataFrame, folder: str) -> DataFrame:
    blank = F.lit(" ")
    keyed = rows.select(
        _key("conv_id").alias("_c"), "conv_id", "turn", F.coalesce("role", blank).alias("role"), F.coalesce("text", blank).alias("text"))
    return written_in_order(keyed, folder, [F.col(c) for c in ("_c", "turn", "role", "text")])


def _faults(ordered: DataFrame, folder: str) -> DataFrame:
    """Per row: _c, turn, initial, fault, its place, and the initial of the row before it in its conversation."""
    stripped = F.rtrim(F.col("text"), F.lit(WHITE))
    named = F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")), 256)
    checked = ordered.select(
        "_c", "turn", "_at", "_part", F.substring("role", 1, 1).alias("initial"), (stripped == "").alias("blank"),
        F.right(stripped, F.lit(1)).isin(".", "!", "?").alias("ended"), named.alias("digest"))
    checked = store.staged(checked, folder, "checked")
    first = checked.filter("NOT blank").groupBy("_c", "digest").agg(F.min("_at").alias("_at")).select("_at", F.lit(True).alias("first"))
    placed = with_positions(checked, ["_c", "turn", "initial", "blank", "ended"], "_c", F.col("initial"))
    fault = F.when(F.col("blank"), "blank").when(F.col("first").isNull(), "duplicate").when(~F.col("ended"), "truncated")
    before = F.coalesce(F.lag("initial").over(W.partitionBy("_c", "_part").orderBy("_at")), F.col("before_part"))
    return placed.withColumn("before", before).join(first, "_at", "left").select(
        "_c", "turn", "initial", fault.alias("fault"), "_at", "pos", "size", "before")


def _counts(faults: DataFrame) -> DataFrame:
    """Per conversation: gaps, blank, duplicate, truncated, illegal."""
    pair = F.concat("before", "initial")
    tests = {k: F.coalesce(F.col("fault") == k, F.lit(False)) for k in ("blank", "duplicate", "truncated")}
    tests["illegal"] = F.col("before").isNotNull() & ~pair.isin("su", "ua", "au")
    turns = faults.groupBy("_c", "turn").agg(*[F.count_if(t).alias(k) for k, t in tests.items()])
    gaps = F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count("turn"), F.lit(0)).cast("bigint")
    return turns.groupBy("_c").agg(gaps.alias("gaps"), *[F.sum(k).alias(k) for k in tests])


# --- lattices


def _user_next(state: int) -> int:
    return AFTER_A if state == AFTER_U else AFTER_U


def edit_lattice(rows: list[tuple[str, int]], last: bool) -> tuple[list, list[int], int]:
    """Arcs, feasible prices and the first exit node of a block of (initial, kind) rows.

    Nodes are 4 * place + state. Inserts before a row belong to its block, so a block ends with a row; the last one of a
    conversation has also the inserts behind it, and one exit more, to which accepting states lead.
    """
    arcs: list[list[tuple[str, int, int]]] = []
    for i, (initial, kind) in enumerate(rows):
        more = TRUNCATED if kind == CUT_OFF else 0
        for q in STATES:
            out = [("D", DELETE, 4 * i + 4 + q), ("I", INSERT, 4 * i + _user_next(q))]
            if kind != DOOMED:
                if (q, initial) in _KEPT:
                    out.append(("K", KEEP + more, 4 * i + 4 + _KEPT[q, initial]))
                out.append(("R", REROLE + more, 4 * i + 4 + _user_next(q)))
            arcs.append(out)
    if last:
        i = len(rows)
        for q in STATES:
            arcs.append([("", 0, 4 * i + 4)] * (q in ACCEPTING) + [("I", INSERT, 4 * i + _user_next(q))])
    arcs += [[] for _ in STATES]
    return arcs, _prices([0 if kind == SOUND else DELETE for _, kind in rows] + [0] * last), len(arcs) - 4


def block_lattice(parts: list[tuple[list[int | None], list[int]]]) -> tuple[list, list[int], int]:
    """The same over blocks: each has 16 costs and 16 ranks of entry and exit state, and the rank is the label."""
    arcs: list[list[tuple[int, int, int]]] = []
    for i, (costs, ranks) in enumerate(parts):
        for q in STATES:
            arcs.append(sorted((ranks[4 * q + x], costs[4 * q + x], 4 * i + 4 + x) for x in STATES if costs[4 * q + x] is not None))
    arcs += [[] for _ in STATES]
    return arcs, _prices([min(c for c in costs if c is not None) for costs, _ in parts]), len(arcs) - 4


def _prices(least: list[int]) -> list[int]:
    """A feasible dual to begin with: what the rows to come cost at least, whatever the state."""
    prices = [0] * (4 * len(least) + 4)
    for i in range(len(least) - 1, -1, -1):
        prices[4 * i : 4 * i + 4] = [prices[4 * i + 4] + least[i]] * 4
    return prices


def links(lattice: tuple[list, list[int], int]) -> tuple[list[int | None], list[int]]:
    """Costs from each entry to each exit state (16), and the ranks of the least label sequences among those of an entry."""
    arcs, start, exits = lattice
    costs: list[int | None] = [None] * 16
    labels: dict[int, list] = {}
    for x in STATES:
        prices = towards(arcs, start, exits + x)
        for q in STATES:
            if auction(arcs, prices, q, exits + x):
                costs[4 * q + x] = prices[q]
                labels[4 * q + x] = [step[0] for step in least_tight_path(arcs, prices, q, exits + x)]
    ranks = [0] * 16
    for q in STATES:
        for rank, at in enumerate(sorted((k for k in labels if k // 4 == q), key=labels.__getitem__)):
            ranks[at] = rank
    return costs, ranks


def cheapest(lattice: tuple[list, list[int], int], entry: int, exit_state: int) -> list[tuple]:
    """The least of the cheapest paths between two states."""
    arcs, start, exits = lattice
    prices = towards(arcs, start, exits + exit_state)
    if not auction(arcs, prices, entry, exits + exit_state):
        raise ValueError("no path between these states")
    return least_tight_path(arcs, prices, entry, exits + exit_state)


# --- tasks

_LINKS = pa.schema([("_c", pa.string()), ("block", pa.int64()), ("costs", pa.list_(pa.int64())), ("ranks", pa.list_(pa.int64()))])
_ENDS = pa.schema([("_c", pa.string()), ("block", pa.int64()), ("entry", pa.int64()), ("leave", pa.int64())])
_EDITS = pa.schema([
    ("_c", pa.string()), ("block", pa.int64()), ("step", pa.int64()), ("edit", pa.string()), ("new_role", pa.string()), ("_at", pa.int64()),
    ("cost", pa.int64())])
_LINKS_SQL = "_c string, block long, costs array<long>, ranks array<long>"
_EDITS_SQL = "_c string, block long, step long, edit string, new_role string, _at long, cost long"


def _link_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(_c, block, pos, initial, kind, last) to links."""
    def found():
        for (c, block), rows in runs_of(batches, 2):
            held = list(rows)
            yield c, block, *links(edit_lattice([r[3:5] for r in held], held[-1][5]))

    return batched(found(), _LINKS)


def _link_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(_c, parent, block, costs, ranks) to the links of the parents."""
    def found():
        for (c, parent), rows in runs_of(batches, 2):
            yield c, parent, *links(block_lattice([r[3:5] for r in rows]))

    return batched(found(), _LINKS)


def _pass_down(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(_c, parent, block, costs, ranks, entry, leave) of parents to those of their blocks."""
    def found():
        for (c, _), rows in runs_of(batches, 2):
            held = list(rows)
            for row, (_, _, node, nxt) in zip(held, cheapest(block_lattice([r[3:5] for r in held]), *held[0][5:7])):
                yield c, row[2], node % 4, nxt % 4

    return batched(found(), _ENDS)


def _edit_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(_c, block, pos, initial, kind, last, _at, entry, leave) to edits in order."""
    def found():
        for (c, block), rows in runs_of(batches, 2):
            held = list(rows)
            path = cheapest(edit_lattice([r[3:5] for r in held], held[-1][5]), *held[0][7:9])
            for step, (edit, cost, node, nxt) in enumerate(path):
                if edit:
                    new_role = None if edit in "KD" else "user" if nxt % 4 == AFTER_U else "assistant"
                    yield c, block, step, edit, new_role, None if edit == "I" else held[node // 4][6], cost

    return batched(found(), _EDITS)


def _edits(faults: DataFrame, folder: str, block: int) -> DataFrame:
    kind = F.when(F.col("fault").isNull(), SOUND).when(F.col("fault") == "truncated", CUT_OFF).otherwise(DOOMED)
    items = store.staged(faults.select(
        "_c", F.floor(F.col("pos") / block).alias("block"), "pos", "initial", kind.alias("kind"), (F.col("pos") == F.col("size") - 1).alias("last"),
        "_at", "size"), folder, "items")
    parent = F.floor(F.col("block") / block).alias("parent")

    def together(df, *keys):
        return df.repartition("_c", keys[0]).sortWithinPartitions("_c", *keys)

    rows = items.filter(F.col("size") > block).select("_c", "block", "pos", "initial", "kind", "last")
    levels = [store.staged(together(rows, "block", "pos").mapInArrow(_link_rows, _LINKS_SQL), folder, "links")]
    while (levels[-1].agg(F.max("block")).first()[0] or 0) > 0:
        blocks = levels[-1].select("_c", parent, "block", "costs", "ranks")
        levels.append(store.staged(together(blocks, "parent", "block").mapInArrow(_link_blocks, _LINKS_SQL), folder, "links"))
    state = F.lit(0).cast("bigint")
    ends = levels.pop().select("_c", "block", state.alias("entry"), state.alias("leave"))
    for level in reversed(levels):
        above = ends.withColumnRenamed("block", "parent")
        blocks = level.select("_c", parent, "block", "costs", "ranks").join(above, ["_c", "parent"])
        blocks = blocks.select("_c", "parent", "block", "costs", "ranks", "entry", "leave")
        ends = together(blocks, "parent", "block").mapInArrow(_pass_down, "_c string, block long, entry long, leave long")
        ends = store.staged(ends, folder, "ends")
    if levels:
        items = items.join(ends, ["_c", "block"], "left")
    else:
        items = items.withColumns({"entry": state, "leave": state})
    items = items.select(
        "_c", "block", "pos", "initial", "kind", "last", "_at", F.coalesce("entry", state).alias("entry"), F.coalesce("leave", state).alias("leave"))
    return store.staged(together(items, "block", "pos").mapInArrow(_edit_rows, _EDITS_SQL), folder, "edits")


def _lines(edits: DataFrame, ordered: DataFrame) -> DataFrame:
    texts = ordered.select("_at", "turn", "role", "text")
    return edits.join(texts, "_at", "left").select(
        "_c", "block", "step", "edit", "cost", "turn", F.coalesce("new_role", "role").alias("role"), F.coalesce("text", F.lit("")).alias("text"))


def repair_conversations(rows: DataFrame, block: int = BLOCK) -> DataFrame:
    """The edits of every conversation, in the order of (block, step): edit, cost, turn, role, text.

    Rows with edit D are those to leave out; the others are the repaired conversation. Role and text NULL count as one space;
    rows of equal turn come by role, then text; NULL turns come first; rows without conv_id are one conversation.
    """
    folder = common.scratch(rows.sparkSession)
    ordered = _ordered(rows, folder)
    found = _lines(_edits(_faults(ordered, folder), folder, block), ordered)
    ids = rows.groupBy(_key("conv_id").alias("_c")).agg(F.max("conv_id").alias("conv_id"))
    return found.join(ids, "_c").select("conv_id", "block", "step", "edit", "cost", "turn", "role", "text")


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(_c, block, step, edit, cost, line) to (_c, cost, audit, repaired_sha256); a conversation passes row by row."""
    schema = pa.schema([("_c", pa.string()), ("cost", pa.int64()), ("audit", pa.string()), ("repaired_sha256", pa.string())])
    small = (b.slice(i, 256) for b in batches for i in range(0, b.num_rows, 256))

    def found():
        for (c,), rows in runs_of(small, 1):
            cost, audit, digest, between = 0, [], hashlib.sha256(), b""
            for _, _, _, edit, paid, line in rows:
                cost += paid
                audit.append(edit)
                if line is not None:
                    digest.update(between + line.encode())
                    between = b"\n"
            yield c, cost, "".join(audit), digest.hexdigest()

    return batched(found(), schema, 256)


def audit_conversations(conversations: DataFrame, block: int = BLOCK) -> DataFrame:
    """Damages the conversations and reports their faults and their cheapest repair, a row for every conv_id.

    gaps, blank, duplicate, truncated and illegal describe the rows after damage, cost and audit (the initials of the edits) the
    repair, repaired_sha256 its `role:text` lines. A conversation that lost all rows has zeros, no edits and the digest of the
    empty text. NULLs, ties and repeated rows: see `damaged` and `repair_conversations`; other columns are ignored; an empty
    table gives no rows. A digest is sequential by nature, so the repaired text of one conversation streams through one task.
    """
    folder = common.scratch(conversations.sparkSession)
    ordered = _ordered(damaged(conversations), folder)
    faults = store.staged(_faults(ordered, folder), folder, "faults")
    line = F.when(F.col("edit") != "D", F.concat("role", F.lit(":"), "text")).alias("line")
    lines = _lines(_edits(faults, folder, block), ordered).select("_c", "block", "step", "edit", "cost", line)
    digests = lines.repartition("_c").sortWithinPartitions("_c", "block", "step").mapInArrow(
        _digests, "_c string, cost long, audit string, repaired_sha256 string")
    ids = conversations.groupBy(_key("conv_id").alias("_c")).agg(F.max("conv_id").alias("conv_id"))
    whole = ids.join(_counts(faults), "_c", "left").join(digests, "_c", "left")
    numbers = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    return whole.select(
        "conv_id", *[F.coalesce(n, F.lit(0).cast("bigint")).alias(n) for n in numbers], F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"))
