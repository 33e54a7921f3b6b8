"""A prefix trie over conversations as a burst trie.

Conversations are sequences of turn ids. They begin in one container under the root. A container that holds too many ids is
burst: what all its suffixes have in common becomes a chain of nodes, and behind it every next turn id heads a container of
its own. Containers that fit are sorted and swept into nodes, a container in one task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tallyspark.llm import common
from tallyspark.llm.conversations import batched, runs_of, with_positions, written_in_order
from tallyspark.sources import store

#: Turn ids in a container that is swept.
CAPACITY = 4096
#: Conversations of a hundred share the first turns of its first one, up to this many.
FAMILY, SHARED = 100, 6

_HEAD = ["head", "head_depth"]
_TOTALS = ["n_children", "n_leaves", "saved_tokens"]
_EMPTY_DIGEST = hashlib.sha256().hexdigest()


def _long(value) -> Column:
    return F.lit(value).cast("bigint")


def turn_ids(conversations: DataFrame, folder: str) -> DataFrame:
    """(c, pos, tid, chars, size) for every row with a conv_id: its place in its conversation and a 128-bit id of role and text."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    digest = F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256)
    narrow = conversations.filter(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("c"), "turn", F.unhex(F.substring(digest, 1, 32)).alias("tid"),
        F.length(text).cast("bigint").alias("chars"))
    ordered = written_in_order(narrow, folder, [F.col(c) for c in ("c", "turn", "tid")])
    return with_positions(ordered, ["c", "tid", "chars"], "c").select("c", "pos", "tid", "chars", "size")


def rebuilt(placed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The ids of all conversations, and (c, depth, tid, chars): the first turns of the family's first conversation, then its own."""
    shared = (F.crc32(F.col("c").cast("string")) % SHARED).alias("h")
    convs = placed.filter("pos = 0").select("c", shared, (F.col("c") - F.col("c") % FAMILY).alias("base"), "size")
    bases = convs.filter("c = base").select("base", F.col("size").alias("base_size"))
    there = F.least("h", F.coalesce("base_size", _long(0)))
    convs = convs.join(bases, "base", "left").select("c", "h", "base", there.alias("there"))
    first = placed.filter(F.col("pos") < SHARED - 1).filter(F.col("c") % FAMILY == 0).select(F.col("c").alias("base"), "pos", "tid", "chars")
    lent = convs.join(first, "base").filter("pos < h").select("c", (F.col("pos") + 1).alias("depth"), "tid", "chars")
    own = placed.filter(F.col("pos") >= F.crc32(F.col("c").cast("string")) % SHARED).join(convs.select("c", "h", "there"), "c").select(
        "c", (F.col("there") + F.col("pos") - F.col("h") + 1).alias("depth"), "tid", "chars")
    return convs.select("c"), lent.unionByName(own)


def _ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(n, f, g, c), sorted, to one row for each sequence: its first conversation, length, members and the digest of their ids."""
    schema = pa.schema([("seq", pa.int64()), ("n", pa.int64()), ("m", pa.int64()), ("ends_sha256", pa.string())])

    def found():
        for (n, _, _), rows in runs_of(batches, 3):
            digest, first, m = hashlib.sha256(), None, 0
            for *_, c in rows:
                digest.update(b"%d" % c if m == 0 else b",%d" % c)
                first, m = c if first is None else first, m + 1
            yield first, n, m, digest.hexdigest()

    return batched(found(), schema)


def _sequences(convs: DataFrame, turns: DataFrame) -> DataFrame:
    """(seq, n, m, ends_sha256): conversations of equal sequences are one, named by the smallest of them.

    Sequences are told apart by their length and two 64-bit sums over the digests of their turns, as conversations of any length are.
    """
    marks = turns.groupBy("c").agg(
        F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("depth", "tid")).alias("f"), F.bit_xor(F.xxhash64("tid", F.lit("g"), "depth")).alias("g"))
    known = convs.join(marks, "c", "left").select(*[F.coalesce(x, _long(0)).alias(x) for x in ("n", "f", "g")], "c")
    return known.repartition("n", "f", "g").sortWithinPartitions("n", "f", "g", "c").mapInArrow(
        _ends, "seq long, n long, m long, ends_sha256 string")


# --- sweeping


_SWEPT = ["conv_id", "depth", "parent_conv_id", "n_convs", *_TOTALS, "end_seq", *_HEAD]


def swept(sequences: list[tuple[int, int, list[bytes], list[int]]]) -> list[list]:
    """Nodes of a sorted container of (seq, members, ids, chars): [parent index, depth below the head, chars, conv_id, n_convs,
    n_children, n_leaves, saved_tokens, end_seq]; parents come before their children."""
    nodes: list[list] = []
    path: list[int] = []
    before: list[bytes] = []
    for seq, m, ids, chars in sorted(sequences, key=lambda s: s[2]):
        shared = next((i for i, (a, b) in enumerate(zip(before, ids)) if a != b), min(len(before), len(ids)))
        del path[shared:]
        for i in range(shared, len(ids)):
            nodes.append([path[-1] if path else -1, i + 1, chars[i], seq, 0, 0, 0, 0, None])
            path.append(len(nodes) - 1)
        last = nodes[path[-1]]
        last[3], last[4], last[8] = min(last[3], seq), last[4] + m, seq
        before = ids
    for node in reversed(nodes):
        node[6] = node[6] or 1
        node[7] += (node[4] - 1) * node[2]
        if node[0] >= 0:
            above = nodes[node[0]]
            above[3], above[4], above[5] = min(above[3], node[3]), above[4] + node[4], above[5] + 1
            above[6], above[7] = above[6] + node[6], above[7] + node[7]
    return nodes


def _sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(head, head_depth, seq, depth, m, tid, chars), sorted, to nodes."""
    schema = pa.schema([(n, pa.int64()) for n in _SWEPT])

    def found():
        for (head, top), rows in runs_of(batches, 2):
            held = []
            for (seq, m), turns in groupby(rows, key=lambda r: (r[2], r[4])):
                turns = list(turns)
                held.append((seq, m, [t[5] for t in turns], [t[6] for t in turns]))
            nodes = swept(held)
            for parent, depth, _, conv, n_convs, *rest in nodes:
                yield conv, top + depth, nodes[parent][3] if parent >= 0 else head, n_convs, *rest, head, top

    return batched(found(), schema)


# --- bursting


def _sized(open_: DataFrame, capacity: int, folder: str) -> DataFrame:
    """The open suffixes with k, the sequences in their container, and whether it has to be burst."""
    sizes = open_.groupBy(*_HEAD).agg(F.count(F.lit(1)).alias("k"), (F.sum(F.col("n") - F.col("head_depth")) > capacity).alias("bursts"))
    return store.staged(open_.join(store.staged(sizes, folder, "sizes"), _HEAD), folder, "open")


def _burst(paths: DataFrame, full: DataFrame, folder: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Burst all containers of `full`. Returns the containers, their chains, the heads below them and the suffixes under these."""
    suffixes = paths.join(full.select("seq", *_HEAD, "k"), "seq").filter(F.col("depth") > F.col("head_depth"))
    levels = store.staged(suffixes.groupBy(*_HEAD, "depth").agg(
        F.count(F.lit(1)).alias("met"), F.min("tid").alias("least"), F.max("tid").alias("most"), F.sum("m").alias("n_convs"),
        F.min("seq").alias("first"), F.max("chars").alias("chars"), F.max("k").alias("k")), folder, "levels")
    parts = (F.col("met") < F.col("k")) | (F.col("least") != F.col("most"))
    bottom = F.coalesce(F.min(F.when(parts, F.col("depth"))) - 1, F.max("depth")).alias("bottom")
    containers = levels.groupBy(*_HEAD).agg(bottom, F.min("first").alias("first"))
    ended = full.select(*_HEAD, "seq", "n")
    containers = store.staged(containers.join(ended.join(containers, _HEAD).filter((F.col("n") == F.col("bottom")) & (F.col("n") > F.col("head_depth"))).select(
        *_HEAD, F.col("seq").alias("end_seq")), _HEAD, "left"), folder, "containers")
    chains = levels.join(containers.select(*_HEAD, "bottom"), _HEAD).filter(F.col("depth") <= F.col("bottom")).select(
        *_HEAD, "depth", "bottom", "first", "n_convs", ((F.col("n_convs") - 1) * F.col("chars")).alias("own"))
    behind = full.select("seq", *_HEAD).join(containers.select(*_HEAD, "bottom", F.col("first").alias("above")), _HEAD)
    following = store.staged(paths.join(behind, "seq").filter(F.col("depth") == F.col("bottom") + 1), folder, "following")
    heads = store.staged(following.groupBy(*_HEAD, "tid").agg(
        F.min("seq").alias("conv_id"), F.max("depth").alias("depth"), F.sum("m").alias("n_convs"), F.max("chars").alias("chars"),
        F.max(F.when(F.col("n") == F.col("depth"), F.col("seq"))).alias("end_seq"),
        F.max(F.when(F.col("bottom") > F.col("head_depth"), F.col("above")).otherwise(F.col("head"))).alias("parent_conv_id"),
    ), folder, "heads")
    new = following.filter(F.col("n") > F.col("depth")).select(*_HEAD, "tid", "seq", "n", "m").join(
        heads.select(*_HEAD, "tid", "conv_id", "depth"), [*_HEAD, "tid"])
    return containers, chains, heads, new.select(F.col("conv_id").alias("head"), F.col("depth").alias("head_depth"), "seq", "n", "m")


def _under(nodes: DataFrame) -> DataFrame:
    return nodes.groupBy(*_HEAD).agg(F.count(F.lit(1)).alias("n_children"), *[F.sum(x).alias(x) for x in _TOTALS[1:]])


def _with_totals(heads: DataFrame, under: DataFrame) -> DataFrame:
    """Heads (conv_id, depth, own, ...) with the totals of their subtrees."""
    below = under.select(F.col("head").alias("conv_id"), F.col("head_depth").alias("depth"), *[F.col(x).alias(f"_{x}") for x in _TOTALS])
    return heads.join(below, ["conv_id", "depth"], "left").withColumns({
        "n_children": F.coalesce("_n_children", _long(0)), "n_leaves": F.coalesce("_n_leaves", _long(1)),
        "saved_tokens": F.col("own") + F.coalesce("_saved_tokens", _long(0)),
    }).drop("own", *[f"_{x}" for x in _TOTALS])


def trie_nodes(convs: DataFrame, turns: DataFrame, folder: str, capacity: int = CAPACITY) -> DataFrame:
    """A row for every node of the trie of (c, depth, tid, chars) sequences: conv_id (its smallest member), depth, parent_conv_id,
    n_convs, n_children, n_leaves, saved_tokens, ends_sha256. `convs` has every c, also those without turns."""
    sequences = store.staged(_sequences(convs, turns), folder, "sequences")
    paths = store.staged(turns.join(sequences.select(F.col("seq").alias("c"), "n", "m"), "c").withColumnRenamed("c", "seq"), folder, "paths")
    top = sequences.agg(F.min("seq").alias("conv_id"), F.sum("m").alias("n_convs"), F.max(F.when(F.col("n") == 0, F.col("seq"))).alias("end_seq"))
    root = top.filter("conv_id IS NOT NULL").select("conv_id", _long(0).alias("depth"), _long(None).alias("parent_conv_id"), "n_convs", _long(0).alias("own"), "end_seq")
    open_ = sequences.filter("n > 0").crossJoin(F.broadcast(root.select(F.col("conv_id").alias("head")))).select(  # one row
        "head", _long(0).alias("head_depth"), "seq", "n", "m")
    rounds, closed = [], []
    while True:
        sized = _sized(open_, capacity, folder)
        closed.append(sized.filter("NOT bursts").select("seq", *_HEAD))
        full = sized.filter("bursts")
        if full.isEmpty():
            break
        *made, open_ = _burst(paths, full, folder)
        rounds.append(made)
    held = closed[0]
    for more in closed[1:]:
        held = held.unionByName(more)
    rows = paths.join(held, "seq").filter(F.col("depth") > F.col("head_depth")).select(*_HEAD, "seq", "depth", "m", "tid", "chars")
    swept_nodes = rows.repartition(*_HEAD).sortWithinPartitions(*_HEAD, "seq", "depth").mapInArrow(
        _sweep, ", ".join(f"{x} long" for x in _SWEPT))
    swept_nodes = store.staged(swept_nodes, folder, "swept")
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", *_TOTALS, "end_seq"]
    found, under = [swept_nodes.select(columns)], _under(swept_nodes.filter(F.col("depth") == F.col("head_depth") + 1))
    for containers, chains, heads in reversed(rounds):
        own = heads.withColumn("own", (F.col("n_convs") - 1) * F.col("chars"))
        heads = store.staged(_with_totals(own, under), folder, "heads")
        found.append(heads.select(columns))
        behind = containers.join(_under(heads), _HEAD, "left").select(
            *_HEAD, "bottom", "first", "end_seq", F.coalesce("n_children", _long(0)).alias("n_children"),
            F.coalesce("n_leaves", _long(1)).alias("n_leaves"), F.coalesce("saved_tokens", _long(0)).alias("saved_tokens"))
        behind = store.staged(behind, folder, "behind")
        links = _chain_totals(chains, folder).join(behind.drop("bottom", "first"), _HEAD)
        at_end = F.col("depth") == F.col("bottom")
        links = store.staged(links.select(
            *_HEAD, F.col("first").alias("conv_id"), "depth",
            F.when(F.col("depth") == F.col("head_depth") + 1, F.col("head")).otherwise(F.col("first")).alias("parent_conv_id"), "n_convs",
            F.when(at_end, F.col("n_children")).otherwise(_long(1)).alias("n_children"), "n_leaves",
            (F.col("saved_tokens") + F.col("below")).alias("saved_tokens"), F.when(at_end, F.col("end_seq")).alias("end_seq")), folder, "links")
        found.append(links.select(columns))
        tops = links.filter(F.col("depth") == F.col("head_depth") + 1).select(*_HEAD, _long(1).alias("n_children"), *_TOTALS[1:])
        direct = behind.filter(F.col("bottom") == F.col("head_depth")).select(*_HEAD, *_TOTALS)
        under = under.unionByName(tops).unionByName(direct)
    nodes = _with_totals(root, under).select(columns)
    for more in found:
        nodes = nodes.unionByName(more)
    ends = sequences.select(F.col("seq").alias("end_seq"), "ends_sha256")
    return nodes.join(ends, "end_seq", "left").select(*columns[:-1], F.coalesce("ends_sha256", F.lit(_EMPTY_DIGEST)).alias("ends_sha256"))


def _chain_totals(chains: DataFrame, folder: str) -> DataFrame:
    """Chains with `below`: what they save from here to their bottom. No window holds a whole chain."""
    order = [F.col("head"), F.col("head_depth"), F.col("depth").desc()]
    summed = common.running_totals(chains, folder, order, {"total": F.col("own")})
    base = summed.groupBy(*_HEAD).agg(F.min(F.col("total") - F.col("own")).alias("base"))
    return summed.join(base, _HEAD).withColumn("below", F.col("total") - F.col("base")).drop("total", "base", "own")


def conversation_trie(conversations: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """The prefix trie of the rebuilt conversations (see `rebuilt`), a row for every node; see `trie_nodes` for the columns.

    Turns come by `turn`, NULL first, those of equal turn by their digest; repeated rows are turns of their own. NULL role or
    text counts as empty. Rows without conv_id belong to no conversation. An empty table gives no nodes, not even a root.
    Other columns are ignored. Conversations of equal turns are one sequence, so copies never fill a container; long runs
    that a container shares are one burst. The digest of the members that end in a node is sequential: their ids stream through one task.
    """
    folder = common.scratch(conversations.sparkSession)
    placed = store.staged(turn_ids(conversations, folder), folder, "placed")
    convs, turns = rebuilt(placed)
    return trie_nodes(store.staged(convs, folder, "convs"), store.staged(turns, folder, "turns"), folder, capacity)
