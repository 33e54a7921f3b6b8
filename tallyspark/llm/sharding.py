"""A uniform shuffle into shards of exact sizes by a hypergeometric communication matrix.

Rows are counted in the partitions in which they are read. How many rows every partition sends to every shard is drawn
from the multivariate hypergeometric law, the law of a uniform permutation. Partitions permute their rows and deal them
out by these counts, and each shard permutes what it has received. All of it is SQL functions.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tallyspark.llm import common
from tallyspark.sources import store

SHARDS, SEED = 16, 29
#: Partitions below one node of the tree over which the matrix is drawn.
FAN_OUT = 16
#: Low bits of monotonically_increasing_id: the place in its partition.
PLACE_BITS = 33


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of a value that is computed once."""
    return F.transform(F.array(value), body)[0]


def _whole_range(first: Column, last: Column, step: int) -> Column:
    """first, first + step, ..., last; nothing where last lies before first."""
    there = last >= first if step > 0 else last <= first
    return F.when(there, F.sequence(first, F.when(there, last).otherwise(first), F.lit(step).cast("bigint"))).otherwise(F.array().cast("array<bigint>"))


def hypergeometric(total: Column, good: Column, n: Column, u: Column) -> Column:
    """How many of `n` rows drawn from `total`, of which `good` are marked, are marked; by inversion of `u` in [0, 1).

    Probabilities relative to that of the mode follow from their ratios, upwards and downwards from it. They are summed
    over the support, or 10 standard deviations and 40 around the mode: what lies beyond has less than 1e-20 in all,
    which the 53 bits of `u` cannot tell from nothing.
    """
    lo, hi = F.greatest(F.lit(0).cast("bigint"), n - (total - good)), F.least(n, good)
    share = F.coalesce(F.try_divide(good, total), F.lit(0.0))
    spread = F.sqrt(n * share * (1 - share) * (total - n) / F.greatest(total - 1, F.lit(1)))
    middle = F.floor((n + F.lit(1.0)) * (good + F.lit(1.0)) / (total + F.lit(2.0)))
    place = F.struct(lo.alias("lo"), hi.alias("hi"), F.greatest(lo, F.least(hi, middle)).alias("mode"), F.ceil(10 * spread + 40).alias("reach"))

    def drawn(v: Column) -> Column:
        mode = v["mode"]
        last, first = F.least(v["hi"], mode + v["reach"]), F.greatest(v["lo"], mode - v["reach"])
        ups, downs = _whole_range(mode + 1, last, 1), _whole_range(mode - 1, first, -1)
        up = lambda w, j: w * (good - j + 1) * (n - j + 1) / (j * (total - good - n + j).cast("double"))
        down = lambda w, j: w * (j + 1) * (total - good - n + j + 1) / ((good - j) * (n - j).cast("double"))

        def summed(values, ratio):
            start = F.struct(F.lit(1.0).alias("w"), F.lit(0.0).alias("sum"))
            return F.aggregate(values, start, lambda a, j: _let(
                ratio(a["w"], j), lambda w: F.struct(w.alias("w"), (a["sum"] + w).alias("sum"))), lambda a: a["sum"])

        def found(values, ratio, left, otherwise):
            start = F.struct(F.lit(1.0).alias("w"), left.alias("left"), F.lit(None).cast("bigint").alias("k"))
            return F.aggregate(values, start, lambda a, j: _let(ratio(a["w"], j), lambda w: F.struct(
                w.alias("w"), (a["left"] - w).alias("left"), F.coalesce(a["k"], F.when(a["left"] < w, j)).alias("k"))),
                lambda a: F.coalesce(a["k"], otherwise))

        sums = F.struct(summed(ups, up).alias("up"), summed(downs, down).alias("down"))
        return _let(sums, lambda s: _let(u * (1 + s["up"] + s["down"]), lambda t: (
            F.when(t < 1, mode).when(t < 1 + s["up"], found(ups, up, t - 1, last))
            .otherwise(found(downs, down, t - 1 - s["up"], first)))))

    return _let(place, drawn)


def _uniform(*parts: Column) -> Column:
    return F.xxhash64(*parts).bitwiseAND(F.lit(2**53 - 1)) / F.lit(float(2**53))


def _split(kids: Column, room: Column, seed: Column) -> Column:
    """Deal the free places of every shard out to the parts below a node, one part after the other, shard by shard."""

    def part(state: Column, kid: Column) -> Column:
        def shard(s: Column, i: Column) -> Column:
            free = F.get(state["room"], i)
            u = _uniform(seed, kid["node"], i.cast("bigint"))
            return _let(hypergeometric(s["rest"], free, s["need"], u), lambda k: F.struct(
                F.concat(s["taken"], F.array(k)).alias("taken"), (s["need"] - k).alias("need"), (s["rest"] - free).alias("rest")))

        rest = F.aggregate(state["room"], F.lit(0).cast("bigint"), lambda a, x: a + x)
        start = F.struct(F.array().cast("array<bigint>").alias("taken"), kid["n"].alias("need"), rest.alias("rest"))
        taken = F.aggregate(F.sequence(F.lit(0), F.size(state["room"]) - 1), start, shard, lambda s: s["taken"])
        return _let(taken, lambda k: F.struct(
            F.zip_with(state["room"], k, lambda a, b: a - b).alias("room"),
            F.concat(state["dealt"], F.array(F.struct(kid["node"].alias("node"), k.alias("room")))).alias("dealt")))

    start = F.struct(room.alias("room"), F.array().cast("array<struct<node:bigint,room:array<bigint>>>").alias("dealt"))
    return F.aggregate(kids, start, part, lambda s: s["dealt"])


def communication_matrix(counts: DataFrame, sizes: list[int], seed: int = SEED) -> DataFrame:
    """(part, sent): for every row (part, n) of `counts` an array of how many of its rows go to each shard.

    The sums over the parts are `sizes`, those over the shards are n. Parts form a tree with `FAN_OUT` below each node;
    a node deals its places out to the nodes below it, so the levels are few and all nodes of a level are drawn
    side by side.
    """
    numbered = counts.select("part", "n", (F.row_number().over(W.orderBy("part")) - 1).cast("bigint").alias("node"))
    nodes, left, levels = numbered.select("node", "n"), counts.count(), []
    while not levels or left > 1:
        parent = F.floor(F.col("node") / FAN_OUT).alias("parent")
        kids = nodes.groupBy(parent).agg(F.sort_array(F.collect_list(F.struct("node", "n"))).alias("kids"), F.sum("n").alias("n"))
        levels.append(kids)
        nodes, left = kids.select(F.col("parent").alias("node"), "n"), -(-left // FAN_OUT)
    room = F.array(*[F.lit(x).cast("bigint") for x in sizes])
    drawn = nodes.select("node", room.alias("room"))
    for i, kids in enumerate(reversed(levels)):
        dealt = F.explode(_split(F.col("kids"), F.col("room"), F.lit(seed * 1000 + i)))
        drawn = kids.drop("n").join(drawn, F.col("parent") == F.col("node")).select(dealt.alias("dealt")).select("dealt.*")
    return numbered.join(drawn, "node").select("part", F.col("room").alias("sent"))


def _places(df: DataFrame) -> DataFrame:
    """_part and _rank: the partition of a row and its place there."""
    return df.withColumns({
        "_part": F.shiftright("_place", PLACE_BITS), "_rank": F.col("_place").bitwiseAND(F.lit(2**PLACE_BITS - 1)),
    })


def shard_rows(rows: DataFrame, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """The rows with `shard` (int, from 0) and `slot` (long, gapless from 0 in its shard): a uniform random permutation.

    Sizes of shards differ by one row at most. Which permutation it is depends on the seed, on the rows and on the partitions
    in which Spark reads them; equal rows may change places. A column of the input that is named shard or slot gives way.
    NULLs are values like others, an empty table gives no rows. One exchange by shard moves the rows; a shard is range-split
    by its second draw, so no task gets a whole one.
    """
    folder = common.scratch(rows.sparkSession)
    packed = rows.select(F.struct(*[F.col(f"`{c}`") for c in rows.columns if c not in ("shard", "slot")]).alias("_row"))
    permuted = packed.withColumn("_draw", F.xxhash64(F.lit(seed), F.col("_row"))).sortWithinPartitions("_draw")
    local = _places(store.staged(permuted.select("_row", F.monotonically_increasing_id().alias("_place")), folder, "local"))
    counts = store.staged(local.groupBy(F.col("_part").alias("part")).agg(F.count(F.lit(1)).alias("n")), folder, "counts")
    total = counts.agg(F.sum("n")).first()[0] or 0
    sizes = [total // shards + (i < total % shards) for i in range(shards)]
    sent = store.staged(communication_matrix(counts, sizes, seed), folder, "sent")
    ends = F.transform("sent", lambda _, i: F.aggregate(F.slice("sent", 1, i + 1), F.lit(0).cast("bigint"), lambda a, x: a + x))
    ends = sent.select(F.col("part").alias("_part"), ends.alias("_ends"))
    dealt = local.join(ends, "_part").select(
        "_row", F.size(F.filter("_ends", lambda e: e <= F.col("_rank"))).alias("shard"),
        F.xxhash64(F.lit(seed + 1), F.col("_place")).alias("_draw"), F.col("_place").alias("_was"),
    )
    order = ["shard", "_draw", "_was"]
    again = dealt.repartitionByRange(*order).sortWithinPartitions(*order).select("_row", "shard", F.monotonically_increasing_id().alias("_place"))
    again = _places(store.staged(again, folder, "exchanged"))
    before = F.coalesce(F.sum("n").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    offsets = again.groupBy("_part").agg(F.count(F.lit(1)).alias("n")).select("_part", before.alias("_before"))
    starts = F.array(*[F.lit(sum(sizes[:i])).cast("bigint") for i in range(shards)])
    slot = F.col("_before") + F.col("_rank") - F.get(starts, F.col("shard"))
    return again.join(store.staged(offsets, folder, "offsets"), "_part").select("_row.*", "shard", slot.alias("slot"))


def write_shards(rows: DataFrame, folder: str, shards: int = SHARDS, seed: int = SEED) -> None:
    """The shuffled rows as Parquet, a folder for each shard; its files, by name, hold the slots in ascending order."""
    found = shard_rows(rows, shards, seed)
    found.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(folder)


def shard_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shards: int = SHARDS) -> DataFrame:
    """Per document: id, size (UTF-8 bytes and 1), text_crc32, law (`rows`), shard, slot, grown_shard (NULL under this law).

    A NULL text has no bytes. Every row takes part, also repeated ids and rows without an id. Other columns are ignored.
    """
    data = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    narrow = docs.select(F.col(id_col), (F.octet_length(data) + 1).cast("bigint").alias("size"), F.crc32(data).alias("text_crc32"))
    return shard_rows(narrow, shards).select(
        id_col, "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
