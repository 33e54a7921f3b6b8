"""Mixing sources to target weights by Sainte-Laguë apportionment; columns and SQL functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tallyspark.llm import common
from tallyspark.sources import store

#: Words of a block inside a shard; the mix takes whole blocks but for the last one of a shard.
BLOCK_WORDS = 64
#: Words of a shard of one source, about. Orders within a shard are the only windows over documents.
SHARD_WORDS = 4_000_000
MOST_PASSES = 3


def source_targets(sized: DataFrame, folder: str, weights: int = 3, most: int = MOST_PASSES) -> DataFrame:
    """(source, source_size, ordinal, weight, target) of every source of `sized` (source, size).

    Sources in code point order, NULL last, weigh 1 to `weights`, repeating. Targets add up to the size of all
    sources; one that would exceed `most` times its source stops there and the excess goes to the others by
    weight. With sources in order of cap / weight, the stopped ones come first and the rest share one rate.
    """
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = [F.col("source").isNull(), F.col("source")]
    numbered = common.running_totals(sources, folder, order, {"ordinal": F.lit(1)})
    numbered = numbered.withColumn("weight", (F.col("ordinal") - 1) % weights + 1)
    numbered = store.staged(numbered.withColumn("cap", F.col("source_size") * most), folder, "sources")
    by_ratio = [F.col("cap") / F.col("weight"), F.col("ordinal")]
    filled = common.running_totals(
        numbered, folder, by_ratio, {"caps": F.col("cap"), "weights": F.col("weight"), "place": F.lit(1)}
    )
    total = numbered.agg(F.sum("source_size").alias("all_size"), F.sum("weight").alias("all_weight"))
    rate = (F.col("all_size") - F.col("caps") + F.col("cap")) / (F.col("all_weight") - F.col("weights") + F.col("weight"))
    rates = filled.join(F.broadcast(total)).withColumn("rate", rate)  # one row
    free = rates.filter(F.col("rate") * F.col("weight") <= F.col("cap"))
    free = free.agg(F.min(F.struct("place", "rate")).alias("first")).select(F.col("first.rate").alias("rate"))
    return numbered.join(F.broadcast(free)).select(
        "source", "source_size", "ordinal", "weight",
        F.least(F.col("cap").cast("double"), F.coalesce(F.col("rate") * F.col("weight"), F.lit(0.0))).alias("target"),
    )


def apportion(units: DataFrame, folder: str, group: str | None, unit: str, weight: str, seats: str) -> DataFrame:
    """Sainte-Laguë: `seats` places of each group go to the highest quotients weight / (2 k + 1); adds `quota`.

    Half-way rounding moves a unit by at most half a seat plus its share of half a seat per unit, so all places
    below that margin are granted at once and only the few quotients around it are ranked. Ties go to the
    smaller unit; units without weight get nothing.
    """
    keys = [group] if group else []
    live = units.filter(F.col(weight) > 0)
    totals = live.groupBy(*keys).agg(F.sum(weight).alias("_sum"), F.count(F.lit(1)).alias("_n"))
    joined = live.join(totals, keys) if group else live.join(F.broadcast(totals))  # one row
    share = F.col(weight) / F.col("_sum")
    near = F.col("_n") * share / 2 + 1
    sure = F.greatest(F.lit(0), F.floor(F.col(seats) * share - near)).cast("long")
    last = F.ceil(F.col(seats) * share + near).cast("long")
    joined = store.staged(joined.select(*keys, unit, weight, seats, sure.alias("sure"), last.alias("last")), folder, "units")
    open_seats = joined.groupBy(*keys).agg((F.max(seats) - F.sum("sure")).alias("open"))
    offers = joined.select(*keys, unit, weight, F.explode(F.sequence("sure", "last")).alias("k"))
    offers = offers.withColumn("quotient", F.col(weight) / (2 * F.col("k") + 1))
    order = [F.desc("quotient"), F.asc(unit), F.asc("k")]
    if group:
        ranked = offers.withColumn("place", F.row_number().over(W.partitionBy(group).orderBy(*order)))
        won = ranked.join(open_seats, group)
    else:
        won = common.running_totals(offers, folder, order, {"place": F.lit(1)}).join(F.broadcast(open_seats))  # one row
    won = won.filter("place <= open").groupBy(*keys, unit).agg(F.count(F.lit(1)).alias("won"))
    quota = (F.coalesce("sure", F.lit(0)) + F.coalesce("won", F.lit(0))).cast("long")
    mine = joined.select(*keys, unit, "sure")
    return units.join(mine, [*keys, unit], "left").join(won, [*keys, unit], "left").withColumn("quota", quota).drop("sure", "won")


def _hash(seed: int, *parts: Column) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]))


def mix_plan(
    sized: DataFrame, folder: str, seed: int = 17, block_words: int = BLOCK_WORDS, shard_words: int = SHARD_WORDS
) -> DataFrame:
    """What the mix takes of every row of `sized` (row, id, source, size).

    Adds source_size, target, passes (whole copies), ranges (of words, as arrays of start and length, taken once more)
    and taken. A source is dealt to shards by hash, and the words of a shard form one sequence in seeded order. Sources
    get words by Sainte-Laguë, then so do the shards of a source: seats of one word, so that the smallest source comes as
    near its target as the largest. A shard repeats its whole sequence as often as its quota allows and takes the rest as
    blocks of `block_words` in seeded order, the last one cut to the exact number.
    """
    targets = store.staged(source_targets(sized, folder), folder, "targets")
    words = targets.agg(F.round(F.sum("target")).cast("long").alias("seats"))
    sources = apportion(targets.join(F.broadcast(words)), folder, None, "ordinal", "target", "seats")  # one row
    sources = store.staged(
        sources.withColumn("shards", F.greatest(F.lit(1), F.ceil(F.col("source_size") / shard_words)).cast("long")),
        folder, "quotas",
    ).select("source", "ordinal", "source_size", "target", "shards", F.col("quota").alias("due"))
    named = sources.withColumnRenamed("source", "_source")
    dealt = sized.join(named, F.col("source").eqNullSafe(F.col("_source")), "left").withColumn("order", _hash(seed, F.col("id")))
    shard = F.pmod(F.conv(F.substring("order", 1, 15), 16, 10).cast("long"), F.col("shards"))
    dealt = store.staged(dealt.withColumn("shard", shard).drop("_source"), folder, "dealt")

    shards = dealt.groupBy("ordinal", "shard").agg(F.sum("size").alias("words"), F.max("due").alias("due"))
    shards = apportion(shards, folder, "ordinal", "shard", "words", "due")
    quota = F.least(F.col("quota"), F.col("words") * MOST_PASSES)
    shards = store.staged(
        shards.withColumn("passes", F.when(F.col("words") > 0, F.floor(quota / F.col("words"))).otherwise(0).cast("long"))
        .withColumn("rest", quota - F.col("passes") * F.col("words"))
        .select("ordinal", "shard", "words", "passes", "rest"),
        folder, "shards",
    )
    per_shard = W.partitionBy("ordinal", "shard")
    opened = shards.filter("rest > 0").withColumn(
        "block", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("words") - 1) / block_words)))
    ).withColumns({
        "n": F.least(F.lit(block_words).cast("long"), F.col("words") - F.col("block") * block_words),
        "draw": _hash(seed, F.col("ordinal"), F.col("shard"), F.col("block")),
    })
    seen = F.sum("n").over(per_shard.orderBy("draw", "block").rowsBetween(W.unboundedPreceding, 0))
    drawn = opened.withColumn("n", F.least(F.col("n"), F.col("rest") - seen + F.col("n"))).filter("n > 0")
    # Written, so that joins know its size: estimates take a generated table for as small as its source and broadcast it.
    drawn = store.staged(drawn.select("ordinal", "shard", "block", "n"), folder, "drawn")

    end = F.sum("size").over(per_shard.orderBy("order", "id", "row").rowsBetween(W.unboundedPreceding, 0))
    placed = store.staged(
        dealt.withColumn("at", end - F.col("size")).join(shards.select("ordinal", "shard", "passes"), ["ordinal", "shard"], "left"),
        folder, "placed",
    )
    spans = placed.filter("size > 0").select(
        "row", "ordinal", "shard", "at", "size",
        F.explode(F.sequence(F.floor(F.col("at") / block_words), F.floor((F.col("at") + F.col("size") - 1) / block_words))).alias("block"),
    ).join(drawn, ["ordinal", "shard", "block"])
    first = F.greatest(F.col("at"), F.col("block") * block_words)
    length = F.least(F.col("at") + F.col("size"), F.col("block") * block_words + F.col("n")) - first
    spans = spans.withColumn("first", first - F.col("at")).withColumn("length", length).filter("length > 0")
    extra = spans.groupBy("row").agg(
        F.sum("length").alias("extra"), F.sort_array(F.collect_list(F.array("first", "length"))).alias("ranges")
    )
    passes = F.coalesce("passes", F.lit(0))
    return placed.join(extra, "row", "left").select(
        "row", "id", "source", "size", "source_size", "target", passes.alias("passes"), "ranges",
        (passes * F.col("size") + F.coalesce("extra", F.lit(0))).cast("long").alias("taken"),
    )


def _sized(docs: DataFrame, id_col: str, text_col: str, source_col: str, *more: Column) -> DataFrame:
    size = F.regexp_count(F.coalesce(text_col, F.lit("")), F.lit(common.WORD)).cast("long")
    return docs.select(
        F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("id"), F.col(source_col).alias("source"),
        size.alias("size"), *more,
    )


def mix_sources(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options: int
) -> DataFrame:
    """One row per row of `docs`: id, size, source_size, target (of its source), taken.

    A NULL or blank text has size 0 and nothing is taken of it. Repeated rows count each on their own. A NULL source
    is a source of its own, the last. Extra columns are ignored; an empty table gives no rows. `options`: see mix_plan.
    """
    folder = common.scratch(docs.sparkSession)
    sized = store.staged(_sized(docs, id_col, text_col, source_col), folder, "sized")
    plan = mix_plan(sized, folder, **options)
    return plan.select(F.col("id").alias(id_col), "size", "source_size", "target", "taken")


def mixed_documents(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options: int
) -> DataFrame:
    """`docs` as the mix takes them, same columns: texts of which nothing is taken go, the others hold exactly the
    taken words: the text itself for every pass, then the drawn ranges of words, parts separated by a line break."""
    folder = common.scratch(docs.sparkSession)
    whole = store.staged(_sized(docs, id_col, text_col, source_col, F.struct("*").alias("doc")), folder, "texts")
    plan = mix_plan(whole.select("row", "id", "source", "size"), folder, **options).filter("taken > 0")
    taken = whole.select("row", "doc").join(plan.select("row", "passes", "ranges"), "row")
    text = F.col("doc").getField(text_col)
    words = F.regexp_extract_all(text, F.lit(common.WORD), F.lit(0))
    drawn = F.transform("ranges", lambda r: F.concat_ws(" ", F.slice(words, (r[0] + 1).cast("int"), r[1].cast("int"))))
    copies = F.array_repeat(text, F.col("passes").cast("int"))
    mixed = F.when(F.col("ranges").isNull() & (F.col("passes") == 1), text).otherwise(
        F.concat_ws("\n", copies, F.coalesce(drawn, F.array().cast("array<string>")))
    )
    return taken.withColumn("_mixed", mixed).select("doc.*", "_mixed").withColumn(text_col, F.col("_mixed")).drop("_mixed")
