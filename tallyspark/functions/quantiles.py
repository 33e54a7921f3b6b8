"""Exact percentiles without gathering the values of a column in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tallyspark.functions.names import col

_STEPS = 10  # 2**10 value ranges per column
_CUTS = 2**_STEPS - 1


def melt(df: DataFrame, columns: list[str], name: str = "column", value: str = "value") -> DataFrame:
    """Columns of one type to (column, value) rows."""
    return df.unpivot([], [col(c) for c in columns], name, value)


def _cut_shares() -> Column:
    """Evenly spaced shares as one constant (an array of a thousand literals is slow to analyze)."""
    shares = ",".join(str(i / (_CUTS + 1)) for i in range(1, _CUTS + 1))
    return F.split(F.lit(shares), ",").cast("array<double>")


def exact_percentiles(long: DataFrame, percents: dict[str, float], name: str = "column", value: str = "value"):
    """One row per `name` with linearly interpolated percentiles of `value`.

    Values are counted per distinct value first (hot values collapse map-side).
    Approximate cut points split the distinct values into about a thousand ranges;
    range totals say which range holds each wanted rank, and only those ranges are
    ordered. Cut points affect balance only, never the result.
    """
    counts = long.filter(F.col(value).isNotNull()).groupBy(name, value).agg(F.count(F.lit(1)).alias("n"))
    # Reads the same columns of `counts` as the ranges do, so the shuffle is planned once.
    cuts = counts.groupBy(name).agg(
        F.percentile_approx(value, _cut_shares(), 4 * (_CUTS + 1)).alias("_cuts"), F.sum("n").alias("_all")
    )
    ranged = counts.join(F.broadcast(cuts), name).withColumn("_range", F.lit(0))
    for step in reversed(range(_STEPS)):
        probe = F.get(F.col("_cuts"), F.col("_range") + (2**step - 1))
        ranged = ranged.withColumn("_range", F.col("_range") + F.when(F.col(value) > probe, 2**step).otherwise(0))
    ranged = ranged.select(name, value, "n", "_all", "_range")

    # At most a thousand ranges per column, so their totals fit one row.
    totals = (
        ranged.groupBy(name, "_range", "_all").agg(F.sum("n").alias("_in"))
        .groupBy(name, "_all").agg(F.sort_array(F.collect_list(F.struct("_range", "_in"))).alias("_ranges"))
    )
    before = F.transform("_ranges", lambda r, i: F.struct(
        r["_range"].alias("_range"), r["_in"].alias("_in"),
        F.aggregate(F.slice("_ranges", 1, i), F.lit(0).cast("bigint"), lambda acc, x: acc + x["_in"]).alias("_before"),
    ))
    wanted = F.array(*[
        F.struct(
            F.lit(key).alias("_key"),
            F.lit(side).alias("_side"),
            rank((F.col("_all") - 1) * F.lit(p)).cast("bigint").alias("_rank"),
        )
        for key, p in percents.items()
        for side, rank in (("lo", F.floor), ("hi", F.ceil))
    ])
    held = F.filter("_every", lambda w: (w["_rank"] >= F.col("_before")) & (w["_rank"] < F.col("_before") + F.col("_in")))
    picks = (
        totals.select(name, wanted.alias("_every"), F.inline(before))
        .select(name, "_range", "_before", held.alias("_wanted"))
        .filter(F.size("_wanted") > 0)
    )

    # At most two ranks per percentile and column, so `picks` is a handful of rows.
    upto = F.sum("n").over(W.partitionBy(name, "_range").orderBy(value)) + F.col("_before")
    found = (
        ranged.join(F.broadcast(picks), [name, "_range"])
        .withColumn("_upto", upto)
        .withColumn("_w", F.explode("_wanted"))
        .filter((F.col("_w._rank") >= F.col("_upto") - F.col("n")) & (F.col("_w._rank") < F.col("_upto")))
        .select(name, value, "_all", "_w.*")
    )

    def at(key: str, side: str):
        return F.max(F.when((F.col("_key") == key) & (F.col("_side") == side), F.col(value)))

    def interpolated(key: str, p: float):
        share = (F.max("_all") - 1) * F.lit(p)
        return at(key, "lo") + (at(key, "hi") - at(key, "lo")) * (share - F.floor(share))

    return found.groupBy(name).agg(*[interpolated(k, p).alias(k) for k, p in percents.items()])
