"""Amount summary, outliers, vendor trend and vendor variance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tallyspark.functions import fixed_values as fv
from tallyspark.functions.quantiles import exact_percentiles, melt
from tallyspark.functions.values import either_part, exact_mean, exact_parts, exact_sum, merged_parts
from tallyspark.operators.ledger import params_with, with_values


def _amounts(ledger: DataFrame) -> DataFrame:
    return with_values(ledger, ["amount"])


def amount_summary(ledger: DataFrame, params: dict | None = None) -> DataFrame:
    """One row of count, mean, median, std, min, max, p95, p99, outlier counts and fences; none without amounts."""
    long = melt(_amounts(ledger), ["amount"])
    basics = long.groupBy("column").agg(
        F.count("value").alias("count"), F.avg("value").alias("mean"),
        F.coalesce(F.stddev_samp("value"), F.lit(0.0)).alias("std"),
        F.min("value").alias("min"), F.max("value").alias("max"),
    )
    ranks = exact_percentiles(long, {"q1": 0.25, "median": 0.5, "q3": 0.75, "p95": 0.95, "p99": 0.99})
    reach = (F.col("q3") - F.col("q1")) * fv.IQR_FENCE
    known = basics.join(ranks, "column").withColumns(
        {"iqr_lower_fence": F.col("q1") - reach, "iqr_upper_fence": F.col("q3") + reach}
    )
    value, z = F.col("value"), F.try_divide(F.col("value") - F.col("mean"), F.col("std"))
    far = F.abs(z) > params_with(params)["outlier_zscore_threshold"]
    outside = (value < F.col("iqr_lower_fence")) | (value > F.col("iqr_upper_fence"))
    facts = ["count", "mean", "median", "std", "min", "max", "p95", "p99"]
    fences = ["iqr_lower_fence", "iqr_upper_fence"]
    first = [F.any_value(c).alias(c) for c in facts + fences]
    return (
        long.join(F.broadcast(known), "column")  # one row per column
        .groupBy("column").agg(
            *first, F.count_if(far).alias("outliers_zscore_count"), F.count_if(outside).alias("outliers_iqr_count")
        )
        .select(*facts, "outliers_zscore_count", "outliers_iqr_count", *fences)
    )


def amount_moments(ledger: DataFrame) -> DataFrame:
    """Bias-corrected skewness (n > 2) and excess kurtosis (n > 3), else 0."""
    n, g1, g2 = F.col("n"), F.col("g1"), F.col("g2")
    raw = _amounts(ledger).agg(
        F.count("amount").cast("double").alias("n"), F.skewness("amount").alias("g1"), F.kurtosis("amount").alias("g2")
    )
    skew = F.when(n > 2, g1 * F.sqrt(n * (n - 1)) / (n - 2))
    kurt = F.when(n > 3, (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * g2 + 6))
    zero = F.lit(0.0)
    return raw.select(
        F.coalesce(F.when(g1.isNotNull(), skew), zero).alias("skewness"),
        F.coalesce(F.when(g2.isNotNull(), kurt), zero).alias("kurtosis"),
    )


def _long_rows(ledger: DataFrame) -> DataFrame:
    """(row_index, column, value), so that statistics join their rows on the column name."""
    return _amounts(ledger).select("row_index", "amount").unpivot("row_index", "amount", "column", "value")


def zscore_outliers(ledger: DataFrame, params: dict | None = None) -> DataFrame:
    """Rows more than the given number of standard deviations from the mean."""
    rows = _long_rows(ledger)
    spread = rows.groupBy("column").agg(F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"))
    z = F.try_divide(F.col("value") - F.col("mean"), F.col("std"))
    return (
        rows.join(F.broadcast(spread), "column")  # one row per column
        .select("row_index", F.col("value").alias("amount"), z.alias("zscore"))
        .filter(F.abs("zscore") > params_with(params)["outlier_zscore_threshold"])
    )


def iqr_outliers(ledger: DataFrame) -> DataFrame:
    """Rows outside the quartile fences, with the fences."""
    rows = _long_rows(ledger)
    parts = exact_percentiles(rows.select("column", "value"), {"q1": 0.25, "q3": 0.75})
    reach = (F.col("q3") - F.col("q1")) * fv.IQR_FENCE
    fences = parts.select("column", (F.col("q1") - reach).alias("lower_fence"), (F.col("q3") + reach).alias("upper_fence"))
    return (
        rows.join(F.broadcast(fences), "column")  # one row per column
        .filter((F.col("value") < F.col("lower_fence")) | (F.col("value") > F.col("upper_fence")))
        .select("row_index", F.col("value").alias("amount"), "lower_fence", "upper_fence")
    )


def _month() -> Column:
    return F.date_format("date", "yyyy-MM").alias("month")


def vendor_monthly(ledger: DataFrame) -> DataFrame:
    return (
        with_values(ledger, ["vendor", "amount", "date"])
        .groupBy("vendor", _month()).agg(exact_sum(F.col("amount")).alias("total"))
    )


def top_vendors(ledger: DataFrame, n: int = fv.TOP_VENDORS) -> DataFrame:
    """Vendors with the largest absolute spend over dated rows."""
    return (
        with_values(ledger, ["vendor", "amount", "date"])
        .groupBy("vendor").agg(exact_sum(F.abs("amount")).alias("spend"))
        .orderBy(F.desc("spend"), "vendor").limit(n)
    )


def vendor_trend(ledger: DataFrame) -> DataFrame:
    """Monthly totals of the top vendors and the change against the previous month present.

    A change from a zero month is infinite with the sign of the new total.
    """
    top = F.broadcast(top_vendors(ledger).select("vendor"))  # at most TOP_VENDORS rows
    now, before = F.col("total"), F.col("_before")
    change = F.when(before != 0, F.try_divide(now - before, before)).when(
        now != 0, F.signum(now) * F.lit(float("inf"))
    )
    return (
        vendor_monthly(ledger).join(top, "vendor", "left_semi")
        .withColumn("_before", F.lag("total").over(W.partitionBy("vendor").orderBy("month")))
        .select("vendor", "month", "total", F.when(before.isNotNull(), change * 100).alias("pct_change"))
    )


def vendor_spikes(ledger: DataFrame) -> DataFrame:
    return vendor_trend(ledger).filter(F.abs("pct_change") > fv.SPIKE_PCT).select("vendor", "month", "pct_change")


def vendor_variance(ledger: DataFrame, n: int = fv.TOP_VENDORS) -> DataFrame:
    """Mean amount of a vendor against the overall mean, for the vendors with the highest means."""
    known = with_values(ledger, ["vendor", "amount"])
    exact, loose = exact_parts(F.col("amount"))
    totals = known.groupBy("vendor").agg(exact.alias("_exact"), loose.alias("_loose"), F.count(F.lit(1)).alias("_n"))
    parts = F.col("_exact"), F.col("_loose")
    overall = totals.agg(F.try_divide(either_part(*merged_parts(*parts)), F.sum("_n"))).scalar()
    deviation = F.coalesce(F.try_divide(F.col("vendor_mean") - F.col("overall_mean"), F.col("overall_mean")), F.lit(0.0))
    return (
        totals.select("vendor", F.try_divide(either_part(*parts), F.col("_n")).alias("vendor_mean"))
        .orderBy(F.desc("vendor_mean"), "vendor").limit(n)
        .withColumn("overall_mean", overall)
        .withColumn("deviation_pct", deviation * 100)
    )


def vendor_summary(ledger: DataFrame, vendor: str | None = None) -> DataFrame:
    """Count, spend and date range of one vendor, or of all of them."""
    rows = with_values(ledger, ["vendor"])
    if vendor is not None:
        rows = rows.filter(F.col("vendor") == str(vendor))
    return rows.groupBy("vendor").agg(
        F.count(F.lit(1)).alias("transaction_count"),
        exact_sum(F.col("amount")).alias("total_spend"), exact_mean(F.col("amount")).alias("avg_amount"),
        F.min("amount").alias("min_amount"), F.max("amount").alias("max_amount"),
        F.min("date").alias("first_date"), F.max("date").alias("last_date"),
    )
