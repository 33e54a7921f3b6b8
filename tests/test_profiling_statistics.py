import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tallyspark.functions.quantiles import exact_percentiles, melt
from tallyspark.functions.skew import salted_join
from tallyspark.operators import profiling, statistics
from tallyspark.operators.ledger import narrow

PERCENTS = {"q1": 0.25, "median": 0.5, "q3": 0.75, "p95": 0.95, "p99": 0.99, "low": 0.0, "high": 1.0}


@pytest.mark.parametrize("n,kind", [(1, "u"), (2, "u"), (3, "u"), (500, "u"), (500, "ties"), (5000, "u"), (3000, "wide")])
def test_percentiles_are_exact(spark, n, kind):
    rng = random.Random(n)
    draw = {"u": lambda: rng.uniform(-5, 5), "ties": lambda: float(rng.choice([1, 2, 2, 2, 9])),
            "wide": lambda: rng.choice([-1, 1]) * 10 ** rng.uniform(-6, 12)}[kind]
    xs = [draw() for _ in range(n)]
    df = spark.createDataFrame([(x, None) for x in xs] + [(None, 1.0)], "x double, y double")
    got = {r["column"]: r.asDict() for r in exact_percentiles(melt(df, ["x", "y"]), PERCENTS).collect()}
    for name, p in PERCENTS.items():
        assert math.isclose(got["x"][name], np.percentile(xs, p * 100), rel_tol=1e-12, abs_tol=1e-12)
        assert got["y"][name] == 1.0


def test_percentiles_of_nothing(spark):
    assert exact_percentiles(spark.createDataFrame([], "column string, value double"), PERCENTS).collect() == []


@pytest.mark.parametrize("slice_rows", [1, 3, 1000])
def test_salted_join_equals_join(spark, slice_rows):
    rows = spark.range(200).select(F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 7).alias("k"), "id")
    groups = spark.createDataFrame([(0, "a"), (0, "b"), (3, "c"), (9, "d")], "k bigint, g string")
    sizes = rows.groupBy("k").count()
    got = salted_join(rows, groups, ["k"], sizes, "count", F.col("id"), slice_rows).select("k", "id", "g")
    want = rows.join(groups, "k").select("k", "id", "g")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_profile(spark, make):
    df = make(vendor=["A", "B", "A", None], amount=[1, 2, None, None], date=["2024-01-01", None, "2024-01-03", None], entry_date=[None] * 4)
    columns = {r["column"]: r for r in profiling.profile_columns(df).collect()}
    assert (columns["vendor"]["type"], columns["vendor"]["null_count"], columns["vendor"]["unique_count"]) == ("text", 1, 2)
    assert (columns["amount"]["type"], columns["amount"]["null_pct"]) == ("numeric", 50.0)
    assert (columns["entry_date"]["type"], columns["entry_date"]["null_pct"], columns["entry_date"]["unique_count"]) == ("date", 100.0, 0)
    approx = {r["column"]: r["unique_count"] for r in profiling.profile_columns(df, approx=True).collect()}
    assert approx["vendor"] == 2
    whole = profiling.profile_dataset(profiling.profile_columns(df)).first()
    assert tuple(whole) == (4, 4, 43.75)
    quality = profiling.quality_summary(profiling.profile_columns(df)).first()
    assert tuple(quality) == (9, 4, 100.0)
    numeric = profiling.profile_numeric(df).first()
    assert tuple(numeric) == ("amount", 1.5, 1.5, pytest.approx(0.7071067811865476), 1.0, 2.0)
    assert profiling.profile_numeric(make(amount=[3])).first()["std"] == 0.0
    assert [r["column"] for r in profiling.profile_dates(df).collect()] == ["date"]
    samples = [tuple(r) for r in profiling.profile_samples(df).orderBy("column", "position").collect()]
    assert samples[:2] == [("amount", 1, "1.0"), ("amount", 2, "2.0")]
    lines = [r["line"] for r in profiling.schema_digest(profiling.profile_columns(df), profiling.profile_samples(df)).orderBy("ordinal").collect()]
    assert lines[0] == "- vendor (text), examples: ['A', 'B', 'A']" and lines[3] == "- entry_date (date), examples: []"


def test_columns_with_odd_names(spark):
    df = spark.createDataFrame([(0, "a", 1.0), (1, None, 2.0)], "row_index bigint, `Inv. No` string, `total amount` double")
    names = {r["column"] for r in profiling.profile_columns(df).collect()}
    assert names == {"Inv. No", "total amount"}
    assert profiling.profile_samples(df).count() == 3 and profiling.profile_numeric(df).count() == 1


@pytest.fixture(scope="module")
def amounts():
    rng = random.Random(5)
    return [round(rng.lognormvariate(6, 1.2), 2) for _ in range(400)] + [99999.0, -50000.0]


def test_amount_statistics_match_pandas(make, amounts):
    df, s = narrow(make(amount=amounts + [None])), pd.Series(amounts)
    got = statistics.amount_summary(df).first().asDict()
    want = {"count": len(s), "mean": s.mean(), "median": s.median(), "std": s.std(), "min": s.min(), "max": s.max(),
            "p95": s.quantile(0.95), "p99": s.quantile(0.99)}
    q1, q3 = s.quantile(0.25), s.quantile(0.75)
    low, high = q1 - 1.5 * (q3 - q1), q3 + 1.5 * (q3 - q1)
    want |= {"iqr_lower_fence": low, "iqr_upper_fence": high, "outliers_iqr_count": int(((s < low) | (s > high)).sum()),
             "outliers_zscore_count": int(((s - s.mean()).abs() / s.std() > 3).sum())}
    assert got == pytest.approx(want)
    moments = statistics.amount_moments(df).first()
    assert tuple(moments) == pytest.approx((s.skew(), s.kurtosis()))
    z = (s - s.mean()) / s.std()
    assert {r["row_index"] for r in statistics.zscore_outliers(df).collect()} == set(s.index[z.abs() > 3])
    q1, q3 = s.quantile(0.25), s.quantile(0.75)
    outside = (s < q1 - 1.5 * (q3 - q1)) | (s > q3 + 1.5 * (q3 - q1))
    rows = statistics.iqr_outliers(df).collect()
    assert {r["row_index"] for r in rows} == set(s.index[outside])
    stats = profiling.column_stats(df, "amount").first()
    assert stats["outlier_count"] == outside.sum() and stats["q1"] == pytest.approx(q1)


def test_degenerate_amounts(make):
    one = narrow(make(amount=[5]))
    assert statistics.amount_summary(one).first()["std"] == 0.0
    assert tuple(statistics.amount_moments(one).first()) == (0.0, 0.0)
    same = narrow(make(amount=[5, 5, 5, 5, 5]))
    assert tuple(statistics.amount_moments(same).first()) == (0.0, 0.0)
    assert statistics.zscore_outliers(same).collect() == [] and statistics.iqr_outliers(same).collect() == []
    assert statistics.amount_summary(narrow(make(amount=[None]))).collect() == []


def test_vendor_trend(make):
    df = narrow(make(
        vendor=["A"] * 5 + ["B"], amount=[100, 160, 0, 50, -10, 7],
        date=["2024-01-05", "2024-02-05", "2024-04-01", "2024-05-01", "2024-06-01", "2024-01-01"],
    ))
    trend = [tuple(r) for r in statistics.vendor_trend(df).orderBy("vendor", "month").collect()]
    assert trend[0] == ("A", "2024-01", 100.0, None) and trend[1][3] == pytest.approx(60)
    assert trend[2][3] == -100.0 and trend[3][3] == math.inf and trend[4][3] == pytest.approx(-120)
    spikes = {r["month"] for r in statistics.vendor_spikes(df).collect()}
    assert spikes == {"2024-02", "2024-04", "2024-05", "2024-06"}


def test_top_vendors_and_variance(make):
    df = narrow(make(vendor=[f"V{i % 60:02d}" for i in range(120)], amount=list(range(120)), date=["2024-01-01"] * 120))
    top = [r["vendor"] for r in statistics.top_vendors(df).collect()]
    assert len(top) == 50 and set(top) == {f"V{i:02d}" for i in range(10, 60)}
    first = statistics.vendor_variance(df).orderBy(F.desc("vendor_mean")).first()
    assert (first["vendor"], first["vendor_mean"], first["overall_mean"]) == ("V59", 89.0, 59.5)
    zero = statistics.vendor_variance(narrow(make(vendor=["A", "B"], amount=[5, -5]))).collect()
    assert {r["deviation_pct"] for r in zero} == {0.0}


def test_vendor_summary(make):
    df = narrow(make(vendor=["A", "A", "B"], amount=[1, 3, 9], date=["2024-01-01", "2024-02-01", None]))
    row = statistics.vendor_summary(df, "A").first()
    assert (row["transaction_count"], row["total_spend"], row["avg_amount"]) == (2, 4.0, 2.0)
    assert statistics.vendor_summary(df, "nobody").collect() == []
    assert statistics.vendor_summary(df).count() == 2


def test_top_values(make):
    top = profiling.column_top_values(make(vendor=list("aabbbcdefg")), "vendor").collect()
    assert [(r["value"], r["n"]) for r in top] == [("b", 3), ("a", 2), ("c", 1), ("d", 1), ("e", 1)]
    assert {r["unique_count"] for r in top} == {7}
