"""Mergeable profiles, heavy hitters, postings and clustered ledgers."""

import random

import pytest
from pyspark.sql import functions as F

from tallyspark.operators import profiling, sketches, text_index
from tallyspark.sources import clustered


def mixed(spark, n=6000):
    rng = random.Random(2)
    rows = [(i, f"v{rng.randrange(3000)}", rng.choice([None, -0.0, 0.0, 1.5, rng.random()]), None) for i in range(n)]
    return spark.createDataFrame(rows, "row_index long, vendor string, amount double, empty string")


def test_merged_sketches_stay_within_the_bound(spark):
    """Counts are exact in any grouping; estimates may differ in their last places, as sketches keep another history."""
    df = mixed(spark).cache()
    parts = [sketches.sketch_profile(df.filter(F.col("row_index") % 3 == i)) for i in range(3)]
    rows = lambda p: sorted(map(tuple, sketches.estimated(p).collect()))
    union = parts[0].unionByName(parts[1]).unionByName(parts[2])
    once = rows(sketches.merged_profiles(union))
    nested = sketches.merged_profiles(parts[2].unionByName(sketches.merged_profiles(parts[0].unionByName(parts[1])).select(parts[0].columns)))
    exact = {r["column"]: r for r in profiling.profile_columns(df).collect()}
    for column, _, n, nulls, null_pct, unique in once + rows(nested) + rows(sketches.sketch_profile(df).select("column", "ordinal", "row_count", "null_count", "sketch")):
        want = exact[column]
        assert (n, nulls, null_pct) == (want["row_count"], want["null_count"], want["null_pct"])
        assert abs(unique - want["unique_count"]) <= max(1, sketches.ERROR_BOUND * want["unique_count"])


def test_an_empty_profile(spark):
    got = sketches.estimated(sketches.merged_profiles(sketches.sketch_profile(mixed(spark).limit(0)))).collect()
    assert {(r["row_count"], r["null_count"], r["null_pct"], r["unique_count"]) for r in got} == {(0, 0, None, 0)}


@pytest.mark.parametrize("kind", ["skewed", "level", "ties", "few", "none"])
def test_no_heavy_hitter_is_missed(spark, kind):
    """Buckets so few and so rarely opened that values collide; each table would mislead a summary that guesses."""
    rng = random.Random(4)
    values = {
        "skewed": ["hot"] * 900 + [f"w{i % 7}" for i in range(700)] + [f"r{i}" for i in range(2000)],
        "level": [f"v{i % 500}" for i in range(2003)],  # three values are one ahead
        "ties": [f"t{i % 12}" for i in range(240)] + [f"s{i}" for i in range(600)],
        "few": ["a", "b", "b", None], "none": [None, None],
    }[kind]
    rng.shuffle(values)
    df = spark.createDataFrame([(v,) for v in values], "x string").repartition(4)
    want = [tuple(r) for r in profiling.column_top_values(df, "x").select("value", "n").collect()]
    for opened in (1, 4):
        got = sketches.heavy_hitters(df, "x", buckets=64, opened=opened).values
        assert [tuple(r) for r in got.collect()] == want


def test_values_that_stand_out_open_few_buckets(spark):
    values = [f"top{i % 5}" for i in range(5000)] + [f"r{i}" for i in range(5000)]
    df = spark.createDataFrame([(v,) for v in values], "x string")
    found = sketches.heavy_hitters(df, "x", buckets=1024, opened=8)
    assert found.opened.count() == 0 and found.values.count() == 5


def texts(spark):
    words = ["Duplicate", "payment", "vendor", "Ünïcode", "gap", "round", "weekend"]
    rng = random.Random(7)
    rows = [(i, f"Rule {i // 40}", " ".join(rng.choice(words) for _ in range(6)), None if i % 9 == 0 else f"file{i // 20}.csv") for i in range(400)]
    return spark.createDataFrame(rows + [(400, None, "x", "ab"), (401, "", None, None)], "id int, rule_name string, text string, dataset_name string")


def test_search_by_postings_finds_what_a_scan_finds(spark, tmp_path):
    rows, columns = texts(spark), ["rule_name", "text", "dataset_name"]
    text_index.write_index(rows, f"{tmp_path}/i", columns, ["rule_name", "dataset_name"], 16)
    every = rows.collect()
    for needle in ("rule 3", "FILE7.", "ünï", "payment vendor", "ab", "x", "csv", "no such text", "", "%", "e 1"):
        got = {r["id"] for r in text_index.search_index(spark, f"{tmp_path}/i", columns, needle).collect()}
        assert got == {r["id"] for r in every if any(needle.lower() in (r[c] or "").lower() for c in columns if r[c] is not None)}, needle
    whole = len(spark.read.parquet(f"{tmp_path}/i/rows").inputFiles())
    assert text_index.parts_with(spark, f"{tmp_path}/i", "ab") is None and text_index.parts_with(spark, f"{tmp_path}/i", "qqq") == []
    assert 0 < len(text_index.parts_with(spark, f"{tmp_path}/i", "file7.csv")) <= 3 < whole


def rows_read(df):
    """Rows that the scan returned, after files, row groups and pages were skipped."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    plan = plan.executedPlan() if "AdaptiveSparkPlan" in plan.nodeName() else plan
    return plan.collectLeaves().head().metrics().apply("numOutputRows").value()


def test_lookups_skip_row_groups(spark, tmp_path):
    n = 200_000
    ledger = spark.range(n).select(
        F.col("id").alias("row_index"), F.when(F.col("id") % 3 == 0, "Hot").otherwise(F.concat(F.lit("V"), F.col("id") % 997)).alias("vendor"),
        F.concat(F.lit("INV-"), F.sha2(F.col("id").cast("string"), 256)).alias("invoice_no"))
    clustered.write_clustered(ledger, f"{tmp_path}/c", "vendor", ["invoice_no"], distinct=5000, row_group_bytes=1 << 18)
    clustered.write_clustered(ledger, f"{tmp_path}/plain", "vendor", row_group_bytes=1 << 18)
    one = clustered.lookup(spark, f"{tmp_path}/c", "vendor", "V5")
    assert one.count() == ledger.filter("vendor = 'V5'").count() > 100 and rows_read(one) < n / 5
    number = ledger.filter("row_index = 4321").first()["invoice_no"]
    hit, plain = (clustered.lookup(spark, f"{tmp_path}/{x}", "invoice_no", number) for x in ("c", "plain"))
    assert hit.count() == plain.count() == 1 and rows_read(hit) < rows_read(plain) / 2
    assert clustered.lookup(spark, f"{tmp_path}/c", "vendor", "nobody").count() == 0
    assert spark.read.parquet(f"{tmp_path}/c").count() == n and spark.read.parquet(f"{tmp_path}/c").columns == ledger.columns
