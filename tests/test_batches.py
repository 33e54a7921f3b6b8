"""Rules over batches against one run over everything."""

import random
import re

import pytest
from pyspark.sql import functions as F

from tallyspark.operators import duplicates, payment_history, vendor_state, vendors
from tallyspark.sources import store, version_log


def payments(make, n, seed=5):
    """Few vendors, amounts and days; a third of the rows are one vendor's copies and one a day without an invoice."""
    rng = random.Random(seed)
    hot = [rng.random() < 0.3 for _ in range(n)]
    return make(
        invoice_no=[None if rng.random() < 0.2 else f"I{rng.randrange(n // 3)}" for _ in range(n)],
        vendor=[None if rng.random() < 0.03 else "Hot" if h else f"V{rng.randrange(6)}" for h in hot],
        amount=[100.0 if h else rng.choice([1.5, -0.0, 0.0, 70.0]) for h in hot],
        date=[None if rng.random() < 0.03 else f"2024-01-{rng.randrange(1, 29):02d}T{rng.randrange(24):02d}:00" for _ in range(n)],
    )


def in_batches(spark, ledger, root, numbers, **options):
    history, found = payment_history.PaymentHistory(spark, root, 4, **options), []
    for number in numbers:
        batch = ledger.filter(F.pmod(F.xxhash64("row_index"), F.lit(3)) == number)
        got = duplicates.unfolded(history.add(number, batch)).select("row_a", "row_b", "days_apart").collect()
        found.append(sorted(map(tuple, got)))
    return history, found


@pytest.mark.parametrize("tile", [duplicates.TILE, 5])
def test_pairs_of_batches_are_those_of_one_run(spark, make, tmp_path, tile):
    ledger = payments(make, 150).cache()
    want = sorted(map(tuple, duplicates.duplicate_payments(ledger).select("row_a", "row_b", "days_apart").collect()))
    history, found = in_batches(spark, ledger, str(tmp_path), (0, 1, 2, 1), tile=tile)
    assert len(want) > 100 and sorted(found[0] + found[1] + found[2]) == want
    assert found[3] == found[1]  # the same batch again: nothing twice, no later batch
    history.close()


def test_the_history_is_not_shuffled(spark, make, tmp_path):
    ledger = payments(make, 60)
    history, _ = in_batches(spark, ledger, str(tmp_path), (0, 1))
    cells = spark.read.parquet(f"{tmp_path}/batches/batch=1")
    hot = spark.createDataFrame([], "vendor string, amount double, span long, sides int")
    plan = history.pairs_with_history(2, cells, hot)._jdf.queryExecution().executedPlan().toString()
    past = plan[: plan.index(history.table)]
    assert "Bucketed: true" in plan and "SortMergeJoin [meet" in plan
    lines = past.splitlines()
    depth = re.search(r"[:+]- ", lines[-1]).start()
    above = [x for x in lines if (m := re.search(r"[:+]- ", x)) is None or m.start() < depth]
    assert not any("Exchange" in x for x in above)
    history.close()


def test_pairs_of_a_batch_are_computed_once(spark, make, tmp_path):
    """Unfolding reads the pairs of cells several times; they must not be joined and shuffled again for each."""
    history, _ = in_batches(spark, payments(make, 60), str(tmp_path), (0,))
    found = history.add(1, payments(make, 60, seed=6).withColumn("row_index", F.col("row_index") + 1000))
    plan = found.pairs._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan and found.pairs.count() > 0
    history.close()


def test_hot_keys_of_a_batch_are_written_for_the_joins(spark, make, tmp_path, monkeypatch):
    monkeypatch.setattr(duplicates, "TILE", 3)
    ledger = payments(make, 90).cache()
    want = sorted(map(tuple, duplicates.duplicate_payments(ledger).select("row_a", "row_b", "days_apart").collect()))
    history, found = in_batches(spark, ledger, str(tmp_path), (0, 1, 2))
    assert want and sorted(found[0] + found[1] + found[2]) == want
    assert spark.read.parquet(f"{tmp_path}/payment_grid").filter("_side > 1").count() > 0
    assert spark.read.parquet(f"{tmp_path}/heavy").count() == 0  # no cell of a million rows
    history.close()


def test_a_later_session_takes_the_history_up(spark, make, tmp_path):
    ledger = payments(make, 120).cache()
    _, whole = in_batches(spark, ledger, f"{tmp_path}/whole", (0, 1))
    first, begun = in_batches(spark, ledger, f"{tmp_path}/parts", (0,))
    first.close()
    second, rest = in_batches(spark, ledger, f"{tmp_path}/parts", (1,))
    assert begun + rest == whole and whole[1]
    second.close()


def state_ledger(make, n=300):
    rng = random.Random(9)
    days = sorted(rng.randrange(1, 900) for _ in range(n))
    return make(
        vendor=[None if rng.random() < 0.05 else f"V{rng.randrange(25)}" for _ in days],
        amount=[None if rng.random() < 0.1 else rng.choice([5.0, -20_000.0, 30_000.0]) for _ in days],
        date=[f"{2020 + d // 360}-{d % 360 // 30 + 1:02d}-{d % 30 % 28 + 1:02d}" for d in days],
    )


def hits(df):
    return sorted(map(tuple, df.select("row_index", "days").collect()))


def test_vendor_batches_give_one_full_run(spark, make, tmp_path):
    ledger, root = state_ledger(make).cache(), str(tmp_path)
    dormant, fresh = hits(vendors.dormant_vendor_rows(ledger)), hits(vendors.new_vendor_rows(ledger))
    got = []
    for first, after in (("2019", "2020-08"), ("2020-08", "2021-05"), ("2021-05", "2021-05-01"), ("2021-05-01", "2030")):
        day = F.date_format("date", "yyyy-MM-dd")
        batch = ledger.filter((day >= first) & (day < after))
        got.append(vendor_state.audit_batch(batch, root, "s"))
        assert got[-1].late.count() == 0
    assert sorted(x for g in got for x in hits(g.dormant)) == dormant and len(dormant) > 10
    assert sorted(x for g in got for x in hits(g.new_vendors)) == fresh and len(fresh) > 5
    assert sorted(map(tuple, vendor_state.stored(spark, root, "s").collect()), key=str) == sorted(
        map(tuple, vendor_state.summary(ledger).collect()), key=str)


def test_late_rows_are_reported_and_a_second_writer_is_refused(spark, make, tmp_path, monkeypatch):
    root = str(tmp_path)
    vendor_state.audit_batch(make(vendor=["a", "b"], amount=[1.0, 1.0], date=["2024-03-01", "2024-01-01"]), root, "s")
    batch = make(vendor=["a", "b", "c"], amount=[1.0, 1.0, 1.0], date=["2024-02-01", "2024-02-01", "2024-01-01"])
    real = store.write_partition

    def overtaken(*a, **k):
        monkeypatch.undo()
        vendor_state.audit_batch(batch.limit(1), root, "s")
        return real(*a, **k)

    monkeypatch.setattr(store, "write_partition", overtaken)
    with pytest.raises(version_log.CommitConflict):
        vendor_state.audit_batch(batch, root, "s")
    assert [r["vendor"] for r in vendor_state.audit_batch(batch, root, "s").late.collect()] == ["a"]


def test_merging_is_free_of_order(spark, make):
    ledger = state_ledger(make, 60)
    parts = [vendor_state.summary(ledger.filter(F.col("row_index") % 3 == i)) for i in range(3)]
    rows = lambda df: sorted(map(tuple, df.collect()), key=str)
    want = rows(vendor_state.summary(ledger))
    assert rows(vendor_state.merge(vendor_state.merge(parts[0], parts[1]), parts[2])) == want
    assert rows(vendor_state.merge(parts[2], vendor_state.merge(parts[1], parts[0]))) == want
