from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from tallyspark.operators import duplicates, row_rules
from tallyspark.operators.amounts import split_transactions
from tallyspark.operators.ledger import narrow
from tallyspark.plans import portable
from tallyspark.sources import store, version_log
from tallyspark.streaming import ledger_stream


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """The derived ledger in date order, one file after another, plus one row that closes the last day."""
    path = str(tmp_path_factory.mktemp("ledger") / "parts")
    ledger = portable.ledger(spark, "/root/testdata/sf0.001")
    for year in range(1994, 2003):
        ledger.filter(F.year("date") == year).coalesce(1).write.mode("append").parquet(path)
    return path


def drain(spark, stream, name, tmp_path):
    query = (
        stream.writeStream.format("memory").queryName(name).outputMode("append")
        .option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
    )
    query.awaitTermination(300)
    return spark.table(name)


def test_streams_agree_with_batch(spark, folder, tmp_path):
    batch = narrow(spark.read.parquet(folder))
    source = lambda: spark.readStream.schema(spark.read.parquet(folder).schema).option("maxFilesPerTrigger", 4).parquet(folder)

    rows = drain(spark, ledger_stream.flagged_rows(source()), "rows", tmp_path)
    want = row_rules.all_rows(batch, row_rules.row_checks(batch))
    key = ["rule_id", "row_index"]
    assert sorted(map(tuple, rows.select(key).collect())) == sorted(map(tuple, want.select(key).collect()))

    late = "4000 days"  # the files are not in strict date order
    pairs = drain(spark, ledger_stream.duplicate_payments(source(), late), "pairs", tmp_path)
    key = ["row_a", "row_b", "days_apart"]
    assert sorted(map(tuple, pairs.select(key).collect())) == sorted(map(tuple, duplicates.duplicate_payments(batch).select(key).collect()))

    splits = ledger_stream.split_transactions(source(), "1 day")
    assert splits.isStreaming and splits.columns == ["vendor", "day", "transaction_count", "total_amount"]
    closed = ledger_stream.split_transactions(spark.read.parquet(folder)).select("vendor", "total_amount")
    assert sorted(map(tuple, closed.collect())) == sorted(map(tuple, split_transactions(batch).select("vendor", "total_amount").collect()))


SCHEMA = "row_index long, invoice_no string, vendor string, amount double, date timestamp_ntz"


def arrive(spark, folder, *rows):
    """(row_index, invoice, vendor, amount, day) as one more file."""
    cells = [(i, no, vendor, amount, datetime.fromisoformat(day)) for i, no, vendor, amount, day in rows]
    spark.createDataFrame(cells, SCHEMA).coalesce(1).write.mode("append").parquet(folder)


def run(spark, tmp_path, found, table="t"):
    """One availableNow run, started anew from the checkpoint; returns the progress of its batches."""
    source = ledger_stream.ledger_files(spark, f"{tmp_path}/in", spark.read.parquet(f"{tmp_path}/in").schema)
    query = ledger_stream.into_store(found(source), f"{tmp_path}/store", table, "d", f"{tmp_path}/checkpoint")
    query.awaitTermination(120)
    return [p for p in query.recentProgress if p["stateOperators"]]


def stored(spark, tmp_path, *columns, table="t"):
    return sorted(map(tuple, store.read_partition(spark, f"{tmp_path}/store", table, "d").select(*columns).collect()))


def test_pairs_late_rows_are_dropped_and_state_shrinks(spark, tmp_path):
    pairs = lambda rows: ledger_stream.duplicate_payments(rows, "3 days")
    arrive(spark, f"{tmp_path}/in", (1, "A", "v", 5.0, "2024-01-01"), *((100 + i, "X", f"w{i}", 1.0, "2024-01-02") for i in range(50)))
    full = run(spark, tmp_path, pairs)[-1]["stateOperators"][0]["numRowsTotal"]
    arrive(spark, f"{tmp_path}/in", (2, "B", "v", 5.0, "2024-01-08"))  # still within 7 days of row 1
    run(spark, tmp_path, pairs)
    arrive(spark, f"{tmp_path}/in", (3, "C", "v", 5.0, "2024-03-01"))
    run(spark, tmp_path, pairs)
    arrive(spark, f"{tmp_path}/in", (4, "D", "v", 5.0, "2024-01-03"), (5, "E", "v", 5.0, "2024-03-04"))  # row 4 is too late
    last = run(spark, tmp_path, pairs)
    assert stored(spark, tmp_path, "row_a", "row_b", "days_apart") == [(1, 2, 7), (3, 5, 3)]
    assert full >= 100 and last[-1]["stateOperators"][0]["numRowsTotal"] <= 4  # both sides of rows 3 and 5
    assert sum(p["stateOperators"][0]["numRowsDroppedByWatermark"] for p in last) >= 1


def test_days_close_once_and_late_rows_do_not_open_them(spark, tmp_path):
    splits = lambda rows: ledger_stream.split_transactions(rows, "2 days")
    arrive(spark, f"{tmp_path}/in", (1, "A", "v", 30_000.0, "2024-01-01"), (2, "B", "w", 9.0, "2024-01-02"))
    run(spark, tmp_path, splits)
    assert stored(spark, tmp_path, "vendor") == []
    arrive(spark, f"{tmp_path}/in", (3, "C", "v", 30_000.0, "2024-01-01"), (4, "D", "w", 9.0, "2024-01-09"))
    run(spark, tmp_path, splits)
    run(spark, tmp_path, splits)
    assert stored(spark, tmp_path, "vendor", "transaction_count", "total_amount") == [("v", 2, 60_000.0)]
    arrive(spark, f"{tmp_path}/in", (5, "E", "v", 10_000.0, "2024-01-01"), (6, "F", "w", 9.0, "2024-02-01"))
    run(spark, tmp_path, splits)
    assert stored(spark, tmp_path, "vendor", "transaction_count") == [("v", 2)]


def test_a_row_with_a_date_alone_moves_time_on(spark, tmp_path):
    splits = lambda rows: ledger_stream.split_transactions(rows, "1 day")
    arrive(spark, f"{tmp_path}/in", (1, "A", "v", 30_000.0, "2024-01-01"), (2, "B", "v", 30_000.0, "2024-01-01"), (3, None, None, None, "2024-01-04"))
    run(spark, tmp_path, splits)
    assert stored(spark, tmp_path, "vendor", "day") == [("v", date(2024, 1, 1))]


@pytest.mark.parametrize("lost_after", ["the rows", "the log entry"])
def test_a_batch_that_fails_is_repeated_and_counts_once(spark, tmp_path, monkeypatch, lost_after):
    rules = ledger_stream.flagged_rows
    arrive(spark, f"{tmp_path}/in", (1, "A", "v", 60_000.0, "2024-01-06"))
    run(spark, tmp_path, rules)
    first = stored(spark, tmp_path, "rule_id", "row_index")
    arrive(spark, f"{tmp_path}/in", (2, "B", "v", 60_000.0, "2024-01-07"))
    real = version_log.commit

    def lost(*a, **k):
        if lost_after == "the log entry":
            real(*a, **k)
        raise RuntimeError("lost")

    monkeypatch.setattr(version_log, "commit", lost)
    with pytest.raises(Exception, match="lost"):
        run(spark, tmp_path, rules)
    monkeypatch.undo()
    run(spark, tmp_path, rules)
    arrive(spark, f"{tmp_path}/in", (3, "C", "v", 60_000.0, "2024-01-06"))
    run(spark, tmp_path, rules)
    got = stored(spark, tmp_path, "rule_id", "row_index")
    batch = narrow(spark.read.parquet(f"{tmp_path}/in"))
    want = row_rules.all_rows(batch, row_rules.row_checks(batch)).select("rule_id", "row_index").collect()
    assert len(first) < len(got) and got == sorted(map(tuple, want))


def test_appends_follow_a_write_and_go_with_a_delete(spark, tmp_path):
    root, rows = str(tmp_path), lambda *x: spark.createDataFrame([(v,) for v in x], "x int")
    read = lambda: sorted(r["x"] for r in store.read_partition(spark, root, "t", "d").collect())
    store.append_version(rows(1), root, "t", "d", "a")
    store.append_version(rows(2), root, "t", "d", "b")
    store.append_version(rows(2), root, "t", "d", "b")
    assert read() == [1, 2]
    assert store.purge_versions(spark, root, older_than_hours=-1) == 0 and read() == [1, 2]
    store.append_version(rows(2), root, "t", "d", "b")
    assert read() == [1, 2]
    store.write_partition(rows(9), root, "t", "d")
    store.append_version(rows(3), root, "t", "d", "c")
    assert read() == [3, 9] and store.purge_versions(spark, root, older_than_hours=-1) == 2
    store.delete_datasets(spark.createDataFrame([("d",)], "dataset_id string"), root)
    assert read() == []
    store.append_version(rows(4), root, "t", "d", "e")
    assert read() == [4]
