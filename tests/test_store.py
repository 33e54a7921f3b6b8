"""The versioned store: crashes, deletes, reruns and reviews."""

import pytest

from pyspark.sql import functions as F

from tallyspark.sources import store, version_log


def rows(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "x int")


def read(spark, root):
    return sorted((r["dataset_id"], r["x"]) for r in store.read_table(spark, root, "t").collect())


def test_replace_delete_and_write_again(spark, tmp_path):
    root = str(tmp_path)
    store.write_partition(rows(spark, 1, 2), root, "t", "007")
    store.write_partition(rows(spark, 3), root, "t", "a/b=c")
    store.write_partition(rows(spark, 4), root, "t", "007")
    assert read(spark, root) == [("007", 4), ("a/b=c", 3)]
    store.delete_datasets(spark.createDataFrame([("007",)], "dataset_id string"), root)
    assert read(spark, root) == [("a/b=c", 3)] and store.read_partition(spark, root, "t", "007").count() == 0
    store.write_partition(rows(spark, 5), root, "t", "007")
    assert read(spark, root) == [("007", 5), ("a/b=c", 3)]
    store.write_partition(rows(spark), root, "t", "007")
    assert read(spark, root) == [("a/b=c", 3)]


def test_a_crash_before_the_log_changes_nothing(spark, tmp_path, monkeypatch):
    root = str(tmp_path)
    store.write_partition(rows(spark, 1), root, "t", "d")

    def crash(*_):
        raise RuntimeError("lost")

    monkeypatch.setattr(version_log, "create_if_absent", crash)
    with pytest.raises(RuntimeError):
        store.write_partition(rows(spark, 2), root, "t", "d")
    assert read(spark, root) == [("d", 1)]


def test_reviews_belong_to_a_run(spark, tmp_path):
    root = str(tmp_path)
    found = spark.createDataFrame([("F1",), ("F2",)], "finding_id string")
    store.write_partition(found, root, "findings", "d")
    store.append_reviews(spark.createDataFrame([("d", "F1", "CONFIRM")], "dataset_id string, finding_id string, action string"), root)
    assert [r["finding_id"] for r in store.read_reviews(spark, root).collect()] == ["F1"]
    store.write_partition(found, root, "findings", "d")
    assert store.read_reviews(spark, root).count() == 0


def test_read_errors_are_not_swallowed(spark, tmp_path):
    with pytest.raises(Exception):
        store.read_table(spark, str(tmp_path), "no_such_table").count()


def test_ids_and_keys_do_not_run_into_each_other(spark):
    found = spark.createDataFrame([("b|c",), ("c",)], "finding_key string")
    ids = {r["finding_id"] for d in ("a", "a|b") for r in store.with_finding_ids(found, d).collect()}
    assert len(ids) == 4


def line(df, root, dataset_id="d", table="t"):
    return store.prepare(df, root, table, dataset_id)


def test_two_writers_neither_is_lost_and_the_last_committer_wins(spark, tmp_path, monkeypatch):
    """Both see the same last number; the second finds it taken and goes on to the next."""
    root = str(tmp_path)
    store.write_partition(rows(spark, 0), root, "t", "d")
    first, second, other = line(rows(spark, 1), root), line(rows(spark, 2), root), line(rows(spark, 3), root, "e")
    monkeypatch.setattr(version_log, "last_number", lambda *_: 1)
    assert [version_log.commit(spark, root, [x]) for x in (second, first, other)] == [2, 3, 4]
    monkeypatch.undo()
    assert read(spark, root) == [("d", 1), ("e", 3)]
    log = sorted((r.seq, r.dataset_id) for r in version_log.events(spark, root).collect())
    assert log == [(1, "d"), (2, "d"), (3, "d"), (4, "e")]


def test_many_writers_at_once(spark, tmp_path):
    from concurrent.futures import ThreadPoolExecutor

    root = str(tmp_path)
    lines = [[{"event": "write", "table": "t", "dataset_id": str(i % 3), "version": str(i)}] for i in range(24)]
    with ThreadPoolExecutor(8) as pool:
        numbers = list(pool.map(lambda x: version_log.commit(spark, root, x), lines))
    assert sorted(numbers) == list(range(1, 25))
    last = {str(d): max((n, str(i)) for i, n in enumerate(numbers) if i % 3 == d)[1] for d in range(3)}
    assert {r.dataset_id: r.version for r in store.current_versions(spark, root, "t").collect()} == last


def test_a_name_is_taken_once_without_links_too(spark, tmp_path, monkeypatch):
    """The rename that refuses to overwrite, which other file systems than local disks use."""
    def renamed(session, fs, source, target):
        context = session._jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), session._jsc.hadoopConfiguration())
        try:
            context.rename(source, target, session._sc._gateway.new_array(getattr(session._jvm.org.apache.hadoop.fs, "Options$Rename"), 0))
        except Exception as error:
            assert "FileAlreadyExists" in str(error)
            return False
        return True

    monkeypatch.setattr(version_log, "_move_if_absent", renamed)
    assert version_log.create_if_absent(spark, str(tmp_path), "x", "one") and not version_log.create_if_absent(spark, str(tmp_path), "x", "two")
    assert (tmp_path / "x").read_text() == "one" and [p.name for p in tmp_path.iterdir() if "draft" in p.name and not p.name.endswith(".crc")] == []


def test_a_conflict_is_refused(spark, tmp_path):
    root = str(tmp_path)
    since = store.write_partition(rows(spark, 1), root, "t", "d")
    store.write_partition(rows(spark, 2), root, "t", "e")
    store.write_partition(rows(spark, 3), root, "u", "d")
    seen = store.write_partition(rows(spark, 4), root, "t", "d", since)  # the others touched other data
    with pytest.raises(version_log.CommitConflict, match="dataset d"):
        store.write_partition(rows(spark, 5), root, "t", "d", since)
    assert read(spark, root) == [("d", 4), ("e", 2)]
    store.delete_datasets(spark.createDataFrame([("d",)], "dataset_id string"), root)
    with pytest.raises(version_log.CommitConflict):
        store.write_partition(rows(spark, 6), root, "t", "d", seen)
    assert read(spark, root) == [("e", 2)]


def test_tables_of_a_run_change_together(spark, tmp_path, monkeypatch):
    root = str(tmp_path)
    store.write_tables({"t": rows(spark, 1), "u": rows(spark, 10)}, root, "d")
    monkeypatch.setattr(version_log, "create_if_absent", lambda *_: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        store.write_tables({"t": rows(spark, 2), "u": rows(spark, 20)}, root, "d")
    monkeypatch.undo()
    assert read(spark, root) == [("d", 1)] and store.read_table(spark, root, "u").first()["x"] == 10


def test_purge_keeps_what_is_current_or_young(spark, tmp_path):
    root = str(tmp_path)
    for x in range(4):
        store.write_partition(rows(spark, x), root, "t", "a%2Fb")
    store.write_partition(rows(spark, 9), root, "t", "gone")
    store.delete_datasets(spark.createDataFrame([("gone",)], "dataset_id string"), root)
    unborn = line(rows(spark, 7), root, "late")
    found = {(r.dataset_id, r.current): r["count"] for r in store.stored_versions(spark, root).groupBy("dataset_id", "current").count().collect()}
    assert found == {("a%2Fb", True): 1, ("a%2Fb", False): 3, ("gone", False): 1, ("late", False): 1}
    assert store.purge_versions(spark, root) == 0 and read(spark, root) == [("a%2Fb", 3)]
    version_log.commit(spark, root, [unborn])
    assert store.purge_versions(spark, root, older_than_hours=-1) == 4
    assert read(spark, root) == [("a%2Fb", 3), ("late", 7)]
    assert [r.current for r in store.stored_versions(spark, root).collect()] == [True, True]
    names = {p.name[-11:] for p in (tmp_path / "versions" / "log").iterdir() if not p.name.endswith(".crc")}
    assert not any(n.endswith(".json") for n in names) and sum(n.endswith(".checkpoint") for n in names) == 1
    store.write_partition(rows(spark, 5), root, "t", "late")
    store.write_partition(rows(spark, 6), root, "t", "gone")
    assert read(spark, root) == [("a%2Fb", 3), ("gone", 6), ("late", 5)]


def test_a_writer_that_slept_through_a_checkpoint_is_not_lost(spark, tmp_path, monkeypatch):
    root = str(tmp_path)
    for x in range(3):
        store.write_partition(rows(spark, x), root, "t", "d")
    store.purge_versions(spark, root, older_than_hours=-1)  # entry numbers 1 to 3 are free again
    slow, real, calls = line(rows(spark, 8), root), version_log.last_number, []

    def stale(*a):
        calls.append(1)
        return 0 if len(calls) == 1 else real(*a)

    monkeypatch.setattr(version_log, "last_number", stale)
    assert version_log.commit(spark, root, [slow]) == 4
    monkeypatch.undo()
    assert read(spark, root) == [("d", 8)]


def test_reviews_are_purged_with_their_findings(spark, tmp_path):
    root = str(tmp_path)
    found = spark.createDataFrame([("F1",)], "finding_id string")
    review = spark.createDataFrame([("d", "F1", "CONFIRM")], "dataset_id string, finding_id string, action string")
    store.write_partition(found, root, "findings", "d")
    store.append_reviews(review, root)
    store.write_partition(found, root, "findings", "d")
    store.append_reviews(review.withColumn("action", F.lit("DISMISS")), root)
    assert store.purge_versions(spark, root, older_than_hours=-1) == 2
    assert [r["action"] for r in store.read_reviews(spark, root).collect()] == ["DISMISS"]
