from datetime import datetime

import pandas as pd
import pytest

from tallyspark.functions.names import distinct_names
from tallyspark.functions.values import number_text, parse_date, parse_number, strip_text, whole_days
from tallyspark.operators import cleaning
from tallyspark.sources import csv_ledger, store
from tallyspark.sources.csv_ledger import (
    EmptyLedgerError, MalformedLedgerError, dense_row_index, read_csv_ledger, rejected_rows,
)
from pyspark.sql import functions as F


def values(spark, texts, fn):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, v string")
    return [r["o"] for r in df.select("i", fn(F.col("v")).alias("o")).orderBy("i").collect()]


def test_strip(spark):
    assert values(spark, [" a ", "\t b c \n", "", None, "　x"], strip_text) == ["a", "b c", "", None, "x"]


def test_numbers(spark):
    texts = ["1,234.50", "$5", "($5,000.00)", "5%", "(5)%", "1e5", ".5", "5d", "abc", None, "-3", "'-3", "+7", "", "()"]
    assert values(spark, texts, parse_number) == [
        1234.5, 5.0, -5000.0, 5.0, None, 100000.0, 0.5, None, None, None, -3.0, None, 7.0, None, None,
    ]


FORMATS = ["%Y-%m-%d", "%m/%d/%Y", "%d/%m/%Y", "%B %d, %Y", "%Y-%m-%dT%H:%M:%S", "%d-%b-%Y", "%Y-%m-%d %H:%M:%S", "%m/%d/%Y %H:%M"]


@pytest.mark.parametrize("pattern", FORMATS)
def test_dates_match_pandas(spark, pattern):
    texts = [datetime(2023, m, d, 8, 30).strftime(pattern) for m in range(1, 13) for d in (1, 9, 13, 28)]
    expected = [pd.to_datetime(pd.Series([t]), format="mixed", errors="coerce")[0].to_pydatetime() for t in texts]
    assert values(spark, texts, parse_date) == expected


def test_bad_dates(spark):
    assert values(spark, ["13/13/2024", "2024-02-30", "soon", "", None, "12-Foo-2024", "1234.5"], parse_date) == [None] * 7


def test_number_text(spark):
    df = spark.createDataFrame([(500.0,), (12345678.9,), (0.1,), (-3.25,), (1e20,)], "v double")
    assert [r[0] for r in df.select(number_text(F.col("v"))).collect()] == [
        "500.0", "12345678.9", "0.1", "-3.25", "100000000000000000000.0"
    ]


def test_whole_days(spark):
    df = spark.sql("SELECT timestamp_ntz'2024-01-01 12:00:00' a, timestamp_ntz'2024-01-08 11:59:00' b")
    assert df.select(whole_days(F.col("a"), F.col("b"))).first()[0] == 6


def raw(spark, rows, schema="row_index bigint, a string, b string"):
    return spark.createDataFrame(rows, schema)


def test_guard_comes_before_null_tokens(spark):
    df = raw(spark, [(0, "-", "=1"), (1, "none", "@x"), (2, "N/A", "+4")])
    steps = cleaning.null_cells(cleaning.guard_cells(cleaning.strip_cells(df))).orderBy("row_index").collect()
    assert [(r["a"], r["b"]) for r in steps] == [("'-", "'=1"), (None, "'@x"), (None, "'+4")]
    mild = cleaning.null_cells(cleaning.guard_cells(df, compat=False)).orderBy("row_index").collect()
    assert [(r["a"], r["b"]) for r in mild] == [(None, "'=1"), (None, "'@x"), (None, "'+4")]


def test_leading_minus_amounts(spark):
    df = raw(spark, [(i, v, "x") for i, v in enumerate(["-5.00", "(6.00)", "7", "8", "9", "10"])])
    stage = lambda d, name: d
    out = cleaning.clean(df, stage).ledger.orderBy("row_index").collect()
    assert [r["a"] for r in out] == [None, -6.0, 7.0, 8.0, 9.0, 10.0]
    out = cleaning.clean(df, stage, compat=False).ledger.orderBy("row_index").collect()
    assert [r["a"] for r in out][0] == -5.0


def test_copies_and_log(spark):
    rows = [(0, "1", "2024-01-01"), (1, "2", None), (2, "1", "2024-01-01"), (3, "2", "none"), (4, "3", "2024-01-05")]
    cleaned = cleaning.clean(raw(spark, rows), lambda d, name: d)
    assert sorted(r["row_index"] for r in cleaned.ledger.collect()) == [0, 1, 4]
    assert cleaned.types == {"a": "numeric", "b": "date"}
    expected = [("normalize_nulls", None, 1), ("drop_duplicate_rows", None, 2), ("coerce_numeric", "a", None), ("coerce_date", "b", None)]
    assert [tuple(r)[1:] for r in cleaned.log.orderBy("seq").collect()] == expected
    assert [tuple(r)[1:] for r in cleaning.cleaning_log(raw(spark, rows)).orderBy("seq").collect()] == expected


def test_votes_need_four_fifths(spark):
    rows = [(i, "5" if i < 8 else f"x{i}", "5" if i < 7 else f"y{i}") for i in range(10)]
    rows = [(i, a + str(i) if a == "5" else a, b + str(i) if b == "5" else b) for i, a, b in rows]
    types = {r["column"]: r["type"] for r in cleaning.detect_types(raw(spark, rows)).collect()}
    assert types == {"a": "numeric", "b": "text"}
    empty = cleaning.detect_types(raw(spark, [(0, None, None)])).collect()
    assert {r["type"] for r in empty} == {"text"}


def test_names():
    assert distinct_names([" Date ", "date", "DATE", None, "x"]) == ["Date", "date.1", "DATE.2", "Unnamed: 3", "x"]


def test_csv(spark, tmp_path):
    path = tmp_path / "l.csv"
    path.write_text('Inv. No, Vendor ,Memo\nA1,"Acme, ""Inc""","two\nlines"\n\nA2,NA,\nA3,none,--\n')
    df = read_csv_ledger(spark, str(path))
    assert df.columns == ["row_index", "Inv. No", "Vendor", "Memo"]
    assert [tuple(r) for r in df.orderBy("row_index").collect()] == [
        (0, "A1", 'Acme, "Inc"', "two\nlines"), (1, "A2", None, None), (2, "A3", "none", "--"),
    ]
    cleaned = cleaning.clean(df, lambda d, name: d)
    assert cleaned.types["Inv. No"] == "text" and cleaned.ledger.count() == 3


@pytest.mark.parametrize("text", [b"a,b\n1,2\n3,4,5\n", b"a,b\n1,2\n3,4,\n", b"a,b\n1,caf\xe9\n2,3\n"])
def test_malformed_rows_are_refused_or_listed(spark, tmp_path, text):
    path = tmp_path / "bad.csv"
    path.write_bytes(text)
    with pytest.raises(Exception, match="more cells than the header"):
        read_csv_ledger(spark, str(path)).collect()
    kept = read_csv_ledger(spark, str(path), skip_bad_rows=True).drop("row_index").collect()
    bad = rejected_rows(spark, str(path)).collect()
    assert len(kept) == len(bad) == 1 and kept[0]["a"] in ("1", "2") and bad[0]["a"] in ("1", "3")


def test_malformed_rows_are_refused_whatever_is_read(spark, tmp_path):
    path = tmp_path / "bad.csv"
    path.write_bytes(b"a,b\n1,2\n3,4,5\n")
    ledger = read_csv_ledger(spark, str(path))
    for read in (ledger.drop("row_index"), ledger.select("a"), ledger.groupBy().count()):
        with pytest.raises(Exception, match="more cells than the header"):
            read.collect()


def test_short_rows_are_filled(spark, tmp_path):
    path = tmp_path / "short.csv"
    path.write_text("a,b,c\n1,2\n3\n")
    rows = read_csv_ledger(spark, str(path)).orderBy("row_index").drop("row_index").collect()
    assert [tuple(r) for r in rows] == [("1", "2", None), ("3", None, None)]


def test_folder_of_files(spark, tmp_path):
    """Columns by name, whatever their order; only the file with a line break inside a cell is read whole."""
    (tmp_path / "1.csv").write_text("vendor,amount\nKiln,1\n")
    (tmp_path / "2.csv").write_text("amount,vendor\n2,Loom\n")
    (tmp_path / "3.csv").write_text('vendor,amount\n"Two\nlines",3\n')
    got = read_csv_ledger(spark, str(tmp_path)).select("vendor", "amount", "row_index").collect()
    assert sorted((r["vendor"], r["amount"]) for r in got) == [("Kiln", "1"), ("Loom", "2"), ("Two\nlines", "3")]
    assert len({r["row_index"] for r in got}) == 3
    (tmp_path / "4.csv").write_text("vendor,total\nMill,4\n")
    with pytest.raises(MalformedLedgerError):
        read_csv_ledger(spark, str(tmp_path))


@pytest.mark.parametrize("text, want", [
    ("1/5/24", "2024-01-05"), ("12/31/69", "1969-12-31"), ("31/12/68", "2068-12-31"), ("01/05/2024 8:30 AM", "2024-01-05 08:30:00"),
    ("01/05/2024 12:05 am", "2024-01-05 00:05:00"), ("2024-01-05 08:30:15 PM", "2024-01-05 20:30:15"), ("05-Jan-24", "2024-01-05"),
    ("5 Jan 24", "2024-01-05"), ("Jan 5, 2024 08:30", "2024-01-05 08:30:00"), ("2024.01.05", "2024-01-05"), ("05.01.2024", "2024-05-01"),
    ("Fri, 05 Jan 2024", "2024-01-05"), ("Wednesday," + " " * 60 + "3rd September 2025", "2025-09-03"), ("2024-1-5T8:30", "2024-01-05 08:30:00"),
    ("25.12.2024", "2024-12-25"), ("2024-13-05", None), ("5 Foo 2024", None), ("Janet 5, 2024", None), ("13:00 PM", None), ("2024", None),
    ("x" * 5000, None), ("2024-01-05 13:00 PM", None),
])
def test_dates(spark, text, want):
    got = spark.createDataFrame([(text,)], "d string").select(parse_date(F.col("d")).cast("string")).first()[0]
    assert got == (want if want is None or " " in want else f"{want} 00:00:00")


def test_empty_csv(spark, tmp_path):
    for text in ("", "a,b\n"):
        path = tmp_path / "e.csv"
        path.write_text(text)
        with pytest.raises(EmptyLedgerError):
            read_csv_ledger(spark, str(path))


def test_dense_index(spark):
    old = [3, 7, 8, (1 << 20) + 5, (1 << 33) + 1, (1 << 33) + 4]
    df = raw(spark, [(i, str(i), "x") for i in reversed(old)])
    new = {int(r["a"]): r["row_index"] for r in dense_row_index(df).collect()}
    assert new == {v: i for i, v in enumerate(old)}


def test_staged_table_lives_in_the_shared_folder(spark):
    folder = store.scratch_folder(spark)
    shared = spark.conf.get("spark.checkpoint.dir", None)
    assert shared is None or folder.startswith(shared)
    df = store.staged(spark.range(5).toDF("x"), folder, "t")
    assert df.count() == 5
    store.remove_folder(spark, folder)


def test_a_large_file_with_line_breaks_is_refused(spark, tmp_path, monkeypatch):
    (tmp_path / "a.csv").write_text('x,y\n"one\ntwo",3\n4,5\n')
    monkeypatch.setattr(csv_ledger, "LARGEST_WHOLE_FILE", 10)
    with pytest.raises(csv_ledger.MalformedLedgerError, match="a.csv"):
        csv_ledger.read_csv_ledger(spark, str(tmp_path / "a.csv"))
    assert csv_ledger.read_csv_ledger(spark, str(tmp_path / "a.csv"), multi_line=True).count() == 2
    (tmp_path / "b.csv").write_text("x,y\none,3\n4,5\n")
    assert csv_ledger.read_csv_ledger(spark, str(tmp_path / "b.csv")).count() == 2
