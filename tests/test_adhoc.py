import pytest

from tallyspark.operators import adhoc


@pytest.fixture(scope="module")
def ledger(spark):
    rows = [(f"depot {i % 3}", float(i), i, i) for i in range(12)]
    return spark.createDataFrame(rows, "vendor string, amount double, lot int, drop int").cache()


@pytest.fixture
def others(spark, ledger):
    """A view called like the ledger and one with another name, both of the caller."""
    spark.createDataFrame([(1,)], "secret int").createOrReplaceTempView("dataset")
    spark.createDataFrame([(2,)], "secret int").createOrReplaceTempView("hidden")
    spark.createDataFrame([(3,)], "secret int").createOrReplaceGlobalTempView("shared")
    yield
    for name in ("dataset", "hidden"):
        spark.catalog.dropTempView(name)
    spark.catalog.dropGlobalTempView("shared")


def run(ledger, sql, limit=500):
    return [tuple(r) for r in adhoc.query_ledger(ledger, sql, limit).collect()]


@pytest.mark.parametrize("sql, rows", [
    ("select max(amount) from dataset where vendor = 'depot 1'", [(10.0,)]),
    ("WITH big AS (SELECT * FROM dataset WHERE amount > 8), n AS (SELECT count(*) c FROM big) SELECT c FROM n ;", [(3,)]),
    ("SELECT (SELECT min(amount) FROM dataset) + 1 FROM dataset WHERE amount IN (SELECT 3 FROM dataset)", [(1.0,)]),
    ("SELECT x FROM (VALUES (5), (4)) AS v(x) ORDER BY x", [(4,), (5,)]),
    ("SELECT `drop` FROM dataset WHERE vendor = 'parquet.`x`' OR amount = 2 -- closing remark", [(2,)]),
    ("SELECT a.amount FROM dataset a JOIN dataset b ON a.lot = b.lot + 11", [(11.0,)]),
    ("SELECT e FROM dataset LATERAL VIEW explode(array(1, 2)) t AS e WHERE amount = 0", [(1,), (2,)]),
    ("SELECT 1 AS updated_at, ' create ' AS b", [(1, " create ")]),
])
def test_accepted(ledger, sql, rows):
    assert run(ledger, sql) == rows


@pytest.mark.parametrize("sql", [
    "", " ;; ", "TABLE dataset", "SELECT 1; SELECT 2", "UPDATE dataset SET amount = 0", "WITH w AS (SELECT 1) INSERT INTO t SELECT * FROM w",
    "SELECT amount FROM dataset drop", "select 5 LOAD x", "SELECT java_method('java.lang.Runtime', 'getRuntime')",
])
def test_refused_by_words(sql):
    with pytest.raises(adhoc.QueryRefused):
        adhoc.check_readonly(sql)


@pytest.mark.parametrize("source", [
    "`parquet`.`/tmp/x`", "parquet/**/.`/tmp/x`", "csv . `/tmp/x`", "hidden", "global_temp.shared", "default.dataset", "range(3)",
    "IDENTIFIER('hid' || 'den')", "(SELECT * FROM hidden)", "`text`.`/etc/hosts`",
])
@pytest.mark.parametrize("frame", [
    "SELECT * FROM {}", "SELECT * FROM dataset WHERE lot IN (SELECT 1 FROM {})", "SELECT (SELECT count(*) FROM {}) FROM dataset",
    "WITH c AS (SELECT * FROM {}) SELECT * FROM c", "SELECT 1 FROM dataset UNION ALL SELECT 1 FROM {}",
    "SELECT * FROM dataset d WHERE EXISTS (SELECT 1 FROM (WITH z AS (SELECT 1 FROM {}) SELECT * FROM z))",
])
def test_nothing_else_is_visible(ledger, others, source, frame):
    with pytest.raises(adhoc.QueryRefused):
        adhoc.query_ledger(ledger, frame.format(source))


def test_the_callers_view_stays(spark, ledger, others):
    assert run(ledger, "SELECT count(*) FROM dataset") == [(12,)]
    assert spark.sql("SELECT secret FROM dataset").first()[0] == 1
    with pytest.raises(adhoc.QueryRefused):
        run(ledger, "WITH dataset AS (SELECT 1) SELECT * FROM dataset")


def test_a_syntax_error_stays_one(ledger):
    with pytest.raises(Exception) as error:
        run(ledger, "SELECT amount FRM dataset WHERE GROUP")
    assert not isinstance(error.value, adhoc.QueryRefused)


def test_row_cap(ledger):
    assert len(run(ledger, "SELECT amount FROM dataset", 4)) == 4
    assert len(run(ledger, "SELECT amount FROM dataset LIMIT 7", 4)) == 7
    assert len(run(ledger, "SELECT amount FROM (SELECT amount FROM dataset LIMIT 9)", 4)) == 4
    assert len(run(ledger, "SELECT amount FROM dataset", None)) == 12
    assert run(ledger, "SELECT amount FROM dataset ORDER BY amount DESC", 2) == [(11.0,), (10.0,)]
    assert not adhoc.has_own_limit("SELECT rate_limit, 'limit' FROM dataset")


def test_written_ledger_in_a_folder_with_a_quote(spark, ledger, tmp_path):
    path = str(tmp_path / "year's end")
    ledger.write.parquet(path)
    assert [tuple(r) for r in adhoc.query_parquet(spark, path, "SELECT sum(amount) FROM dataset").collect()] == [(66.0,)]
