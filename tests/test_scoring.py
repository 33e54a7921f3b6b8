import pytest

from tallyspark.operators import scoring

SCHEMA = (
    "severity string, rule_name string, rule_id string, n_rows bigint, total_exposure double, duplicate_count bigint, "
    "p_value double, concentration_pct double, threshold_pct double, gap_pct double"
)


def score(spark, severity, params=None, **metrics):
    row = (severity, "X", "X_ID", 0, *[
        metrics.get(k) for k in ("total_exposure", "duplicate_count", "p_value", "concentration_pct", "threshold_pct", "gap_pct")
    ])
    return scoring.score(spark.createDataFrame([row], SCHEMA), params).first()


@pytest.mark.parametrize("severity,base", [("HIGH", 85), ("MEDIUM", 60), ("LOW", 30), ("SOMETHING", 50), (None, 60)])
def test_base(spark, severity, base):
    assert score(spark, severity)["risk_score"] == base


def test_bounds(spark):
    high = score(spark, "HIGH", {"materiality_threshold": 1}, total_exposure=1e7, duplicate_count=50, p_value=0.0001,
                 concentration_pct=99.0, threshold_pct=40.0, gap_pct=99.0)
    low = score(spark, "LOW", total_exposure=-1e9)
    assert high["risk_score"] == 100 and low["risk_score"] == 0


def test_boosts(spark):
    assert score(spark, "HIGH", duplicate_count=10)["risk_score"] >= score(spark, "HIGH", duplicate_count=2)["risk_score"]
    assert score(spark, "MEDIUM", gap_pct=6.0)["risk_score"] == 60  # 60.5 rounds to even
    assert score(spark, "MEDIUM", gap_pct=8.0)["risk_score"] == 62  # 61.5 rounds to even
    assert score(spark, "MEDIUM", concentration_pct=50.0)["risk_score"] == 65


def test_justification(spark):
    assert score(spark, "HIGH", total_exposure=50000.0)["risk_justification"] == (
        "HIGH severity finding for rule 'X' affecting 0 row(s); base score 85 adjusted by +5.0 based on supporting metrics."
    )
    assert "adjusted by -5.0 " in score(spark, "HIGH", total_exposure=-50000.0)["risk_justification"]
