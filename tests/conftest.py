import os
import sys
from datetime import datetime, timedelta

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tallyspark.session import build_session  # noqa: E402

SCHEMA = {
    "invoice_no": "string", "vendor": "string", "amount": "double", "date": "timestamp_ntz",
    "entry_date": "timestamp_ntz", "timestamp": "timestamp_ntz",
}


@pytest.fixture(scope="session")
def spark():
    session = build_session("tests", "local[8]", spark__sql__shuffle__partitions="4", spark__ui__enabled="false")
    session.sparkContext.setLogLevel("OFF")
    return session


def at(text):
    """'2024-01-02' or '2024-01-02 03:00' as a datetime."""
    return None if text is None else datetime.fromisoformat(text)


@pytest.fixture(scope="session")
def make(spark):
    """Build a ledger from columns; dates may be ISO text."""

    def build(**columns):
        names = list(columns)
        n = len(next(iter(columns.values()))) if columns else 0

        def cell(name, i):
            v = columns[name][i]
            if SCHEMA.get(name) == "timestamp_ntz" and isinstance(v, str):
                return at(v)
            return float(v) if SCHEMA.get(name) == "double" and v is not None else v

        rows = [(i, *[cell(c, i) for c in names]) for i in range(n)]
        schema = ", ".join(["row_index bigint"] + [f"{c} {SCHEMA.get(c, 'bigint')}" for c in names])
        return spark.createDataFrame(rows, schema)

    return build


@pytest.fixture(scope="session")
def clean_ledger(make):
    days, day = [], at("2024-01-02")
    while len(days) < 20:
        if day.weekday() < 5:
            days.append(day)
        day += timedelta(days=1)
    return make(
        invoice_no=[f"INV-{1000 + i}" for i in range(20)], vendor=[f"Vendor {i % 5}" for i in range(20)],
        amount=[1234.56 + i for i in range(20)], date=days, entry_date=days,
        timestamp=[d + timedelta(hours=10) for d in days],
    )
