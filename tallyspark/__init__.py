"""Ledger audit analytics on Spark DataFrames."""

from importlib import import_module

_HOME = {
    "AuditRun": "tallyspark.plans.pipeline",
    "build_session": "tallyspark.session",
    "run_audit": "tallyspark.plans.pipeline",
}
__all__ = sorted(_HOME)


def __getattr__(name: str):
    """Load on first use: a Python worker that needs one module does not import them all."""
    if name not in _HOME:
        raise AttributeError(f"module {__name__!r} has no attribute {name!r}")
    return getattr(import_module(_HOME[name]), name)
