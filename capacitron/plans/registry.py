"""Query catalogue: operator id -> (Spark DataFrame builder, DuckDB oracle SQL).

Every builder takes ``(spark, sf_dir)`` and returns a lazy DataFrame over the whole
driver tables.  ``sql`` is omitted only for operators with no SQL equivalent
(model fitting, streaming, file-tree ingest); those are covered by unit tests.
"""

from __future__ import annotations

from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        if name in QUERIES:
            raise KeyError(f"duplicate query id {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def load_all():
    """Import every plan module so its @register decorators run."""
    from . import (warehouse_plans, benefit_plans, series_plans, profile_plans, feature_plans,  # noqa: F401
                   ml_plans, mllib_plans,
                   scalar_plans, extra_plans, source_plans)
    return QUERIES, ORACLE
