"""Queries of the general training-data operators that belong to the core."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ferrolith.operators import reconcile, units
from ferrolith.sources.tables import table as t


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "p3_found": lambda s, d: units.found(t(s, d, "bars")),
        "p3_report": lambda s, d: units.report(t(s, d, "bars")),
        "p5_found": lambda s, d: reconcile.found(t(s, d, "records_plan"), t(s, d, "records_atelier"), t(s, d, "records_mirror")),
    }


def oracle_sql() -> dict[str, str]:
    """None: changepoint search is beyond SQL; reconciliation needs Unicode composition as the operator does it. tests/ hold both against brute force."""
    return {}
