"""All registered queries over the driver's tables, and the SQL that states the same results."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from wavelake.plans import base, detectors, kernels, recordings, records, rules, signals  # noqa: F401  (modules register their queries)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(base.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(base.ORACLE)
