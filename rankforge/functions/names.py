"""Names of runs and metrics."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def safe_metric_name(c) -> Column:
    """SCL-17: '@' -> '_', then anything outside [0-9a-zA-Z_-. /] -> '_'."""
    return F.regexp_replace(F.regexp_replace(_col(c), "@", "_"), "[^0-9a-zA-Z_\\-\\. /]", "_")


def join_sources(c, sep: str = ",") -> Column:
    """SCL-18: source names joined with ',' or '_'."""
    return F.array_join(_col(c), sep)
