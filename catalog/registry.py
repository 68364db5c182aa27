"""Where queries and their check SQL are registered."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, check: str | None = None):
    """Register a query; without check SQL only its rows are looked at."""

    def keep(fn):
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = fn
        if check:
            ORACLE[name] = check
        return fn

    return keep


def again(name: str, fn: Callable[[SparkSession, str], DataFrame], suffix: str = "segments") -> None:
    """Register a query a second time over another plan, against the same check SQL."""
    query(f"{name}_{suffix}", ORACLE[name])(fn)


def rounded(df: DataFrame, *columns: str, places: int = 6) -> DataFrame:
    """Round derived doubles, whose last bits depend on the order of summation."""
    return df.withColumns({c: F.round(c, places) for c in columns})
