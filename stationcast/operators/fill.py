"""Forward fill and interpolation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import DATE, FILLED_POLLUTANTS, POLLUTANTS, STATION, TARGET
from .ordered import Ordered, arrange


def forward_fill(
    df: DataFrame,
    columns: Sequence[str] = FILLED_POLLUTANTS,
    **arranged,
) -> DataFrame:
    """Carry the last known value forward inside each station.

    Rows without a station come out null. ``arranged`` goes to :func:`arrange`,
    here and in all operators that take it.
    """
    return arrange(df, **arranged).fill(columns).result()


def forward_fill_global(
    df: DataFrame,
    columns: Sequence[str] = POLLUTANTS,
    order: Sequence[str] = (DATE, STATION),
    **arranged,
) -> DataFrame:
    """Carry values forward in date order across all stations."""
    return arrange(df, (), order, **arranged).fill(columns).result()


def interpolate(series: Ordered, column: str = TARGET) -> Ordered:
    """Linear interpolation by row position.

    Interior gaps are linear, a trailing gap holds the last value, a leading gap
    stays null.
    """
    known = F.struct(F.col(column).alias("v"), F.col("_position").alias("p"))
    marked = series.number().map(
        lambda df: df.withColumn("_known", F.when(F.col(column).isNotNull(), known)), loose=False
    )
    around = Ordered(marked.parts, marked.columns).fill(["_known"], into=lambda _: "_prev")
    around = around.fill(["_known"], forward=False, into=lambda _: "_next")
    prev, nxt, at = F.col("_prev"), F.col("_next"), F.col("_position")
    share = F.try_divide(at - prev["p"], nxt["p"] - prev["p"])
    gap = F.when(nxt.isNull(), prev["v"]).otherwise(prev["v"] + (nxt["v"] - prev["v"]) * share)
    filled = around.map(
        lambda df: df.withColumn(column, F.coalesce(F.col(column), gap)).drop(
            "_known", "_prev", "_next", "_position"
        )
    )
    return Ordered(filled.parts, series.columns, series.loose)


def interpolate_target(df: DataFrame, column: str = TARGET, **arranged) -> DataFrame:
    return interpolate(arrange(df, **arranged), column).result()


def impute_series(series: Ordered, column: str = TARGET) -> Ordered:
    """Keep a copy of the target, fill it forward and drop what stays empty.

    Interpolating after the fill could only touch leading gaps, which linear
    interpolation leaves empty, so that step needs no work of its own.
    """
    kept = series.map(lambda df: df.withColumn(f"{column}_original", F.col(column)))
    filled = kept.fill([column])
    return filled.map(lambda df: df.filter(F.col(column).isNotNull()))


def impute_target(df: DataFrame, column: str = TARGET, **arranged) -> DataFrame:
    return impute_series(arrange(df, **arranged), column).result()


def imputation_report(df: DataFrame, column: str = TARGET, **arranged) -> DataFrame:
    """Missing counts of the target before, after the fill and after interpolation."""
    series = arrange(df, **arranged)
    filled = series.fill([column], into=lambda c: f"_{c}_filled").result()
    missing = F.count_if(F.col(f"_{column}_filled").isNull())
    rows = F.count(F.lit(1))
    before = F.count_if(F.col(column).isNull())
    return filled.agg(
        rows.alias("rows"),
        before.alias("missing_before"),
        F.round(F.try_divide(before * 100.0, rows), 6).alias("missing_before_pct"),
        missing.alias("missing_after_fill"),
        missing.alias("missing_after_interpolation"),
        (rows - missing).alias("rows_kept"),
    )
