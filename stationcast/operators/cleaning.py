"""From raw text readings to a typed panel."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import numbers
from ..schema import (
    DATE,
    FILLED_POLLUTANTS,
    NULL_TOKENS,
    POLLUTANT_NAMES,
    POLLUTANTS,
    RAW_DAY,
    RAW_MONTH,
    RAW_PERIOD,
    RAW_STATION,
    STATION,
    TARGET,
)
from .fill import forward_fill, forward_fill_global


def clean_column_names(df: DataFrame) -> DataFrame:
    """Trim and lowercase the column names."""
    names = [name.strip().lower() for name in df.columns]
    if len(set(names)) < len(names):
        twice = sorted({n for n in names if names.count(n) > 1})
        raise ValueError(f"column names collide after cleaning: {twice}")
    return df.toDF(*names)


def null_tokens(df: DataFrame, tokens: Sequence[str] = NULL_TOKENS) -> DataFrame:
    """Cells that are exactly one of ``tokens`` become null, in all text columns."""
    text = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    return df.withColumns(
        {c: F.when(~F.col(f"`{c}`").isin(*tokens), F.col(f"`{c}`")) for c in text}
    )


def coerce_numbers(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Text to double; what is no finite number becomes null. Absent columns are skipped."""
    wanted = columns if columns is not None else (*POLLUTANT_NAMES, *POLLUTANTS)
    kinds = {f.name: f.dataType for f in df.schema.fields if f.name in wanted}
    typed = df.withColumns(
        {
            c: F.col(c).cast("double") if isinstance(t, T.NumericType) else numbers.to_number(F.col(c))
            for c, t in kinds.items()
        }
    )
    return typed.withColumns({c: numbers.finite(F.col(c)) for c in kinds})


def reading_date(period: Column, day: Column, strict_day: bool = False) -> Column:
    """Date from YYYYMM and a day of month, null when there is no such day.

    The day may be written as a whole number with decimals (``5.0``) unless
    ``strict_day`` is set.
    """
    day = day.cast("string")
    if not strict_day:
        day = F.regexp_replace(F.trim(day), r"\.0*$", "")
    # concat gives null when a piece is null, and the parser refuses the rest
    text = F.concat(
        numbers.period_year(period), F.lit("-"), numbers.period_month(period), F.lit("-"), day
    )
    return F.try_to_date(text, "yyyy-M-d")


def assemble_dates(df: DataFrame, strict_day: bool = False) -> DataFrame:
    return df.withColumn(DATE, reading_date(F.col(RAW_PERIOD), F.col(RAW_DAY), strict_day))


def drop_invalid_dates(df: DataFrame) -> DataFrame:
    return df.filter(F.col(DATE).isNotNull())


def invalid_date_report(df: DataFrame) -> DataFrame:
    """Rows before, rows after and rows dropped for want of a valid date."""
    rows, valid = F.count(F.lit(1)), F.count(DATE)
    return df.agg(
        rows.alias("rows_before"), valid.alias("rows_after"), (rows - valid).alias("rows_dropped")
    )


def sort_by_date(df: DataFrame, tiebreak: Sequence[str] = (STATION,)) -> DataFrame:
    """For output only: operators that need order ask for it themselves."""
    return df.orderBy(DATE, *tiebreak)


def engine_names(df: DataFrame) -> DataFrame:
    """Source column names to engine names; other columns pass through."""
    return df.withColumnsRenamed({RAW_STATION: STATION, **POLLUTANT_NAMES})


def calendar_numbers(df: DataFrame) -> DataFrame:
    """The raw period and month as whole numbers, so that they can be features."""
    present = [c for c in (RAW_PERIOD, RAW_MONTH) if c in df.columns]
    return df.withColumns({c: F.col(c).cast("string").try_cast("int") for c in present})


def typed_readings(df: DataFrame, strict_day: bool = False) -> DataFrame:
    """All cleaning steps that look at one row only."""
    return (
        df.transform(clean_column_names)
        .transform(null_tokens)
        .transform(coerce_numbers)
        .transform(assemble_dates, strict_day)
        .transform(drop_invalid_dates)
        .transform(calendar_numbers)
        .transform(engine_names)
    )


def clean_readings(
    df: DataFrame,
    strict_day: bool = False,
    scope: str = "station",
    **arranged,
) -> DataFrame:
    """The whole cleaning chain, raw text to filled panel.

    ``scope="global"`` fills in date order across all stations instead of inside
    each station.
    """
    typed = typed_readings(df, strict_day).drop(RAW_DAY)
    if scope == "global":
        return forward_fill_global(typed, POLLUTANTS, **arranged)
    return forward_fill(typed, FILLED_POLLUTANTS, **arranged)


def only_station(df: DataFrame, station: str) -> DataFrame:
    return df.filter(F.col(STATION) == station)


def drop_incomplete(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Drop rows with a null in any of ``columns`` (default: all)."""
    return df.na.drop("any", subset=list(columns) if columns else None)


def incomplete_report(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """How many rows :func:`drop_incomplete` takes away, and their share."""
    wanted = list(columns or df.columns)
    complete = F.lit(True)
    for c in wanted:
        complete = complete & F.col(c).isNotNull()
    rows, kept = F.count(F.lit(1)), F.count_if(complete)
    return df.agg(
        rows.alias("rows_before"),
        kept.alias("rows_after"),
        (rows - kept).alias("rows_dropped"),
        F.round(F.try_divide((rows - kept) * 100.0, rows), 6).alias("dropped_pct"),
    )


def drop_missing_target(df: DataFrame, column: str = TARGET) -> DataFrame:
    return df.na.drop(subset=[column])
