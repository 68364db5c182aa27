"""Calendar parts of a date column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import DATE


def _col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def day_of_week(date: Column | str) -> Column:
    """Monday is 0."""
    return F.weekday(_col(date))


def is_weekend(date: Column | str) -> Column:
    return day_of_week(date).isin(5, 6).cast("int")


def season(date: Column | str) -> Column:
    """1 for December to February, then one step per quarter."""
    shifted = F.month(_col(date)) % 12
    return (F.floor(shifted / 3) + 1).cast("int")


def is_rainy_season(date: Column | str) -> Column:
    """October to March."""
    return (~F.month(_col(date)).between(4, 9)).cast("int")


def period(date: Column | str) -> Column:
    """The date as the number YYYYMM."""
    date = _col(date)
    return F.year(date) * 100 + F.month(date)


def days_ahead(date: Column | str, days: Column | int) -> Column:
    return F.date_add(_col(date), days)


def time_parts(date: Column | str = DATE) -> dict[str, Column]:
    date = _col(date)
    return {
        "day_of_week": day_of_week(date),
        "month": F.month(date),
        "year": F.year(date),
        "day_of_year": F.dayofyear(date),
        "quarter": F.quarter(date),
        "is_weekend": is_weekend(date),
    }


def season_parts(date: Column | str = DATE) -> dict[str, Column]:
    return {"season": season(date), "is_rainy_season": is_rainy_season(date)}


def with_calendar(df: DataFrame, date: str = DATE) -> DataFrame:
    """Add all time and season parts of ``date``."""
    return df.withColumns({**time_parts(date), **season_parts(date)})


def with_serving_calendar(df: DataFrame, date: str) -> DataFrame:
    """Calendar parts plus the two raw numeric columns a model may expect."""
    return with_calendar(df, date).withColumns(
        {"periode_data": period(date), "bulan": F.month(F.col(date))}
    )
