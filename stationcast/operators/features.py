"""Feature columns of every station in one plan."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.calendar import with_calendar
from ..schema import (
    CHANGES,
    DATE,
    FILLED_POLLUTANTS,
    LAGS,
    RAW_DAY,
    ROLLING_STATS,
    ROLLING_WINDOWS,
    STATION,
    TARGET,
)
from .cleaning import drop_incomplete, typed_readings
from .fill import impute_series
from .ordered import Ordered, arrange

# Columns that never are features.
EXCLUDED = (DATE, STATION, "kategori")
# Name parts that give away a column derived from the target.
TARGET_MARKS = ("pm25", "duakomalima")


def lag_columns(w: WindowSpec, column: str = TARGET, lags: Sequence[int] = LAGS) -> dict[str, Column]:
    return {f"pm25_lag_{n}": F.lag(column, n).over(w) for n in lags}


def rolling_columns(
    w: WindowSpec, column: str = TARGET, windows: Sequence[int] = ROLLING_WINDOWS
) -> dict[str, Column]:
    """Statistics of the last n rows, null until all n are there and known."""
    stats = {"mean": F.avg, "std": F.stddev_samp, "min": F.min, "max": F.max}
    out = {}
    for n in windows:
        frame = w.rowsBetween(1 - n, 0)
        full = F.count(column).over(frame) == n
        for name in ROLLING_STATS:
            out[f"pm25_rolling_{name}_{n}"] = F.when(full, stats[name](column).over(frame))
    return out


def change_columns(w: WindowSpec, column: str = TARGET) -> dict[str, Column]:
    return {name: F.col(column) - F.lag(column, n).over(w) for name, n in CHANGES.items()}


def _history(df: DataFrame, depth: int, build, column: str, arranged: dict) -> DataFrame:
    return arrange(df, **arranged).history(depth, [column], build).result()


def add_lags(
    df: DataFrame, column: str = TARGET, lags: Sequence[int] = LAGS, **arranged
) -> DataFrame:
    """Earlier values by row position; gaps between dates do not count."""
    return _history(df, max(lags), lambda w: lag_columns(w, column, lags), column, arranged)


def add_calendar_lags(
    df: DataFrame, column: str = TARGET, lags: Sequence[int] = LAGS, pick: str = "max"
) -> DataFrame:
    """The value exactly n days earlier.

    With several values for a station and date, ``pick`` names the aggregate to take
    (``max``, ``min`` or ``avg``); with ``error`` they are an error.
    """
    choose = F.max if pick == "error" else {"max": F.max, "min": F.min, "avg": F.avg}[pick]
    known = df.filter(F.col(column).isNotNull())
    days = known.groupBy(STATION, DATE).agg(choose(column).alias("_value"), F.count(F.lit(1)).alias("_n"))
    if pick == "error":
        one = F.when(F.col("_n") == 1, F.col("_value"))
        days = days.withColumn("_value", F.coalesce(one, F.raise_error(F.lit("several values for a station and date")).cast("double")))
    earlier = days.select(
        STATION,
        F.explode(F.array(*[F.struct(F.date_add(DATE, n).alias(DATE), F.lit(n).alias("n")) for n in lags])).alias("at"),
        "_value",
    )
    wide = earlier.groupBy(STATION, F.col("at")[DATE].alias(DATE)).agg(
        *[F.max(F.when(F.col("at")["n"] == n, F.col("_value"))).alias(f"pm25_lag_{n}") for n in lags]
    )
    return df.join(wide, [STATION, DATE], "left")


def add_rolling(
    df: DataFrame, column: str = TARGET, windows: Sequence[int] = ROLLING_WINDOWS, **arranged
) -> DataFrame:
    return _history(
        df, max(windows) - 1, lambda w: rolling_columns(w, column, windows), column, arranged
    )


def add_changes(df: DataFrame, column: str = TARGET, **arranged) -> DataFrame:
    return _history(
        df, max(CHANGES.values()), lambda w: change_columns(w, column), column, arranged
    )


def history_features(series: Ordered, column: str = TARGET) -> Ordered:
    """Lags, rolling statistics and changes on one shared window."""
    return series.history(
        max(*LAGS, *ROLLING_WINDOWS),
        [column],
        lambda w: lag_columns(w, column) | rolling_columns(w, column) | change_columns(w, column),
    )


def feature_series(series: Ordered) -> Ordered:
    """Impute the target, then history columns: no further shuffle or sort."""
    return history_features(impute_series(series))


def build_features(
    df: DataFrame, station: str | None = None, complete: bool = True, **arranged
) -> DataFrame:
    """The whole feature chain: impute the target, calendar, history, complete rows.

    All stations at once unless ``station`` names one.
    """
    if station is not None:
        df = df.filter(F.col(STATION) == station)
    out = with_calendar(feature_series(arrange(df, **arranged)).result())
    return drop_incomplete(out) if complete else out


def features_from_raw(
    raw: DataFrame,
    station: str | None = None,
    complete: bool = True,
    strict_day: bool = False,
    **arranged,
) -> DataFrame:
    """Raw text to feature rows, cleaning and features on one arrangement.

    One measurement, one shuffle and one sort for fill, imputation and history.
    """
    typed = typed_readings(raw, strict_day).drop(RAW_DAY)
    if station is not None:
        typed = typed.filter(F.col(STATION) == station)
    series = arrange(typed, **arranged).fill(FILLED_POLLUTANTS)
    out = with_calendar(feature_series(series).result())
    return drop_incomplete(out) if complete else out


def richest_station(df: DataFrame, column: str = TARGET) -> DataFrame:
    """The station with most known values, the first by name on ties (one row)."""
    return (
        df.filter(F.col(STATION).isNotNull())
        .groupBy(STATION)
        .agg(F.count(column).alias("n_values"))
        .orderBy(F.desc("n_values"), STATION)
        .limit(1)
    )


def select_station(df: DataFrame, station: str | None = None, column: str = TARGET) -> DataFrame:
    """Rows of ``station``, or of the station with most known values."""
    if station is not None:
        return df.filter(F.col(STATION) == station)
    # one row, so the broadcast has a fixed size
    best = F.broadcast(richest_station(df, column).select(STATION))
    return df.join(best, STATION, "left_semi")


def feature_columns(df: DataFrame, excluded: Sequence[str] = EXCLUDED) -> list[str]:
    """Numeric columns in table order, without keys and dates; the target stays."""
    return [
        f.name
        for f in df.schema.fields
        if isinstance(f.dataType, T.NumericType) and f.name not in excluded
    ]


def leakage_free(
    columns: Sequence[str], target: str = TARGET, allow_lagged: bool = False
) -> list[str]:
    """Drop the target, repeated names and everything derived from the target.

    ``allow_lagged`` keeps strictly earlier values; rolling frames and changes
    include the current row and go in any case.
    """
    out = []
    for name in dict.fromkeys(columns):
        marked = any(mark in name.lower() for mark in TARGET_MARKS)
        lagged = allow_lagged and "_lag_" in name
        if name != target and (not marked or lagged):
            out.append(name)
    return out


def drop_leaking(df: DataFrame, target: str = TARGET, allow_lagged: bool = False) -> DataFrame:
    """The label and keys with the features that do not leak."""
    keep = leakage_free(feature_columns(df), target, allow_lagged)
    return df.select(STATION, DATE, F.col(target).alias("label"), *keep)


def known_columns(df: DataFrame, columns: Sequence[str]) -> list[str]:
    """Columns with at least one value, found with one aggregate."""
    counts = df.agg(*[F.count(c).alias(c) for c in columns]).first()
    return [c for c in columns if counts[c] > 0]


def align_features(df: DataFrame, columns: Sequence[str], keep: Sequence[str] = (STATION, DATE)) -> DataFrame:
    """Exactly the features of a model, in its order."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"features missing from the input: {missing}")
    return df.select(*[c for c in keep if c in df.columns and c not in columns], *columns)


#: Up to so many rows the rank filter itself limits each input partition (Spark's default).
RANK_LIMIT = 1000


def latest_rows(
    df: DataFrame,
    n: int,
    keys: Sequence[str] = (STATION,),
    order: Sequence[str] = (DATE,),
    tiebreak: Sequence[str] = (),
) -> DataFrame:
    """The last n rows of each station.

    Each input partition is limited to n rows per station before the shuffle that brings
    stations together, so a big station costs no more than a small one: by the rank
    filter for small n, by ranks inside each input partition for others.
    """
    last = [F.desc(c) for c in (*order, *tiebreak)]

    def ranked(rows: DataFrame, by: Sequence[str]) -> DataFrame:
        place = F.row_number().over(Window.partitionBy(*by).orderBy(*last))
        return rows.withColumn("_newest", place).filter(F.col("_newest") <= n).drop("_newest")

    if n > RANK_LIMIT:
        df = ranked(df.withColumn("_source", F.spark_partition_id()), [*keys, "_source"]).drop("_source")
    return ranked(df, keys)


def latest_rows_global(df: DataFrame, n: int, tiebreak: Sequence[str] = (STATION,)) -> DataFrame:
    """The last n rows by date of the whole table."""
    return df.orderBy(F.desc(DATE), *[F.desc(c) for c in tiebreak]).limit(n)
