"""Chronological split and expanding time-series folds."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import DATE
from .ordered import arrange


def add_split(
    df: DataFrame,
    test_size: float = 0.2,
    **arranged,
) -> DataFrame:
    """Flag the first ``int(n * (1 - test_size))`` rows of each series as train.

    Adds ``position`` (1-based), ``series_size`` and ``is_train``. With no keys
    the whole table is one series.
    """
    numbered = arrange(df, **arranged).number("position", "series_size")
    share = 1.0 - test_size
    return numbered.result().withColumn(
        "is_train", F.col("position") <= F.floor(F.col("series_size") * F.lit(share))
    )


def add_segments(
    df: DataFrame, max_folds: int = 5, position: str = "position", size: str = "series_size"
) -> DataFrame:
    """Fold blocks of a numbered series.

    With K = min(max_folds, n // 10) test blocks of n // (K + 1) rows, block 0
    takes what is left over at the start. Fold k trains on blocks below k and
    tests on block k. Fewer than two folds: ``fold_count`` and ``block`` are null.
    """
    n = F.col(size)
    folds = F.least(F.lit(max_folds), F.floor(n / 10)).cast("int")
    folds = F.when(folds >= 2, folds)
    block_size = F.floor(n / (folds + 1))
    first = n - folds * block_size
    at = F.col(position) - 1
    block = F.when(at < first, 0).otherwise(F.floor((at - first) / block_size) + 1)
    return df.withColumns({"fold_count": folds, "block": F.when(folds.isNotNull(), block).cast("int")})


def add_folds(
    df: DataFrame,
    max_folds: int = 5,
    **arranged,
) -> DataFrame:
    numbered = arrange(df, **arranged).number("position", "series_size")
    return add_segments(numbered.result(), max_folds)


def add_split_and_folds(
    df: DataFrame,
    test_size: float = 0.2,
    max_folds: int = 5,
    **arranged,
) -> DataFrame:
    """:func:`add_split` and :func:`add_folds` on one arrangement: one shuffle and one sort for both."""
    return add_segments(add_split(df, test_size, **arranged), max_folds)


def split_report(df: DataFrame) -> DataFrame:
    """Size, share and date range of each side of the split."""
    sides = df.groupBy("is_train").agg(
        F.count(F.lit(1)).alias("rows"),
        F.min(DATE).alias("first_date"),
        F.max(DATE).alias("last_date"),
    )
    total = df.agg(F.count(F.lit(1)).alias("n")).scalar()
    return sides.withColumn("share_pct", F.round(F.col("rows") * 100.0 / total, 6))


def sorted_band(
    df: DataFrame,
    std: float | str = "residual_std",
    keys: Sequence[str] = ("model",),
    **arranged,
) -> DataFrame:
    """Rows numbered by actual value, with a band of one ``std`` around the prediction."""
    width = F.col(std) if isinstance(std, str) else F.lit(std)
    ranked = arrange(df, keys, ("label",), **arranged).number("sample").result()
    return ranked.withColumns(
        {"lower": F.col("prediction") - width, "upper": F.col("prediction") + width}
    )
