"""Bias of predictions overall, by month and by level of the actual value."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import levels, numbers
from ..schema import DATE


def _error(label: str, prediction: str):
    return numbers.signed_error(F.col(label), F.col(prediction))


def with_errors(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    y, p = F.col(label), F.col(prediction)
    return df.withColumns(
        {
            "error": numbers.signed_error(y, p),
            "residual": numbers.residual(y, p),
            "abs_error": numbers.absolute_error(y, p),
        }
    )


def overall_bias(df: DataFrame, by: Sequence[str] = ("model",), label: str = "label", prediction: str = "prediction") -> DataFrame:
    """Mean error, population spread, mean absolute, smallest and largest error."""
    error = _error(label, prediction)
    return df.groupBy(*by).agg(
        F.count(error).alias("n"),
        F.avg(error).alias("overall_bias"),
        F.stddev_pop(error).alias("residual_std"),
        F.avg(F.abs(error)).alias("mean_abs_residual"),
        F.min(error).alias("min_residual"),
        F.max(error).alias("max_residual"),
    )


def monthly_bias(df: DataFrame, by: Sequence[str] = ("model",), label: str = "label", prediction: str = "prediction") -> DataFrame:
    """Mean error and mean absolute error per calendar month."""
    error = _error(label, prediction)
    return (
        df.filter(error.isNotNull())
        .groupBy(*by, F.month(DATE).alias("month"))
        .agg(F.avg(error).alias("bias"), F.avg(F.abs(error)).alias("mae"))
    )


def level_bias(
    df: DataFrame,
    by: Sequence[str] = ("model",),
    label: str = "label",
    prediction: str = "prediction",
    contiguous: bool = False,
) -> DataFrame:
    """MAE, mean error and count per level of the actual value; empty levels are absent."""
    error = _error(label, prediction)
    return (
        df.filter(error.isNotNull())
        .withColumn("level", levels.report_level(F.col(label), contiguous))
        .filter(F.col("level").isNotNull())
        .groupBy(*by, "level")
        .agg(
            F.avg(F.abs(error)).alias("mae"),
            F.avg(error).alias("bias"),
            F.count(F.lit(1)).alias("n"),
        )
    )


def bias_report(df: DataFrame, **columns) -> dict[str, DataFrame]:
    """The three tables of the bias analysis."""
    return {
        "overall": overall_bias(df, **columns),
        "monthly": monthly_bias(df, **columns),
        "levels": level_bias(df, **columns),
    }


def bias_report_long(df: DataFrame, by: Sequence[str] = ("model",)) -> DataFrame:
    """All three tables in one: ``by``, ``part``, ``item``, ``figure``, ``value``.

    Grouping sets give the three tables from one scan and one shuffle of partial
    aggregates.
    """
    error = _error("label", "prediction")
    grouped = (
        df.filter(error.isNotNull())
        .withColumns(
            {"month": F.month(DATE), "level": levels.report_level(F.col("label")), "error": error}
        )
        .groupingSets([[*by], [*by, "month"], [*by, "level"]], *by, "month", "level")
        .agg(
            F.grouping("month").alias("no_month"),
            F.grouping("level").alias("no_level"),
            F.avg("error").alias("bias"),
            F.avg(F.abs("error")).alias("mae"),
            F.stddev_pop("error").alias("residual_std"),
            F.min("error").alias("min_residual"),
            F.max("error").alias("max_residual"),
            F.count("error").cast("double").alias("count"),
        )
    )
    whole = (F.col("no_month") == 1) & (F.col("no_level") == 1)
    monthly = F.col("no_month") == 0

    def figures(*pairs: tuple[str, str]):
        return F.array(
            *[F.struct(F.lit(n).alias("figure"), F.col(c).alias("value")) for n, c in pairs]
        )

    rows = (
        F.when(
            whole,
            figures(
                ("bias", "bias"),
                ("residual_std", "residual_std"),
                ("mean_abs_residual", "mae"),
                ("min_residual", "min_residual"),
                ("max_residual", "max_residual"),
            ),
        )
        .when(monthly, figures(("bias", "bias"), ("mae", "mae")))
        .otherwise(figures(("mae", "mae"), ("bias", "bias"), ("count", "count")))
    )
    part = F.when(whole, "overall").when(monthly, "month").otherwise("level")
    item = (
        F.when(whole, F.lit("all"))
        .when(monthly, F.col("month").cast("string"))
        .otherwise(F.col("level"))
    )
    return (
        grouped.withColumns({"part": part, "item": item})
        .filter(F.col("item").isNotNull())
        .select(*by, "part", "item", F.inline(rows))
    )


def month_bars(monthly: DataFrame, by: Sequence[str] = ("model",)) -> DataFrame:
    """All twelve months per group, bias 0 where a month has no rows.

    The spine is twelve months per group that occurs, not a cross join.
    """
    spine = monthly.select(*by).distinct().select(
        *by, F.explode(F.sequence(F.lit(1), F.lit(12))).alias("month")
    )
    return spine.join(monthly, [*by, "month"], "left").select(
        *by, "month", F.coalesce("bias", F.lit(0.0)).alias("bias")
    )
