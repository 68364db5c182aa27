"""Error metrics and checks of predictions, for all models in one aggregate."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import TINY, near_equal

SIDES = ("train", "test")
METRICS = ("mae", "rmse", "r2", "mape")

# A model better than this is rejected as too good to be true.
MIN_TEST_MAE = 0.1
MAX_TEST_R2 = 0.999
# Fixed value: predictions spanning less than this share of the actuals are suspicious.
MIN_RANGE_SHARE = 0.1


def mae(y: Column, p: Column) -> Column:
    return F.avg(F.abs(y - p))


def rmse(y: Column, p: Column) -> Column:
    return F.sqrt(F.avg((y - p) * (y - p)))


def r2(y: Column, p: Column) -> Column:
    """1 - SSE / SST. Constant actuals: 1 if matched exactly, else 0. Under two rows: null."""
    sse = F.sum((y - p) * (y - p))
    constant = F.max(y) == F.min(y)
    return (
        F.when(F.count(y) < 2, F.lit(None).cast("double"))
        .when(constant, F.when(sse == 0, 1.0).otherwise(0.0))
        .otherwise(1.0 - F.try_divide(sse, F.var_pop(y) * F.count(y)))
    )


def mape(y: Column, p: Column) -> Column:
    """In percent; the denominator is at least the double epsilon."""
    return F.avg(F.abs(y - p) / F.greatest(F.abs(y), F.lit(TINY))) * 100.0


def metric_columns(label: str = "label", prediction: str = "prediction") -> dict[str, Column]:
    y, p = F.col(label), F.col(prediction)
    return {"mae": mae(y, p), "rmse": rmse(y, p), "r2": r2(y, p), "mape": mape(y, p)}


def evaluate(
    df: DataFrame,
    by: Sequence[str] = ("model", "side"),
    label: str = "label",
    prediction: str = "prediction",
) -> DataFrame:
    """MAE, RMSE, R2 and MAPE per group, in one pass."""
    scored = df.filter(F.col(label).isNotNull() & F.col(prediction).isNotNull())
    columns = metric_columns(label, prediction)
    return scored.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), *[e.alias(name) for name, e in columns.items()]
    )


def sanity_check(
    df: DataFrame,
    by: Sequence[str] = ("model", "side"),
    label: str = "label",
    prediction: str = "prediction",
) -> DataFrame:
    """``status`` per group: exact_copy and constant fail, narrow_range only warns."""
    y, p = F.col(label), F.col(prediction)
    found = (
        df.filter(y.isNotNull() & p.isNotNull())
        .groupBy(*by)
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.count_if(near_equal(p, y)).alias("n_near_equal"),
            (F.max(p) - F.min(p)).alias("predicted_range"),
            (F.max(y) - F.min(y)).alias("actual_range"),
        )
    )
    status = (
        F.when(F.col("n_near_equal") == F.col("n"), "exact_copy")
        .when(F.col("predicted_range") == 0, "constant")
        .when(F.col("predicted_range") < F.col("actual_range") * MIN_RANGE_SHARE, "narrow_range")
        .otherwise("ok")
    )
    return found.withColumn("status", status).withColumn(
        "passed", ~F.col("status").isin("exact_copy", "constant")
    )


def too_good(test_mae: Column, test_r2: Column) -> Column:
    return F.coalesce((test_mae < MIN_TEST_MAE) | (test_r2 > MAX_TEST_R2), F.lit(False))


def fold_errors(
    df: DataFrame, by: Sequence[str] = ("model",), label: str = "label", prediction: str = "prediction"
) -> DataFrame:
    """MAE of each fold: ``by``, ``fold``, ``fold_mae``. Block 0 is never tested."""
    return (
        df.filter(F.col("block") >= 1)
        .groupBy(*by, F.col("block").alias("fold"))
        .agg(mae(F.col(label), F.col(prediction)).alias("fold_mae"))
    )


def cv_summary(folds: DataFrame, by: Sequence[str] = ("model",)) -> DataFrame:
    """Mean and population standard deviation of the fold errors."""
    return folds.groupBy(*by).agg(
        F.avg("fold_mae").alias("cv_mae"), F.stddev_pop("fold_mae").alias("cv_std")
    )


def comparison(metrics: DataFrame, cv: DataFrame | None = None) -> DataFrame:
    """One row per model: the metrics of both sides and the cross-validation values."""
    wide = metrics.groupBy("model").agg(
        *[
            F.max(F.when(F.col("side") == side, F.col(m))).alias(f"{side}_{m}")
            for m in METRICS
            for side in SIDES
        ]
    )
    if cv is None:
        return wide.withColumns(
            {c: F.lit(None).cast("double") for c in ("cv_mae", "cv_std")}
        )
    return wide.join(cv, "model", "left")
