"""Arithmetic on predictions, errors and report figures."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Tolerances of the near-equality test.
REL_TOL = 1e-5
ABS_TOL = 1e-8
# Fixed value: smallest denominator of a relative error (double epsilon).
TINY = 2.220446049250313e-16
# What a well-formed decimal number looks like; anything else coerces to null.
NUMBER_PATTERN = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"


def to_number(text: Column) -> Column:
    """Text to double; malformed text becomes null (overflow: see ``finite``)."""
    text = text.cast("string")
    return F.when(text.rlike(NUMBER_PATTERN), F.trim(text)).try_cast("double")


def finite(value: Column) -> Column:
    """Infinities and NaN become null."""
    return F.when(F.abs(value) < float("inf"), value)


def lower_bound(value: Column, std: Column, k: float = 1.0) -> Column:
    return value - std * k


def upper_bound(value: Column, std: Column, k: float = 1.0) -> Column:
    return value + std * k


def signed_error(actual: Column, predicted: Column) -> Column:
    return predicted - actual


def residual(actual: Column, predicted: Column) -> Column:
    return actual - predicted


def absolute_error(actual: Column, predicted: Column) -> Column:
    return F.abs(predicted - actual)


def delta(simulated: Column, baseline: Column) -> Column:
    return simulated - baseline


def delta_direction(change: Column, band: float = 0.1) -> Column:
    return F.when(change > band, "up").when(change < -band, "down").otherwise("flat")


def near_equal(predicted: Column, actual: Column) -> Column:
    return F.abs(predicted - actual) <= ABS_TOL + REL_TOL * F.abs(actual)


def horizon_label(days: Column) -> Column:
    return F.concat(F.lit("H+"), days.cast("string"))


def date_label(date: Column) -> Column:
    return F.date_format(date, "dd MMM yyyy")


def r2_verdict(r2: Column) -> Column:
    return (
        F.when(r2 > 0.8, "excellent")
        .when(r2 > 0.6, "good")
        .when(r2 > 0.4, "moderate")
        .otherwise("poor")
    )


def bias_verdict(bias: Column, limit: float = 5.0) -> Column:
    return F.when(F.abs(bias) > limit, "significant").otherwise("minimal")


def fit_gap_verdict(train_mae: Column, test_mae: Column, limit: float = 2.0) -> Column:
    """Error much lower on train than on test is overfitting, the reverse is underfitting."""
    gap = train_mae - test_mae
    return F.when(gap < -limit, "overfitting").when(gap > limit, "underfitting").otherwise("balanced")


def report_round(value: Column, places: int) -> Column:
    """Half-even rounding."""
    return F.bround(value, places)


def period_year(text: Column) -> Column:
    return F.substring(text.cast("string"), 1, 4)


def period_month(text: Column) -> Column:
    return F.substring(text.cast("string"), 5, 2)
