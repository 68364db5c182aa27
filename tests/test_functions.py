import datetime

import pytest
from pyspark.sql import functions as F

from stationcast.functions import calendar, levels, numbers


def column(spark, values, kind="double"):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")


def apply(spark, values, fn, kind="double"):
    rows = column(spark, values, kind).select("i", fn(F.col("x")).alias("y")).orderBy("i").collect()
    return [r.y for r in rows]


def test_category_closes_upper_edges(spark):
    got = apply(spark, [50.0, 50.1, 100.0, 150.0, 150.1, None], levels.category)
    assert got == ["Baik", "Sedang", "Sedang", "Tidak Sehat", "Sangat Tidak Sehat", "Sangat Tidak Sehat"]


def test_risk_closes_lower_edges(spark):
    got = apply(spark, [49.9, 50.0, 100.0, 150.0, None], levels.risk_level)
    assert got == ["Rendah", "Sedang", "Tinggi", "Kritis", "Rendah"]


def test_report_levels_leave_gaps(spark):
    values = [50.0, 50.5, 51.0, 151.0, -1.0, None]
    assert apply(spark, values, levels.report_level) == ["Good", None, "Moderate", "Very Unhealthy", None, None]
    closed = apply(spark, values, lambda c: levels.report_level(c, contiguous=True))
    assert closed == ["Good", "Moderate", "Moderate", "Very Unhealthy", "Good", None]


def test_trend_has_a_dead_band(spark):
    got = apply(spark, [5.0, 5.1, -5.0, -5.1], levels.trend_direction)
    assert got == ["Stable", "Rising", "Stable", "Falling"]


def test_confidence_needs_both_sides(spark):
    got = apply(spark, [200.0, 50.0, 0.5, None], lambda c: levels.confidence_level(c, F.lit(10.0)))
    assert got == ["Tinggi", "Sedang", "Rendah", "Rendah"]
    assert apply(spark, [200.0], lambda c: levels.confidence_level(c, F.lit(None).cast("double"))) == ["Rendah"]


def test_every_risk_level_has_advice(spark):
    got = apply(spark, list(levels.RECOMMENDATIONS), levels.recommendation, "string")
    assert got == list(levels.RECOMMENDATIONS.values())


def test_number_coercion(spark):
    values = ["12", " 12 ", "1e3", "12f", "1.0d", "inf", "---", "1,5", "", None, "-.5", "1e999", "NaN"]
    got = apply(spark, values, lambda c: numbers.finite(numbers.to_number(c)), "string")
    assert got == [12.0, 12.0, 1000.0, None, None, None, None, None, None, None, -0.5, None, None]


@pytest.mark.parametrize("day, season, rainy", [
    ("2021-12-31", 1, 1), ("2021-02-01", 1, 1), ("2021-03-01", 2, 1), ("2021-04-01", 2, 0), ("2021-09-30", 4, 0), ("2021-10-01", 4, 1),
])
def test_season(spark, day, season, rainy):
    date = F.lit(day).cast("date")
    row = spark.range(1).select(calendar.season(date).alias("s"), calendar.is_rainy_season(date).alias("r")).first()
    assert (row.s, row.r) == (season, rainy)


def test_calendar_parts(spark):
    date = F.lit("2021-01-03").cast("date")  # a Sunday
    row = spark.range(1).select(*[e.alias(n) for n, e in calendar.time_parts(date).items()], calendar.period(date).alias("p")).first()
    assert row.asDict() == {"day_of_week": 6, "month": 1, "year": 2021, "day_of_year": 3, "quarter": 1, "is_weekend": 1, "p": 202101}


def test_labels(spark):
    row = spark.range(1).select(
        numbers.horizon_label(F.lit(3)).alias("h"), numbers.date_label(F.lit(datetime.date(2021, 1, 5))).alias("d")
    ).first()
    assert (row.h, row.d) == ("H+3", "05 Jan 2021")


def test_delta_direction(spark):
    assert apply(spark, [0.2, 0.1, -0.1, -0.2], numbers.delta_direction) == ["up", "flat", "flat", "down"]


def test_fit_gap_words_follow_the_sign(spark):
    got = apply(spark, [1.0, 5.0, 9.0], lambda c: numbers.fit_gap_verdict(c, F.lit(5.0)))
    assert got == ["overfitting", "balanced", "underfitting"]


def test_rounding_is_half_even(spark):
    assert apply(spark, [0.5, 1.5, 2.5], lambda c: numbers.report_round(c, 0)) == [0.0, 2.0, 2.0]
