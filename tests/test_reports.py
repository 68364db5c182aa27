import datetime
import math

import pytest
from pyspark.sql import functions as F

from stationcast.operators import bias, features, metrics, quantiles, reports, selection, split


def predictions(spark, rows, model="m", side="test"):
    start = datetime.date(2021, 1, 1)
    data = [(model, side, "a", start + datetime.timedelta(days=i), float(y), p) for i, (y, p) in enumerate(rows)]
    return spark.createDataFrame(data, "model string, side string, station string, obs_date date, label double, prediction double")


PAIRS = [(10, 12.0), (20, 19.0), (30, 32.0), (40, 38.0), (50, 51.0)]


def test_metrics_by_hand(spark):
    row = metrics.evaluate(predictions(spark, PAIRS)).first()
    assert row.mae == pytest.approx(1.6)
    assert row.rmse == pytest.approx(math.sqrt(2.8))
    assert row.r2 == pytest.approx(0.986)
    assert row.mape == pytest.approx(7.733333, abs=1e-6)


@pytest.mark.parametrize("pairs, r2", [([(5, 5.0), (5, 5.0)], 1.0), ([(5, 5.0), (5, 6.0)], 0.0), ([(5, 6.0)], None)])
def test_r2_of_constant_actuals(spark, pairs, r2):
    assert metrics.evaluate(predictions(spark, pairs)).first().r2 == r2


def test_mape_of_zero_actual_is_finite(spark):
    assert metrics.evaluate(predictions(spark, [(0, 1.0), (2, 2.0)])).first().mape > 1e15


@pytest.mark.parametrize("pairs, status, passed", [
    ([(1, 1.0), (2, 2.0)], "exact_copy", False),
    ([(1, 1.5), (2, 1.5)], "constant", False),
    ([(0, 50.0), (100, 51.0)], "narrow_range", True),
    (PAIRS, "ok", True),
])
def test_sanity(spark, pairs, status, passed):
    row = metrics.sanity_check(predictions(spark, pairs)).first()
    assert (row.status, row.passed) == (status, passed)


def test_bias_report(spark):
    rows = {(r.part, r.item, r.figure): r.value for r in bias.bias_report_long(predictions(spark, PAIRS)).collect()}
    assert rows["overall", "all", "bias"] == pytest.approx(0.4)
    assert rows["overall", "all", "mean_abs_residual"] == pytest.approx(1.6)
    assert rows["overall", "all", "residual_std"] == pytest.approx(math.sqrt(2.8 - 0.16))
    assert rows["month", "1", "mae"] == pytest.approx(1.6)
    assert rows["level", "Good", "count"] == 5
    assert not any(item == "Moderate" for _, item, _ in rows)


def test_month_spine(spark):
    bars = bias.month_bars(bias.monthly_bias(predictions(spark, PAIRS))).collect()
    assert sorted(b.month for b in bars) == list(range(1, 13))
    assert sum(b.bias for b in bars) == pytest.approx(0.4)


def test_histogram_closes_the_last_bin(days):
    rows = [("a", i, v) for i, v in enumerate([0.0, 1.0, 2.0, 3.0, 10.0, None])]
    bins = reports.histogram(days(rows), bins=5).orderBy("bin").collect()
    assert [b.n for b in bins] == [2, 2, 0, 0, 1]
    assert sum(b.density * (b.high - b.low) for b in bins) == pytest.approx(1)


def test_histogram_of_a_constant(days):
    bins = reports.histogram(days([("a", 0, 3.0), ("a", 1, 3.0)]), bins=4).orderBy("bin").collect()
    assert (bins[0].low, bins[-1].high) == (2.5, 3.5)
    assert sum(b.n for b in bins) == 2


def test_quartiles(days):
    rows = [("a", i, v) for i, v in enumerate([1.0, 2.0, 4.0, 10.0])]
    got = quantiles.exact_quantiles(days(rows), ["pm25"], [0.25, 0.5, 0.75]).orderBy("probability").collect()
    assert [r.value for r in got] == [1.75, 3.0, 5.5]


def test_box_with_outlier(days):
    values = [1.0, 2.0, 3.0, 4.0, 5.0, 100.0]
    df = days([("a", i, v) for i, v in enumerate(values)])
    row = reports.box_summary(df, by=("station",)).first()
    assert (row.whisker_low, row.whisker_high, row.outliers, row.n) == (1.0, 5.0, 1, 6)
    assert [r.pm25 for r in reports.outliers(df, by=("station",)).collect()] == [100.0]


def test_richest_station_ties_by_name(days):
    rows = [("a", i, 1.0) for i in range(3)] + [(s, i, 1.0) for s in "cb" for i in range(5)]
    assert features.richest_station(days(rows)).first().station == "b"


def test_duplicates_count_null_dates(spark):
    values = [1, 1, 1, 2, None, None]
    df = spark.createDataFrame([("a", v) for v in values], "station string, day int").select(
        "station", F.date_add(F.lit("2021-01-01").cast("date"), F.col("day")).alias("obs_date")
    )
    assert reports.duplicate_dates(df).first().duplicates == 3


def test_rolling_needs_a_full_window(days):
    rows = [("a", i, v) for i, v in enumerate([1.0, None, 3.0, 4.0, 5.0])]
    out = features.add_rolling(days(rows), windows=[3]).orderBy("obs_date").collect()
    assert [r.pm25_rolling_mean_3 for r in out] == [None, None, None, None, 4.0]
    assert [r.pm25_rolling_std_3 for r in out] == [None, None, None, None, 1.0]


def test_lags_by_row_and_by_calendar(days):
    df = days([("a", 0, 1.0), ("a", 2, 2.0), ("a", 3, 3.0)])
    by_row = features.add_lags(df, lags=[1]).orderBy("obs_date").collect()
    by_day = features.add_calendar_lags(df, lags=[1]).orderBy("obs_date").collect()
    assert [r.pm25_lag_1 for r in by_row] == [None, 1.0, 2.0]
    assert [r.pm25_lag_1 for r in by_day] == [None, None, 2.0]


@pytest.mark.parametrize("n, folds, first", [(19, None, None), (20, 2, 8), (57, 5, 12)])
def test_folds(days, n, folds, first):
    out = split.add_folds(days([("a", i, 1.0) for i in range(n)])).collect()
    assert {r.fold_count for r in out} == {folds}
    if folds:
        sizes = [sum(r.block == b for r in out) for b in range(folds + 1)]
        assert sizes[0] == first and set(sizes[1:]) == {n // (folds + 1)}
        for k in range(1, folds + 1):
            assert max(r.obs_date for r in out if r.block < k) < min(r.obs_date for r in out if r.block == k)


def test_leakage():
    names = ["pm25", "pm10", "pm25_lag_1", "pm25_rolling_mean_7", "PM_DuakomaLima_x", "month", "pm10"]
    assert features.leakage_free(names) == ["pm10", "month"]
    assert features.leakage_free(names, allow_lagged=True) == ["pm10", "pm25_lag_1", "month"]


def test_feature_columns_are_numeric(spark):
    df = spark.createDataFrame([], "station string, obs_date date, pm25 double, kategori int, n int, note string")
    assert features.feature_columns(df) == ["pm25", "n"]


def table(spark, rows):
    names = "model string, rank int, test_mae double, test_r2 double, test_mape double, cv_mae double, cv_std double"
    return spark.createDataFrame(rows, names)


def test_selection_adds_fold_spread_and_breaks_ties_by_order(spark):
    rows = [("a", 0, 3.0, 0.5, 1.0, None, None), ("b", 1, 1.0, 0.9, 2.0, 1.0, 2.0), ("c", 2, 2.9, 0.9, 3.0, 1.0, 0.1)]
    assert selection.select_best(table(spark, rows)).first().model == "a"
    best = {r.criterion: r.model for r in selection.best_per_metric(table(spark, rows)).collect()}
    assert best == {"best_test_mae": "b", "best_test_r2": "b", "best_test_mape": "a", "most_consistent": "c"}
    assert selection.select_best(table(spark, [])).count() == 0
    missing = table(spark, [("a", 0, 1.0, None, None, None, None)])
    assert [r.criterion for r in selection.best_per_metric(missing).collect()] == ["best_test_mae"]


def test_correlation_is_pairwise(spark):
    df = spark.createDataFrame([(1.0, 2.0, 5.0), (2.0, 4.0, 5.0), (3.0, None, 5.0)], "a double, b double, c double")
    got = {(r.column_a, r.column_b): r.correlation for r in reports.correlation(df, ["a", "b", "c"]).collect()}
    assert got["a", "b"] == pytest.approx(1) and got["b", "a"] == got["a", "b"]
    assert got["a", "a"] == 1 and got["c", "c"] is None and got["a", "c"] is None
    assert len(got) == 9


def test_quality_counts_tokens_on_both_sides(raw):
    from stationcast.operators.cleaning import clean_readings

    row = reports.quality_report(raw, clean_readings(raw), ["pm_duakomalima", "max"], ["pm25", "max_idx"]).first()
    assert row.rows_before - row.rows_after == row.rows_dropped > 0
    assert row.quality_before < row.quality_after <= 100
