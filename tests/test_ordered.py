"""Series cut into segments give the same rows as plain windows, under any skew."""

import pandas as pd
import pytest
from pyspark.sql import functions as F

from stationcast.operators import features, fill, quantiles, split
from stationcast.operators.ordered import SEGMENT, arrange, measure, with_tie

KEYS = ["station", "obs_date"]


def frame(df, keys=None):
    pdf = df.toPandas()
    pdf = pdf[sorted(pdf.columns)]
    return pdf.sort_values(list(keys or pdf.columns)).reset_index(drop=True)


def same(a, b, keys=None):
    pd.testing.assert_frame_equal(frame(a, keys), frame(b, keys))


@pytest.fixture(scope="module")
def skewed(spark):
    """One station with a third of all rows on one date, many of them exact copies."""
    rng = spark.range(3000).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("s"), F.col("id") % 7)).alias("station"),
        F.when((F.col("id") % 3 == 0) & (F.col("id") < 2400), F.lit("2021-05-05").cast("date"))
        .otherwise(F.date_add(F.lit("2021-01-01").cast("date"), (F.col("id") % 400).cast("int")))
        .alias("obs_date"),
        F.when(F.col("id") % 5 == 0, None).otherwise((F.col("id") % 17).cast("double")).alias("pm25"),
    )
    return rng


@pytest.mark.parametrize("limit", [700, 100, 20])
def test_features_of_big_series(panel, limit):
    filled = fill.forward_fill(panel)
    same(features.build_features(filled), features.build_features(filled, max_rows=limit), KEYS)


@pytest.mark.parametrize("limit", [400, 60])
def test_fill_and_interpolation_under_skew(skewed, limit):
    same(fill.forward_fill(skewed, ["pm25"]), fill.forward_fill(skewed, ["pm25"], max_rows=limit))
    same(fill.interpolate_target(skewed), fill.interpolate_target(skewed, max_rows=limit))


@pytest.mark.parametrize("limit", [400, 60])
def test_history_and_numbers_under_skew(skewed, limit):
    same(features.add_lags(skewed), features.add_lags(skewed, max_rows=limit))
    same(features.add_rolling(skewed), features.add_rolling(skewed, max_rows=limit))
    same(split.add_folds(skewed), split.add_folds(skewed, max_rows=limit))


def test_segments_stay_small_even_for_copies(spark):
    copies = spark.range(0, 4000, 1, 16).select(
        F.lit("hot").alias("station"), F.lit("2021-01-01").cast("date").alias("obs_date"), F.lit(1.0).alias("pm25")
    )
    series = arrange(copies, max_rows=500)
    assert series.segmented
    cut = [p for p in series.parts if p.segmented][0]
    largest = cut.df.groupBy(SEGMENT).count().agg(F.max("count")).first()[0]
    assert largest <= 1500
    numbered = series.number("position", "size").result()
    row = numbered.agg(F.count_distinct("position"), F.min("position"), F.max("position"), F.max("size")).first()
    assert tuple(row) == (4000, 1, 4000, 4000)


def test_rows_without_key_in_bulk(spark, days):
    rows = [(None, i, float(i)) for i in range(50)] + [("a", i, None if i % 2 else float(i)) for i in range(6)]
    out = fill.forward_fill(days(rows), ["pm25"], max_rows=10).collect()
    assert len(out) == 56
    assert all(r.pm25 is None for r in out if r.station is None)
    assert sorted(r.pm25 for r in out if r.station == "a") == [0.0, 0.0, 2.0, 2.0, 4.0, 4.0]


def test_global_series(panel):
    out = split.add_split(panel.select(*KEYS), keys=(), order=("obs_date", "station"), max_rows=300)
    want = frame(panel.select(*KEYS)).sort_values(["obs_date", "station"]).reset_index(drop=True)
    got = out.toPandas().sort_values("position").reset_index(drop=True)
    assert list(got.position) == list(range(1, len(want) + 1))
    assert list(got.station) == list(want.station)
    assert got.is_train.sum() == int(len(want) * 0.8)


def test_measure_bounds_the_big_keys(skewed):
    sizes = measure(skewed, max_rows=900)
    assert sizes.total == 3000 and [tuple(r) for r in sizes.big.collect()] == [("hot",)]
    assert measure(skewed).big is None


def test_one_measurement_serves_a_chain(skewed):
    sizes = measure(skewed, max_rows=60)
    a = fill.impute_target(skewed, sizes=sizes)
    same(a, fill.impute_target(skewed))


def test_quantiles_of_many_values(skewed):
    small = quantiles.exact_quantiles(skewed, ["pm25"], [0.1, 0.5, 0.9], by=["station"])
    same(small, quantiles.exact_quantiles(skewed, ["pm25"], [0.1, 0.5, 0.9], by=["station"], max_rows=5))
    want = skewed.toPandas().groupby("station").pm25.quantile(0.9)
    got = small.filter("probability = 0.9").toPandas().set_index("station").value
    assert got.round(9).to_dict() == want.round(9).to_dict()


def test_history_leaves_bulk_rows_without_key_empty(days):
    rows = [(None, i, float(i)) for i in range(40)] + [("a", i, float(i)) for i in range(30)] + [("b", 0, 1.0)]
    df = days(rows)
    same(features.add_lags(df, lags=[1, 3]), features.add_lags(df, lags=[1, 3], max_rows=12))
    out = features.add_lags(df, lags=[1], max_rows=12)
    assert out.columns == ["station", "obs_date", "pm25", "pm25_lag_1"]
    assert out.filter("station IS NULL AND pm25_lag_1 IS NOT NULL").count() == 0
    assert out.filter("station = 'a' AND pm25_lag_1 = pm25 - 1").count() == 29


def test_interpolation_with_bulk_rows_without_key(days):
    rows = [(None, i, None if i % 2 else 1.0) for i in range(30)]
    rows += [("a", i, None if i % 3 else float(i)) for i in range(30)]
    same(fill.interpolate_target(days(rows)), fill.interpolate_target(days(rows), max_rows=12))


@pytest.fixture
def keyless(days):
    """Forty rows without a station, more than fit a window, beside a series."""
    return days([(None, i, float(i)) for i in range(40)] + [("a", i, float(i % 7)) for i in range(30)])


@pytest.mark.parametrize("limit", [1000, 35, 12])
def test_rows_without_key_have_no_position_at_any_size(keyless, limit):
    same(split.add_folds(keyless), split.add_folds(keyless, max_rows=limit))
    out = split.add_split(keyless, max_rows=limit)
    same(split.add_split(keyless), out)
    row = out.groupBy().agg(
        F.count_if(F.col("station").isNull() & F.col("position").isNull() & F.col("is_train").isNull()),
        F.count_if(F.col("is_train")), F.count_if(~F.col("is_train")),
    ).first()
    assert tuple(row) == (40, 24, 6)


@pytest.mark.parametrize("limit", [1000, 12])
def test_running_sum_and_quantiles_without_key(keyless, limit):
    series = arrange(keyless.withColumn("one", F.lit(1).cast("long")), max_rows=limit)
    out = series.running_sum("one", "upto", "all").result()
    assert out.filter("station IS NULL AND (upto IS NOT NULL OR `all` IS NOT NULL)").count() == 0
    assert out.filter("station = 'a' AND `all` = 30").count() == 30
    got = quantiles.exact_quantiles(keyless, ["pm25"], [0.5], by=["station"], max_rows=limit)
    assert {r.station: r.value for r in got.collect()} == {"a": 3.0, None: 19.5}


@pytest.mark.parametrize("limit", [1000, 5])
def test_tied_rows_keep_their_order_through_a_chain(days, limit):
    """Twelve readings of one day: a later operator sees the order that an earlier one used."""
    df = days([("a", 0, float(i)) for i in range(12)])
    lagged = features.add_lags(df, lags=[1], max_rows=limit)
    placed = split.add_split(features.with_calendar(lagged), max_rows=limit).orderBy("position").collect()
    assert [r.pm25_lag_1 for r in placed[1:]] == [r.pm25 for r in placed[:-1]]
    shared = with_tie(df)
    by_tie = split.add_split(features.add_lags(shared, lags=[1], max_rows=limit), max_rows=limit).orderBy("position").collect()
    assert [r.pm25_lag_1 for r in by_tie[1:]] == [r.pm25 for r in by_tie[:-1]]


def test_many_segments_are_joined_not_broadcast(skewed, monkeypatch):
    from stationcast.operators import ordered

    monkeypatch.setattr(ordered, "MAX_PIECES", 3)
    same(fill.forward_fill(skewed, ["pm25"]), fill.forward_fill(skewed, ["pm25"], max_rows=60))
    same(split.add_split(skewed), split.add_split(skewed, max_rows=60))


def test_quantiles_between_approximate_ones(spark):
    """Only a small part of the values is sorted, with the same result."""
    df = spark.range(40_000).select(
        F.when(F.col("id") % 3 == 0, None).otherwise(F.concat(F.lit("g"), F.col("id") % 2)).alias("g"),
        F.when(F.col("id") % 11 > 0, (F.hash("id") % 5000) / 7.0).alias("x"),
        F.when(F.col("id") < 30, F.col("id").cast("double")).alias("y"),
    )
    ps = [0.0, 0.25, 0.5, 0.9, 1.0]
    for by in ((), ("g",)):
        plain = quantiles.exact_quantiles(df, ["x", "y"], ps, by)
        same(plain, quantiles.exact_quantiles(df, ["x", "y"], ps, by, bracket_rows=8_000))
        same(plain, quantiles.exact_quantiles(df, ["x", "y"], ps, by, bracket_rows=8_000, max_rows=50))
    want = df.toPandas()[["x", "y"]].quantile(0.25)
    got = quantiles.exact_quantiles(df, ["x", "y"], [0.25], bracket_rows=8_000).toPandas().set_index("column").value
    assert got.round(9).to_dict() == want.round(9).to_dict()


def test_long_lags_across_short_segments(spark, days):
    """365 rows back over segments of 7 rows, with no more rows in an array than lags need."""
    rows = [("a", i, float(i)) for i in range(900)] + [("b", i, float(-i)) for i in range(200)]
    df = days(rows)
    long = features.add_lags(df, lags=(1, 365), max_rows=7)
    plain = features.add_lags(df, lags=(1, 365))
    assert long.exceptAll(plain).count() == 0 and long.count() == plain.count()
    assert long.filter("pm25_lag_365 is not null").count() == 900 - 365
    part = next(p for p in arrange(df, max_rows=7).parts if p.segmented)
    halo = part._halo(365, ["pm25"])
    assert halo.groupBy("station", "_segment").count().agg(F.max("count")).first()[0] == 365
