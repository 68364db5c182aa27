import numpy as np
from pyspark.sql import functions as F

from stationcast.plans import charts


def wave(n, station="a"):
    rng = np.random.default_rng(n)
    y = np.sin(np.arange(n) / 40) * 50 + rng.normal(size=n)
    y[n // 3] = 900.0
    return [(station, i, float(v)) for i, v in enumerate(y)]


def test_thin_lines_keep_ends_and_extremes(days):
    df = days(wave(3000) + wave(40, "short") + [("short", 41, None), (None, 1, 2.0)] + [("flat", i, 1.0) for i in range(500)])
    for options in ({}, {"max_rows": 50}):
        out = charts.thin_line(df, 100, **options)
        counts = {r.station: r["count"] for r in out.groupBy("station").count().collect()}
        assert set(counts) == {"a", "short", "flat"} and max(counts.values()) <= 100 and counts["a"] > 80
        assert out.exceptAll(df).count() == 0
        full = df.filter("station is not null and pm25 is not null").groupBy("station").agg(F.min("pm25"), F.max("pm25"), F.min("obs_date"), F.max("obs_date"))
        assert out.groupBy("station").agg(F.min("pm25"), F.max("pm25"), F.min("obs_date"), F.max("obs_date")).exceptAll(full).count() == 0
    assert charts.thin_line(df.limit(0), 100).count() == 0


def test_short_lines_stay_whole(days):
    df = days(wave(30))
    assert charts.thin_line(df, 100).exceptAll(df).count() == 0 and charts.thin_line(df, 100).count() == 30


def test_thin_line_is_closer_than_every_nth_point(days):
    corners = np.cumsum(np.random.default_rng(2).integers(20, 150, 60))
    y = np.interp(np.arange(4000), corners, np.where(np.arange(60) % 2, 40.0, -40.0))
    rows = [("a", i, float(v)) for i, v in enumerate(y)]
    df = days(rows)
    out = sorted((r.obs_date, r.pm25) for r in charts.thin_line(df, 120).collect())
    first = min(r.obs_date for r in df.select("obs_date").collect())
    x, y = np.array([(d - first).days for d, _ in out]), np.array([v for _, v in out])
    all_y = np.array([v for _, _, v in rows])
    nth = np.arange(0, 4000, 34)
    error = lambda px, py: np.sqrt(np.mean((np.interp(np.arange(4000), px, py) - all_y) ** 2))
    assert error(x, y) < error(nth, all_y[nth])


def test_largest_triangles():
    x, y = np.arange(9.0), np.array([0, 0, 5, 0, 0, 0, -7, 0, 0.0])
    assert charts._largest_triangles(x, y, 4).tolist() == [0, 2, 6, 8]
    assert charts._largest_triangles(x, y, 9).tolist() == list(range(9))


def test_scatter_cells_hold_all_points(spark):
    rows = [("m", "test", "p", float(i % 50), float(i % 7)) for i in range(2000)] + [("m", "test", "p", None, 1.0), ("c", "test", "p", 3.0, 3.0)]
    points = spark.createDataFrame(rows, "model string, side string, panel string, x double, y double")
    out = charts.scatter_cells(points, 10).collect()
    assert sum(r.n for r in out) == 2001
    m = [r for r in out if r.model == "m"]
    assert min(r.x_low for r in m) == 0 and max(r.x_high for r in m) == 49 and max(r.y_high for r in m) == 6
    assert len(m) <= 100
