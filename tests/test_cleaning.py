import datetime

import pytest

from stationcast.operators import cleaning, fill


def test_column_names(spark):
    df = spark.createDataFrame([(1, 2)], [" A ", "b"])
    assert cleaning.clean_column_names(df).columns == ["a", "b"]
    with pytest.raises(ValueError, match="collide"):
        cleaning.clean_column_names(spark.createDataFrame([(1, 2)], ["A", "a "]))


def test_tokens_are_exact(spark):
    df = spark.createDataFrame([("N/A", 1), ("null", 2), ("TIDAK ADA DATA", 3), ("n/a", 4), (" null", 5)], ["x", "n"])
    got = [r.x for r in cleaning.null_tokens(df).orderBy("n").collect()]
    assert got == [None, None, None, "n/a", " null"]


@pytest.mark.parametrize("period, day, strict, expected", [
    ("202102", "30", False, None),
    ("202113", "01", False, None),
    ("202101", "5", False, datetime.date(2021, 1, 5)),
    ("202101", "5.0", False, datetime.date(2021, 1, 5)),
    ("202101", "5.0", True, None),
    ("202101", "5.7", False, None),
    ("202101", "05", True, datetime.date(2021, 1, 5)),
    ("202101", None, False, None),
    ("2021", "5", False, None),
    (None, "5", False, None),
])
def test_dates(spark, period, day, strict, expected):
    df = spark.createDataFrame([(period, day)], "periode_data string, tanggal string")
    assert cleaning.assemble_dates(df, strict).first().obs_date == expected


def test_fill_skips_leading_gap(days):
    rows = [("a", i, v) for i, v in enumerate([None, 1.0, None, None, 4.0, None])]
    got = [r.pm25 for r in fill.forward_fill(days(rows), ["pm25"]).orderBy("obs_date").collect()]
    assert got == [None, 1.0, 1.0, 1.0, 4.0, 4.0]


def test_fill_without_station_is_null(days):
    rows = [("a", 0, 1.0), (None, 1, 2.0), ("a", 2, None), (None, 3, None)]
    got = [r.pm25 for r in fill.forward_fill(days(rows), ["pm25"]).orderBy("obs_date").collect()]
    assert got == [1.0, None, 1.0, None]


def test_interpolation(days):
    rows = [("a", i, v) for i, v in enumerate([None, 1.0, None, None, 4.0, None])]
    got = [r.pm25 for r in fill.interpolate_target(days(rows)).orderBy("obs_date").collect()]
    assert got == [None, 1.0, 2.0, 3.0, 4.0, 4.0]


def test_interpolation_counts_rows_not_days(days):
    rows = [("a", 0, 0.0), ("a", 50, None), ("a", 51, 2.0)]
    got = [r.pm25 for r in fill.interpolate_target(days(rows)).orderBy("obs_date").collect()]
    assert got == [0.0, 1.0, 2.0]


def test_fill_never_changes_known_values(panel):
    filled = fill.forward_fill(panel).withColumnRenamed("pm25", "filled").select("station", "obs_date", "filled")
    both = panel.join(filled, ["station", "obs_date"]).filter("pm25 IS NOT NULL")
    assert both.count() == panel.filter("pm25 IS NOT NULL").count()
    assert both.filter("pm25 <> filled").count() == 0


def test_clean_chain_gives_back_the_panel(raw, panel):
    clean = cleaning.clean_readings(raw)
    assert clean.count() == panel.count()
    again = fill.forward_fill(panel)
    assert clean.select(*panel.columns).exceptAll(again).count() == 0


def test_global_fill_crosses_stations(days):
    rows = [("a", 0, 1.0), ("b", 1, None), ("a", 2, None), ("b", 3, 5.0), ("a", 4, None)]
    out = fill.forward_fill_global(days(rows), ["pm25"]).orderBy("obs_date").collect()
    assert [r.pm25 for r in out] == [1.0, 1.0, 1.0, 5.0, 5.0]


def test_extra_columns_pass_through(spark):
    df = spark.createDataFrame([("202101", "1", "s", "3", "memo")], ["periode_data", "tanggal", "stasiun", "max", "Note"])
    row = cleaning.clean_readings(df).first()
    assert (row.note, row.max_idx, row.station) == ("memo", 3.0, "s")


def test_incomplete_report(days):
    rows = [("a", 0, 1.0), ("a", 1, None), ("a", 2, 2.0), ("a", 3, None)]
    row = cleaning.incomplete_report(days(rows)).first()
    assert (row.rows_before, row.rows_after, row.rows_dropped, row.dropped_pct) == (4, 2, 2, 50.0)
    assert cleaning.drop_incomplete(days(rows)).count() == 2
