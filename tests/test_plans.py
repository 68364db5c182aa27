"""The physical plans are the intended ones."""

import re

import pytest
from pyspark.sql import functions as F

from stationcast.operators import bias, cleaning, features, fill, metrics
from stationcast.plans import scoring
from stationcast.session import scratch_path
from stationcast.sources.readings import read_panel, write_panel


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def exchanges(text: str) -> int:
    return len(re.findall(r"Exchange hashpartitioning|Exchange rangepartitioning|Exchange SinglePartition", text))


def test_feature_chain_shuffles_and_sorts_once(raw):
    text = plan(features.features_from_raw(raw))
    assert exchanges(text) == 1
    assert len(re.findall(r"\bSort \[", text)) == 1
    assert "SinglePartition" not in text and "Python" not in text


def test_history_columns_share_one_sort(panel):
    text = plan(features.build_features(panel, tiebreak=()))
    assert exchanges(text) == 1 and len(re.findall(r"\bSort \[", text)) == 1


def test_station_filter_reaches_the_scan(panel):
    text = plan(cleaning.only_station(fill.forward_fill(panel, tiebreak=()), "NATION_1"))
    assert re.search(r"PushedFilters: \[[^\]]*EqualTo\(station,NATION_1\)", text)


def test_scan_reads_wanted_columns_only(panel):
    text = plan(features.add_lags(panel.select("station", "obs_date", "pm25"), tiebreak=()))
    assert re.findall(r"ReadSchema: struct<([^>]*)>", text) == ["station:string,obs_date:date,pm25:double"]


def test_last_rows_are_cut_before_the_shuffle(panel):
    text = plan(features.latest_rows(panel, 7))
    assert text.count("WindowGroupLimit") == 2


@pytest.mark.parametrize("build", [
    lambda p: metrics.evaluate(p),
    lambda p: bias.bias_report_long(p),
])
def test_aggregates_are_combined_first(spark, panel, build):
    rows = panel.select("station", "obs_date", F.col("pm25").alias("label"), F.col("pm10").alias("prediction"))
    rows = rows.withColumns({"model": F.lit("m"), "side": F.lit("test")})
    text = plan(build(rows))
    assert "partial_" in text and exchanges(text) == 1


def test_forecasts_need_no_cross_join(panel):
    text = plan(scoring.forecast_features(panel, scenarios=tuple(scoring.SCENARIOS)))
    assert "Cartesian" not in text and "NestedLoop" not in text and exchanges(text) == 1


def test_big_series_use_no_single_partition_for_rows(panel):
    out = fill.forward_fill_global(panel)
    text = plan(out)
    single = [m.start() for m in re.finditer("SinglePartition", text)]
    # only the summary with one row per segment meets in one place
    assert len(single) <= 1
    assert "Window [last(pm25" in text


def test_stored_panel_is_pruned_by_year(spark, panel):
    path = scratch_path(spark, "panel")
    write_panel(panel, path)
    stored = spark.read.parquet(path).filter("_year = 1996")
    assert "PartitionFilters: [isnotnull(_year" in plan(stored)
    assert read_panel(spark, path).columns == panel.columns
