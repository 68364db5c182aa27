"""Registered queries against their DuckDB SQL at the smallest scale.

All of them run with ``STATIONCAST_ALL=1``; by default one of each kind.
"""

import os

import pytest

import __spark_entry__ as entry
from oracle_check import compare, connect

CHECKED = entry.oracle_sql()
SOME = (
    "panel raw_panel s1_csv_scan s4_live_feed c8_forward_fill c9_forward_fill_global c10_clean_chain "
    "w5_interpolate w7_feature_chain w8_split_global w9_folds w10_sorted_band f8_category a6_bias_report "
    "a8_quality_report a11_box_summary a12_medians m5_all_metrics m15_comparison l3_select_best "
    "m19_forecast_features m20_forecast m21_requested_scenario m22_manual_scoring r1_forecast_chart t1_live_ingest "
    "m13_station_models m14_fold_errors_one_feature m20_forecast_values r3_scatter_cells r10_line_extremes t1_daily_averages"
).split()
NAMES = list(CHECKED) if os.environ.get("STATIONCAST_ALL") else SOME


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, sf, con, name):
    problem, rows = compare(spark, con, sf, entry.queries()[name], CHECKED[name])
    assert problem is None and rows > 0


@pytest.mark.parametrize("name", ["m10_linear_regression", "m12_comparison_values", "m8_leaf_values"])
def test_trained_models_at_the_next_scale(spark, name):
    larger = "/root/testdata/sf0.01"
    problem, rows = compare(spark, connect(larger), larger, entry.queries()[name], CHECKED[name])
    assert problem is None and rows > 0


def test_optional_parts_can_be_missing(monkeypatch):
    """Without a library that only the text operators need, all other queries are still there."""
    import importlib
    import sys

    for name in [n for n in sys.modules if n == "corpus_pipeline" or n.startswith("stationcast.llm")]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, "zstandard", None)
    monkeypatch.setitem(sys.modules, "xxhash", None)
    monkeypatch.setitem(sys.modules, "tiktoken", None)
    try:
        without = importlib.reload(entry)
        assert "m10_linear_regression" in without.queries() and set(without.oracle_sql()) <= set(without.queries())
    finally:
        monkeypatch.undo()
        importlib.reload(entry)


def test_every_check_has_a_query():
    assert set(CHECKED) <= set(entry.queries())


def test_entry(spark):
    out = entry.entry(spark)
    assert {"station", "horizon", "value", "level"} <= set(out.columns)
    assert out.count() > 0
