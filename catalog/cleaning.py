"""Sources and cleaning."""

from __future__ import annotations

from functools import partial

from pyspark.sql import functions as F

from stationcast.operators import cleaning, features, fill, split
from stationcast.schema import (
    CONTEXT_POLLUTANTS,
    DATE,
    RAW_COLUMNS,
    SERVING_FEATURES,
    STATION,
)
from stationcast.functions.calendar import with_serving_calendar
from stationcast.session import scratch_path
from stationcast.sources import derived, feed, readings

from . import base, ctes
from .ctes import CALENDAR, GLOBAL_FILLS, sql
from .registry import again, query, rounded

RAW_LIST = ", ".join(RAW_COLUMNS)
PANEL_LIST = "station, obs_date, pm25, pm10, so2, co, o3, no2, max_idx"


@query("panel", sql(f"select {PANEL_LIST} from panel", "panel"))
def panel(spark, sf):
    return base.panel(spark, sf)


@query("raw_panel", sql(f"select {RAW_LIST} from raw", "raw"))
def raw_panel(spark, sf):
    return base.raw(spark, sf)


def _csv(spark, sf) -> str:
    path = scratch_path(spark, "csv")
    base.raw(spark, sf).write.option("header", True).csv(path)
    return path


@query("s1_csv_scan", sql(f"select {RAW_LIST.replace('bulan', 'cast(bulan as varchar) as bulan')} from raw", "raw"))
def s1(spark, sf):
    return readings.read_readings(spark, _csv(spark, sf))


@query(
    "s2_land_csv",
    sql(
        "select count(*) as rows, cast(11 as int) as columns, 'periode_data,tanggal,stasiun,pm_duakomalima,pm_sepuluh,"
        "sulfur_dioksida,karbon_monoksida,ozon,nitrogen_dioksida,max,bulan' as column_names from raw",
        "raw",
    ),
)
def s2(spark, sf):
    return readings.land_readings(spark, _csv(spark, sf), scratch_path(spark, "landed"))


@query(
    "s1_csv_other_orders",
    sql(
        f"select {RAW_LIST.replace('bulan', 'cast(bulan as varchar) as bulan')}, "
        "case when length(tanggal) = 1 then stasiun end as note from raw",
        "raw",
    ),
)
def s1_other_orders(spark, sf):
    """Two files with their columns in different orders, one with a column more."""
    path = scratch_path(spark, "csv")
    rows = base.raw(spark, sf).coalesce(1)
    short = F.length("tanggal") == 1
    rows.filter(short).select(*reversed(RAW_COLUMNS), F.col("stasiun").alias("note")).write.option("header", True).csv(path)
    rows.filter(~short | short.isNull()).write.mode("append").option("header", True).csv(path)
    return readings.read_readings(spark, path)


@query("s3_serving_scan", sql(f"select {PANEL_LIST} from clean where obs_date between date '1994-03-05' and date '1995-02-10'", "clean"))
def s3(spark, sf):
    path = scratch_path(spark, "panel")
    readings.write_panel(cleaning.clean_readings(base.raw(spark, sf)), path)
    stored = readings.read_panel(spark, path, "1994-03-05", "1995-02-10")
    return stored.select(*PANEL_LIST.split(", "))


@query("s4_live_feed", sql("select * from live", "live"))
def s4(spark, sf):
    return base.live(spark, sf)


# a third of the messages is spoilt: cut off, cut off and closed, without an id
SPOILT = ("substr(value, 1, 40)", "replace(value, 'reading_id', 'reading')")


def _spoilt(spark, sf):
    path = scratch_path(spark, "landing")
    messages = derived.live_messages(spark, sf)
    kind = F.pmod(F.get_json_object("value", "$.reading_id").cast("long"), F.lit(9))
    value = F.when(kind == 0, F.expr(SPOILT[0])).when(kind == 1, F.concat(F.expr(SPOILT[0]), F.lit("}")))
    value = value.when(kind == 2, F.expr(SPOILT[1])).otherwise(F.col("value"))
    messages.select(value.alias("value")).write.text(path)
    return path


@query("s4_spoilt_feed", sql("select * from live where reading_id % 9 not in (0, 1, 2)", "live"))
def s4_spoilt(spark, sf):
    return feed.read_live(spark, _spoilt(spark, sf))


@query("s4_rejects", sql("select reading_id % 9 as kind, count(*) as n from live where reading_id % 9 in (0, 1, 2) group by 1", "live"))
def s4_rejects(spark, sf):
    """The lines kept apart, by how they were spoilt."""
    line = F.col("line")
    kind = F.when(line.contains('"reading"'), 2).when(line.endswith("}"), 1).otherwise(0).cast("long")
    return feed.read_rejects(spark, _spoilt(spark, sf)).groupBy(kind.alias("kind")).agg(F.count(F.lit(1)).alias("n"))


@query("s4_explicit_nulls", sql("select * replace (case when reading_id % 5 = 1 then null else pm10 end as pm10) from live", "live"))
def s4_nulls(spark, sf):
    return feed.read_live(spark, base.landed_messages(spark, sf), null_as_zero=False)


@query("c1_column_names", sql(f"select {RAW_LIST} from raw", "raw"))
def c1(spark, sf):
    messy = base.raw(spark, sf)
    return cleaning.clean_column_names(messy.toDF(*[f"  {c.upper()} " for c in messy.columns]))


def _nulled(columns) -> str:
    return ", ".join(
        f"case when {c} not in ('N/A', 'null', 'TIDAK ADA DATA') then {c} end as {c}" for c in columns
    )


@query("c2_null_tokens", sql(f"select {_nulled(RAW_COLUMNS[:-1])}, bulan from raw", "raw"))
def c2(spark, sf):
    return cleaning.null_tokens(base.raw(spark, sf))


RAW_NUMBERS = [c for c in RAW_COLUMNS if c not in ("periode_data", "tanggal", "stasiun", "bulan")]


@query(
    "c3_numeric_coercion",
    sql(
        "select periode_data, tanggal, stasiun, bulan, "
        + ", ".join(f"try_cast({c} as double) as {c}" for c in RAW_NUMBERS)
        + " from raw",
        "raw",
    ),
)
def c3(spark, sf):
    return cleaning.coerce_numbers(base.raw(spark, sf))


DATES = "cast(try_strptime(periode_data || '-' || tanggal, '%Y%m-%d') as date)"


@query("c4_dates_strict", sql(f"select periode_data, tanggal, stasiun, {DATES} as obs_date from raw", "raw"))
def c4(spark, sf):
    dated = cleaning.assemble_dates(base.raw(spark, sf), strict_day=True)
    return dated.select("periode_data", "tanggal", "stasiun", DATE)


@query(
    "c5_dates_tolerant",
    sql(f"select periode_data, tanggal || '.0' as tanggal, stasiun, {DATES} as obs_date from raw", "raw"),
)
def c5(spark, sf):
    decimal = base.raw(spark, sf).withColumn("tanggal", F.concat("tanggal", F.lit(".0")))
    return cleaning.assemble_dates(decimal).select("periode_data", "tanggal", "stasiun", DATE)


@query(
    "c6_invalid_dates",
    sql(f"select count(*) as rows_before, count({DATES}) as rows_after, count(*) - count({DATES}) as rows_dropped from raw", "raw"),
)
def c6(spark, sf):
    return cleaning.invalid_date_report(cleaning.assemble_dates(base.raw(spark, sf)))


@query("c7_sort_by_date", sql(f"select {PANEL_LIST} from panel order by obs_date, station", "panel"))
def c7(spark, sf):
    return cleaning.sort_by_date(base.panel(spark, sf))


@query("c8_forward_fill", sql(f"select {PANEL_LIST} from filled", "filled"))
def c8(spark, sf):
    return base.filled(spark, sf)


again("c8_forward_fill", lambda spark, sf: base.filled(spark, sf, base.SEGMENT_ROWS))


@query(
    "c9_forward_fill_global",
    sql(
        f"select station, obs_date, {GLOBAL_FILLS} from panel window w as "
        "(order by obs_date, station rows between unbounded preceding and current row)",
        "panel",
    ),
)
def c9(spark, sf):
    return fill.forward_fill_global(base.panel(spark, sf), **base.UNIQUE)


@query("c10_clean_chain", sql("select * from clean", "clean"))
def c10(spark, sf):
    return cleaning.clean_readings(base.raw(spark, sf))


@query(
    "c11_station_filter",
    sql(f"select {PANEL_LIST} from panel where station = (select max(station) from panel)", "panel"),
)
def c11(spark, sf):
    days = base.panel(spark, sf)
    last = days.agg(F.max(STATION).alias("last")).first()["last"]
    return cleaning.only_station(days, last)


@query("c12_drop_incomplete", sql("""
select count(*) as rows_before, count(*) filter (ok) as rows_after, count(*) filter (not ok) as rows_dropped,
  round(count(*) filter (not ok) * 100.0::double / count(*), 6) as dropped_pct
from (select pm25 is not null and pm10 is not null and so2 is not null and co is not null and o3 is not null and no2 is not null and max_idx is not null as ok from panel)""", "panel"))
def c12(spark, sf):
    return cleaning.incomplete_report(base.panel(spark, sf))


@query("c12_complete_rows", sql(f"select {PANEL_LIST} from panel where pm25 is not null and pm10 is not null and so2 is not null", "panel"))
def c12_rows(spark, sf):
    return cleaning.drop_incomplete(base.panel(spark, sf))


@query("c13_drop_missing_target", sql(f"select {PANEL_LIST} from panel where pm25 is not null", "panel"))
def c13(spark, sf):
    return cleaning.drop_missing_target(base.panel(spark, sf))


FEATURE_NAMES = [
    "pm25", "pm10", "so2", "co", "o3", "no2", "max_idx", "pm25_original",
    *[f"pm25_lag_{n}" for n in (1, 2, 3, 7, 14, 30)],
    *[f"pm25_rolling_{s}_{n}" for n in (7, 14, 30) for s in ("mean", "std", "min", "max")],
    "pm25_day_change", "pm25_week_change",
    "day_of_week", "month", "year", "day_of_year", "quarter", "is_weekend", "season", "is_rainy_season",
]
CLEAN_NAMES = [n for n in FEATURE_NAMES if "pm25" not in n]


def _counts(names, table) -> str:
    return " union all ".join(f"select '{n}' as feature, count({n}) as n_values from {table}" for n in names)


def _value_counts(df, names):
    one = df.agg(*[F.count(n).alias(n) for n in names])
    return one.unpivot([], list(names), "feature", "n_values")


@query("c14_feature_columns", sql(_counts(FEATURE_NAMES, "hist"), "hist"))
def c14(spark, sf):
    rows = base.history(spark, sf).withColumn("kategori", F.lit("x"))
    return _value_counts(rows, features.feature_columns(rows))


@query("c15_leakage_check", sql(_counts(CLEAN_NAMES, "hist"), "hist"))
def c15(spark, sf):
    safe = features.drop_leaking(base.history(spark, sf))
    return _value_counts(safe, [c for c in safe.columns if c not in (STATION, DATE, "label")])


@query(
    "c16_drop_empty_columns",
    sql("select station, obs_date, is_train, pm10, so2, co, o3, no2, max_idx from split", "split"),
)
def c16(spark, sf):
    rows = base.split_rows(spark, sf).withColumn("late_only", F.when(~F.col("is_train"), F.col("co")))
    wanted = [*CONTEXT_POLLUTANTS, "late_only"]
    kept = features.known_columns(rows.filter("is_train"), wanted)
    return rows.select(STATION, DATE, "is_train", *kept)


@query(
    "c17_align_features",
    sql(
        f"select station, obs_date, pm10, so2, co, o3, no2, max_idx, {CALENDAR}, "
        "cast(year(obs_date) * 100 + month(obs_date) as int) as periode_data, cast(month(obs_date) as int) as bulan from filled",
        "filled",
    ),
)
def c17(spark, sf):
    rows = with_serving_calendar(base.filled(spark, sf), DATE)
    return features.align_features(rows, SERVING_FEATURES)


@query("w4_fill_target", sql("select station, obs_date, pm25, last_value(pm25 ignore nulls) over w as filled from panel " + ctes.W, "panel"))
def w4(spark, sf):
    series = fill.arrange(base.panel(spark, sf).select(STATION, DATE, "pm25"), **base.UNIQUE)
    return series.fill(["pm25"], into=lambda _: "filled").result()


INTERPOLATED = """
select station, obs_date, round(case when pm25 is not null then pm25 when nv is null then pv
  else pv + (nv - pv) * (cast(rn - pp as double) / (np - pp)) end, 6) as pm25
from (select *, last_value(pm25 ignore nulls) over b as pv, last_value(case when pm25 is not null then rn end ignore nulls) over b as pp,
  first_value(pm25 ignore nulls) over a as nv, first_value(case when pm25 is not null then rn end ignore nulls) over a as np
  from (select station, obs_date, pm25, row_number() over (partition by station order by obs_date) as rn from panel)
  window b as (partition by station order by rn rows between unbounded preceding and current row),
         a as (partition by station order by rn rows between current row and unbounded following))"""


@query("w5_interpolate", sql(INTERPOLATED, "panel"))
def w5(spark, sf):
    days = base.panel(spark, sf).select(STATION, DATE, "pm25")
    return rounded(fill.interpolate_target(days, **base.UNIQUE), "pm25")


@partial(again, "w5_interpolate")
def w5_segments(spark, sf):
    days = base.panel(spark, sf).select(STATION, DATE, "pm25")
    return rounded(fill.interpolate_target(days, **base.UNIQUE, max_rows=base.SEGMENT_ROWS), "pm25")


@query("w6_impute_target", sql("select station, obs_date, pm25, pm25_original from target", "target"))
def w6(spark, sf):
    days = base.filled(spark, sf).select(STATION, DATE, "pm25")
    return fill.impute_target(days, **base.UNIQUE)


@query("w6_imputation_report", sql("""
select count(*) as rows, count(*) filter (pm25 is null) as missing_before,
  round(count(*) filter (pm25 is null) * 100.0::double / count(*), 6) as missing_before_pct,
  count(*) filter (f is null) as missing_after_fill, count(*) filter (f is null) as missing_after_interpolation, count(f) as rows_kept
from (select pm25, last_value(pm25 ignore nulls) over w as f from panel window w as (partition by station order by obs_date rows between unbounded preceding and current row))""", "panel"))
def w6_report(spark, sf):
    return fill.imputation_report(base.panel(spark, sf), **base.UNIQUE)


HISTORY = ["station", "obs_date"]


@query("w1_lags", sql(f"select station, obs_date, {ctes.LAGS} from target window {ctes.O}", "target"))
def w1(spark, sf):
    days = base.target(spark, sf).select(*HISTORY, "pm25")
    return features.add_lags(days, **base.UNIQUE).drop("pm25")


CALENDAR_LAGS = "select t.station, t.obs_date, " + ", ".join(
    f"l{n}.pm25 as pm25_lag_{n}" for n in (1, 2, 3, 7, 14, 30)
) + " from target t " + " ".join(
    f"left join target l{n} on l{n}.station = t.station and l{n}.obs_date = t.obs_date - {n}" for n in (1, 2, 3, 7, 14, 30)
)


@query("w1_calendar_lags", sql(CALENDAR_LAGS, "target"))
def w1_calendar(spark, sf):
    return features.add_calendar_lags(base.target(spark, sf).select(*HISTORY, "pm25")).drop("pm25")


STDS = [f"pm25_rolling_{s}_{n}" for n in (7, 14, 30) for s in ("mean", "std")]


@query("w2_rolling", sql(f"select station, obs_date, {ctes.ROLLING} from target window {ctes.R}", "target"))
def w2(spark, sf):
    days = base.target(spark, sf).select(*HISTORY, "pm25")
    return rounded(features.add_rolling(days, **base.UNIQUE).drop("pm25"), *STDS)


@query("w3_changes", sql(f"select station, obs_date, {ctes.CHANGES} from target window {ctes.O}", "target"))
def w3(spark, sf):
    days = base.target(spark, sf).select(*HISTORY, "pm25")
    return features.add_changes(days, **base.UNIQUE).drop("pm25")


@query("w7_feature_chain", sql("select * from feat", "feat"))
def w7(spark, sf):
    return rounded(base.feature_rows(spark, sf), *STDS)


again("w7_feature_chain", lambda spark, sf: rounded(base.feature_rows(spark, sf, max_rows=base.SEGMENT_ROWS), *STDS))


@query("w8_split", sql("select station, obs_date, position, series_size, is_train from split", "split"))
def w8(spark, sf):
    return base.split_rows(spark, sf).select(*HISTORY, "position", "series_size", "is_train")


@partial(again, "w8_split")
def w8_segments(spark, sf):
    return base.split_rows(spark, sf, base.SEGMENT_ROWS).select(*HISTORY, "position", "series_size", "is_train")


@query("w8_split_global", sql("""
select station, obs_date, row_number() over (order by obs_date, station) as position, count(*) over () as series_size,
  row_number() over (order by obs_date, station) <= floor(count(*) over () * cast(0.8 as double)) as is_train from panel""", "panel"))
def w8_global(spark, sf):
    days = base.panel(spark, sf).select(*HISTORY)
    return split.add_split(days, keys=(), order=(DATE, STATION), **base.UNIQUE)


FOLDS = """
select station, obs_date, position, series_size, cast(k as int) as fold_count,
  cast(case when k is null then null when position - 1 < series_size - k * t then 0 else 1 + (position - 1 - (series_size - k * t)) // t end as int) as block
from (select *, series_size // (k + 1) as t from (select *, case when least(5, series_size // 10) >= 2 then least(5, series_size // 10) end as k from numbered))"""


@query("w9_folds", sql(FOLDS, "numbered"))
def w9(spark, sf):
    days = base.target(spark, sf).select(*HISTORY)
    return split.add_folds(days, **base.UNIQUE)


@partial(again, "w9_folds")
def w9_segments(spark, sf):
    days = base.target(spark, sf, base.SEGMENT_ROWS).select(*HISTORY)
    return split.add_folds(days, **base.UNIQUE, max_rows=base.SEGMENT_ROWS)


@query("w10_sorted_band", sql("""
select model, station, obs_date, label, round(prediction, 6) as prediction, round(residual_std, 6) as residual_std,
  row_number() over (partition by model order by label, obs_date, station) as sample,
  round(prediction - residual_std, 6) as lower, round(prediction + residual_std, 6) as upper
from test join spread using (model)""", "test", "spread"))
def w10(spark, sf):
    from stationcast.plans.charts import test_band

    band = test_band(base.predictions(spark, sf), tiebreak=(DATE, STATION))
    return rounded(band, "prediction", "residual_std", "lower", "upper").drop("side", "block")


@query("w11_last_actual", sql("select station, max(obs_date) as last_date, max_by(pm25, obs_date) as last_actual from filled group by station", "filled"))
def w11(spark, sf):
    from stationcast.plans.scoring import last_actual

    return last_actual(base.filled(spark, sf))


CONTEXT = ", ".join(f"round({c}, 6) as {c}" for c in CONTEXT_POLLUTANTS)


@query("w12_context", sql(f"select station, last_date, last_actual, {CONTEXT} from context", "context"))
def w12(spark, sf):
    from stationcast.plans.scoring import forecast_context

    return rounded(forecast_context(base.filled(spark, sf)), *CONTEXT_POLLUTANTS)


@query("l1_last_rows_global", sql(f"select {PANEL_LIST} from panel order by obs_date desc, station desc limit 30", "panel"))
def l1(spark, sf):
    return features.latest_rows_global(base.panel(spark, sf), 30)


@query("l1_last_rows_station", sql(f"select {PANEL_LIST} from (select *, row_number() over (partition by station order by obs_date desc) as b from panel) where b <= 50", "panel"))
def l1_station(spark, sf):
    return features.latest_rows(base.panel(spark, sf), 50)

