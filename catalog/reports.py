"""Aggregates, joins, metrics, selection and chart tables."""

from __future__ import annotations

from functools import partial

from pyspark.sql import functions as F

from stationcast.operators import bias, cleaning, features, metrics, quantiles, reports, selection, split
from stationcast.plans import charts, scoring
from stationcast.schema import CONTEXT_POLLUTANTS, DATE, SERVING_FEATURES, STATION, TARGET

from . import base, ctes
from .cleaning import PANEL_LIST, STDS
from .ctes import sql
from .registry import again, query, rounded


def r(*columns: str) -> str:
    return ", ".join(f"round({c}, 6) as {c}" for c in columns)


@query("a1_richest_station", sql("select station, count(pm25) as n_values from panel group by station order by n_values desc, station limit 1", "panel"))
def a1(spark, sf):
    return features.richest_station(base.panel(spark, sf))


@query("a1_richest_station_rows", sql(f"select {PANEL_LIST} from panel where station = (select station from panel group by station order by count(pm25) desc, station limit 1)", "panel"))
def a1_rows(spark, sf):
    return features.select_station(base.panel(spark, sf))


MONTHLY = "select model, cast(month(obs_date) as int) as month, round(avg(prediction - label), 6) as bias, round(avg(abs(prediction - label)), 6) as mae from test group by 1, 2"


@query("a2_monthly_bias", sql(f"select model, month, bias from ({MONTHLY})", "test"))
def a2(spark, sf):
    return rounded(bias.monthly_bias(base.tested(spark, sf)).drop("mae"), "bias")


@query("a3_monthly_mae", sql(f"select model, month, mae from ({MONTHLY})", "test"))
def a3(spark, sf):
    return rounded(bias.monthly_bias(base.tested(spark, sf)).drop("bias"), "mae")


LEVELS = f"select model, level, round(avg(abs(prediction - label)), 6) as mae, round(avg(prediction - label), 6) as bias, count(*) as n from (select *, {ctes.level('label')} as level from test) where level is not null group by 1, 2"


@query("a4_level_bias", sql(LEVELS, "test"))
def a4(spark, sf):
    return rounded(bias.level_bias(base.tested(spark, sf)), "mae", "bias")


@query("a4_level_bias_contiguous", sql("select model, case when label <= 50 then 'Good' when label <= 100 then 'Moderate' when label <= 150 then 'Unhealthy' else 'Very Unhealthy' end as level, round(avg(abs(prediction - label)), 6) as mae, round(avg(prediction - label), 6) as bias, count(*) as n from test group by 1, 2", "test"))
def a4_contiguous(spark, sf):
    return rounded(bias.level_bias(base.tested(spark, sf), contiguous=True), "mae", "bias")


OVERALL = "select model, count(*) as n, avg(prediction - label) as overall_bias, stddev_pop(prediction - label) as residual_std, avg(abs(prediction - label)) as mean_abs_residual, min(prediction - label) as min_residual, max(prediction - label) as max_residual from test group by model"
OVERALL_NAMES = ("overall_bias", "residual_std", "mean_abs_residual", "min_residual", "max_residual")


@query("a5_overall_bias", sql(f"select model, n, {r(*OVERALL_NAMES)} from ({OVERALL})", "test"))
def a5(spark, sf):
    return rounded(bias.overall_bias(base.tested(spark, sf)), *OVERALL_NAMES)


def _figures(table: str, part: str, item: str, names: dict[str, str]) -> str:
    return " union all ".join(
        f"select model, '{part}' as part, {item} as item, '{n}' as figure, round(cast({c} as double), 6) as value from ({table})"
        for n, c in names.items()
    )


A6 = " union all ".join(
    (
        _figures(OVERALL, "overall", "'all'", {"bias": "overall_bias", **{n: n for n in OVERALL_NAMES[1:]}}),
        _figures(MONTHLY, "month", "cast(month as varchar)", {"bias": "bias", "mae": "mae"}),
        _figures(LEVELS, "level", "level", {"mae": "mae", "bias": "bias", "count": "n"}),
    )
)


@query("a6_bias_report", sql(A6, "test"))
def a6(spark, sf):
    return rounded(bias.bias_report_long(base.tested(spark, sf)), "value")


def _missing(names, table) -> str:
    return " union all ".join(
        f"select '{n}' as \"column\", count(*) - count({n}) as missing, round((count(*) - count({n})) * 100.0::double / count(*), 6) as missing_pct from {table}"
        for n in names
    )


PANEL_NAMES = PANEL_LIST.split(", ")


@query("a7_missing_counts", sql(f"select * from ({_missing(PANEL_NAMES, 'panel')}) where missing > 0 order by missing desc, \"column\"", "panel"))
def a7(spark, sf):
    return reports.missing_counts(base.panel(spark, sf))


RAW_CELLS = [
    "pm_duakomalima", "pm_sepuluh", "sulfur_dioksida", "karbon_monoksida", "ozon", "nitrogen_dioksida", "max", "stasiun",
    "periode_data", "tanggal", "bulan",
]
CLEAN_CELLS = ["pm25", "pm10", "so2", "co", "o3", "no2", "max_idx", "station"]
_before = " + ".join(f"count(*) filter (cast({c} as varchar) not in ('N/A', 'null', 'TIDAK ADA DATA'))" for c in RAW_CELLS)
_after = " + ".join(f"count({c})" for c in CLEAN_CELLS)


@query("a8_quality_report", sql(f"""
select b.rows as rows_before, cast(11 as int) as columns_before, a.rows as rows_after, cast(8 as int) as columns_after, b.rows - a.rows as rows_dropped,
  round((b.rows - a.rows) * 100.0::double / b.rows, 6) as dropped_pct, first_date, last_date, stations,
  round(b.filled * 100.0::double / (b.rows * 11), 6) as quality_before, round(a.filled * 100.0::double / (a.rows * 8), 6) as quality_after,
  round(round(a.filled * 100.0::double / (a.rows * 8), 6) - round(b.filled * 100.0::double / (b.rows * 11), 6), 6) as quality_change
from (select count(*) as rows, {_before} as filled from raw) b,
  (select count(*) as rows, {_after} as filled, min(obs_date) as first_date, max(obs_date) as last_date, count(distinct station) as stations from clean) a""", "raw", "clean"))
def a8(spark, sf):
    raw = base.raw(spark, sf)
    return reports.quality_report(raw, cleaning.clean_readings(raw), RAW_CELLS, CLEAN_CELLS)


COUNTS = """select 'year' as dimension, cast(year(obs_date) as varchar) as item, count(*) as n from panel group by 1, 2
union all select 'month', cast(month(obs_date) as varchar), count(*) from panel group by 1, 2
union all select 'station', station, count(*) from panel group by 1, 2"""


@query("a9_row_counts", sql(COUNTS, "panel"))
def a9(spark, sf):
    return reports.row_counts(base.panel(spark, sf))


def _histogram(value: str, table: str, bins: int, by: str = "") -> str:
    """The bins of a numeric column, empty bins included."""
    group, pick = (f"group by {by}", f"{by}, ") if by else ("", "")
    on = f"using ({by})" if by else "on true"
    also = f"s.{by} = c.{by} and " if by else ""
    return f"""
select {'s.' + by + ',' if by else ''} cast(i as int) as bin, round(lo + i * ((hi - lo) / {bins}), 6) as low,
  round(case when i = {bins - 1} then hi else lo + (i + 1) * ((hi - lo) / {bins}) end, 6) as high,
  coalesce(n, 0) as n, round(coalesce(n, 0) / (total * ((hi - lo) / {bins})), 6) as density
from (select {pick}min({value}) as lo, max({value}) as hi, count({value}) as total from {table} {group}) s
cross join range({bins}) t(i)
left join (select {pick}least(floor((v - lo) / ((hi - lo) / {bins})), {bins - 1}) as b, count(*) as n
  from (select {pick}{value} as v from {table} where {value} is not null) x
  join (select {pick}min({value}) as lo, max({value}) as hi from {table} {group}) m {on} group by {pick}b) c on {also}c.b = i"""


BIN = ("low", "high", "density")


@query("a10_histogram", sql(_histogram("pm25", "panel", 30), "panel"))
def a10(spark, sf):
    return rounded(reports.histogram(base.panel(spark, sf)), *BIN)


@query("a10_histogram_station", sql(_histogram("pm25", "panel", 15, "station"), "panel"))
def a10_station(spark, sf):
    return rounded(reports.histogram(base.panel(spark, sf), bins=15, by=(STATION,)), *BIN)


def _box(v):
    return f"""
select is_train, q[1] as q1, q[2] as median, q[3] as q3, min({v}) filter ({v} >= lo and {v} <= hi) as whisker_low,
  max({v}) filter ({v} >= lo and {v} <= hi) as whisker_high, count(*) filter ({v} < lo or {v} > hi) as outliers, round(avg({v}), 6) as mean, count({v}) as n
from split join (select is_train, q, q[1] - 1.5 * (q[3] - q[1]) as lo, q[3] + 1.5 * (q[3] - q[1]) as hi
  from (select is_train, quantile_cont({v}, [0.25, 0.5, 0.75]) as q from split group by is_train)) using (is_train)
group by is_train, q"""


@query("a11_box_summary", sql(f"select is_train, {r('q1', 'median', 'q3')}, whisker_low, whisker_high, outliers, mean, n from ({_box('pm25')})", "split"))
def a11(spark, sf):
    return rounded(reports.box_summary(base.split_rows(spark, sf)), "q1", "median", "q3", "mean")


@partial(again, "a11_box_summary")
def a11_segments(spark, sf):
    return rounded(reports.box_summary(base.split_rows(spark, sf, base.SEGMENT_ROWS), max_rows=base.SEGMENT_ROWS), "q1", "median", "q3", "mean")


@query("a11_outliers", sql(f"select s.is_train, station, obs_date, so2 * co as load from split s join ({_box('so2 * co')}) b on s.is_train = b.is_train where so2 * co < whisker_low or so2 * co > whisker_high", "split"))
def a11_rows(spark, sf):
    rows = base.split_rows(spark, sf)
    return reports.outliers(rows.select("is_train", STATION, DATE, (F.col("so2") * F.col("co")).alias("load")), "load")


@query("a12_medians", sql(" union all ".join(f"select '{c}' as \"column\", round(median({c}), 6) as median from split where is_train" for c in CONTEXT_POLLUTANTS), "split"))
def a12(spark, sf):
    train = base.split_rows(spark, sf).filter("is_train")
    return rounded(quantiles.medians(train, CONTEXT_POLLUTANTS), "median")


@partial(again, "a12_medians")
def a12_segments(spark, sf):
    train = base.split_rows(spark, sf, base.SEGMENT_ROWS).filter("is_train")
    found = quantiles.exact_quantiles(train, CONTEXT_POLLUTANTS, [0.5], max_rows=base.SEGMENT_ROWS, bracket_rows=7_000)
    return rounded(found.select("column", F.col("value").alias("median")), "median")


CORR = ["pm25", "pm10", "so2", "co", "o3"]


@query("a13_correlation", sql(" union all ".join(
    f"select '{a}' as column_a, '{b}' as column_b, " + ("min(cast(1.0 as double))" if a == b else f"round(corr({a}, {b}), 6)") + " as correlation from panel"
    for a in CORR for b in CORR), "panel"))
def a13(spark, sf):
    return rounded(reports.correlation(base.panel(spark, sf), CORR), "correlation")


@query("a14_duplicate_dates", sql("select cast(sum(n - 1) as bigint) as duplicates, min(obs_date) as first_date, max(obs_date) as last_date, cast(sum(n) as bigint) as rows from (select obs_date, count(*) as n from panel group by 1)", "panel"))
def a14(spark, sf):
    return reports.duplicate_dates(base.panel(spark, sf), by=(DATE,))


@query("a14_duplicate_station_dates", sql("select cast(sum(n - 1) as bigint) as duplicates, min(obs_date) as first_date, max(obs_date) as last_date, cast(sum(n) as bigint) as rows from (select station, obs_date, count(*) as n from panel group by 1, 2)", "panel"))
def a14_station(spark, sf):
    return reports.duplicate_dates(base.panel(spark, sf))


HIST_NAMES = [*[f"pm25_lag_{n}" for n in (1, 2, 3, 7, 14, 30)], *STDS, "pm25_day_change", "pm25_week_change"]


@query("a15_feature_gaps", sql(_missing(HIST_NAMES, "hist"), "hist"))
def a15(spark, sf):
    return reports.missing_counts(base.history(spark, sf), HIST_NAMES, only_missing=False)


@query("a16_split_report", sql("select is_train, count(*) as rows, min(obs_date) as first_date, max(obs_date) as last_date, round(count(*) * 100.0::double / (select count(*) from split), 6) as share_pct from split group by is_train", "split"))
def a16(spark, sf):
    return split.split_report(base.split_rows(spark, sf))


@query("a17_plausibility", sql("select station, obs_date, pm25 as last_value, coalesce(pm25 > 30, false) as plausible from recent where back = 1", "recent"))
def a17(spark, sf):
    return reports.plausibility(base.filled(spark, sf))


# -- joins and unions ---------------------------------------------------------


@query("j1_alignment", sql("select model, station, obs_date, cast(month(obs_date) as int) as month, label, round(prediction, 6) as prediction, round(prediction - label, 6) as error from test", "test"))
def j1(spark, sf):
    rows = bias.with_errors(base.tested(spark, sf))
    out = rows.select("model", STATION, DATE, F.month(DATE).alias("month"), "label", "prediction", "error")
    return rounded(out, "prediction", "error")


@query("j2_horizons", sql("select station, last_date, h as horizon, last_date + cast(h as int) as target_date from (select station, max(obs_date) as last_date from filled group by 1), (values (1), (3), (7)) t(h)", "filled"))
def j2(spark, sf):
    ends = base.filled(spark, sf).groupBy(STATION).agg(F.max(DATE).alias("last_date"))
    return scoring.add_horizons(ends)


ASKED = "case day(obs_date) % 4 when 0 then 'normal' when 1 then 'increase' when 2 then 'decrease' else 'storm' end"


def _asked(df):
    day = F.day(DATE) % 4
    name = F.when(day == 0, "normal").when(day == 1, "increase").when(day == 2, "decrease").otherwise("storm")
    return df.withColumn("scenario", name)


@query("j3_scenario_lookup", sql(f"""
select station, obs_date, scenario, case scenario when 'increase' then 1.1::double when 'decrease' then 0.9::double else 1.0::double end as factor,
  case scenario when 'increase' then 'Kenaikan Polusi (+10%)' when 'decrease' then 'Penurunan Polusi (-10%)' else 'Kondisi Normal' end as scenario_label
from (select station, obs_date, {ASKED} as scenario from panel)""", "panel"))
def j3(spark, sf):
    return scoring.lookup_scenario(_asked(base.panel(spark, sf).select(STATION, DATE)))


SCENARIOS = """
select s.station, s.horizon, s.scenario, s.scenario_label, round(b.prediction, 6) as baseline, round(s.prediction, 6) as simulated, round(s.prediction - b.prediction, 6) as delta,
  case when s.prediction - b.prediction > 0.1 then 'up' when s.prediction - b.prediction < -0.1 then 'down' else 'flat' end as direction
from scored s join scored b on s.station = b.station and s.horizon = b.horizon and b.scenario = 'normal'"""
SIMULATED = ("baseline", "simulated", "delta")


@query("j4_baseline_and_simulated", sql(SCENARIOS, "scored"))
def j4(spark, sf):
    inputs = scoring.forecast_features(base.filled(spark, sf), scenarios=tuple(scoring.SCENARIOS))
    return rounded(scoring.compare_scenarios(base.linear(inputs)), *SIMULATED)


@query("j5_month_spine", sql(f"select m.model, cast(i as int) as month, coalesce(bias, 0.0) as bias from (select distinct model from test) m cross join range(1, 13) t(i) left join ({MONTHLY}) b on b.model = m.model and b.month = i", "test"))
def j5(spark, sf):
    return rounded(bias.month_bars(bias.monthly_bias(base.tested(spark, sf))), "bias")


@query("j6_recommendation", sql(f"select station, obs_date, {ctes.risk('pm25')} as level, {ctes.advice(ctes.risk('pm25'))} as recommendation from filled", "filled"))
def j6(spark, sf):
    from stationcast.functions import levels

    days = base.filled(spark, sf).withColumn("level", levels.risk_level(F.col(TARGET)))
    return days.select(STATION, DATE, "level", levels.recommendation(F.col("level")).alias("recommendation"))


CHART = """
select station, 'history' as series, obs_date as x, pm25 as y from recent where back <= 30
union all select station, s, obs_date, pm25 from recent, (values ('forecast'), ('lower'), ('upper')) t(s) where back = 1
union all select station, s, obs_date, round(prediction + d, 6) from scored, (values ('forecast', 0.0::double), ('lower', -8.5::double), ('upper', 8.5::double)) t(s, d) where scenario = 'normal'"""


def _chart(spark, sf):
    days = base.filled(spark, sf)
    return charts.forecast_chart(days, scoring.forecast(days, base.linear, base.STD))


@query("u1_chart_series", sql(f"select series, count(*) as points, min(x) as first_x, max(x) as last_x from ({CHART}) group by series", "recent", "scored"))
def u1(spark, sf):
    return _chart(spark, sf).groupBy("series").agg(
        F.count(F.lit(1)).alias("points"), F.min("x").alias("first_x"), F.max("x").alias("last_x")
    )


@query("r1_forecast_chart", sql(CHART, "recent", "scored"))
def r1(spark, sf):
    return rounded(_chart(spark, sf), "y")


@query("u2_all_errors", sql("select model, side, station, obs_date, round(abs(label - prediction), 6) as abs_error from pred", "pred"))
def u2(spark, sf):
    rows = bias.with_errors(base.predictions(spark, sf))
    both = rows.filter(F.col("side") == "train").unionByName(rows.filter(F.col("side") == "test"))
    return rounded(both.select("model", "side", STATION, DATE, "abs_error"), "abs_error")


# -- metrics and choice ---------------------------------------------------------


def _metric(name):
    return sql(f"select model, side, round({name}, 6) as {name} from metric", "metric")


for _i, _name in enumerate(metrics.METRICS, 1):

    def _one(spark, sf, name=_name):
        return rounded(metrics.evaluate(base.predictions(spark, sf)).select("model", "side", name), name)

    query(f"m{_i}_{_name}", _metric(_name))(_one)


@query("m5_all_metrics", sql(f"select model, side, n, {r(*metrics.METRICS)} from metric", "metric"))
def m5(spark, sf):
    return rounded(metrics.evaluate(base.predictions(spark, sf)), *metrics.METRICS)


@query("m5_metrics_by_station", sql(f"select model, station, n, {r(*metrics.METRICS)} from (select model, station, {ctes.METRICS} from pred group by model, station)", "pred"))
def m5_station(spark, sf):
    return rounded(metrics.evaluate(base.predictions(spark, sf), by=("model", STATION)), *metrics.METRICS)


@query("m6_sanity_check", sql("""
select *, status not in ('exact_copy', 'constant') as passed from (select *, case when n_near_equal = n then 'exact_copy' when predicted_range = 0 then 'constant'
  when predicted_range < 0.1 * actual_range then 'narrow_range' else 'ok' end as status
from (select model, side, count(*) as n, count(*) filter (abs(prediction - label) <= 1e-8 + 1e-5 * abs(label)) as n_near_equal,
  round(max(prediction) - min(prediction), 6) as predicted_range, max(label) - min(label) as actual_range from (
    select model, side, label, prediction from pred
    union all select 'Copy', side, label, label from pred
    union all select 'Flat', side, label, 60.0::double from pred
    union all select 'Narrow', side, label, label / 100 from pred) group by model, side))""", "pred"))
def m6(spark, sf):
    rows = base.predictions(spark, sf).select("model", "side", "label", "prediction")
    label = F.col("label")
    variants = F.array(
        F.struct(F.col("model"), F.col("prediction")),
        F.struct(F.lit("Copy").alias("model"), label.alias("prediction")),
        F.struct(F.lit("Flat").alias("model"), F.lit(60.0).alias("prediction")),
        F.struct(F.lit("Narrow").alias("model"), (label / 100).alias("prediction")),
    )
    return rounded(metrics.sanity_check(rows.select("side", "label", F.inline(variants))), "predicted_range")


@query("m7_too_good", sql("select model, coalesce(test_mae < 0.1 or test_r2 > 0.999, false) as rejected from (select model, test_mae, test_r2 from wide union all select 'Copy', 0.0, 1.0 from (select 1 from wide limit 1))", "wide"))
def m7(spark, sf):
    rows = base.predictions(spark, sf)
    copy = rows.filter(F.col("model") == base.MODELS[0]).withColumns(
        {"model": F.lit("Copy"), "prediction": F.col("label")}
    )
    table = metrics.comparison(metrics.evaluate(rows.unionByName(copy)))
    return table.select("model", metrics.too_good(F.col("test_mae"), F.col("test_r2")).alias("rejected"))


@query("m14_fold_errors", sql("select model, cast(fold as int) as fold, round(fold_mae, 6) as fold_mae from folds", "folds"))
def m14_folds(spark, sf):
    return rounded(metrics.fold_errors(base.predictions(spark, sf)), "fold_mae")


@query("m14_cv_summary", sql(f"select model, {r('cv_mae', 'cv_std')} from cv", "cv"))
def m14(spark, sf):
    return rounded(metrics.cv_summary(metrics.fold_errors(base.predictions(spark, sf))), "cv_mae", "cv_std")


WIDE_NAMES = [f"{s}_{m}" for m in metrics.METRICS for s in metrics.SIDES] + ["cv_mae", "cv_std"]


@query("m15_comparison", sql(f"select model, cast(rank as int) as rank, {r(*WIDE_NAMES)} from cmp", "cmp"))
def m15(spark, sf):
    return rounded(base.comparison(spark, sf), *WIDE_NAMES)


@query("m15_report_table", sql("select model, cast(rank as int) as rank, " + ", ".join(f"round_even({c}, 4) as {c}" for c in WIDE_NAMES) + " from cmp", "cmp"))
def m15_report(spark, sf):
    return selection.report_table(base.comparison(spark, sf))


@query("m15_short_table", sql("select model, round_even(test_mae, 2) as mae, round_even(test_r2, 3) as r2, round_even(test_mape, 1) as mape from cmp", "cmp"))
def m15_short(spark, sf):
    return selection.short_table(base.comparison(spark, sf))


FIT = "case when train_mae - test_mae < -2 then 'overfitting' when train_mae - test_mae > 2 then 'underfitting' else 'balanced' end"
R2 = "case when test_r2 > 0.8 then 'excellent' when test_r2 > 0.6 then 'good' when test_r2 > 0.4 then 'moderate' else 'poor' end"


@query("m16_detailed_table", sql(f"select model, {R2} as r2_verdict, {FIT} as fit_verdict, dataset, {r('mae', 'rmse', 'r2', 'mape', 'mae_std')} from (" + " union all ".join((
    "select *, 'Training' as dataset, train_mae as mae, train_rmse as rmse, train_r2 as r2, train_mape as mape, null::double as mae_std from cmp",
    "select *, 'Testing', test_mae, test_rmse, test_r2, test_mape, null from cmp",
    "select *, 'Cross-Validation', cv_mae, null, null, null, cv_std from cmp")) + ") where mae is not null", "cmp"))
def m16(spark, sf):
    return rounded(selection.detailed_table(base.comparison(spark, sf)), *metrics.METRICS, "mae_std")


BEST = " union all ".join(
    f"(select '{name}' as criterion, model, round({c}, 6) as value from cmp where {c} is not null order by {c} {'asc' if up else 'desc'}, rank limit 1)"
    for name, (c, up) in selection.BEST_BY.items()
)


@query("l2_best_per_metric", sql(BEST, "cmp"))
def l2(spark, sf):
    return rounded(selection.best_per_metric(base.comparison(spark, sf)), "value")


@query("l3_select_best", sql("select model, round(case when cv_mae is not null then test_mae + cv_std else test_mae end, 6) as score from cmp order by 2, rank limit 1", "cmp"))
def l3(spark, sf):
    return rounded(selection.select_best(base.comparison(spark, sf)).select("model", "score"), "score")


PLACES = " union all ".join(
    f"select '{c}' as metric, model, round({c}, 6) as value, cast(row_number() over (order by {c} {'asc' if up else 'desc'}, rank) as int) as place from cmp where {c} is not null"
    for c, up in selection.RANKED.items()
)


@query("l4_rank_models", sql(PLACES, "cmp"))
def l4(spark, sf):
    return rounded(selection.rank_models(base.comparison(spark, sf)), "value")


# -- forecasts with the stand-in model -------------------------------------------

INPUTS = ", ".join(f"round({c}, 6) as {c}" if c in CONTEXT_POLLUTANTS else c for c in SERVING_FEATURES)


@query("m19_forecast_features", sql(f"select station, last_date, last_actual, horizon, obs_date as target_date, scenario, factor, scenario_label, {INPUTS} from inputs", "inputs"))
def m19(spark, sf):
    rows = scoring.forecast_features(base.filled(spark, sf), scenarios=tuple(scoring.SCENARIOS))
    return rounded(rows, *CONTEXT_POLLUTANTS)


WORDS = ("Model sangat yakin dengan prakiraan ini.", "Model memiliki keyakinan yang cukup.", "Prakiraan memiliki ketidakpastian tinggi. Harap waspada.")
RISK = {
    "level": ctes.risk("prediction"),
    "color": ctes.risk_color("prediction"),
    "recommendation": ctes.advice(ctes.risk("prediction")),
    "trend_val": "round(prediction - last_actual, 6)",
    "trend_dir": ctes.trend("prediction - last_actual"),
    "conf_level": ctes.confidence("prediction", "8.5", ("Tinggi", "Sedang", "Rendah")),
    "conf_desc": ctes.confidence("prediction", "8.5", WORDS),
    "conf_badge": ctes.confidence("prediction", "8.5", ("success", "primary", "secondary")),
    "ci_width": "cast(17.0 as double)",
}


@query("m20_forecast", sql(f"""
select station, horizon, 'H+' || cast(horizon as varchar) as label, obs_date as target_date, strftime(obs_date, '%d %b %Y') as date_text,
  round(prediction, 6) as value, round(prediction - 8.5, 6) as lower, round(prediction + 8.5, 6) as upper,
  {ctes.category('prediction')} as category, {ctes.badge('prediction')} as badge, last_actual,
  {", ".join(f"case when horizon = 1 then {e} end as {n}" for n, e in RISK.items())}
from scored where scenario = 'normal'""", "scored"))
def m20(spark, sf):
    rows = scoring.forecast(base.filled(spark, sf), base.linear, base.STD)
    return rounded(rows, "value", "lower", "upper", "trend_val")


@query("m21_scenarios", sql(SCENARIOS, "scored"))
def m21(spark, sf):
    return rounded(scoring.simulate(base.filled(spark, sf), base.linear), *SIMULATED)


ASKED_STATION = "case length(station) % 2 when 0 then 'increase' else 'storm' end"


@query("m21_requested_scenario", sql(f"""
select r.station, r.horizon, asked as scenario, s.scenario_label, round(r.prediction, 6) as baseline, round(s.prediction, 6) as simulated, round(s.prediction - r.prediction, 6) as delta
from (select *, {ASKED_STATION} as asked from scored where scenario = 'normal') r
join scored s on s.station = r.station and s.horizon = r.horizon and s.scenario = case asked when 'storm' then 'normal' else asked end""", "scored"))
def m21_requested(spark, sf):
    days = base.filled(spark, sf)
    name = F.when(F.length(STATION) % 2 == 0, "increase").otherwise("storm")
    asked = days.select(STATION).distinct().withColumn("scenario", name)
    return rounded(scoring.requested_simulation(days, asked, base.linear), *SIMULATED)


FORM = {"pm10": "pm_sepuluh", "so2": "sulfur_dioksida", "co": "karbon_monoksida", "o3": "ozon", "no2": "nitrogen_dioksida", "max_idx": "max"}


def form_requests(spark, sf):
    """One request per raw row: the date as typed in, six numbers as text."""
    raw = base.raw(spark, sf)
    date = F.concat_ws("-", F.substring("periode_data", 1, 4), F.substring("periode_data", 5, 2), F.col("tanggal"))
    return raw.select(F.col("stasiun").alias("station"), date.alias("date"), *[F.col(s).alias(n) for n, s in FORM.items()])


@query("m22_manual_scoring", sql(f"""
select station, obs_date as target_date, error, case when error is null then round(prediction, 6) end as value,
  case when error is null then {ctes.category('prediction')} end as category, case when error is null then {ctes.badge('prediction')} end as badge,
  case when error is null then {ctes.risk('prediction')} end as level, case when error is null then {ctes.advice(ctes.risk('prediction'))} end as recommendation
from (select *, {ctes.LINEAR} as prediction,
  case when obs_date is null then 'invalid date' {" ".join(f"when {c} is null then 'invalid {c}'" for c in CONTEXT_POLLUTANTS)} end as error
 from (select *, {ctes.CALENDAR} from (select stasiun as station, cast(try_strptime(periode_data || '-' || tanggal, '%Y%m-%d') as date) as obs_date,
  {", ".join(f"try_cast({s} as double) as {n}" for n, s in FORM.items())} from raw)))""", "raw"))
def m22(spark, sf):
    return rounded(scoring.score_requests(form_requests(spark, sf), base.linear, keep=(STATION,)), "value")


RECENT = f"""
select station, obs_date, pm25 as label, prediction, prediction - 8.5 as lower, prediction + 8.5 as upper, pm25 - prediction as residual
from (select *, {ctes.LINEAR} as prediction from (select *, {ctes.CALENDAR} from recent where back <= 50))"""
SCORED = ("prediction", "lower", "upper", "residual")


@query("m23_score_recent", sql(f"select station, obs_date, label, {r(*SCORED)} from ({RECENT})", "recent"))
def m23(spark, sf):
    return rounded(scoring.score_recent(base.filled(spark, sf), base.linear, base.STD), *SCORED)


@query("m23_residual_histogram", sql(f"with_recent {''}", "recent").replace("with_recent", _histogram("residual", f"(select round(residual, 6) as residual from ({RECENT}) z)", 15)))
def m23_histogram(spark, sf):
    rows = rounded(scoring.score_recent(base.filled(spark, sf), base.linear, base.STD), "residual")
    return rounded(reports.histogram(rows, "residual", 15), *BIN)


# -- chart tables ------------------------------------------------------------------


@query("r2_actual_vs_predicted", sql("select model, side, station, obs_date, label, round(prediction, 6) as prediction from pred", "pred"))
def r2(spark, sf):
    return rounded(charts.actual_vs_predicted(base.predictions(spark, sf)), "prediction")


@query("r3_scatter", sql("""
select model, side, 'actual_predicted' as panel, label as x, round(prediction, 6) as y from pred
union all select model, side, 'predicted_residual', round(prediction, 6), round(label - prediction, 6) from pred""", "pred"))
def r3(spark, sf):
    return rounded(charts.scatter(base.predictions(spark, sf)), "x", "y")


DENSITY = _histogram("abs_error", "(select model, round(abs(label - prediction), 6) as abs_error from pred)", 30, "model")


@query("r4_error_density", sql(f"select h.*, round(mean_error, 6) as mean_error from ({DENSITY}) h join (select model, avg(round(abs(label - prediction), 6)) as mean_error from pred group by 1) e using (model)", "pred"))
def r4(spark, sf):
    return rounded(charts.error_density(base.predictions(spark, sf), places=6), *BIN, "mean_error")


@query("r5_bias_bars", sql(f"""
select m.model, 'month' as panel, cast(i as varchar) as item, coalesce(bias, 0.0) as value
from (select distinct model from test) m cross join range(1, 13) t(i) left join ({MONTHLY}) b on b.model = m.model and b.month = i
union all select model, 'level', level, mae from ({LEVELS})""", "test"))
def r5(spark, sf):
    return rounded(charts.bias_bars(base.tested(spark, sf)), "value")


@query("r6_metric_bars", sql(" union all ".join(f"select model, '{m}' as metric, '{s}' as side, round({s}_{m}, 6) as value from cmp" for m in ("mae", "rmse", "r2") for s in ("train", "test")), "cmp"))
def r6(spark, sf):
    return rounded(selection.metric_bars(base.comparison(spark, sf)), "value")


@query("r7_sorted_test_band", sql("""
select model, count(*) as samples, round(min(prediction - residual_std), 6) as lowest, round(max(prediction + residual_std), 6) as highest
from test join spread using (model) group by model""", "test", "spread"))
def r7(spark, sf):
    band = charts.test_band(base.predictions(spark, sf), tiebreak=(DATE, STATION))
    out = band.groupBy("model").agg(F.max("sample").alias("samples"), F.min("lower").alias("lowest"), F.max("upper").alias("highest"))
    return rounded(out, "lowest", "highest")


@query("r8_split_timeline", sql("select station, obs_date, pm25, is_train from split", "split"))
def r8(spark, sf):
    return charts.split_chart(base.split_rows(spark, sf))["timeline"]


@query("r8_split_dates", sql("select station, min(obs_date) as split_date from split where not is_train group by station", "split"))
def r8_dates(spark, sf):
    return charts.split_chart(base.split_rows(spark, sf))["split_date"]


@query("r9_distribution", sql(COUNTS, "panel"))
def r9(spark, sf):
    return reports.row_counts(base.panel(spark, sf))


@query("r10_target_timeline", sql("select station, obs_date, pm25 from feat", "feat"))
def r10(spark, sf):
    return charts.target_chart(base.feature_rows(spark, sf))["timeline"]


@query("r10_target_histogram", sql(_histogram("pm25", "feat", 30), "feat"))
def r10_histogram(spark, sf):
    return rounded(charts.target_chart(base.feature_rows(spark, sf))["histogram"], *BIN)


COMPARED = ["train_mae", "test_mae", "train_rmse", "test_rmse", "train_r2", "test_r2", "train_mape", "test_mape", "cv_mae", "cv_std"]


@query("r11_metric_correlation", sql(" union all ".join(
    f"select '{a}' as column_a, '{b}' as column_b, " + ("min(cast(1.0 as double))" if a == b else f"round(corr({a}, {b}), 6)") + " as correlation from cmp"
    for a in COMPARED for b in COMPARED), "cmp"))
def r11(spark, sf):
    return rounded(reports.correlation(base.comparison(spark, sf), COMPARED), "correlation")


PANEL_ROWS = {
    "train_lines": "select count(*) from pred where side = 'train'",
    "test_lines": "select count(*) from pred where side = 'test'",
    "actual_predicted": "select count(*) from pred",
    "predicted_residual": "select count(*) from pred",
    "error_density": "select 30 * count(distinct model) from pred",
    "month_bias": "select 12 * count(distinct model) from pred",
    "level_mae": f"select count(*) from ({LEVELS.replace('from test', 'from pred')})",
    "metric_bars": "select 6 * count(distinct model) from pred",
    "sorted_band": "select count(*) from test",
}


@query("r12_model_figure", sql(" union all ".join(f"select '{name}' as panel, cast(({rows}) as bigint) as rows" for name, rows in PANEL_ROWS.items()), "pred", "test"))
def r12(spark, sf):
    rows = base.predictions(spark, sf)
    panels = charts.model_figure(rows, selection.metric_bars(base.comparison(spark, sf)))
    counted = [t.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(n).alias("panel"), "rows") for n, t in panels.items()]
    out = counted[0]
    for table in counted[1:]:
        out = out.unionByName(table)
    return out


FIGURE = f"""
select side || '_lines' as panel, model, side, s as series, station || ' ' || cast(obs_date as varchar) as item, cast(null as double) as x, case s when 'label' then label else prediction end as y
from pred, (select unnest(['label', 'prediction']) as s)
union all select 'actual_predicted', model, side, 'points', null, label, prediction from pred
union all select 'predicted_residual', model, side, 'points', null, prediction, label - prediction from pred
union all select 'error_density', h.model, null, s, null, h.low, case s when 'density' then density else e.mean_error end
  from ({DENSITY}) h join (select model, avg(round(abs(label - prediction), 6)) as mean_error from pred group by 1) e using (model), (select unnest(['density', 'mean_error']) as s)
union all select 'month_bias', m.model, null, 'bars', cast(i as varchar), null, coalesce(bias, 0.0)
  from (select distinct model from pred) m cross join range(1, 13) t(i) left join ({MONTHLY.replace('from test', 'from pred')}) b on b.model = m.model and b.month = i
union all select 'level_mae', model, null, 'bars', level, null, mae from ({LEVELS.replace('from test', 'from pred')})
union all {" union all ".join(f"select 'metric_bars', model, '{s}', 'bars', '{m}', null, {s}_{m} from cmp" for m in ("mae", "rmse", "r2") for s in ("train", "test"))}
union all select 'sorted_band', model, 'test', s, null, cast(row_number() over (partition by model, s order by label, obs_date, station) as double),
  case s when 'label' then label when 'prediction' then prediction when 'lower' then prediction - residual_std else prediction + residual_std end
  from test join spread using (model), (select unnest(['label', 'prediction', 'lower', 'upper']) as s)"""


@query("r12_figure_rows", sql(f"select panel, model, side, series, item, round(x, 6) as x, round(y, 6) as y from ({FIGURE})", "pred", "test", "cmp", "spread"))
def r12_rows(spark, sf):
    """All nine panels of the model figure, as rows."""
    panels = charts.model_figure(base.predictions(spark, sf), selection.metric_bars(base.comparison(spark, sf)))
    panels["sorted_band"] = charts.test_band(base.predictions(spark, sf), tiebreak=(DATE, STATION))
    panels["error_density"] = charts.error_density(base.predictions(spark, sf), places=6)
    return rounded(charts.figure_rows(panels), "x", "y")


@query("u1_chart_rows", sql(CHART, "recent", "scored"))
def u1_rows(spark, sf):
    """The union itself: the rows of all four series."""
    return rounded(_chart(spark, sf), "y")


@query("r7_band_rows", sql("""
select model, row_number() over (partition by model order by label, obs_date, station) as sample, label, round(prediction, 6) as prediction,
  round(prediction - residual_std, 6) as lower, round(prediction + residual_std, 6) as upper from test join spread using (model)""", "test", "spread"))
def r7_rows(spark, sf):
    band = charts.test_band(base.predictions(spark, sf), tiebreak=(DATE, STATION))
    return rounded(band.select("model", "sample", "label", "prediction", "lower", "upper"), "prediction", "lower", "upper")


CELL_ENDS = ", ".join(
    f"case when min({c}) = max({c}) then min({c}) - 0.5 else min({c}) end as {c}_lo, case when min({c}) = max({c}) then max({c}) + 0.5 else max({c}) end as {c}_hi" for c in "xy"
)


SCATTER = """(select model, side, 'actual_predicted' as panel, label as x, round(prediction, 6) as y from pred
union all select model, side, 'predicted_residual', round(prediction, 6), round(label - prediction, 6) from pred)"""
AT = {c: f"cast(least(floor(({c} - {c}_lo) / (({c}_hi - {c}_lo) / 64)), 63) as int)" for c in "xy"}
EDGES = ", ".join(
    f"round(min({c}_lo + ({c}_hi - {c}_lo) / 64 * {at}), 6) as {c}_low, round(min({c}_lo + ({c}_hi - {c}_lo) / 64 * ({at} + 1)), 6) as {c}_high"
    for c, at in (("x", "at_x"), ("y", "at_y"))
)


@query("r3_scatter_cells", sql(f"""
select model, side, panel, at_x as "column", at_y as "row", count(*) as n, {EDGES}
from (select *, {AT['x']} as at_x, {AT['y']} as at_y
  from {SCATTER} join (select model, side, panel, {CELL_ENDS} from {SCATTER} group by all) using (model, side, panel))
group by model, side, panel, at_x, at_y""", "pred"))
def r3_cells(spark, sf):
    """Both scatters as counts of cells."""
    points = rounded(charts.scatter(base.predictions(spark, sf)), "x", "y")
    return rounded(charts.scatter_cells(points), "x_low", "x_high", "y_low", "y_high")


@query("r10_line_extremes", sql("""
select distinct station, r.obs_date, r.pm25, r.position, r.size from (
  select station, unnest([arg_min(r, (pm25, position)), arg_min(r, (-pm25, position))]) as r from (
    select *, {'obs_date': obs_date, 'pm25': pm25, 'position': position, 'size': size} as r, floor((position - 1) * 120 / greatest(size, 120)) as bin
    from (select station, obs_date, pm25, row_number() over (partition by station order by obs_date) as position, count(*) over (partition by station) as size from feat))
  group by station, bin)""", "feat"))
def r10_extremes(spark, sf):
    """The lowest and highest reading of each of 120 stretches of a station's line."""
    return charts.line_extremes(base.feature_rows(spark, sf), 120, **base.UNIQUE)


@query("r10_thin_line", sql("""
select station, min(obs_date) as first_date, max(obs_date) as last_date, min(pm25) as lowest, max(pm25) as highest, true as bounded
from feat group by station""", "feat"))
def r10_thin(spark, sf):
    """Lines of 60 points at most keep their ends and extremes."""
    line = charts.thin_line(base.feature_rows(spark, sf), 60, **base.UNIQUE)
    return line.groupBy(STATION).agg(
        F.min(DATE).alias("first_date"), F.max(DATE).alias("last_date"), F.min(TARGET).alias("lowest"), F.max(TARGET).alias("highest"),
        (F.count(F.lit(1)) <= 60).alias("bounded"),
    )
