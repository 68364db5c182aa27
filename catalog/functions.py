"""Column functions over the panel and the naive predictions."""

from __future__ import annotations

from pyspark.sql import functions as F

from stationcast.functions import calendar, levels, numbers
from stationcast.operators.bias import with_errors
from stationcast.plans import scoring
from stationcast.schema import CONTEXT_POLLUTANTS, DATE, STATION, TARGET

from . import base, ctes
from .ctes import sql
from .registry import query, rounded

KEYS = (STATION, DATE)


def _panel_query(name, select, build):
    @query(name, sql(f"select station, obs_date, {select} from panel", "panel"))
    def run(spark, sf):
        return base.panel(spark, sf).select(*KEYS, *[e.alias(n) for n, e in build().items()])

    return run


def _prediction_query(name, select, build):
    @query(name, sql(f"select model, station, obs_date, {select} from test", "test"))
    def run(spark, sf):
        rows = base.tested(spark, sf)
        return rows.select("model", *KEYS, *[e.alias(n) for n, e in build().items()])

    return run


_panel_query("f1_day_of_week", "cast(isodow(obs_date) - 1 as int) as day_of_week", lambda: {"day_of_week": calendar.day_of_week(DATE)})
_panel_query(
    "f2_date_parts",
    "cast(month(obs_date) as int) as month, cast(year(obs_date) as int) as year, cast(dayofyear(obs_date) as int) as day_of_year, cast(quarter(obs_date) as int) as quarter",
    lambda: {n: calendar.time_parts()[n] for n in ("month", "year", "day_of_year", "quarter")},
)
_panel_query("f3_is_weekend", "cast(case when isodow(obs_date) in (6, 7) then 1 else 0 end as int) as is_weekend", lambda: {"is_weekend": calendar.is_weekend(DATE)})
_panel_query("f4_season", "cast((month(obs_date) % 12 + 3) // 3 as int) as season", lambda: {"season": calendar.season(DATE)})
_panel_query("f5_rainy_season", "cast(case when month(obs_date) >= 10 or month(obs_date) <= 3 then 1 else 0 end as int) as is_rainy_season", lambda: {"is_rainy_season": calendar.is_rainy_season(DATE)})
_panel_query(
    "f6_period",
    "cast(strftime(obs_date, '%Y%m') as int) as periode_data, cast(month(obs_date) as int) as bulan",
    lambda: {"periode_data": calendar.period(DATE), "bulan": F.month(DATE)},
)
_panel_query("f7_date_add", "obs_date + 7 as target_date", lambda: {"target_date": calendar.days_ahead(DATE, 7)})
_panel_query(
    "f8_category",
    f"pm25, {ctes.category('pm25')} as category, {ctes.badge('pm25')} as badge",
    lambda: {"pm25": F.col(TARGET), "category": levels.category(F.col(TARGET)), "badge": levels.category_badge(F.col(TARGET))},
)
_panel_query(
    "f9_risk_level",
    f"pm25, {ctes.risk('pm25')} as level, {ctes.risk_color('pm25')} as color",
    lambda: {"pm25": F.col(TARGET), "level": levels.risk_level(F.col(TARGET)), "color": levels.risk_color(F.col(TARGET))},
)
_panel_query(
    "f10_recommendation",
    f"{ctes.advice(ctes.risk('pm25'))} as recommendation",
    lambda: {"recommendation": levels.recommendation(levels.risk_level(F.col(TARGET)))},
)
_prediction_query(
    "f11_trend",
    f"round(prediction - label, 6) as trend_val, {ctes.trend('round(prediction - label, 6)')} as trend_dir, case {ctes.trend('round(prediction - label, 6)')} when 'Rising' then 'Naik' when 'Falling' then 'Turun' else 'Stabil' end as trend_text",
    lambda: {
        "trend_val": F.round(F.col("prediction") - F.col("label"), 6),
        "trend_dir": levels.trend_direction(F.round(F.col("prediction") - F.col("label"), 6)),
        "trend_text": levels.trend_text(levels.trend_direction(F.round(F.col("prediction") - F.col("label"), 6))),
    },
)
_panel_query(
    "f12_confidence",
    f"{ctes.confidence('pm25', '8.5', ('Tinggi', 'Sedang', 'Rendah'))} as conf_level, "
    f"{ctes.confidence('pm25', '8.5', ('Model sangat yakin dengan prakiraan ini.', 'Model memiliki keyakinan yang cukup.', 'Prakiraan memiliki ketidakpastian tinggi. Harap waspada.'))} as conf_desc, "
    f"{ctes.confidence('pm25', '8.5', ('success', 'primary', 'secondary'))} as conf_badge, "
    f"cast({ctes.confidence('pm25', '8.5', ('90', '60', '30'))} as int) as conf_percent",
    lambda: {
        "conf_level": levels.confidence_level(F.col(TARGET), F.lit(base.STD)),
        "conf_desc": levels.confidence_text(F.col(TARGET), F.lit(base.STD)),
        "conf_badge": levels.confidence_badge(F.col(TARGET), F.lit(base.STD)),
        "conf_percent": levels.confidence_percent(F.col(TARGET), F.lit(base.STD)),
    },
)
_prediction_query(
    "f13_bounds",
    "round(prediction - 8.5, 6) as lower, round(prediction + 8.5, 6) as upper, round(prediction + 1.96 * 8.5, 6) as upper_95, cast(17.0 as double) as width",
    lambda: {
        "lower": F.round(numbers.lower_bound(F.col("prediction"), F.lit(base.STD)), 6),
        "upper": F.round(numbers.upper_bound(F.col("prediction"), F.lit(base.STD)), 6),
        "upper_95": F.round(numbers.upper_bound(F.col("prediction"), F.lit(base.STD), 1.96), 6),
        "width": F.lit(base.STD) * 2,
    },
)


@query(
    "f14_scale_inputs",
    sql("select station, obs_date, " + ", ".join(f"round({c} * 1.1::double, 6) as {c}" for c in CONTEXT_POLLUTANTS) + " from panel", "panel"),
)
def f14(spark, sf):
    rows = base.panel(spark, sf).select(*KEYS, *CONTEXT_POLLUTANTS)
    return rounded(scoring.scale_inputs(rows, 1.1), *CONTEXT_POLLUTANTS)


_prediction_query(
    "f15_delta",
    "round(prediction - label, 6) as delta, case when round(prediction - label, 6) > 0.1 then 'up' when round(prediction - label, 6) < -0.1 then 'down' else 'flat' end as direction",
    lambda: {
        "delta": F.round(numbers.delta(F.col("prediction"), F.col("label")), 6),
        "direction": numbers.delta_direction(F.round(numbers.delta(F.col("prediction"), F.col("label")), 6)),
    },
)
_panel_query(
    "f16_labels",
    "'H+' || cast(day(obs_date) as varchar) as label, strftime(obs_date, '%d %b %Y') as date_text",
    lambda: {"label": numbers.horizon_label(F.day(DATE)), "date_text": numbers.date_label(F.col(DATE))},
)


@query(
    "f17_errors",
    sql("select model, station, obs_date, round(prediction - label, 6) as error, round(label - prediction, 6) as residual, round(abs(label - prediction), 6) as abs_error from test", "test"),
)
def f17(spark, sf):
    rows = with_errors(base.tested(spark, sf)).select("model", *KEYS, "error", "residual", "abs_error")
    return rounded(rows, "error", "residual", "abs_error")


FIT = "case when train_mae - test_mae < -2 then 'overfitting' when train_mae - test_mae > 2 then 'underfitting' else 'balanced' end"
R2 = "case when test_r2 > 0.8 then 'excellent' when test_r2 > 0.6 then 'good' when test_r2 > 0.4 then 'moderate' else 'poor' end"


@query("f18_verdicts", sql(f"select model, {R2} as r2_verdict, case when abs(overall_bias) > 5 then 'significant' else 'minimal' end as bias_verdict, {FIT} as fit_verdict from cmp join spread using (model)", "cmp", "spread"))
def f18(spark, sf):
    from stationcast.operators.bias import overall_bias
    from stationcast.plans.training import verdicts

    return verdicts(base.comparison(spark, sf), overall_bias(base.tested(spark, sf)))


GAP = "round(prediction - label, 6)"
_prediction_query(
    "f19_fit_gap",
    f"case when {GAP} < -2 then 'overfitting' when {GAP} > 2 then 'underfitting' else 'balanced' end as fit_verdict",
    lambda: {"fit_verdict": numbers.fit_gap_verdict(F.round(F.col("prediction") - F.col("label"), 6), F.lit(0.0))},
)
_panel_query(
    "f20_rounding",
    "round_even(pm25, 2) as two, round_even(pm10, 1) as one, round_even(so2, 3) as three, round_even(co, 4) as four",
    lambda: {
        "two": numbers.report_round(F.col("pm25"), 2),
        "one": numbers.report_round(F.col("pm10"), 1),
        "three": numbers.report_round(F.col("so2"), 3),
        "four": numbers.report_round(F.col("co"), 4),
    },
)
_prediction_query(
    "f21_near_equal",
    "abs(prediction - label) <= 1e-8 + 1e-5 * abs(label) as near",
    lambda: {"near": numbers.near_equal(F.col("prediction"), F.col("label"))},
)


@query("f22_period_parts", sql("select stasiun, periode_data, tanggal, substr(periode_data, 1, 4) as year_text, substr(periode_data, 5, 2) as month_text from raw", "raw"))
def f22(spark, sf):
    return base.raw(spark, sf).select(
        "stasiun",
        "periode_data",
        "tanggal",
        numbers.period_year(F.col("periode_data")).alias("year_text"),
        numbers.period_month(F.col("periode_data")).alias("month_text"),
    )
