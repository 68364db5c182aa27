"""Forecasts, scenarios, manual requests and scoring of past rows.

A predictor is any ``DataFrame -> DataFrame`` function that adds a
``prediction`` column; :func:`model_predictor` makes one from a saved model.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import levels, numbers
from ..functions.calendar import days_ahead, with_serving_calendar
from ..operators.features import latest_rows
from ..operators.ordered import arrange
from ..schema import CONTEXT_POLLUTANTS, DATE, SERVING_FEATURES, STATION, TARGET
from ..sources.artifacts import Artifacts
from .stages import PanelFeaturesModel

Predictor = Callable[[DataFrame], DataFrame]

# Forecast horizons in days, rows behind a forecast.
HORIZONS = (1, 3, 7)
CONTEXT_ROWS = 7
# Scenario -> (factor, label). Unknown names count as normal.
SCENARIOS = {
    "normal": (1.0, "Kondisi Normal"),
    "increase": (1.1, "Kenaikan Polusi (+10%)"),
    "decrease": (0.9, "Penurunan Polusi (-10%)"),
}
DEFAULT_SCENARIO = "normal"


def model_predictor(model: PipelineModel, columns: Sequence[str] = ()) -> Predictor:
    """Predict with a fitted pipeline; ``columns`` must all be there."""

    def predict(df: DataFrame) -> DataFrame:
        missing = [c for c in columns if c not in df.columns]
        if missing:
            raise ValueError(f"features missing from the input: {missing}")
        return model.transform(df).drop("features")

    return predict


def with_bounds(df: DataFrame, std: Column, k: float = 1.0, value: str = "prediction") -> DataFrame:
    """``lower`` and ``upper``, k standard deviations around the value.

    The default is one, about two thirds of normal errors; 1.96 gives 95 %.
    """
    return df.withColumns(
        {
            "lower": numbers.lower_bound(F.col(value), std, k),
            "upper": numbers.upper_bound(F.col(value), std, k),
        }
    )


def std_column(std: float | None) -> Column:
    return F.lit(std).cast("double")


def last_actual(df: DataFrame, column: str = TARGET, tiebreak: Sequence[str] = ()) -> DataFrame:
    """Date and target of the last row of each station."""
    newest = F.struct(*[F.col(c) for c in (DATE, *tiebreak)])
    return df.groupBy(STATION).agg(
        F.max(DATE).alias("last_date"), F.max_by(F.col(column), newest).alias("last_actual")
    )


def forecast_context(
    df: DataFrame, rows: int = CONTEXT_ROWS, tiebreak: Sequence[str] = ()
) -> DataFrame:
    """Mean of the last rows of the inputs per station, with the last date and target.

    Rows are cut to the latest few before the shuffle.
    """
    newest = F.struct(*[F.col(c) for c in (DATE, *tiebreak)])
    recent = latest_rows(df, rows, tiebreak=tiebreak)
    return recent.groupBy(STATION).agg(
        F.max(DATE).alias("last_date"),
        F.max_by(F.col(TARGET), newest).alias("last_actual"),
        *[F.avg(c).alias(c) for c in CONTEXT_POLLUTANTS],
    )


def add_horizons(df: DataFrame, horizons: Sequence[int] = HORIZONS) -> DataFrame:
    """Each row once per horizon, with the target date."""
    days = F.array(*[F.lit(h) for h in horizons])
    return df.select("*", F.explode(days).alias("horizon")).withColumn(
        "target_date", days_ahead(F.col("last_date"), F.col("horizon"))
    )


def add_scenarios(df: DataFrame, names: Sequence[str] = tuple(SCENARIOS)) -> DataFrame:
    """Each row once per scenario, with its factor and label."""
    rows = [
        F.struct(
            F.lit(n).alias("scenario"),
            F.lit(SCENARIOS[n][0]).alias("factor"),
            F.lit(SCENARIOS[n][1]).alias("scenario_label"),
        )
        for n in names
    ]
    return df.select("*", F.inline(F.array(*rows)))


def scenario_table(df: DataFrame) -> DataFrame:
    rows = [(n, f, t) for n, (f, t) in SCENARIOS.items()]
    return df.sparkSession.createDataFrame(rows, "scenario string, factor double, scenario_label string")


def lookup_scenario(df: DataFrame, column: str = "scenario") -> DataFrame:
    """Factor and label of the scenario named in each row; the name stays as given."""
    table = F.broadcast(scenario_table(df).withColumnRenamed("scenario", column))
    factor, label = SCENARIOS[DEFAULT_SCENARIO]
    return df.join(table, column, "left").withColumns(
        {
            "factor": F.coalesce("factor", F.lit(factor)),
            "scenario_label": F.coalesce("scenario_label", F.lit(label)),
        }
    )


def scale_inputs(df: DataFrame, factor: Column | float) -> DataFrame:
    factor = factor if isinstance(factor, Column) else F.lit(factor)
    return df.withColumns({c: F.col(c) * factor for c in CONTEXT_POLLUTANTS})


def forecast_features(
    df: DataFrame,
    horizons: Sequence[int] = HORIZONS,
    scenarios: Sequence[str] = (DEFAULT_SCENARIO,),
    tiebreak: Sequence[str] = (),
) -> DataFrame:
    """Model inputs for every station, horizon and scenario in one plan."""
    spread = add_scenarios(add_horizons(forecast_context(df, tiebreak=tiebreak), horizons), scenarios)
    return with_serving_calendar(scale_inputs(spread, F.col("factor")), "target_date").select(
        STATION,
        "last_date",
        "last_actual",
        "horizon",
        "target_date",
        "scenario",
        "factor",
        "scenario_label",
        *SERVING_FEATURES,
    )


def forecast(
    df: DataFrame,
    predict: Predictor,
    std: float | None = None,
    horizons: Sequence[int] = HORIZONS,
    k: float = 1.0,
    tiebreak: Sequence[str] = (),
) -> DataFrame:
    """Baseline forecasts with bounds and category; risk columns on the first horizon."""
    spread = std_column(std)
    scored = predict(forecast_features(df, horizons, tiebreak=tiebreak))
    value = F.col("prediction")
    rows = with_bounds(scored, spread, k).select(
        STATION,
        "horizon",
        numbers.horizon_label(F.col("horizon")).alias("label"),
        "target_date",
        numbers.date_label(F.col("target_date")).alias("date_text"),
        value.alias("value"),
        "lower",
        "upper",
        levels.category(value).alias("category"),
        levels.category_badge(value).alias("badge"),
        "last_actual",
    )
    first = F.col("horizon") == min(horizons)
    risk = levels.risk_columns(F.col("value"), spread, F.col("last_actual"))
    return rows.withColumns({n: F.when(first, e) for n, e in risk.items()})


def simulate(
    df: DataFrame,
    predict: Predictor,
    horizons: Sequence[int] = HORIZONS,
    scenarios: Sequence[str] = tuple(SCENARIOS),
    tiebreak: Sequence[str] = (),
) -> DataFrame:
    """Scenario forecasts next to the baseline of the same station and horizon.

    Baseline and simulations are scored in one pass; they meet in one aggregate
    per station and horizon instead of a join.
    """
    names = list(dict.fromkeys([DEFAULT_SCENARIO, *scenarios]))
    scored = predict(forecast_features(df, horizons, names, tiebreak))
    return compare_scenarios(scored).filter(F.col("scenario").isin(*scenarios))


def compare_scenarios(scored: DataFrame) -> DataFrame:
    """``baseline``, ``simulated`` and ``delta`` per station, horizon and scenario."""
    cell = F.struct("scenario", "scenario_label", F.col("prediction").alias("simulated"))
    grouped = scored.groupBy(STATION, "horizon").agg(
        F.max(F.when(F.col("scenario") == DEFAULT_SCENARIO, F.col("prediction"))).alias("baseline"),
        F.collect_list(cell).alias("_cells"),  # one cell per scenario
    )
    change = numbers.delta(F.col("simulated"), F.col("baseline"))
    return grouped.select(STATION, "horizon", "baseline", F.inline("_cells")).withColumns(
        {"delta": change, "direction": numbers.delta_direction(change)}
    )


def requested_simulation(
    df: DataFrame, requests: DataFrame, predict: Predictor, tiebreak: Sequence[str] = ()
) -> DataFrame:
    """One scenario per station as named in ``requests`` (station, scenario)."""
    context = forecast_context(df, tiebreak=tiebreak).join(requests, STATION)
    asked = lookup_scenario(add_horizons(context))
    both = asked.select("*", F.explode(F.array(F.lit(1.0), F.col("factor"))).alias("_factor"))
    features = with_serving_calendar(scale_inputs(both, F.col("_factor")), "target_date")
    value = F.col("prediction")
    out = predict(features).groupBy(STATION, "horizon", "scenario", "scenario_label").agg(
        F.max(F.when(F.col("_factor") == 1.0, value)).alias("baseline"),
        F.max(F.when(F.col("_factor") == F.col("factor"), value)).alias("simulated"),
    )
    return out.withColumn("delta", numbers.delta(F.col("simulated"), F.col("baseline")))


def score_requests(
    requests: DataFrame, predict: Predictor, keep: Sequence[str] = ()
) -> DataFrame:
    """Score typed-in requests: a date and six numbers, all as text.

    A request with a bad date or number keeps its row with an ``error``; the
    trend is zero, since a request has no history.
    """
    date = F.try_to_date(F.col("date"), "yyyy-M-d")
    parsed = requests.withColumns(
        {
            "target_date": date,
            **{c: numbers.finite(numbers.to_number(F.col(c))) for c in CONTEXT_POLLUTANTS},
        }
    )
    bad = F.when(F.col("target_date").isNull(), F.lit("date"))
    for c in CONTEXT_POLLUTANTS:
        bad = bad.when(F.col(c).isNull(), F.lit(c))
    marked = parsed.withColumn("error", F.when(bad.isNotNull(), F.concat(F.lit("invalid "), bad)))
    scored = predict(with_serving_calendar(marked, "target_date"))
    good, value = F.col("error").isNull(), F.col("prediction")
    level = levels.risk_level(value)
    return scored.select(
        *keep,
        "target_date",
        "error",
        F.when(good, value).alias("value"),
        F.when(good, levels.category(value)).alias("category"),
        F.when(good, levels.category_badge(value)).alias("badge"),
        F.when(good, level).alias("level"),
        F.when(good, levels.recommendation(level)).alias("recommendation"),
    )


def score_recent(
    df: DataFrame,
    predict: Predictor,
    std: float | None = None,
    rows: int = 50,
    tiebreak: Sequence[str] = (),
) -> DataFrame:
    """The last rows of each station with prediction, band and residual."""
    recent = latest_rows(df, rows, tiebreak=tiebreak)
    scored = predict(with_serving_calendar(recent, DATE))
    return with_bounds(scored, std_column(std)).select(
        STATION,
        DATE,
        F.col(TARGET).alias("label"),
        "prediction",
        "lower",
        "upper",
        numbers.residual(F.col(TARGET), F.col("prediction")).alias("residual"),
    )


def batch_predict(raw: DataFrame, features: PanelFeaturesModel, artifacts: Artifacts, k: float = 1.0) -> DataFrame:
    """Raw readings to predictions with bounds, by the features saved with the model."""
    rows = features.transform(raw)
    predict = model_predictor(artifacts.model, artifacts.feature_columns)
    scored = with_bounds(predict(rows), std_column(artifacts.residual_std), k)
    return scored.select(STATION, DATE, "prediction", "lower", "upper")


def naive_forecasts(df: DataFrame, **arranged) -> DataFrame:
    """Three baselines per row: yesterday, a week ago and the mean of the last week.

    ``model, station, obs_date, label, prediction``; the mean covers the seven
    rows before the current one.
    """
    def build(w):
        before = w.rowsBetween(-7, -1)
        full = F.count(TARGET).over(before) == 7
        return {
            "Persistence1": F.lag(TARGET, 1).over(w),
            "Persistence7": F.lag(TARGET, 7).over(w),
            "WeekMean": F.when(full, F.avg(TARGET).over(before)),
        }

    names = ("Persistence1", "Persistence7", "WeekMean")
    wide = arrange(df, **arranged).history(7, [TARGET], build).result()
    rows = F.array(*[F.struct(F.lit(n).alias("model"), F.col(n).alias("prediction")) for n in names])
    rest = [c for c in wide.columns if c not in names]
    return wide.select(*rest, F.inline(rows)).withColumn("label", F.col(TARGET))
