"""Trained models, saved artifacts and streams."""

from __future__ import annotations

from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from stationcast.operators import features, fill
from stationcast.operators.metrics import evaluate
from stationcast.plans import scoring, training, trees
from stationcast.plans.stages import MedianImputer, PanelFeatures, PanelFeaturesModel
from stationcast.schema import (
    CONTEXT_POLLUTANTS,
    DATE,
    FILLED_POLLUTANTS,
    SERVING_FEATURES,
    STATION,
)
from stationcast.session import scratch_path
from stationcast.sources.artifacts import load_artifacts, metadata_table
from stationcast.streaming import daily, history, live

from . import base, ctes
from .cleaning import STDS
from .ctes import CALENDAR, sql
from .registry import query, rounded


def _rows(spark, sf):
    """Feature rows with the two raw calendar columns, for all stations."""
    return _with_raw_calendar(base.feature_rows(spark, sf))


def _with_raw_calendar(rows):
    return rows.withColumns({"periode_data": F.year(DATE) * 100 + F.month(DATE), "bulan": F.month(DATE)})


def _train(spark, sf, *names, folds=True, options=None, **changes):
    configured = training.model_configurations()
    chosen = {n: (lambda make=configured[n]: make(**changes)) for n in names or configured}
    days = base.panel(spark, sf)
    known = base.arranged(days)
    filled = fill.forward_fill(days, FILLED_POLLUTANTS, **known)
    rows = _with_raw_calendar(features.build_features(filled, **known))
    return training.train_all(rows, chosen, folds=folds, columns=SERVING_FEATURES, **known, **(options or {}))


#: The feature rows as a training run splits them.
TRAINED = """(select *, case when position <= floor(size * cast(0.8 as double)) then 'train' else 'test' end as side
from (select *, row_number() over (partition by station order by obs_date) as position, count(*) over (partition by station) as size from feat))"""


def _sides(predictions):
    """Rows, scored rows and labels of both sides."""
    known = F.col("prediction").isNotNull() & ~F.isnan("prediction")
    return rounded(predictions.groupBy("model", "side").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(known).alias("n_scored"), F.avg("label").alias("mean_label"),
        F.min("label").alias("min_label"), F.max("label").alias("max_label"),
    ), "mean_label")


def _sides_sql(name: str, more: str = "") -> str:
    return (
        f"select '{name}' as model, side, count(*) as n, count(*) as n_scored, round(avg(pm25), 6) as mean_label,"
        f" min(pm25) as min_label, max(pm25) as max_label{more} from {TRAINED} group by side"
    )


# a forest's prediction is a mean of training labels
@query("m8_random_forest", sql(_sides_sql("RandomForest", ", count(*) as n_inside"), "feat"))
def m8(spark, sf):
    scored = _train(spark, sf, "RandomForest", folds=False).predictions
    low, high = scored.filter("side = 'train'").agg(F.min("label"), F.max("label")).first()
    inside = scored.filter(F.col("prediction").between(low - 1e-9, high + 1e-9)).groupBy("side").agg(F.count(F.lit(1)).alias("n_inside"))
    return _sides(scored).join(F.broadcast(inside), "side")


@query("m9_boosted_trees", sql(_sides_sql("GradientBoosting"), "feat"))
def m9(spark, sf):
    return _sides(_train(spark, sf, "GradientBoosting", folds=False).predictions)


#: Without bagging every tree sees all training rows, so each leaf's value is a mean of theirs.
PLAIN_FOREST = {"bootstrap": False, "numTrees": 12, "maxDepth": 7}


@query("m8_leaf_values", sql(f"""
select tree, count(*) as n_rows, round(avg(pm25), 6) as mean_label, cast(0 as bigint) as wrong_leaves
from {TRAINED}, (select unnest(range(12)) as tree) where side = 'train' group by tree""", "feat"))
def m8_leaves(spark, sf):
    """Every leaf of every tree against the rows that reach it by its table of nodes."""
    trained = _train(spark, sf, "RandomForest", folds=False, **PLAIN_FOREST)
    nodes = trees.node_table(spark, trained.models["RandomForest"], trained.prepared.columns)
    found = trees.leaf_values(trained.prepared.train, nodes, F.col("label"))
    same = (F.col("n") == F.col("n_rows")) & (F.abs(F.col("value") - F.col("mean_label")) < 1e-6)
    return found.groupBy("tree").agg(
        F.sum("n_rows").alias("n_rows"), F.round(F.sum(F.col("mean_label") * F.col("n_rows")) / F.sum("n_rows"), 6).alias("mean_label"),
        F.count_if(~F.coalesce(same, F.lit(False))).alias("wrong_leaves"),
    ).withColumn("tree", F.col("tree").cast("long"))


@query("m8_m9_tree_tables", sql(f"""
select model, station, side, count(*) as n, count(*) as n_equal
from {TRAINED}, (select unnest(['RandomForest', 'GradientBoosting']) as model) group by all""", "feat"))
def m8_m9_tables(spark, sf):
    """Predictions of both ensembles from their tables of nodes, row by row beside the models' own."""
    trained = _train(spark, sf, "RandomForest", "GradientBoosting", folds=False, maxDepth=5)
    out = None
    for name, model in trained.models.items():
        nodes = trees.node_table(spark, model, trained.prepared.columns)
        scored = trees.score(trained.prepared.rows, nodes).withColumnRenamed("prediction", "from_table")
        own = trained.predictions.filter(F.col("model") == name).join(scored, [STATION, DATE])
        out = own if out is None else out.unionByName(own)
    equal = F.abs(F.col("prediction") - F.col("from_table")) < 1e-9
    return out.groupBy("model", STATION, "side").agg(F.count(F.lit(1)).alias("n"), F.count_if(equal).alias("n_equal"))


# least squares with an intercept: on the training rows the residuals have mean zero and
# are uncorrelated with every feature
@query("m10_linear_regression", sql(f"""
select s.*, round(a, 4) as mean_prediction, round(b, 3) as with_month, round(c, 3) as with_pm10
from ({_sides_sql("LinearRegression")}) s left join (
  select side, avg(pm25) as a, avg(pm25 * month(obs_date)) as b, avg(pm25 * pm10) as c from {TRAINED} where side = 'train' group by side
) using (side)""", "feat"))
def m10(spark, sf):
    rows = _train(spark, sf, "LinearRegression", folds=False).predictions
    p = F.col("prediction")
    pm10 = base.feature_rows(spark, sf).select(STATION, DATE, "pm10")
    moments = rows.filter("side = 'train'").join(pm10, [STATION, DATE]).groupBy("side").agg(
        F.round(F.avg(p), 4).alias("mean_prediction"), F.round(F.avg(p * F.month(DATE)), 3).alias("with_month"),
        F.round(F.avg(p * F.col("pm10")), 3).alias("with_pm10"),
    )
    return _sides(rows).join(F.broadcast(moments), "side", "left")


@query(
    "m10_single_feature_regression",
    sql("select round(regr_slope(pm25, no2), 4) as slope, round(regr_intercept(pm25, no2), 4) as intercept, count(*) as n from target where no2 is not null", "target"),
)
def m10_single(spark, sf):
    rows = base.target(spark, sf).filter(F.col("no2").isNotNull())
    ready = VectorAssembler(inputCols=["no2"], outputCol="features").transform(rows)
    fitted = training.linear_regression().setLabelCol("pm25").fit(ready)
    return rows.agg(
        F.round(F.lit(fitted.coefficients[0]), 4).alias("slope"),
        F.round(F.lit(fitted.intercept), 4).alias("intercept"),
        F.count(F.lit(1)).alias("n"),
    )


FILLED_IN = ", ".join(
    f"coalesce({c}, (select median({c}) from split where is_train)) as {c}" for c in CONTEXT_POLLUTANTS
)


@query("m11_numeric_rows", sql(f"select station, obs_date, is_train, pm25 as label, {', '.join(f'round({c}, 6) as {c}' for c in CONTEXT_POLLUTANTS)} from (select station, obs_date, is_train, pm25, {FILLED_IN} from split)", "split"))
def m11(spark, sf):
    rows, chosen = training.training_rows(base.target(spark, sf), columns=CONTEXT_POLLUTANTS)
    imputer = MedianImputer(inputCols=chosen).fit(rows.filter("is_train"))
    out = imputer.transform(rows).drop("block", "fold_count")
    return rounded(out, *CONTEXT_POLLUTANTS)


#: Fold blocks of the training rows of each station.
FOLD_BLOCKS = f"""(select *, case when position - 1 < train_size - k * t then 0 else 1 + (position - 1 - (train_size - k * t)) // t end as block
from (select *, train_size // (k + 1) as t from (select *, case when least(5, train_size // 10) >= 2 then least(5, train_size // 10) end as k
from (select *, cast(floor(size * cast(0.8 as double)) as bigint) as train_size from {TRAINED} where side = 'train'))))"""


def _folds_sql(models: str) -> str:
    """Rows that each fold trains and tests on, and whether it gave an error, for each model."""
    return f"""
select m.model, cast(f.fold as int) as fold, count(*) filter (block < f.fold) as n_train, count(*) filter (block = f.fold) as n_test,
  count(*) filter (block = f.fold) > 0 as measured
from {FOLD_BLOCKS}, (select unnest([1, 2, 3, 4, 5]) as fold) f, (select unnest([{models}]) as model) m
group by m.model, f.fold having count(*) filter (block = f.fold) > 0"""


def _folds(trained):
    """What the folds of a run were made of."""
    train = trained.prepared.train
    sizes = train.groupBy("block").agg(F.count(F.lit(1)).alias("n")).filter("block is not null").collect()  # six rows at most
    count = {row["block"]: row["n"] for row in sizes}
    rows = [(k, sum(n for b, n in count.items() if b < k), count[k]) for k in sorted(count) if k >= 1]
    made = trained.folds.sparkSession.createDataFrame(rows, "fold int, n_train long, n_test long")
    return trained.folds.join(F.broadcast(made), "fold").select(
        "model", "fold", "n_train", "n_test", (F.col("fold_mae") >= 0).alias("measured")
    )


@query("m12_train_one_model", sql(_folds_sql("'LinearRegression'"), "feat"))
def m12(spark, sf):
    return _folds(_train(spark, sf, "LinearRegression"))


@query("m13_train_all_models", sql(
    _sides_sql("RandomForest") + " union all " + _sides_sql("GradientBoosting") + " union all " + _sides_sql("LinearRegression"), "feat"))
def m13(spark, sf):
    return _sides(_train(spark, sf, folds=False).predictions)


@query("m13_best_station", sql(f"""
select side, count(*) as n, min(obs_date) as first_date, max(obs_date) as last_date, min(station) as station
from {TRAINED} where station = (select station from feat group by station order by count(pm25) desc, station limit 1) group by side""", "feat"))
def m13_station(spark, sf):
    """Least squares on the station with most values."""
    trained = _train(spark, sf, "LinearRegression", folds=False, options={"best_station": True})
    return trained.predictions.groupBy("side").agg(
        F.count("prediction").alias("n"), F.min(DATE).alias("first_date"), F.max(DATE).alias("last_date"), F.min(STATION).alias("station")
    )


@query("m13_pooled_by_date", sql("""
select case when position <= floor(size * cast(0.8 as double)) then 'train' else 'test' end as side, count(*) as n,
  min(obs_date) as first_date, max(obs_date) as last_date, count(distinct station) as stations
from (select *, row_number() over (order by obs_date, station) as position, count(*) over () as size from feat) group by 1""", "feat"))
def m13_pooled(spark, sf):
    """Least squares on all stations with a station feature, all split at one date."""
    rows = training.station_index(_rows(spark, sf))
    trained = training.train_all(
        rows, {"LinearRegression": training.linear_regression}, folds=False, by_date=True,
        columns=[*SERVING_FEATURES, "station_index"], **base.UNIQUE,
    )
    return trained.predictions.groupBy("side").agg(
        F.count("prediction").alias("n"), F.min(DATE).alias("first_date"), F.max(DATE).alias("last_date"),
        F.count_distinct(STATION).alias("stations"),
    )


@query("m14_cross_validated_model", sql(_folds_sql("'LinearRegression'"), "feat"))
def m14(spark, sf):
    prepared = training.prepare(_rows(spark, sf), columns=SERVING_FEATURES)
    errors = training.cross_validate(prepared, training.linear_regression, "LinearRegression")
    return _folds(training.Trained(prepared, {}, None, None, errors))


#: Training rows with fold blocks and one feature, gaps filled with the training median.
ONE_FEATURE = f"(select station, obs_date, pm25 as y, coalesce(no2, (select median(no2) from {TRAINED} where side = 'train')) as x, block, k from {FOLD_BLOCKS})"


@query("m14_fold_errors_one_feature", sql(f"""
select f.fold, count(*) as n_test, round(avg(abs(t.y - (f.a + f.b * t.x))), 6) as fold_mae
from {ONE_FEATURE} t join (
  select cast(fold as int) as fold, regr_slope(y, x) as b, regr_intercept(y, x) as a
  from {ONE_FEATURE}, (select unnest([1, 2, 3, 4, 5]) as fold) where block < fold group by fold
) f on t.block = f.fold group by f.fold""", "feat"))
def m14_one_feature(spark, sf):
    """Errors of all folds of least squares with one feature."""
    prepared = training.prepare(base.feature_rows(spark, sf), columns=["no2"], **base.UNIQUE)
    errors = training.cross_validate(prepared, training.linear_regression, "LinearRegression")
    sizes = prepared.train.groupBy(F.col("block").alias("fold")).agg(F.count(F.lit(1)).alias("n_test"))
    return errors.join(sizes, "fold").select("fold", "n_test", F.round("fold_mae", 6).alias("fold_mae"))


SPLIT_ONE = f"(select station, side, pm25 as y, coalesce(no2, (select median(no2) from {TRAINED} where side = 'train')) as x from {TRAINED})"


@query("m13_station_models", sql(f"""
select m.station, m.n, round(b, 6) as slope, round(a, 6) as intercept, round(avg(abs(t.y - (a + b * t.x))), 6) as test_mae
from (select station, count(*) as n, regr_slope(y, x) as b, regr_intercept(y, x) as a from {SPLIT_ONE} where side = 'train' group by station) m
join {SPLIT_ONE} t on t.station = m.station and t.side = 'test' group by m.station, m.n, a, b""", "feat"))
def m13_station_models(spark, sf):
    """A model of its own for every station, all from one shuffle."""
    found = training.train_stations(base.feature_rows(spark, sf), columns=["no2"], **base.UNIQUE)
    test = found.metrics.filter("side = 'test'").select(STATION, F.round("mae", 6).alias("test_mae"))
    return found.models.join(test, STATION).select(
        STATION, "n", F.round(F.col("weights")[0], 6).alias("slope"), F.round("intercept", 6).alias("intercept"), "test_mae"
    )


@query("m13_station_folds", sql(f"""
select t.station, cast(t.block as int) as fold, count(*) as n_test, round(avg(abs(t.y - (f.a + f.b * t.x))), 6) as fold_mae
from {ONE_FEATURE} t join (
  select station, fold, regr_slope(y, x) as b, regr_intercept(y, x) as a
  from {ONE_FEATURE}, (select unnest([1, 2, 3, 4, 5]) as fold) where block < fold and fold <= k group by station, fold
) f on t.station = f.station and t.block = f.fold group by t.station, t.block""", "feat"))
def m13_station_folds(spark, sf):
    """Fold errors of every station's own models."""
    found = training.train_stations(base.feature_rows(spark, sf), columns=["no2"], **base.UNIQUE)
    sizes = found.prepared.train.groupBy(STATION, F.col("block").alias("fold")).agg(F.count(F.lit(1)).alias("n_test"))
    return found.folds.join(sizes, [STATION, "fold"]).select(STATION, "fold", "n_test", F.round("fold_mae", 6).alias("fold_mae"))


#: Least squares on one feature, so that SQL can follow the trained model to its last result.
RULE = f"""(select *, (select stddev_pop(a + b * x - y) from {SPLIT_ONE} where side = 'test') as std, (select median(no2) from {TRAINED} where side = 'train') as filled
from (select regr_intercept(y, x) as a, regr_slope(y, x) as b from {SPLIT_ONE} where side = 'train'))"""


def _one_feature(spark, sf, path=None):
    """Least squares on one feature; with a path it is saved there and loaded, also where the feature is constant."""
    trained = training.train_all(
        base.feature_rows(spark, sf), {"LinearRegression": training.linear_regression}, columns=["no2"], **base.UNIQUE
    )
    if path is None:
        return trained
    training.choose_and_save(spark, trained, path, rejected=True)
    return load_artifacts(spark, path)


def _one_predictor(spark, sf):
    loaded = _one_feature(spark, sf, scratch_path(spark, "artifacts"))
    return loaded, scoring.model_predictor(loaded.model, loaded.feature_columns)


FITTED = f"(select t.*, a + b * x as p from {SPLIT_ONE} t, {RULE})"


@query("m12_comparison_values", sql(f"""
select 'LinearRegression' as model, {", ".join(
    f"max(case when side = '{side}' then round({m}, 6) end) as {side}_{m}" for m in ('mae', 'rmse', 'r2', 'mape') for side in ('train', 'test'))},
  (select round(avg(fold_mae), 6) from folds) as cv_mae, (select round(stddev_pop(fold_mae), 6) from folds) as cv_std
from (select side, avg(abs(y - p)) as mae, sqrt(avg((y - p) * (y - p))) as rmse, 1 - sum((y - p) * (y - p)) / (var_pop(y) * count(*)) as r2,
  100 * avg(abs(y - p) / greatest(abs(y), 2.220446049250313e-16)) as mape from {FITTED} group by side), (
  select 1) one(i)""", "feat").replace("from folds", f"""from (select t.block, avg(abs(t.y - (f.a + f.b * t.x))) as fold_mae from {ONE_FEATURE} t join (
  select fold, regr_slope(y, x) as b, regr_intercept(y, x) as a from {ONE_FEATURE}, (select unnest([1, 2, 3, 4, 5]) as fold) where block < fold group by fold
  ) f on t.block = f.fold group by t.block)"""))
def m12_comparison(spark, sf):
    """All figures of a training run with folds, value by value."""
    table = _one_feature(spark, sf).comparison.drop("rank")
    return rounded(table, *[c for c in table.columns if c != "model"])


@query("m18_batch_values", sql(f"""
select station, obs_date, round(a + b * coalesce(no2, filled), 6) as prediction, round(a + b * coalesce(no2, filled) - std, 6) as lower,
  round(a + b * coalesce(no2, filled) + std, 6) as upper from feat, {RULE}""", "feat"))
def m18_values(spark, sf):
    """Raw readings scored by a saved and loaded model, with bounds."""
    loaded = _one_feature(spark, sf, scratch_path(spark, "artifacts"))
    raw = base.raw(spark, sf)
    return rounded(scoring.batch_predict(raw, PanelFeatures().fit(raw), loaded), "prediction", "lower", "upper")


AHEAD = f"(select s.*, a + b * coalesce(no2, filled) as p, std from scored s, {RULE})"


@query("m20_forecast_values", sql(f"""
select station, cast(horizon as int) as horizon, obs_date as target_date, round(p, 6) as value, round(p - std, 6) as lower, round(p + std, 6) as upper,
  {ctes.category('p')} as category, case when horizon = 1 then {ctes.risk('p')} end as level from {AHEAD} where scenario = 'normal'""", "scored", "feat"))
def m20_values(spark, sf):
    """Forecasts of a trained model, value by value."""
    loaded, predict = _one_predictor(spark, sf)
    out = scoring.forecast(base.filled(spark, sf), predict, loaded.residual_std)
    picked = out.select(STATION, F.col("horizon").cast("int").alias("horizon"), "target_date", "value", "lower", "upper", "category", "level")
    return rounded(picked, "value", "lower", "upper")


@query("m21_scenario_values", sql(f"""
select s.station, cast(s.horizon as int) as horizon, s.scenario, round(n.p, 6) as baseline, round(s.p, 6) as simulated, round(s.p - n.p, 6) as delta
from {AHEAD} s join {AHEAD} n on n.station = s.station and n.horizon = s.horizon and n.scenario = 'normal'""", "scored", "feat"))
def m21_values(spark, sf):
    """Simulations of a trained model, value by value."""
    _, predict = _one_predictor(spark, sf)
    out = scoring.simulate(base.filled(spark, sf), predict)
    picked = out.select(STATION, F.col("horizon").cast("int").alias("horizon"), "scenario", "baseline", "simulated", "delta")
    return rounded(picked, "baseline", "simulated", "delta")


@query("m23_recent_values", sql(f"""
select station, obs_date, pm25 as label, round(p, 6) as prediction, round(p - std, 6) as lower, round(p + std, 6) as upper, round(pm25 - p, 6) as residual
from (select r.*, a + b * coalesce(no2, filled) as p, std from recent r, {RULE} where back <= 50)""", "recent", "feat"))
def m23_values(spark, sf):
    """The last rows scored by a trained model, value by value."""
    loaded, predict = _one_predictor(spark, sf)
    out = scoring.score_recent(base.filled(spark, sf), predict, loaded.residual_std)
    return rounded(out, "prediction", "lower", "upper", "residual")


#: Ensembles small enough to train with all folds in a query.
SMALL = {"RandomForest": {"numTrees": 8, "maxDepth": 4}, "GradientBoosting": {"maxIter": 5, "maxDepth": 3}, "LinearRegression": {}}


def _small_run(spark, sf):
    configured = training.model_configurations()
    models = {n: (lambda make=configured[n], c=c: make(**c)) for n, c in SMALL.items()}
    return training.train_all(_rows(spark, sf), models, columns=SERVING_FEATURES, **base.UNIQUE)


@query("m13_full_comparison")
def m13_comparison(spark, sf):
    """Figures of three models with all folds, their status, splits by feature of the ensembles, and which one is chosen."""
    trained = _small_run(spark, sf)
    best = training.choose_and_save(spark, trained)
    status = F.create_map(*[F.lit(x) for pair in trained.status.items() for x in pair])
    return trained.comparison.withColumns({"status": status[F.col("model")], "chosen": F.col("model") == F.lit(best["model_name"] if best else None)})


@query("m13_chosen_model", sql(f"""
select m.model, cast(5 as bigint) as n_folds, (select count(*) from {TRAINED} where side = 'test') as n_test, true as same_error, true as least_if_chosen
from (select unnest(['RandomForest', 'GradientBoosting', 'LinearRegression']) as model) m""", "feat"))
def m13_chosen(spark, sf):
    """Three models with folds: errors recomputed from the written predictions, and the choice against the least of error plus spread of folds."""
    trained = _small_run(spark, sf)
    best = training.choose_and_save(spark, trained)["model_name"]
    test = trained.predictions.filter("side = 'test'").groupBy("model").agg(
        F.count(F.lit(1)).alias("n_test"), F.avg(F.abs(F.col("label") - F.col("prediction"))).alias("mae")
    )
    folds = trained.folds.groupBy("model").agg(F.count(F.lit(1)).alias("n_folds"), F.stddev_pop("fold_mae").alias("spread"))
    test = test.join(folds, "model").withColumn("score", F.col("mae") + F.col("spread"))
    accepted = trained.accepted().select("model")
    least = test.join(accepted, "model", "left_semi").agg(F.min("score")).scalar()
    table = trained.comparison.select("model", "test_mae").join(test, "model")
    return table.select(
        "model", "n_folds", "n_test", (F.abs(F.col("mae") - F.col("test_mae")) < 1e-9).alias("same_error"),
        ((F.col("model") != best) | (F.col("score") <= least + 1e-9)).alias("least_if_chosen"),
    )


@query("m8_m9_predictions")
def m8_m9_predictions(spark, sf):
    """Every prediction of a forest and of boosted trees."""
    trained = _train(spark, sf, "RandomForest", "GradientBoosting", folds=False, maxDepth=5)
    return trained.predictions.select("model", "side", STATION, DATE, "label", F.round("prediction", 6).alias("prediction"))


CHAIN = "select *, cast(year(obs_date) * 100 + month(obs_date) as int) as periode_data, cast(month(obs_date) as int) as bulan from feat"


@query("m17_panel_features", sql(CHAIN, "feat"))
def m17(spark, sf):
    fitted = PanelFeatures().fit(base.raw(spark, sf))
    return rounded(fitted.transform(base.raw(spark, sf)), *STDS)


@query("m17_best_station", sql("select station, obs_date, pm25, pm25_lag_1, month, season from feat where station = (select station from clean group by station order by count(pm25) desc, station limit 1)", "feat", "clean"))
def m17_station(spark, sf):
    fitted = PanelFeatures(bestStation=True).fit(base.raw(spark, sf))
    return fitted.transform(base.raw(spark, sf)).select(STATION, DATE, "pm25", "pm25_lag_1", "month", "season")


@query("s7_saved_features", sql("select count(*) as rows, count(pm25_lag_30) as n_lag_30, count(distinct station) as stations, cast(38 as int) as n_features from feat", "feat"))
def s7(spark, sf):
    path = scratch_path(spark, "features")
    PanelFeatures().fit(base.raw(spark, sf)).write().save(path)
    loaded = PanelFeaturesModel.load(path)
    rows = loaded.transform(base.raw(spark, sf))
    return rows.agg(
        F.count(F.lit(1)).alias("rows"),
        F.count("pm25_lag_30").alias("n_lag_30"),
        F.count_distinct(STATION).alias("stations"),
        F.lit(len(loaded.get_feature_columns())).alias("n_features"),
    )


def _saved(spark, sf):
    path = scratch_path(spark, "artifacts")
    trained = _train(spark, sf, "LinearRegression", folds=False)
    training.choose_and_save(spark, trained, path)
    return trained, load_artifacts(spark, path)


@query("s5_s6_saved_model", sql("select station, count(*) as n, count(*) as n_equal from feat group by station", "feat"))
def s5_s6(spark, sf):
    """Scores of the model as trained and as loaded, side by side, per station."""
    trained, loaded = _saved(spark, sf)
    rows = _rows(spark, sf)
    kept = trained.models["LinearRegression"].transform(rows).select(STATION, DATE, F.col("prediction").alias("trained"))
    again = loaded.model.transform(rows).select(STATION, DATE, F.col("prediction").alias("loaded"))
    return kept.join(again, [STATION, DATE]).groupBy(STATION).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("trained") == F.col("loaded")).alias("n_equal")
    )


# rmse^2 = bias^2 + variance, so the figures saved with a model must agree with the rows scored
@query("s8_metadata", sql(f"""
select 'LinearRegression' as model_name, cast(16 as int) as n_features, count(*) as n_test, round(avg(pm25), 4) as mean_label
from {TRAINED} where side = 'test'""", "feat"))
def s8(spark, sf):
    trained, loaded = _saved(spark, sf)
    saved = metadata_table(spark, loaded.metadata)
    test = trained.predictions.filter("side = 'test'").agg(
        F.count(F.lit(1)).alias("n_test"), F.avg("prediction").alias("p"),
        F.avg(F.pow(F.col("prediction") - F.col("label"), 2)).alias("mse"), F.avg(F.col("prediction") - F.col("label")).alias("gap"),
    )
    agrees = (F.abs(F.pow("test_rmse", 2) - F.col("mse")) < 1e-6) & (F.abs(F.abs("overall_bias") - F.abs("gap")) < 1e-6)
    return saved.join(F.broadcast(test), agrees).select(
        "model_name", F.col("n_features").cast("int").alias("n_features"), "n_test", F.round(F.col("p") - F.col("gap"), 4).alias("mean_label")
    )


@query("m18_batch_predict", sql("select station, obs_date, true as scored, cast(2 as double) as spread from feat", "feat"))
def m18(spark, sf):
    _, loaded = _saved(spark, sf)
    raw = base.raw(spark, sf)
    out = scoring.batch_predict(raw, PanelFeatures().fit(raw), loaded)
    spread = F.round((F.col("upper") - F.col("lower")) / loaded.residual_std, 6)
    return out.select(STATION, DATE, F.col("prediction").isNotNull().alias("scored"), spread.alias("spread"))


@query("m20_forecast_trained_model", sql("""
select station, cast(horizon as int) as horizon, obs_date as target_date, round(last_actual, 6) as last_actual, true as scored, cast(2 as double) as spread
from scored where scenario = 'normal'""", "scored"))
def m20(spark, sf):
    _, loaded = _saved(spark, sf)
    predict = scoring.model_predictor(loaded.model, loaded.feature_columns)
    out = scoring.forecast(base.filled(spark, sf), predict, loaded.residual_std)
    spread = F.round((F.col("upper") - F.col("lower")) / loaded.residual_std, 6)
    return out.select(
        STATION, F.col("horizon").cast("int").alias("horizon"), "target_date", F.round("last_actual", 6).alias("last_actual"),
        F.col("value").isNotNull().alias("scored"), spread.alias("spread"),
    )


@query("m21_scenarios_trained_model", sql("""
select station, cast(horizon as int) as horizon, scenario, scenario_label, scenario = 'normal' as unchanged_if_normal from scored""", "scored"))
def m21(spark, sf):
    _, loaded = _saved(spark, sf)
    out = scoring.simulate(base.filled(spark, sf), scoring.model_predictor(loaded.model))
    same = (F.col("scenario") == "normal") & (F.col("delta") == 0) & (F.col("baseline") == F.col("simulated"))
    return out.select(STATION, F.col("horizon").cast("int").alias("horizon"), "scenario", "scenario_label", same.alias("unchanged_if_normal"))


@query("m23_score_recent_trained_model", sql("select station, obs_date, pm25 as label, true as consistent from recent where back <= 50", "recent"))
def m23(spark, sf):
    _, loaded = _saved(spark, sf)
    predict = scoring.model_predictor(loaded.model)
    out = scoring.score_recent(base.filled(spark, sf), predict, loaded.residual_std)
    inside = (F.col("lower") < F.col("prediction")) & (F.col("prediction") < F.col("upper"))
    sums = F.coalesce(F.abs(F.abs(F.col("label") - F.col("prediction")) - F.abs("residual")) < 1e-9, F.col("residual").isNull())
    return out.select(STATION, DATE, "label", (inside & sums).alias("consistent"))


@query("m5_trained_by_station", sql(f"""
select 'LinearRegression' as model, side, station, count(*) as n, true as ordered from {TRAINED} group by side, station""", "feat"))
def m5(spark, sf):
    trained = _train(spark, sf, "LinearRegression", folds=False)
    found = evaluate(trained.predictions, by=("model", "side", STATION))
    return found.select("model", "side", STATION, "n", (F.col("mae") <= F.col("rmse") + 1e-9).alias("ordered"))


@query("t2_saved_model", sql("select reading_id, arrival_date, true as scored from live", "live"))
def t2_saved(spark, sf):
    """The stream scored by a model that was saved and loaded."""
    _, loaded = _saved(spark, sf)
    target = scratch_path(spark, "live")
    predict = scoring.model_predictor(loaded.model, loaded.feature_columns)
    live.score_live(spark, base.landed_messages(spark, sf), predict, target, scratch_path(spark, "progress")).awaitTermination()
    return spark.read.parquet(target).select("reading_id", "arrival_date", F.col("value").isNotNull().alias("scored"))


@query("t1_live_ingest", sql("select * from live", "live"))
def t1(spark, sf):
    landing = base.landed_messages(spark, sf)
    target = scratch_path(spark, "live")
    live.ingest_live(spark, landing, target, scratch_path(spark, "progress"), files_per_batch=1).awaitTermination()
    return spark.read.parquet(target)


# a day is given out when the newest reading is two days past its end
@query("t1_daily_averages", sql(f"""
select arrival_date, count(*) as n, {', '.join(f'round(avg({c}), 9) as {c}' for c in CONTEXT_POLLUTANTS)}
from live where arrival_date + 3 <= (select max(arrival_date) from live) group by arrival_date""", "live"))
def t1_daily(spark, sf):
    """Daily means from a stream of files with repeated readings."""
    target = scratch_path(spark, "daily")
    daily.ingest_daily(spark, base.daily_feed(spark, sf), target, scratch_path(spark, "progress"), files_per_batch=1).awaitTermination()
    return rounded(spark.read.parquet(target), *CONTEXT_POLLUTANTS, places=9)


@query("t2_stream_features", sql("select * from feat", "feat"))
def t2_features(spark, sf):
    """The feature chain over days that arrive in four micro-batches."""
    days = base.panel(spark, sf)
    target, state, progress = (scratch_path(spark, n) for n in ("streamed", "state", "progress"))
    landing = base.landed_in_order(days, DATE, 4)
    history.stream_features(spark, landing, days.schema, target, state, progress, files_per_batch=1, **base.UNIQUE).awaitTermination()
    return rounded(history.read_streamed(spark, target), *STDS)


LIVE = f"select *, {ctes.LINEAR} as prediction from (select *, {CALENDAR.replace('obs_date', 'arrival_date')} from live)"


@query("t2_live_scoring", sql(f"""
select reading_id, arrival_date, round(prediction, 6) as value, {ctes.category('prediction')} as category, {ctes.badge('prediction')} as badge,
  {ctes.risk('prediction')} as level, {ctes.advice(ctes.risk('prediction'))} as recommendation from ({LIVE})""", "live"))
def t2(spark, sf):
    landing = base.landed_messages(spark, sf)
    target = scratch_path(spark, "live")
    live.score_live(spark, landing, base.linear, target, scratch_path(spark, "progress"), files_per_batch=1).awaitTermination()
    return rounded(spark.read.parquet(target), "value")



@query("m13_full_run", sql(_folds_sql("'RandomForest', 'GradientBoosting', 'LinearRegression'"), "feat"))
def m13_full(spark, sf):
    """Raw text to a saved best model: features, three models with all folds, checks, choice, saving.

    The rows are the folds of the three models; the model chosen is loaded again and must
    be one of those with the least test error.
    """
    path = scratch_path(spark, "artifacts")
    rows = _with_raw_calendar(features.features_from_raw(base.raw(spark, sf)))
    trained = training.train_all(rows, columns=SERVING_FEATURES, **base.UNIQUE)
    saved = training.choose_and_save(spark, trained, path)
    if load_artifacts(spark, path).metadata["model_name"] != saved["model_name"]:
        raise ValueError("the model saved is not the one chosen")
    return _folds(trained)
