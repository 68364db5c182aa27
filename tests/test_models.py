import pytest
from pyspark.ml import PipelineModel
from pyspark.ml.regression import LinearRegression
from pyspark.sql import functions as F

from stationcast.operators import features, fill
from stationcast.operators.ordered import measure
from stationcast.plans import scoring, training
from stationcast.plans.stages import MedianImputer, PanelFeatures, PanelFeaturesModel
from stationcast.schema import CONTEXT_POLLUTANTS, SERVING_FEATURES
from stationcast.session import scratch_path
from stationcast.sources.artifacts import load_artifacts


@pytest.fixture(scope="module")
def rows(panel):
    from stationcast.session import durable

    out = features.build_features(fill.forward_fill(panel)).withColumns(
        {"periode_data": F.year("obs_date") * 100 + F.month("obs_date"), "bulan": F.month("obs_date")}
    )
    return durable(out)


@pytest.fixture(scope="module")
def trained(rows):
    models = {
        "RandomForest": lambda: training.random_forest(numTrees=5, maxDepth=4),
        "GradientBoosting": lambda: training.boosted_trees(maxIter=3, maxDepth=3),
        "LinearRegression": training.linear_regression,
        "Broken": lambda: LinearRegression(labelCol="no_such_column"),
    }
    return training.train_all(rows, models, columns=SERVING_FEATURES)


def test_a_failing_model_is_left_out(trained):
    assert trained.status["Broken"].startswith("failed")
    assert set(trained.models) == {"RandomForest", "GradientBoosting", "LinearRegression"}


def test_comparison_and_folds(trained):
    table = {r.model: r for r in trained.comparison.collect()}
    assert set(table) == set(trained.models)
    for row in table.values():
        assert row.test_mae > 0 and row.cv_mae > 0 and row.cv_std >= 0
        assert row.train_rmse >= row.train_mae
    assert trained.folds.groupBy("model").count().filter("count <> 5").count() == 0


def test_predictions_cover_every_row_once(trained, rows):
    counts = trained.predictions.groupBy("model").count().collect()
    assert {r["count"] for r in counts} == {rows.count()}


def test_fit_uses_the_past_only(trained):
    sides = trained.prepared.rows.groupBy("station").agg(
        F.max(F.when(F.col("is_train"), F.col("obs_date"))).alias("last"),
        F.min(F.when(~F.col("is_train"), F.col("obs_date"))).alias("first"),
    )
    assert sides.filter("last >= first").count() == 0


def test_saved_model_predicts_the_same(spark, trained, rows):
    path = scratch_path(spark, "artifacts")
    metadata = training.choose_and_save(spark, trained, path)
    loaded = load_artifacts(spark, path)
    assert loaded.metadata["model_name"] == metadata["model_name"]
    assert loaded.feature_columns == list(SERVING_FEATURES)
    assert loaded.residual_std > 0
    kept = trained.models[metadata["model_name"]].transform(rows).select("station", "obs_date", F.col("prediction").alias("a"))
    again = loaded.model.transform(rows).select("station", "obs_date", F.col("prediction").alias("b"))
    assert kept.join(again, ["station", "obs_date"]).filter("a <> b").count() == 0


def test_too_good_models_are_rejected(rows):
    copied = rows.withColumn("copy", F.col("pm25") + F.col("pm10") * 1e-4)
    out = training.train_all(copied, {"LinearRegression": training.linear_regression}, columns=["copy"], folds=False)
    assert out.status["LinearRegression"] in ("too_good", "exact_copy")
    assert training.choose_and_save(rows.sparkSession, out) is None


def test_imputer_uses_exact_medians(spark):
    df = spark.createDataFrame([(1.0, None), (2.0, None), (4.0, None), (10.0, None), (None, None)], "a double, b double")
    model = MedianImputer(inputCols=["a", "b"]).fit(df)
    assert model.getOrDefault(model.inputCols) == ["a"]
    assert sorted(r.a for r in model.transform(df).collect()) == [1.0, 2.0, 3.0, 4.0, 10.0]


def test_imputer_survives_saving(spark):
    df = spark.createDataFrame([(1.0,), (None,), (5.0,)], "a double")
    path = scratch_path(spark, "imputer")
    PipelineModel(stages=[MedianImputer(inputCols=["a"]).fit(df)]).write().save(path)
    assert PipelineModel.load(path).transform(df).agg(F.sum("a")).first()[0] == 9.0


def test_panel_features(spark, raw):
    fitted = PanelFeatures(bestStation=True).fit(raw)
    out = fitted.transform(raw)
    assert out.select("station").distinct().count() == 1
    assert "pm25_lag_30" in fitted.get_feature_columns() and "station" not in fitted.get_feature_columns()
    path = scratch_path(spark, "features")
    fitted.write().save(path)
    again = PanelFeaturesModel.load(path)
    assert again.get_feature_columns() == fitted.get_feature_columns()
    assert again.transform(raw).count() == out.count()


def test_empty_training_side_is_an_error(rows):
    with pytest.raises(ValueError):
        training.prepare(rows.limit(0), columns=["pm10"])


def linear(df):
    return df.withColumn("prediction", sum((F.coalesce(F.col(c), F.lit(0.0)) for c in CONTEXT_POLLUTANTS), F.lit(0.0)))


def test_forecast_bounds_and_risk(panel):
    out = scoring.forecast(fill.forward_fill(panel), linear, 8.0).collect()
    assert len(out) == 3 * panel.select("station").distinct().count()
    for r in out:
        assert r.lower <= r.value <= r.upper
        assert (r.level is not None) == (r.horizon == 1)
        assert r.ci_width in (16.0, None)


def test_no_spread_no_bounds(panel):
    row = scoring.forecast(panel, linear).first()
    assert row.lower is None and row.upper is None and row.value is not None


def test_normal_scenario_changes_nothing(panel):
    out = scoring.simulate(panel, linear)
    assert out.filter("scenario = 'normal' AND delta <> 0").count() == 0
    assert out.filter("scenario = 'increase' AND delta <= 0").count() == 0
    assert out.groupBy("scenario").count().count() == 3


def test_unknown_scenario_counts_as_normal(spark):
    df = spark.createDataFrame([("foo",), ("increase",)], ["scenario"])
    got = {r.scenario: (r.factor, r.scenario_label) for r in scoring.lookup_scenario(df).collect()}
    assert got == {"foo": (1.0, "Kondisi Normal"), "increase": (1.1, "Kenaikan Polusi (+10%)")}


def test_requests_keep_bad_rows(spark):
    good = ("2021-01-05", "1", "2", "3", "4", "5", "6")
    rows = [("a", *good), ("b", "2021-02-30", *good[1:]), ("c", good[0], "x", *good[2:])]
    names = ["id", "date", *CONTEXT_POLLUTANTS]
    out = {r.id: r for r in scoring.score_requests(spark.createDataFrame(rows, names), linear, keep=["id"]).collect()}
    assert out["a"].value == 21.0 and out["a"].category == "Baik" and out["a"].error is None
    assert out["b"].error == "invalid date" and out["b"].value is None
    assert out["c"].error == "invalid pm10" and out["c"].recommendation is None


def test_context_is_the_last_week(days):
    rows = [("a", i, *[float(i)] * 7) for i in range(20)]
    df = days(rows, ("pm25", *CONTEXT_POLLUTANTS))
    row = scoring.forecast_context(df).first()
    assert row.pm10 == 16.0 and row.last_actual == 19.0


def test_sizes_can_be_shared(panel):
    sizes = measure(panel, max_rows=100)
    out = scoring.naive_forecasts(fill.impute_target(panel, sizes=sizes), sizes=sizes)
    plain = scoring.naive_forecasts(fill.impute_target(panel))
    assert out.select(*plain.columns).exceptAll(plain).count() == 0


def test_a_crash_leaves_the_old_version(spark, trained, monkeypatch):
    from stationcast.sources import artifacts

    path = scratch_path(spark, "versions")
    with pytest.raises(FileNotFoundError):
        load_artifacts(spark, path)
    model, other = trained.models["LinearRegression"], trained.models["RandomForest"]
    first = artifacts.save_artifacts(spark, path, model, {"model_name": "old", "feature_columns": ["a"]})

    def stopped(*_):
        raise RuntimeError("stopped between the two writes")

    with monkeypatch.context() as broken:
        broken.setattr(artifacts, "metadata_table", stopped)
        with pytest.raises(RuntimeError):
            artifacts.save_artifacts(spark, path, other, {"model_name": "new"})
    assert len(artifacts._begun(spark, path)) == 2 and artifacts.versions(spark, path) == [first]
    loaded = load_artifacts(spark, path)
    assert loaded.metadata["model_name"] == "old" and type(loaded.model.stages[-1]).__name__ == "LeastSquaresModel"
    third = artifacts.save_artifacts(spark, path, other, {"model_name": "new"})
    assert load_artifacts(spark, path).version == third and load_artifacts(spark, path, first).metadata["model_name"] == "old"
    artifacts.prune(spark, path, keep=1)
    assert artifacts._begun(spark, path) == [third]
    assert load_artifacts(spark, path).metadata["model_name"] == "new"


@pytest.mark.parametrize("name", ["RandomForest", "GradientBoosting"])
def test_tables_of_nodes(spark, trained, name):
    from stationcast.plans import trees

    nodes = trees.node_table(spark, trained.models[name], trained.prepared.columns)
    assert nodes.filter("feature is null and left is not null").count() == 0
    scored = trees.score(trained.prepared.rows, nodes).withColumnRenamed("prediction", "from_table")
    both = trained.predictions.filter(F.col("model") == name).join(scored, ["station", "obs_date"])
    assert both.count() == trained.prepared.rows.count()
    assert both.filter("abs(prediction - from_table) > 1e-9").count() == 0
    assert trees.importance(nodes).agg(F.sum("splits")).first()[0] == nodes.filter("left is not null").count()
    with pytest.raises(ValueError):
        trees.node_table(spark, trained.models["LinearRegression"], trained.prepared.columns)
