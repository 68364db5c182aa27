"""Training, cross-validation, comparison and choice of regression models."""

from __future__ import annotations

import logging
from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from functools import reduce

from pyspark import StorageLevel, inheritable_thread_target
from pyspark.ml import Estimator, Model, PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import numbers
from ..operators import metrics, selection
from ..operators.bias import overall_bias
from ..operators.features import feature_columns, leakage_free, select_station
from ..operators.moments import add_up
from ..operators.ordered import arrange, attach
from ..operators.split import add_segments, add_split
from ..schema import DATE, STATION, TARGET
from ..session import durable, ensure_checkpoint_dir
from ..sources.artifacts import save_artifacts
from .least_squares import LeastSquares, group_moments, score_groups, solve_groups
from .stages import MedianImputer

SEED = 42
#: Fits of one model that run at a time.
PARALLEL = 4

log = logging.getLogger(__name__)


def random_forest(**changes) -> RandomForestRegressor:
    settings = dict(numTrees=100, maxDepth=10, featureSubsetStrategy="sqrt", maxMemoryInMB=1024, seed=SEED)
    return RandomForestRegressor(labelCol="label", **{**settings, **changes})


def boosted_trees(**changes) -> GBTRegressor:
    settings = dict(
        maxIter=100,
        maxDepth=6,
        stepSize=0.1,
        subsamplingRate=0.8,
        featureSubsetStrategy="0.8",
        maxMemoryInMB=1024,
        seed=SEED,
    )
    return GBTRegressor(labelCol="label", **{**settings, **changes})


def linear_regression(**changes) -> Estimator:
    """Exact least squares; with ``changes`` (a penalty, another solver) the regression of Spark ML."""
    return LinearRegression(labelCol="label", **changes) if changes else LeastSquares()


def model_configurations() -> dict[str, Callable[..., Estimator]]:
    """The compared models, in the order that breaks ties."""
    return {
        "RandomForest": random_forest,
        "GradientBoosting": boosted_trees,
        "LinearRegression": linear_regression,
    }


@dataclass
class Prepared:
    """Imputed and assembled rows with their side and fold block."""

    rows: DataFrame
    columns: list[str]
    stages: PipelineModel

    @property
    def train(self) -> DataFrame:
        return self.rows.filter("is_train")

    @property
    def test(self) -> DataFrame:
        return self.rows.filter("NOT is_train")

    def release(self) -> None:
        self.rows.unpersist()


@dataclass
class Trained:
    """Everything a training run found out; the tables stay DataFrames."""

    prepared: Prepared
    models: dict[str, PipelineModel]
    predictions: DataFrame | None
    metrics: DataFrame | None
    folds: DataFrame | None
    status: dict[str, str] = field(default_factory=dict)

    @property
    def comparison(self) -> DataFrame | None:
        if self.metrics is None:
            return None
        cv = metrics.cv_summary(self.folds) if self.folds is not None else None
        return ranked(metrics.comparison(self.metrics, cv))

    def accepted(self) -> DataFrame | None:
        """The comparison without models that failed a check."""
        table = self.comparison
        if table is None:
            return None
        good = [n for n, s in self.status.items() if s in ("ok", "narrow_range")]
        return table.filter(F.col("model").isin(good))


@dataclass
class StationModels:
    """A model for every station: ``models`` has weights (in the order of the columns), intercept, rank and n."""

    prepared: Prepared
    models: DataFrame
    predictions: DataFrame
    metrics: DataFrame
    folds: DataFrame

    @property
    def columns(self) -> list[str]:
        return self.prepared.columns

    def score(self, features: DataFrame) -> DataFrame:
        """Feature rows with their station's prediction."""
        ready = self.prepared.stages.transform(features)
        return score_groups(ready, self.models, [STATION]).drop("features")


def ranked(table: DataFrame, names: Sequence[str] = ()) -> DataFrame:
    """Add the configuration order of each model as ``rank``."""
    names = list(names) or list(model_configurations())
    rank = F.lit(len(names))
    for i, name in enumerate(names):
        rank = F.when(F.col("model") == name, i).otherwise(rank)
    return table.withColumn("rank", rank)


def training_rows(
    features: DataFrame,
    test_size: float = 0.2,
    allow_lagged: bool = False,
    columns: Sequence[str] | None = None,
    max_folds: int = 5,
    station: str | None = None,
    best_station: bool = False,
    by_date: bool = False,
    **arranged,
) -> tuple[DataFrame, list[str]]:
    """Split rows with label, side, fold block and the features that may be used.

    Fold blocks number the training rows only. ``station`` or ``best_station`` (most
    known targets) keeps one station. Otherwise each station is split at its own share
    of rows, or all of them at one date with ``by_date``, so that no model learns from
    days after the first test day.
    """
    if station is not None or best_station:
        features = select_station(features, station)
    chosen = list(columns or leakage_free(feature_columns(features), TARGET, allow_lagged))
    if by_date:
        arranged = {"keys": (), "order": (DATE, STATION), "tiebreak": arranged.get("tiebreak")}
    split = add_split(features.filter(F.col(TARGET).isNotNull()), test_size, **arranged)
    split = split.withColumn("_train_size", F.floor(F.col("series_size") * F.lit(1.0 - test_size)))
    blocks = add_segments(split, max_folds, size="_train_size").withColumn(
        "block", F.when(F.col("is_train"), F.col("block"))
    )
    rows = blocks.select(
        STATION,
        DATE,
        F.col(TARGET).alias("label"),
        "is_train",
        "block",
        "fold_count",
        *[F.col(c).cast("double").alias(c) for c in chosen],
    )
    return rows, chosen


def prepare(features: DataFrame, **options) -> Prepared:
    """Numeric features, columns without any training value dropped, medians filled in.

    The imputer sees training rows only. The split rows are written once to the
    shared folder, since every fit and fold starts from them: a lost executor
    costs a scan, not the feature chain. The assembled rows are cached on top.
    """
    rows, chosen = training_rows(features, **options)
    rows = durable(rows, "training")
    sides = rows.agg(F.count_if("is_train").alias("a"), F.count_if(~F.col("is_train")).alias("b")).first()
    if not sides["a"] or not sides["b"]:
        raise ValueError("train or test side is empty")
    imputer = MedianImputer(inputCols=chosen).fit(rows.filter("is_train"))
    known = imputer.getOrDefault(imputer.inputCols)
    if not known:
        raise ValueError("no feature has a value in the training rows")
    assembler = VectorAssembler(inputCols=known, outputCol="features")
    stages = PipelineModel(stages=[imputer, assembler])
    ready = stages.transform(rows).select(
        STATION, DATE, "label", "is_train", "block", "fold_count", "features"
    )
    return Prepared(ready.persist(StorageLevel.MEMORY_AND_DISK), known, stages)


def _scored(rows: DataFrame, fitted, name: str) -> DataFrame:
    return fitted.transform(rows).select(
        F.lit(name).alias("model"),
        F.when(F.col("is_train"), "train").otherwise("test").alias("side"),
        STATION,
        DATE,
        "label",
        "block",
        "prediction",
    )


def station_index(df: DataFrame, name: str = "station_index") -> DataFrame:
    """``df`` with the place of its station among all station names, as a model feature.

    The index is a table joined to the rows; only its size reaches the driver. The rows
    are read twice, so they are written first.
    """
    df = durable(df, "indexed")
    names = df.select(STATION).filter(F.col(STATION).isNotNull()).distinct()
    index = arrange(names, (), (STATION,), ()).number(name).result()
    return attach(df, index.withColumn(name, F.col(name).cast("int")), [STATION])


def _fold_error(prepared: Prepared, make: Callable[[], Estimator], k: int) -> float | None:
    fitted = make().fit(prepared.train.filter(F.col("block") < k))
    tested = fitted.transform(prepared.train.filter(F.col("block") == k))
    return tested.agg(metrics.mae(F.col("label"), F.col("prediction"))).first()[0]


def cross_validate(
    prepared: Prepared, make: Callable[[], Estimator], name: str, parallel: int = PARALLEL
) -> DataFrame | None:
    """Expanding folds: train on the blocks before k, measure MAE on block k.

    None when no series is long enough for two folds. The folds (five at most) do not
    depend on each other; their distributed fits are submitted ``parallel`` at a time.
    Least squares gets all folds from one scan.
    """
    if isinstance(make(), LeastSquares):
        return _exact(prepared, make(), name)[1]
    most = prepared.train.agg(F.max("fold_count")).first()[0]
    if not most:
        return None
    spark = prepared.rows.sparkSession
    one = inheritable_thread_target(spark)(lambda k: _fold_error(prepared, make, k))
    with ThreadPoolExecutor(parallel) as pool:
        errors = list(pool.map(one, range(1, most + 1)))
    rows = [(name, k, e) for k, e in enumerate(errors, 1) if e is not None]
    return spark.createDataFrame(rows, "model string, fold int, fold_mae double")


def _exact(prepared: Prepared, estimator: LeastSquares, name: str) -> tuple[Model, DataFrame | None]:
    """The fit of all training rows and the errors of all folds, from the same moments."""
    fitted, folds = estimator.fit_blocks(prepared.train)
    if not folds:
        return fitted, None
    errors = estimator.fold_errors(prepared.train, folds)
    return fitted, errors.select(F.lit(name).alias("model"), F.col("fold").cast("int").alias("fold"), "fold_mae")


def train_model(
    prepared: Prepared, make: Callable[[], Estimator], name: str, folds: bool = True
) -> tuple[PipelineModel, DataFrame, DataFrame | None]:
    """Fit one model: the full pipeline, its predictions on both sides, its fold errors."""
    ensure_checkpoint_dir(prepared.rows.sparkSession)
    estimator, errors = make(), None
    if isinstance(estimator, LeastSquares):
        fitted, errors = _exact(prepared, estimator, name)
    else:
        fitted = estimator.fit(prepared.train)
        errors = cross_validate(prepared, make, name) if folds else None
    model = PipelineModel(stages=[*prepared.stages.stages, fitted])
    return model, _scored(prepared.rows, fitted, name), errors if folds else None


def model_status(predictions: DataFrame, table: DataFrame) -> dict[str, str]:
    """Why a model is rejected, ``narrow_range`` as a warning, or ``ok``."""
    status: dict[str, str] = {}
    worst = {"exact_copy": 3, "constant": 2, "narrow_range": 1, "ok": 0}
    # two rows per model
    for row in metrics.sanity_check(predictions).collect():
        name = row["model"]
        if worst[row["status"]] >= worst[status.get(name, "ok")]:
            status[name] = row["status"]
    test = table.filter(F.col("side") == "test")
    flagged = test.filter(metrics.too_good(F.col("mae"), F.col("r2"))).select("model").collect()
    for row in flagged:
        if status[row["model"]] in ("ok", "narrow_range"):
            status[row["model"]] = "too_good"
    return status


def train_all(
    features: DataFrame,
    models: dict[str, Callable[[], Estimator]] | None = None,
    folds: bool = True,
    **options,
) -> Trained:
    """Train every configured model; one that fails is reported and left out."""
    models = models or model_configurations()
    prepared = prepare(features, **options)
    fitted, scored, fold_tables, status = {}, [], [], {}
    for name, make in models.items():
        try:
            model, predictions, errors = train_model(prepared, make, name, folds)
        except Exception as problem:  # one model must not take the run with it
            log.exception("training %s failed", name)
            said = str(problem).strip().splitlines()
            status[name] = f"failed: {type(problem).__name__}: {said[0] if said else ''}"
            continue
        fitted[name] = model
        scored.append(predictions)
        if errors is not None:
            fold_tables.append(errors)
    if not scored:
        return Trained(prepared, {}, None, None, None, status)
    # written once: checks, metrics, bias and charts all read them
    predictions = durable(reduce(DataFrame.unionByName, scored), "predictions")
    table = durable(metrics.evaluate(predictions), "metrics")
    return Trained(
        prepared,
        fitted,
        predictions,
        table,
        reduce(DataFrame.unionByName, fold_tables) if fold_tables else None,
        status | model_status(predictions, table),
    )


def train_stations(features: DataFrame, name: str = "LinearRegression", **options) -> StationModels:
    """A least-squares model of its own for every station, in one run over all of them.

    The rows are split, imputed and cut into folds as for one model of all stations (each
    station at its own share). All models, those of the folds too, come from one scan that
    adds up moments by station and fold block; predictions, metrics and fold errors are
    tables by station. Stations whose training side has no complete row have no model.
    """
    prepared = prepare(features, **options)
    rows = prepared.rows.dropna(subset=[STATION])
    train = rows.filter("is_train")
    by_block = durable(group_moments(train, [STATION, "block", "fold_count"]), "moments")
    models = durable(solve_groups(add_up(by_block, [STATION]), [STATION]), "models")
    predictions = score_groups(rows, models, [STATION]).select(
        F.lit(name).alias("model"), F.when(F.col("is_train"), "train").otherwise("test").alias("side"), STATION, DATE, "label", "block", "prediction"
    )
    # fold k of a station learns from its blocks before k: the moments of block b serve folds b + 1 and on
    serves = F.explode(F.sequence(F.col("block") + 1, F.col("fold_count"))).alias("fold")
    learned = by_block.filter(F.col("block") < F.col("fold_count")).select(STATION, serves, "n", "means", "co")
    fold_models = durable(solve_groups(add_up(learned, [STATION, "fold"]), [STATION, "fold"]), "fold_models")
    tested = train.filter("block >= 1").select(STATION, F.col("block").alias("fold"), "label", "features")
    errors = score_groups(tested, fold_models, [STATION, "fold"]).groupBy(STATION, "fold")
    return StationModels(
        prepared,
        models,
        predictions,
        metrics.evaluate(predictions, by=("model", "side", STATION)),
        errors.agg(metrics.mae(F.col("label"), F.col("prediction")).alias("fold_mae")),
    )


def choose_and_save(spark: SparkSession, trained: Trained, path: str | None = None, rejected: bool = False) -> dict | None:
    """Metadata of the best accepted model, saved with the model when a path is given.

    With ``rejected`` a run in which every model failed a check (one whose only input is
    constant on the test side, say) goes on with the best of these, and a warning says why
    they failed.
    """
    table = trained.accepted()
    best = selection.select_best(table).first() if table is not None else None
    if best is None and rejected and table is not None:
        best = selection.select_best(trained.comparison).first()
        if best is not None:
            log.warning("no model passed its checks: %s; %s is taken all the same", trained.status, best["model"])
    if best is None:
        return None
    test = trained.predictions.filter((F.col("model") == best["model"]) & (F.col("side") == "test"))
    bias = overall_bias(test).first()
    metadata = {
        "model_name": best["model"],
        **{f"test_{m}": best[f"test_{m}"] for m in metrics.METRICS},
        "overall_bias": bias["overall_bias"],
        "residual_std": bias["residual_std"],
        "n_features": len(trained.prepared.columns),
        "feature_columns": trained.prepared.columns,
    }
    if path:
        save_artifacts(spark, path, trained.models[best["model"]], metadata)
    return metadata


def verdicts(table: DataFrame, bias: DataFrame) -> DataFrame:
    """R2 and bias in words, per model."""
    return table.join(bias.select("model", "overall_bias"), "model").select(
        "model",
        numbers.r2_verdict(F.col("test_r2")).alias("r2_verdict"),
        numbers.bias_verdict(F.col("overall_bias")).alias("bias_verdict"),
        numbers.fit_gap_verdict(F.col("train_mae"), F.col("test_mae")).alias("fit_verdict"),
    )
