"""Least squares from one scan: one model, all models of expanding folds, or one model per group."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.functions import vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasFeaturesCol, HasLabelCol, HasPredictionCol
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import moments as m
from ..operators.metrics import mae
from ..operators.ordered import MAX_PIECES
from ..schema import STATION


def as_array(df: DataFrame, features: str) -> Column:
    kind = df.schema[features].dataType
    return F.col(features) if isinstance(kind, T.ArrayType) else vector_to_array(F.col(features))


def rule(values: Column, fit: m.Fit) -> Column:
    """The linear rule as an expression over the array ``values``."""
    total = F.lit(fit.intercept)
    for i, weight in enumerate(fit.coefficients):
        if weight:
            total = total + F.get(values, F.lit(i)) * F.lit(float(weight))
    return total


class LeastSquares(Estimator, HasFeaturesCol, HasLabelCol, HasPredictionCol, DefaultParamsReadable, DefaultParamsWritable):
    """Ordinary least squares with an intercept: exact, also for dependent or constant columns.

    One scan adds up the moments; the solution is found from the small matrix without
    iterations. Of several best solutions the one with the smallest coefficients is taken.
    """

    @keyword_only
    def __init__(self, *, featuresCol="features", labelCol="label", predictionCol="prediction"):
        super().__init__()
        self._set(**self._input_kwargs)

    def setLabelCol(self, value: str) -> LeastSquares:
        return self._set(labelCol=value)

    def _values(self, dataset: DataFrame) -> Column:
        return F.concat(as_array(dataset, self.getFeaturesCol()), F.array(F.col(self.getLabelCol()).cast("double")))

    def model(self, fit: m.Fit) -> LeastSquaresModel:
        names = {p: self.getOrDefault(p) for p in ("featuresCol", "predictionCol")}
        return LeastSquaresModel(weights=[float(w) for w in fit.coefficients], intercept=fit.intercept, rank=fit.rank, **names)

    def _fit(self, dataset: DataFrame) -> LeastSquaresModel:
        rows = m.moments(dataset, self._values(dataset)).collect()  # one row
        if not rows:
            raise ValueError("no rows to fit")
        return self.model(m.least_squares(rows[0]["means"], rows[0]["co"]))

    def fit_blocks(self, dataset: DataFrame, block: str = "block") -> tuple[LeastSquaresModel, dict[int, m.Fit]]:
        """The model of all rows, and for each fold k the fit to the blocks before k: one scan for all.

        Rows without a block belong to no fold. Only a matrix for each block (six at most)
        reaches the driver.
        """
        rows = sorted(m.moments(dataset, self._values(dataset), [block]).collect(), key=lambda r: (r[block] is None, r[block] or 0))
        if not rows:
            raise ValueError("no rows to fit")
        folds = {}
        blocks = [r for r in rows if r[block] is not None]
        for i in range(1, len(blocks)):
            folds[blocks[i][block]] = m.least_squares(*m.merged(blocks[:i])[1:])
        return self.model(m.least_squares(*m.merged(rows)[1:])), folds

    def fold_errors(self, dataset: DataFrame, folds: dict[int, m.Fit], block: str = "block") -> DataFrame:
        """``fold`` and ``fold_mae``: each block scored by the fit to the blocks before it, in one scan."""
        values = as_array(dataset, self.getFeaturesCol())
        scored = F.lit(None).cast("double")
        for k, fit in folds.items():
            scored = F.when(F.col(block) == k, rule(values, fit)).otherwise(scored)
        tested = dataset.filter(F.col(block).isin(list(folds)))
        return tested.groupBy(F.col(block).alias("fold")).agg(mae(F.col(self.getLabelCol()), scored).alias("fold_mae"))


class LeastSquaresModel(Model, HasFeaturesCol, HasPredictionCol, DefaultParamsReadable, DefaultParamsWritable):
    weights = Param(Params._dummy(), "weights", "coefficient per feature", TypeConverters.toListFloat)
    intercept_ = Param(Params._dummy(), "intercept_", "intercept", TypeConverters.toFloat)
    rank_ = Param(Params._dummy(), "rank_", "independent columns", TypeConverters.toInt)

    def __init__(self, weights=None, intercept=0.0, rank=0, featuresCol="features", predictionCol="prediction"):
        super().__init__()
        if weights is not None:
            self._set(weights=weights, intercept_=intercept, rank_=rank, featuresCol=featuresCol, predictionCol=predictionCol)

    @property
    def coefficients(self) -> list[float]:
        return self.getOrDefault(self.weights)

    @property
    def intercept(self) -> float:
        return self.getOrDefault(self.intercept_)

    @property
    def rank(self) -> int:
        return self.getOrDefault(self.rank_)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        fit = m.Fit(np.array(self.coefficients), self.intercept, self.rank)
        return dataset.withColumn(self.getPredictionCol(), rule(as_array(dataset, self.getFeaturesCol()), fit))


def group_models(rows: DataFrame, by: Sequence[str] = (STATION,), features: str = "features", label: str = "label") -> DataFrame:
    """One least-squares model for every group: ``by``, ``n``, ``weights``, ``intercept``, ``rank``.

    One shuffle of moments, whatever the number of groups and however large one is; the
    small systems are solved in Arrow batches. A group with constant features gets its mean;
    rows with a null key get no model.
    """
    return solve_groups(group_moments(rows, by, features, label), by)


def group_moments(rows: DataFrame, by: Sequence[str] = (STATION,), features: str = "features", label: str = "label") -> DataFrame:
    """Moments of features and label by group; rows without a station have none."""
    values = F.concat(as_array(rows, features), F.array(F.col(label).cast("double")))
    return m.moments(rows.dropna(subset=by[:1]), values, list(by))


def solve_groups(found: DataFrame, by: Sequence[str] = (STATION,)) -> DataFrame:
    """The model of each row of moments: ``by``, ``n``, ``weights``, ``intercept``, ``rank``."""
    by = list(by)

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fits = [m.least_squares(mean, co) for mean, co in zip(batch.column("means").to_pylist(), batch.column("co").to_pylist(), strict=True)]
            new = [
                pa.array([f.coefficients.tolist() for f in fits], pa.list_(pa.float64())),
                pa.array([f.intercept for f in fits], pa.float64()),
                pa.array([f.rank for f in fits], pa.int32()),
            ]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(by) + 1], *new], [*by, "n", "weights", "intercept", "rank"])

    schema = T.StructType([*(found.schema[c] for c in by), T.StructField("n", T.LongType())])
    schema.add("weights", T.ArrayType(T.DoubleType())).add("intercept", T.DoubleType()).add("rank", T.IntegerType())
    return found.select(*by, "n", "means", "co").mapInArrow(solve, schema)


def score_groups(rows: DataFrame, models: DataFrame, by: Sequence[str] = (STATION,), features: str = "features") -> DataFrame:
    """``rows`` with the ``prediction`` of their group's model; null for groups without one.

    ``models`` (written) is counted; a few thousand models are broadcast, so that the rows of
    a large group stay where they are.
    """
    by = list(by)
    known = models.select(*by, "weights", "intercept")
    if known.limit(MAX_PIECES + 1).count() <= MAX_PIECES:
        known = F.broadcast(known)
    joined = rows.join(known, by, "left")
    products = F.zip_with(as_array(rows, features), F.col("weights"), lambda x, w: x * w)
    total = F.aggregate(products, F.col("intercept"), lambda a, v: a + v)
    return joined.withColumn("prediction", total).drop("weights", "intercept")
