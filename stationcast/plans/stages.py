"""Spark ML stages: exact median imputation and the panel features."""

from __future__ import annotations

from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.cleaning import clean_readings
from ..operators.features import feature_columns, features_from_raw, richest_station
from ..operators.quantiles import medians


class _MedianParams(Params):
    inputCols = Param(Params._dummy(), "inputCols", "columns to fill", TypeConverters.toListString)


class MedianImputer(Estimator, _MedianParams, DefaultParamsReadable, DefaultParamsWritable):
    """Fill nulls with the exact median of the training rows.

    The built-in imputer only approximates the median.
    """

    @keyword_only
    def __init__(self, *, inputCols=None):
        super().__init__()
        self._set(**self._input_kwargs)

    def _fit(self, dataset: DataFrame) -> MedianImputerModel:
        columns = self.getOrDefault(self.inputCols)
        # one row per column
        found = {r["column"]: r["median"] for r in medians(dataset, columns).collect()}
        known = [c for c in columns if c in found]
        return MedianImputerModel(inputCols=known, values=[found[c] for c in known])


class MedianImputerModel(Model, _MedianParams, DefaultParamsReadable, DefaultParamsWritable):
    values = Param(Params._dummy(), "values", "median per column", TypeConverters.toListFloat)

    @keyword_only
    def __init__(self, *, inputCols=None, values=None):
        super().__init__()
        self._set(**self._input_kwargs)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        pairs = zip(self.getOrDefault(self.inputCols), self.getOrDefault(self.values))
        return dataset.withColumns(
            {c: F.coalesce(F.col(c).cast("double"), F.lit(v)) for c, v in pairs}
        )


class _PanelParams(Params):
    station = Param(
        Params._dummy(), "station", "station to keep; empty for all", TypeConverters.toString
    )
    bestStation = Param(
        Params._dummy(), "bestStation", "keep the station with most values", TypeConverters.toBoolean
    )
    columns = Param(Params._dummy(), "columns", "feature columns", TypeConverters.toListString)


class PanelFeatures(Estimator, _PanelParams, DefaultParamsReadable, DefaultParamsWritable):
    """Raw readings to feature rows: cleaning and the whole feature chain.

    Fitting settles the station (a given one, the one with most values, or all)
    and the list of feature columns.
    """

    @keyword_only
    def __init__(self, *, station="", bestStation=False):
        super().__init__()
        self._setDefault(station="", bestStation=False)
        self._set(**self._input_kwargs)

    def _fit(self, dataset: DataFrame) -> PanelFeaturesModel:
        station = self.getOrDefault(self.station)
        if not station and self.getOrDefault(self.bestStation):
            best = richest_station(clean_readings(dataset)).first()
            station = best["station"] if best else ""
        # names and types are known from the plan of an empty input
        columns = feature_columns(features_from_raw(dataset.limit(0)))
        return PanelFeaturesModel(station=station, columns=columns)


class PanelFeaturesModel(Model, _PanelParams, DefaultParamsReadable, DefaultParamsWritable):
    @keyword_only
    def __init__(self, *, station="", columns=None):
        super().__init__()
        self._setDefault(station="")
        self._set(**self._input_kwargs)

    def get_feature_columns(self) -> list[str]:
        return list(self.getOrDefault(self.columns))

    def _transform(self, dataset: DataFrame) -> DataFrame:
        station = self.getOrDefault(self.station)
        rows = features_from_raw(dataset, station or None)
        saved = self.get_feature_columns() if self.isDefined(self.columns) else feature_columns(rows)
        missing = [c for c in saved if c not in rows.columns]
        if missing:
            raise ValueError(f"feature columns missing from the input: {missing}")
        # a number that the input has in addition is no feature of this model
        return rows.drop(*[c for c in feature_columns(rows) if c not in saved])
