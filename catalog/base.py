"""Derived tables the registered queries start from."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stationcast.operators import features, fill, metrics, split
from stationcast.operators.ordered import MAX_ROWS, measure
from stationcast.plans import scoring, training
from stationcast.schema import DATE, FILLED_POLLUTANTS, STATION
from stationcast.session import scratch_path
from stationcast.sources import derived, feed

# the derived panel is unique per station and date, so ties cannot occur
UNIQUE = {"tiebreak": ()}
MODELS = ("Persistence1", "Persistence7", "WeekMean")
STD = 8.5


def panel(spark: SparkSession, sf: str, grain: str = "nation") -> DataFrame:
    return derived.panel(spark, sf, grain)


def raw(spark: SparkSession, sf: str, grain: str = "nation") -> DataFrame:
    return derived.raw_readings(spark, sf, grain)


#: A limit that every series of the test panel exceeds, for the plan of large series.
SEGMENT_ROWS = 200


def arranged(days: DataFrame, max_rows: int = MAX_ROWS) -> dict:
    """Options for all steps after ``days``: measured once, no ties."""
    return {**UNIQUE, "sizes": measure(days, max_rows=max_rows)}


def filled(spark: SparkSession, sf: str, max_rows: int = MAX_ROWS) -> DataFrame:
    return fill.forward_fill(panel(spark, sf), FILLED_POLLUTANTS, **UNIQUE, max_rows=max_rows)


def _target(days: DataFrame, known: dict) -> DataFrame:
    return fill.impute_target(fill.forward_fill(days, FILLED_POLLUTANTS, **known), **known)


def target(spark: SparkSession, sf: str, max_rows: int = MAX_ROWS) -> DataFrame:
    days = panel(spark, sf)
    return _target(days, arranged(days, max_rows))


def feature_rows(
    spark: SparkSession, sf: str, complete: bool = True, grain: str = "nation", max_rows: int = MAX_ROWS
) -> DataFrame:
    days = panel(spark, sf, grain)
    known = arranged(days, max_rows)
    return features.build_features(
        fill.forward_fill(days, FILLED_POLLUTANTS, **known), complete=complete, **known
    )


def history(spark: SparkSession, sf: str) -> DataFrame:
    return feature_rows(spark, sf, complete=False)


def split_rows(spark: SparkSession, sf: str, max_rows: int = MAX_ROWS) -> DataFrame:
    days = panel(spark, sf)
    known = arranged(days, max_rows)
    return split.add_split(_target(days, known), **known)


def predictions(spark: SparkSession, sf: str, grain: str = "nation") -> DataFrame:
    """Three naive models over the split rows, with side and fold block."""
    days = panel(spark, sf, grain)
    known = arranged(days)
    rows = split.add_split(_target(days, known), **known).withColumn(
        "train_size", F.floor(F.col("series_size") * F.lit(1.0 - 0.2))
    )
    blocks = split.add_segments(rows, size="train_size").withColumn(
        "block", F.when(F.col("is_train"), F.col("block"))
    )
    naive = scoring.naive_forecasts(blocks, **known)
    return naive.filter(F.col("prediction").isNotNull()).select(
        "model",
        F.when(F.col("is_train"), "train").otherwise("test").alias("side"),
        STATION,
        DATE,
        "label",
        "block",
        "prediction",
    )


def tested(spark: SparkSession, sf: str) -> DataFrame:
    return predictions(spark, sf).filter(F.col("side") == "test")


def comparison(spark: SparkSession, sf: str) -> DataFrame:
    rows = predictions(spark, sf)
    table = metrics.comparison(metrics.evaluate(rows), metrics.cv_summary(metrics.fold_errors(rows)))
    return training.ranked(table, MODELS)


def linear(df: DataFrame) -> DataFrame:
    """The stand-in model: a fixed linear rule over the model inputs."""
    weights = {"pm10": 0.5, "so2": 2.0, "co": 1.0, "o3": 0.25, "no2": 0.1, "max_idx": 0.01}
    value = sum((F.coalesce(F.col(c), F.lit(0.0)) * w for c, w in weights.items()), F.lit(0.0))
    return df.withColumn("prediction", value + F.col("month") * 0.3 + F.col("is_weekend") * 1.5)


def landed_messages(spark: SparkSession, sf: str, files: int = 2) -> str:
    """Live messages as JSON files, split by time."""
    path = scratch_path(spark, "landing")
    messages = derived.live_messages(spark, sf)
    messages.repartitionByRange(files, "ts").select("value").write.text(path)
    return path


def live(spark: SparkSession, sf: str) -> DataFrame:
    return feed.read_live(spark, landed_messages(spark, sf))


def landed_in_order(df: DataFrame, column: str, parts: int, kind: str = "parquet", again: int = 0) -> str:
    """``df`` as files that arrive one after the other, by ``column``; the first ``again`` arrive a second time."""
    path = scratch_path(df.sparkSession, "arriving")
    dated = df.select("*", F.col(column).cast("date").alias("_day"))
    first, last = dated.agg(F.min("_day"), F.max("_day")).first()
    width = ((last - first).days + parts) // parts
    part = F.floor(F.date_diff("_day", F.lit(first)) / width)
    for i in [*range(parts), *range(again)]:
        own = dated.filter(part == i).drop("_day").coalesce(1)
        (own.select("value").write.mode("append").text(path) if kind == "text" else own.write.mode("append").parquet(path))
    return path


def daily_feed(spark: SparkSession, sf: str) -> str:
    """Live messages in four files by time, and the first of them once more."""
    return landed_in_order(derived.live_messages(spark, sf), "ts", 4, "text", again=1)
