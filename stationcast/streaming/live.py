"""Live readings as streaming jobs: landing and scoring.

Both jobs keep their progress in a checkpoint folder and write Parquet, so a
restart neither loses nor repeats rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import levels
from ..functions.calendar import with_serving_calendar
from ..sources.feed import stream_live, stream_rejects


def start(df: DataFrame, target: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    writer = df.writeStream.format("parquet").outputMode("append")
    writer = writer.option("path", target).option("checkpointLocation", checkpoint)
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start()


def ingest_rejects(
    spark: SparkSession, landing: str, target: str, checkpoint: str, available_now: bool = True
) -> StreamingQuery:
    """Lines in ``landing`` that are no messages to ``target``; the other jobs leave them out."""
    return start(stream_rejects(spark, landing), target, checkpoint, available_now)


def ingest_live(
    spark: SparkSession,
    landing: str,
    target: str,
    checkpoint: str,
    available_now: bool = True,
    files_per_batch: int | None = None,
) -> StreamingQuery:
    """JSON files in ``landing`` to typed rows in ``target``."""
    return start(stream_live(spark, landing, files_per_batch), target, checkpoint, available_now)


def scored_readings(readings: DataFrame, predict: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Live rows with calendar features, prediction, category, risk and advice.

    The calendar comes from the arrival date, so a replay gives the same rows.
    """
    scored = predict(with_serving_calendar(readings, "arrival_date"))
    value = F.col("prediction")
    level = levels.risk_level(value)
    return scored.select(
        "reading_id",
        "arrival_date",
        value.alias("value"),
        levels.category(value).alias("category"),
        levels.category_badge(value).alias("badge"),
        level.alias("level"),
        levels.recommendation(level).alias("recommendation"),
    )


def score_live(
    spark: SparkSession,
    landing: str,
    predict: Callable[[DataFrame], DataFrame],
    target: str,
    checkpoint: str,
    available_now: bool = True,
    files_per_batch: int | None = None,
) -> StreamingQuery:
    readings = stream_live(spark, landing, files_per_batch)
    return start(scored_readings(readings, predict), target, checkpoint, available_now)
