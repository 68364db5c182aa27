"""Daily averages of the live feed by event time."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..schema import CONTEXT_POLLUTANTS
from ..sources.feed import stream_live
from .live import start

#: How much later than the newest reading one may still arrive.
DELAY = "2 days"


def daily_averages(
    readings: DataFrame, by: Sequence[str] = (), columns: Sequence[str] = CONTEXT_POLLUTANTS, day: str = "arrival_date",
    key: str = "reading_id", delay: str = DELAY,
) -> DataFrame:
    """``by``, ``day``, ``n`` and the mean of each column, for each day; batch and streaming input alike.

    A reading counts once, however often it was delivered. On a stream a day is given out
    when the newest reading is ``delay`` past its end. A reading that is ``delay`` older
    than the newest one when it arrives is left out, and so state is kept for the days (and
    reading ids) of that span only. A date stands for the last second of its day.
    """
    dated = isinstance(readings.schema[day].dataType, T.DateType)
    end = F.to_timestamp(F.date_add(day, 1)) - F.expr("interval 1 second") if dated else F.col(day)
    at = readings.withColumn("_at", end)
    if readings.isStreaming:
        once = at.withWatermark("_at", delay).dropDuplicatesWithinWatermark([key])
    else:
        once = at.dropDuplicates([key])
    days = once.groupBy(*by, F.window("_at", "1 day").alias("_day"))
    means = days.agg(F.count(F.lit(1)).alias("n"), *[F.avg(c).alias(c) for c in columns])
    return means.select(*by, F.to_date("_day.start").alias(day), "n", *columns)


def ingest_daily(
    spark: SparkSession, landing: str, target: str, checkpoint: str, available_now: bool = True, files_per_batch: int | None = None, delay: str = DELAY
) -> StreamingQuery:
    """JSON files in ``landing`` to one row for each finished day in ``target``."""
    means = daily_averages(stream_live(spark, landing, files_per_batch), delay=delay)
    return start(means, target, checkpoint, available_now)
