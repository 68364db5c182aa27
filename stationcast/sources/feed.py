"""Live feed messages: one JSON object per reading."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schema import LIVE_FIELDS, LIVE_SCHEMA


BROKEN = "_broken"
_SCHEMA = T.StructType([*LIVE_SCHEMA.fields, T.StructField(BROKEN, T.StringType())])


def live_readings(messages: DataFrame, null_as_zero: bool = True) -> DataFrame:
    """Engine columns of parsed messages; absent values count as 0, and null values too unless told otherwise.

    With ``null_as_zero=False`` the messages need the column ``_line`` of their text,
    which tells an explicit null from an absent field. The feed has no index maximum, so
    ``max_idx`` is 0. Works on batch and streaming input alike.
    """
    current = F.col("current")

    def value(field: str) -> Column:
        if null_as_zero:
            return F.coalesce(current[field], F.lit(0.0))
        given = F.array_contains(F.json_object_keys(F.get_json_object("_line", "$.current")), field)
        return F.when(given, current[field]).otherwise(F.lit(0.0))

    return messages.select(
        "reading_id",
        F.col("arrival_date"),
        *[value(field).alias(name) for name, field in LIVE_FIELDS.items()],
        F.lit(0.0).alias("max_idx"),
    )


def parsed(lines: DataFrame) -> DataFrame:
    """Lines of text (``value``) as message fields, ``_line`` and ``_broken``.

    ``_broken`` holds the text of a line that is no message: broken JSON, a field of
    another type, or no reading id.
    """
    full = F.from_json("value", _SCHEMA, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": BROKEN})
    rows = lines.select(F.col("value").alias("_line"), full.alias("m")).select("_line", "m.*")
    bad = F.coalesce(F.col(BROKEN), F.when(F.col("reading_id").isNull(), F.col("_line")))
    return rows.withColumn(BROKEN, bad)


def good(messages: DataFrame) -> DataFrame:
    return messages.filter(F.col(BROKEN).isNull())


def rejects(messages: DataFrame) -> DataFrame:
    """The text of lines that are no messages (column ``line``)."""
    return messages.filter(F.col(BROKEN).isNotNull()).select(F.col(BROKEN).alias("line"))


def read_live(spark: SparkSession, path: str, null_as_zero: bool = True) -> DataFrame:
    """The readings; lines that are no messages are left to :func:`read_rejects`."""
    return live_readings(good(parsed(spark.read.text(path))), null_as_zero)


def read_rejects(spark: SparkSession, path: str) -> DataFrame:
    return rejects(parsed(spark.read.text(path)))


def _stream(spark: SparkSession, path: str, files_per_batch: int | None) -> DataFrame:
    reader = spark.readStream
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return parsed(reader.text(path))


def stream_live(
    spark: SparkSession, path: str, files_per_batch: int | None = None, null_as_zero: bool = True
) -> DataFrame:
    return live_readings(good(_stream(spark, path, files_per_batch)), null_as_zero)


def stream_rejects(spark: SparkSession, path: str, files_per_batch: int | None = None) -> DataFrame:
    return rejects(_stream(spark, path, files_per_batch))
