"""Feature rows of a stream of clean readings: lags and rolling statistics across micro-batches.

The state is a table with the last rows of each station, as many as the longest lag or
window needs. A micro-batch is put after its stations' rows of the state and goes through
the same operators as a whole table, skewed stations included. Results and state are
written under the number of the micro-batch: when one is repeated after a failure it
starts from the state before it and replaces what it had written.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..functions.calendar import with_calendar
from ..operators.cleaning import drop_incomplete
from ..operators.features import feature_series, latest_rows
from ..operators.ordered import arrange
from ..schema import DATE, FILLED_POLLUTANTS, LAGS, ROLLING_WINDOWS, STATION
from ..session import durable

#: Rows of a station that later rows look back at.
DEPTH = max(*LAGS, *ROLLING_WINDOWS)
NEW = "_new"


def _numbers(spark: SparkSession, path: str) -> list[int]:
    """The complete micro-batches below ``path``."""
    root = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not files.exists(root):
        return []
    found = [s.getPath() for s in files.listStatus(root) if s.getPath().getName().startswith("batch=")]
    done = [p for p in found if files.exists(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]
    return sorted(int(p.getName().split("=")[1]) for p in done)


def _forget(spark: SparkSession, path: str, before: int) -> None:
    """Delete states that no repeated micro-batch can need."""
    for number in _numbers(spark, path):
        if number < before:
            old = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/batch={number}")
            old.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(old, True)


def step(batch: DataFrame, tails: DataFrame | None, complete: bool = True, **arranged) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Feature rows of ``batch``, the state after it, and the rows that came too late.

    A row is late when its station already has one of that day or a later one in the
    state. Rows without a station have no history and no state.
    """
    marked = batch.withColumn(NEW, F.lit(True))
    if tails is None:
        late, rows = marked.limit(0), marked
    else:
        last = tails.groupBy(STATION).agg(F.max(DATE).alias("_last"))
        dated = durable(marked.join(last, STATION, "left"), "dated")
        too_late = F.coalesce(F.col(DATE) <= F.col("_last"), F.lit(False))
        late, rows = dated.filter(too_late).drop("_last"), dated.filter(~too_late).drop("_last")
        rows = rows.unionByName(tails.withColumn(NEW, F.lit(False)))
    filled = durable(arrange(rows, **arranged).fill(FILLED_POLLUTANTS).result(), "filled")
    featured = with_calendar(feature_series(arrange(filled, **arranged)).result())
    out = featured.filter(NEW).drop(NEW)
    state = latest_rows(filled.filter(F.col(STATION).isNotNull()).drop(NEW), DEPTH)
    return (drop_incomplete(out) if complete else out), state, late.drop(NEW)


def stream_features(
    spark: SparkSession, landing: str, schema: T.StructType, target: str, state: str, checkpoint: str, available_now: bool = True,
    files_per_batch: int | None = None, complete: bool = True, **arranged,
) -> StreamingQuery:
    """Parquet files of clean readings in ``landing`` to feature rows in ``target``.

    ``target`` has a folder for each micro-batch, late rows are below ``{state}/late``.
    Files must arrive in the order of their days; rows of one file may be in any order.
    """

    def write(batch: DataFrame, number: int) -> None:
        known = [n for n in _numbers(spark, f"{state}/tails") if n < number]
        tails = spark.read.schema(schema).parquet(f"{state}/tails/batch={known[-1]}") if known else None
        out, after, late = step(batch, tails, complete, **arranged)
        out.write.mode("overwrite").parquet(f"{target}/batch={number}")
        late.write.mode("overwrite").parquet(f"{state}/late/batch={number}")
        after.write.mode("overwrite").parquet(f"{state}/tails/batch={number}")
        _forget(spark, f"{state}/tails", number - 1)

    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    writer = reader.parquet(landing).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def read_streamed(spark: SparkSession, target: str) -> DataFrame:
    """All feature rows that a stream has written."""
    return spark.read.parquet(target).drop("batch")
