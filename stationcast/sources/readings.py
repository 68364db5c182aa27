"""Reading and landing raw readings."""

from __future__ import annotations

import csv
import io
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schema import DATE, RAW_SCHEMA, STATION


#: Files whose header line is read at a time.
READERS = 16


def _first_line(spark: SparkSession, file: str) -> tuple[str, str]:
    """Path and first line of a file (a URI), plain or compressed; nothing beyond one buffer is read."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(file))
    stream = path.getFileSystem(conf).open(path)
    try:
        codec = jvm.org.apache.hadoop.io.compress.CompressionCodecFactory(conf).getCodec(path)
        plain = stream if codec is None else codec.createInputStream(stream)
        return path.toString(), jvm.java.io.BufferedReader(jvm.java.io.InputStreamReader(plain, "UTF-8")).readLine() or ""
    finally:
        stream.close()


def _headers(spark: SparkSession, path: str) -> dict[tuple[str, ...], list[str]]:
    """The files below ``path`` by their header line.

    One buffer of each file is read, however long the file, by some threads of the driver:
    its length grows with the number of files alone, as does the list of files that
    Spark itself keeps. Empty files have no header and are left out.
    """
    files = sorted(spark.read.text(path).inputFiles())
    with ThreadPoolExecutor(READERS) as pool:
        lines = list(pool.map(inheritable_thread_target(spark)(lambda file: _first_line(spark, file)), files))
    found: dict[tuple[str, ...], list[str]] = {}
    for file, line in lines:
        if line:
            found.setdefault(tuple(next(csv.reader(io.StringIO(line)))), []).append(file)
    return found


def read_readings(
    spark: SparkSession, path: str, schema: T.StructType | None = None
) -> DataFrame:
    """CSV with a header, every column as text.

    The columns of each file come from its own header line, so files may order them
    differently and have columns of their own; a column that a file lacks is null. Types
    are never inferred. With ``schema`` a file whose header differs is an error. Empty
    cells are null; other missing-value words are a cleaning matter.
    """
    headers = _headers(spark, path)
    if schema is not None:
        other = [f for names, files in headers.items() if list(names) != schema.names for f in files]
        if other:
            raise ValueError(f"files with another header than {schema.names}: {other[:5]}")
        headers = {tuple(schema.names): [path]}
    tables = []
    for names, files in headers.items():
        if len(set(names)) < len(names):
            raise ValueError(f"a column name is given twice in {files[0]}: {list(names)}")
        kinds = schema or T.StructType([T.StructField(n, T.StringType()) for n in names])
        tables.append(spark.read.schema(kinds).option("header", True).option("enforceSchema", True).csv(files if len(headers) > 1 else path))
    if not tables:
        return spark.createDataFrame([], schema or RAW_SCHEMA)
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)


def land_readings(spark: SparkSession, path: str, target: str) -> DataFrame:
    """Copy raw CSV to Parquet and report ``rows``, ``columns`` and ``column_names``.

    The report reads the landed copy, where a count needs no cell values.
    """
    read_readings(spark, path).write.mode("overwrite").parquet(target)
    landed = spark.read.parquet(target)
    return landed.agg(F.count(F.lit(1)).alias("rows")).select(
        "rows",
        F.lit(len(landed.columns)).alias("columns"),
        F.lit(",".join(landed.columns)).alias("column_names"),
    )


def read_landed(spark: SparkSession, path: str) -> DataFrame:
    """The landed copy; a missing path is an error."""
    return spark.read.parquet(path)


def write_panel(df: DataFrame, path: str, date: str = DATE, files_per_year: int = 8) -> None:
    """Store a clean panel partitioned by year, ``files_per_year`` files at most for each."""
    share = F.pmod(F.xxhash64(*[c for c in (STATION, date) if c in df.columns]), F.lit(files_per_year))
    dated = df.withColumn("_year", F.year(date)).withColumn("_share", share)
    dated.repartition("_year", "_share").drop("_share").write.mode("overwrite").partitionBy("_year").parquet(path)


def read_panel(
    spark: SparkSession, path: str, first: str | None = None, last: str | None = None, date: str = DATE
) -> DataFrame:
    """A stored panel, or its days from ``first`` to ``last``; only the years in between are read."""
    df = spark.read.parquet(path)
    for day, inside in ((first, ">="), (last, "<=")):
        if day is not None:
            at = F.to_date(F.lit(str(day)))
            year = F.lit(int(str(day)[:4]))
            df = df.filter((F.col(date) >= at) & (F.col("_year") >= year) if inside == ">=" else (F.col(date) <= at) & (F.col("_year") <= year))
    return df.drop("_year")
