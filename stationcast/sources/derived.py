"""Readings derived from the star-schema test tables.

The tables hold no readings, so a panel is made from shipped line items: one
station per nation (or supplier), one reading per shipping day. Only whole
numbers are summed, which keeps the values independent of summation order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import DATE, STATION


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def panel(spark: SparkSession, sf_dir: str, grain: str = "nation") -> DataFrame:
    """Typed panel: station, obs_date and seven readings, unique per station and date."""
    items, suppliers, nations = (
        table(spark, sf_dir, n) for n in ("lineitem", "supplier", "nation")
    )
    if grain == "nation":
        station, key = F.col("n_name"), F.col("n_nationkey")
    else:
        station, key = F.concat(F.lit("S"), F.col("s_suppkey").cast("string")), F.col("s_suppkey")
    quantity = F.col("l_quantity").cast("long")
    daily = (
        items.join(suppliers, F.col("l_suppkey") == F.col("s_suppkey"))
        .join(nations, F.col("s_nationkey") == F.col("n_nationkey"))
        .groupBy(
            station.alias(STATION),
            key.cast("int").alias("skey"),
            F.col("l_shipdate").cast("date").alias(DATE),
        )
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.sum(quantity).alias("q"),
            F.min(quantity).alias("qmin"),
            F.max(quantity).alias("qmax"),
            F.sum(F.floor("l_extendedprice").cast("long")).alias("price"),
            F.sum(F.round(F.col("l_discount") * 100).cast("long")).alias("disc"),
            F.sum(F.round(F.col("l_tax") * 100).cast("long")).alias("tax"),
        )
    )
    day, skey, n = F.dayofyear(DATE), F.col("skey"), F.col("n")
    no_pm25 = ((day + skey) % 11 == 0) | (F.col(DATE) < F.lit("1995-01-10").cast("date"))
    no_pm10 = (day + skey * 2) % 13 == 0
    no_so2 = (skey % 3 == 0) & day.between(100, 105)

    def known(gap, value):
        return F.when(~gap, value)

    return daily.select(
        STATION,
        DATE,
        known(no_pm25, (F.col("q") * 4).cast("double") / n).alias("pm25"),
        known(no_pm10, F.col("price").cast("double") / (n * 1000)).alias("pm10"),
        known(no_so2, F.col("disc").cast("double") / n).alias("so2"),
        (F.col("tax").cast("double") / n).alias("co"),
        F.col("qmin").cast("double").alias("o3"),
        F.col("qmax").cast("double").alias("no2"),
        F.greatest("qmax", "disc").cast("double").alias("max_idx"),
    )


def raw_readings(spark: SparkSession, sf_dir: str, grain: str = "nation") -> DataFrame:
    """The panel as raw text: missing-value tokens, junk cells and 30 February rows."""
    days = panel(spark, sf_dir, grain)
    token = (
        F.when(F.day(DATE) % 4 == 0, "N/A")
        .when(F.day(DATE) % 4 == 1, "null")
        .when(F.day(DATE) % 4 == 2, "TIDAK ADA DATA")
        .otherwise("---")
    )

    def text(name: str):
        return F.coalesce(F.col(name).cast("string"), token)

    month_text = (F.year(DATE) * 100 + F.month(DATE)).cast("string")
    real = F.struct(
        month_text.alias("periode_data"),
        F.day(DATE).cast("string").alias("tanggal"),
        F.col(STATION).alias("stasiun"),
        text("pm25").alias("pm_duakomalima"),
        text("pm10").alias("pm_sepuluh"),
        text("so2").alias("sulfur_dioksida"),
        F.col("co").cast("string").alias("karbon_monoksida"),
        F.col("o3").cast("string").alias("ozon"),
        F.col("no2").cast("string").alias("nitrogen_dioksida"),
        F.col("max_idx").cast("string").alias("max"),
        F.month(DATE).alias("bulan"),
    )
    one = F.lit("1")
    no_such_day = F.struct(
        (F.year(DATE) * 100 + 2).cast("string").alias("periode_data"),
        F.lit("30").alias("tanggal"),
        F.col(STATION).alias("stasiun"),
        one.alias("pm_duakomalima"),
        one.alias("pm_sepuluh"),
        one.alias("sulfur_dioksida"),
        one.alias("karbon_monoksida"),
        one.alias("ozon"),
        one.alias("nitrogen_dioksida"),
        one.alias("max"),
        F.lit(2).alias("bulan"),
    )
    february_28 = (F.month(DATE) == 2) & (F.day(DATE) == 28)
    # both kinds of rows come from one pass over the panel
    rows = F.when(february_28, F.array(real, no_such_day)).otherwise(F.array(real))
    return days.select(F.inline(rows))


def live_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Live feed messages as JSON text, from events.

    A field of the message is left out for every fifth event and an explicit
    null for another fifth.
    """
    events = table(spark, sf_dir, "events")
    number = F.col("value").cast("string")
    kind = F.col("event_id") % 5
    pm10 = (
        F.when(kind == 0, F.lit(""))
        .when(kind == 1, F.lit('"pm10": null, '))
        .otherwise(F.concat(F.lit('"pm10": '), number, F.lit(", ")))
    )
    text = F.concat(
        F.lit('{"reading_id": '),
        F.col("event_id").cast("string"),
        F.lit(', "arrival_date": "'),
        F.date_format("ts", "yyyy-MM-dd"),
        F.lit('", "current": {'),
        pm10,
        F.lit('"ozone": '),
        (F.col("event_id") % 97).cast("string"),
        F.lit(', "pm2_5": '),
        number,
        F.lit(', "carbon_monoxide": '),
        (F.col("user_id") % 50).cast("string"),
        F.lit(', "nitrogen_dioxide": '),
        number,
        F.lit("}}"),
    )
    return events.select("event_id", "ts", text.alias("value"))
