"""Column names and the fixed vocabulary of the readings."""

from __future__ import annotations

from pyspark.sql import types as T

STATION = "station"
DATE = "obs_date"
TARGET = "pm25"

# Source column -> engine column.
POLLUTANT_NAMES = {
    "pm_sepuluh": "pm10",
    "pm_duakomalima": "pm25",
    "sulfur_dioksida": "so2",
    "karbon_monoksida": "co",
    "ozon": "o3",
    "nitrogen_dioksida": "no2",
    "max": "max_idx",
}
RAW_STATION = "stasiun"
RAW_PERIOD = "periode_data"
RAW_DAY = "tanggal"
RAW_MONTH = "bulan"
RAW_CATEGORY = "kategori"

# The text cells that mean "missing".
NULL_TOKENS = ("N/A", "null", "TIDAK ADA DATA")

# The engine's columns, in their order.
POLLUTANTS = ("pm25", "pm10", "so2", "co", "o3", "no2", "max_idx")
#: Columns that tell two readings of a station and day apart.
READINGS = POLLUTANTS
FILLED_POLLUTANTS = ("pm25", "pm10", "so2", "co", "o3", "no2")
CONTEXT_POLLUTANTS = ("pm10", "so2", "co", "o3", "no2", "max_idx")

# Positions of the target history used as features.
LAGS = (1, 2, 3, 7, 14, 30)
ROLLING_WINDOWS = (7, 14, 30)
ROLLING_STATS = ("mean", "std", "min", "max")
CHANGES = {"pm25_day_change": 1, "pm25_week_change": 7}

# Calendar columns of a model's input, in their order.
CALENDAR_FEATURES = (
    "periode_data",
    "bulan",
    "year",
    "day_of_week",
    "month",
    "day_of_year",
    "quarter",
    "is_weekend",
    "season",
    "is_rainy_season",
)
SERVING_FEATURES = CONTEXT_POLLUTANTS + CALENDAR_FEATURES

# Columns of a raw file.
RAW_COLUMNS = (RAW_PERIOD, RAW_DAY, RAW_STATION, *POLLUTANT_NAMES, RAW_MONTH)
RAW_SCHEMA = T.StructType(
    [T.StructField(name, T.StringType()) for name in (*RAW_COLUMNS, RAW_CATEGORY)]
)

# Fields of a live reading.
LIVE_SCHEMA = T.StructType(
    [
        T.StructField(
            "current",
            T.StructType(
                [
                    T.StructField(name, T.DoubleType())
                    for name in (
                        "pm10",
                        "pm2_5",
                        "carbon_monoxide",
                        "nitrogen_dioxide",
                        "sulphur_dioxide",
                        "ozone",
                    )
                ]
            ),
        ),
        T.StructField("arrival_date", T.DateType()),
        T.StructField("reading_id", T.LongType()),
    ]
)
# Engine column -> live feed field.
LIVE_FIELDS = {
    "pm10": "pm10",
    "so2": "sulphur_dioxide",
    "co": "carbon_monoxide",
    "o3": "ozone",
    "no2": "nitrogen_dioxide",
}
