"""Headline timings: prints one JSON line.

Raw readings and a clean panel are derived and landed as Parquet first (not
timed); each query then starts from a Parquet scan, like a user's job would.
Supplier grain, so that the data grows with the scale factor. Each figure is the
median of three runs after a discarded one, of one run for training.

    BENCH_SF_DIR=/root/testdata/sf0.1 BENCH_CPUS=8 python bench.py
"""

from __future__ import annotations

import json
import os
import re
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import functions as F  # noqa: E402

from catalog import base  # noqa: E402
from stationcast.operators import bias, cleaning, features, fill, metrics, quantiles, reports, split  # noqa: E402
from stationcast.plans import charts, scoring, training  # noqa: E402
from stationcast.schema import DATE, FILLED_POLLUTANTS, SERVING_FEATURES, STATION, TARGET  # noqa: E402
from stationcast.session import local_session, release, scratch_path  # noqa: E402
from stationcast.sources.readings import read_landed  # noqa: E402

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
RUNS = int(os.environ.get("BENCH_RUNS", "3"))


def run(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    spark = local_session(CPUS, "bench", **{"spark.sql.shuffle.partitions": CPUS})
    raw_path, clean_path, feature_path, predicted_path, split_path = (
        scratch_path(spark, n) for n in ("raw", "clean", "features", "predicted", "split")
    )
    base.raw(spark, SF_DIR, "supplier").write.parquet(raw_path)
    cleaning.clean_readings(read_landed(spark, raw_path)).write.parquet(clean_path)
    features.build_features(read_landed(spark, clean_path)).write.parquet(feature_path)
    base.predictions(spark, SF_DIR, "supplier").write.parquet(predicted_path)
    split.add_split(read_landed(spark, clean_path).select(STATION, DATE, TARGET)).write.parquet(split_path)

    def clean():
        return read_landed(spark, clean_path)

    def clean_chain():
        run(cleaning.clean_readings(read_landed(spark, raw_path)))

    def fill_station():
        run(fill.forward_fill(clean().select(STATION, DATE, *FILLED_POLLUTANTS)))

    def feature_chain():
        run(features.build_features(clean()))

    def raw_to_features():
        run(features.features_from_raw(read_landed(spark, raw_path)))

    def split_and_folds():
        run(split.add_split_and_folds(clean().select(STATION, DATE, TARGET)))

    def fill_global():
        run(fill.forward_fill_global(clean().select(STATION, DATE, *FILLED_POLLUTANTS), FILLED_POLLUTANTS))

    def fill_segments():
        # every series is above this limit, as series of a large panel are above the real one
        run(fill.forward_fill(clean().select(STATION, DATE, *FILLED_POLLUTANTS), FILLED_POLLUTANTS, max_rows=500))

    def median_per_column():
        run(quantiles.medians(clean(), FILLED_POLLUTANTS))

    def boxes():
        run(reports.box_summary(read_landed(spark, split_path)))

    def metrics_and_bias():
        rows = read_landed(spark, predicted_path)
        run(metrics.evaluate(rows))
        run(bias.bias_report_long(rows.filter(F.col("side") == "test")))

    def forecast_all():
        inputs = scoring.forecast_features(clean(), scenarios=tuple(scoring.SCENARIOS))
        run(scoring.compare_scenarios(base.linear(inputs)))

    def train_linear():
        rows = read_landed(spark, feature_path)
        trained = training.train_all(
            rows, {"LinearRegression": training.linear_regression}, columns=SERVING_FEATURES
        )
        run(trained.comparison)
        trained.prepared.release()

    def train_stations():
        rows = read_landed(spark, feature_path)
        found = training.train_stations(rows, columns=SERVING_FEATURES)
        run(found.metrics)
        run(found.folds)
        found.prepared.release()

    def correlations():
        run(reports.correlation(clean(), FILLED_POLLUTANTS))

    def thin_lines():
        run(charts.thin_line(read_landed(spark, split_path).select(STATION, DATE, TARGET), 200))

    def train_forest():
        rows = read_landed(spark, feature_path)
        trained = training.train_all(rows, {"RandomForest": training.random_forest}, folds=False, columns=SERVING_FEATURES)
        run(trained.comparison)
        trained.prepared.release()

    queries = {
        "clean_chain": clean_chain,
        "fill_station": fill_station,
        "feature_chain": feature_chain,
        "raw_to_features": raw_to_features,
        "split_and_folds": split_and_folds,
        "metrics_and_bias": metrics_and_bias,
        "forecast_all": forecast_all,
        "train_linear_with_folds": train_linear,
        "fill_global": fill_global,
        "fill_segments": fill_segments,
        "medians": median_per_column,
        "box_summary": boxes,
        "train_stations": train_stations,
        "correlations": correlations,
        "thin_lines": thin_lines,
        "train_forest": train_forest,
    }
    took = {}
    for name, query in queries.items():
        times = []
        for i in range(2 if name.startswith("train_") else RUNS + 1):
            start = time.perf_counter()
            query()
            if i:
                times.append(time.perf_counter() - start)
        took[name] = round(statistics.median(times), 3)
        release(spark)
        print(f"{name} {took[name]}", file=sys.stderr, flush=True)
    found = re.search(r"sf([\d.]+)$", SF_DIR.rstrip("/"))
    print(
        json.dumps(
            {
                "metric": "total of median query times",
                "value": round(sum(took.values()), 3),
                "unit": "sec",
                "queries": took,
                "sf": float(found.group(1)) if found else None,
            }
        )
    )


if __name__ == "__main__":
    main()
