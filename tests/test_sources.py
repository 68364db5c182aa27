"""Readers refuse or keep apart what they can't read, and read no more than asked for."""

import json

import pytest
from pyspark.sql import functions as F

from stationcast.operators import reports
from stationcast.plans import training
from stationcast.sources import feed, readings
from stationcast.streaming import live


def put(folder, name, text):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text(text)
    return str(folder)


def test_files_with_other_column_orders(spark, tmp_path):
    put(tmp_path / "csv", "a.csv", "stasiun,tanggal,periode_data\nB,1,202101\n")
    path = put(tmp_path / "csv", "b.csv", "periode_data,stasiun,tanggal,note\n202102,C,2,\"x, y\"\n202102,D,3,\n")
    rows = {r.stasiun: r for r in readings.read_readings(spark, path).collect()}
    assert (rows["B"].periode_data, rows["B"].tanggal, rows["B"].note) == ("202101", "1", None)
    assert (rows["C"].periode_data, rows["C"].note, rows["D"].note) == ("202102", "x, y", None)


def test_a_given_schema_must_fit(spark, tmp_path):
    path = put(tmp_path / "csv", "a.csv", "stasiun,tanggal\nB,1\n")
    good = spark.createDataFrame([], "stasiun string, tanggal string").schema
    assert readings.read_readings(spark, path, good).collect()[0].tanggal == "1"
    with pytest.raises(ValueError, match="another header"):
        readings.read_readings(spark, path, spark.createDataFrame([], "tanggal string, stasiun string").schema)


LINES = [
    {"reading_id": 1, "arrival_date": "2024-01-01", "current": {"pm10": 4.0, "ozone": None}},
    {"reading_id": 2, "arrival_date": "2024-01-01", "current": {"pm10": "high"}},
    {"arrival_date": "2024-01-01", "current": {"pm10": 1.0}},
]


def landing(tmp_path):
    return put(tmp_path / "landing", "a.json", "\n".join(map(json.dumps, LINES)) + "\n{broken\n")


def test_broken_messages_are_kept_apart(spark, tmp_path):
    path = landing(tmp_path)
    rows = feed.read_live(spark, path).collect()
    assert [(r.reading_id, r.pm10, r.o3) for r in rows] == [(1, 4.0, 0.0)]
    assert feed.read_rejects(spark, path).count() == 3
    one = feed.read_live(spark, path, null_as_zero=False).first()
    assert one.o3 is None and one.co == 0.0


def test_broken_messages_of_a_stream(spark, tmp_path):
    path = landing(tmp_path)
    for name, job in (("good", live.ingest_live), ("bad", live.ingest_rejects)):
        job(spark, path, str(tmp_path / name), str(tmp_path / f"{name}-progress")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "good")).count() == 1
    assert spark.read.parquet(str(tmp_path / "bad")).count() == 3


def test_days_of_a_stored_panel(spark, panel, tmp_path):
    path = str(tmp_path / "panel")
    readings.write_panel(panel, path, files_per_year=2)
    first, last = panel.agg(F.min("obs_date"), F.max("obs_date")).first()
    part = readings.read_panel(spark, path, f"{first.year + 1}-02-01", f"{first.year + 1}-03-01")
    plan = part._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(_year" in plan.replace("#", "_year").replace("_year_year", "_year") or "_year" in plan.split("PartitionFilters")[1][:200]
    want = panel.filter(F.col("obs_date").between(f"{first.year + 1}-02-01", f"{first.year + 1}-03-01"))
    assert sorted(map(tuple, part.select(*panel.columns).collect())) == sorted(map(tuple, want.collect()))
    files = {r[0] for r in spark.read.parquet(path).select(F.input_file_name()).distinct().collect()}
    assert len(files) <= 2 * (last.year - first.year + 1)


def test_rows_of_a_few_groups_are_not_shuffled(spark, panel):
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = panel.select("pm25", (F.dayofmonth("obs_date") < 25).alias("is_train"))
        for out in (reports.outliers(rows), reports.histogram(rows, by=("is_train",)).filter("n > 0")):
            out.collect()
        plan = reports.outliers(rows)._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" not in plan and "BroadcastHashJoin" in plan
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)


def test_station_index_and_split_by_date(spark, panel):
    rows = training.station_index(panel.select("station", "obs_date", "pm25"))
    names = sorted(r[0] for r in panel.select("station").distinct().collect())
    assert {(r[0], r[1]) for r in rows.select("station", "station_index").distinct().collect()} == {(n, i) for i, n in enumerate(names, 1)}
    split, _ = training.training_rows(rows.withColumn("x", F.lit(1.0)), columns=["x"], by_date=True)
    sides = {r.is_train: r for r in split.groupBy("is_train").agg(F.min("obs_date").alias("a"), F.max("obs_date").alias("b")).collect()}
    assert sides[True].b <= sides[False].a
    one, _ = training.training_rows(rows, columns=["station_index"], best_station=True)
    assert one.select("station").distinct().count() == 1


def test_header_pass_reads_one_buffer_of_each_file(spark, tmp_path):
    import gzip

    from stationcast.sources import readings

    lines = "\n".join(f"{i},{i}" for i in range(400_000))
    (tmp_path / "a b%.csv").write_text("x,y\n" + lines)
    (tmp_path / "c.csv.gz").write_bytes(gzip.compress(b"y,z\n1,2\n"))
    (tmp_path / "empty.csv").write_text("")
    read = spark.sparkContext._jvm.org.apache.hadoop.fs.FileSystem.getGlobalStorageStatistics
    count = lambda: read().get("file").getLong("bytesRead") or 0
    before = count()
    found = readings._headers(spark, str(tmp_path))
    assert 0 < count() - before < 200_000
    assert sorted(found) == [("x", "y"), ("y", "z")]
    out = readings.read_readings(spark, str(tmp_path))
    assert set(out.columns) == {"x", "y", "z"} and out.count() == 400_001
    assert out.filter("z = '2' and y = '1' and x is null").count() == 1
