from pyspark.sql import functions as F

from catalog import base
from stationcast.session import scratch_path
from stationcast.sources import derived, feed
from stationcast.streaming import daily, history, live


def write(messages, path):
    messages.select("value").coalesce(1).write.mode("append").text(path)


def test_restart_adds_each_row_once(spark, sf):
    messages = derived.live_messages(spark, sf)
    landing, target, progress = (scratch_path(spark, n) for n in ("landing", "target", "progress"))
    write(messages.filter("event_id < 300"), landing)
    live.ingest_live(spark, landing, target, progress).awaitTermination()
    assert spark.read.parquet(target).count() == 300
    write(messages.filter("event_id >= 300"), landing)
    for _ in range(2):
        live.ingest_live(spark, landing, target, progress, files_per_batch=1).awaitTermination()
    stored = spark.read.parquet(target)
    batch = feed.read_live(spark, landing)
    assert stored.count() == batch.count() == messages.count()
    assert stored.exceptAll(batch).count() == 0


def test_missing_and_null_fields_count_as_zero(spark, sf):
    rows = feed.read_live(spark, base.landed_messages(spark, sf))
    assert rows.filter(F.col("reading_id") % 5 < 2).filter("pm10 <> 0").count() == 0
    assert rows.filter("so2 <> 0 OR max_idx <> 0 OR pm10 IS NULL").count() == 0


def test_stream_scores_like_batch(spark, sf):
    landing = base.landed_messages(spark, sf)
    target, progress = scratch_path(spark, "target"), scratch_path(spark, "progress")
    live.score_live(spark, landing, base.linear, target, progress, files_per_batch=1).awaitTermination()
    batch = live.scored_readings(feed.read_live(spark, landing), base.linear)
    stored = spark.read.parquet(target)
    assert stored.count() == batch.count() and stored.exceptAll(batch).count() == 0


def test_model_scores_a_stream(spark, sf, panel):
    from stationcast.operators import features, fill
    from stationcast.plans import scoring, training

    rows = features.build_features(fill.forward_fill(panel))
    trained = training.train_all(
        rows, {"LinearRegression": training.linear_regression}, folds=False, columns=["pm10", "co", "month"]
    )
    landing, target = base.landed_messages(spark, sf), scratch_path(spark, "target")
    predict = scoring.model_predictor(trained.models["LinearRegression"], ["pm10", "co", "month"])
    live.score_live(spark, landing, predict, target, scratch_path(spark, "progress")).awaitTermination()
    assert spark.read.parquet(target).filter("value IS NOT NULL").count() == derived.live_messages(spark, sf).count()


def message(number, day, pm10):
    return f'{{"reading_id": {number}, "arrival_date": "2024-01-{day:02d}", "current": {{"pm10": {pm10}}}}}'


def test_daily_averages_of_late_and_repeated_readings(spark):
    landing, target, progress = (scratch_path(spark, n) for n in ("landing", "daily", "progress"))

    def arrive(*lines):
        spark.createDataFrame([(x,) for x in lines], "value string").coalesce(1).write.mode("append").text(landing)
        daily.ingest_daily(spark, landing, target, progress).awaitTermination()
        return {(r.arrival_date.day, r.n, r.pm10) for r in spark.read.parquet(target).collect()}

    assert arrive(message(1, 2, 10), message(2, 1, 10), message(3, 2, 7), message(2, 1, 10)) == set()
    # out of order and repeated, but not too late
    assert arrive(message(4, 1, 20), message(1, 2, 10), message(5, 4, 1)) == {(1, 2, 15.0)}
    # day 1 is closed, day 3 is open
    assert arrive(message(6, 1, 99), message(7, 3, 9), message(8, 9, 5)) == {(1, 2, 15.0), (2, 2, 8.5), (3, 1, 9.0), (4, 1, 1.0)}
    rows = arrive(message(9, 3, 50), message(10, 30, 1))
    assert rows == {(1, 2, 15.0), (2, 2, 8.5), (3, 1, 9.0), (4, 1, 1.0), (9, 1, 5.0)}
    batch = daily.daily_averages(feed.read_live(spark, landing))
    assert {r.arrival_date.day: r.n for r in batch.collect()} == {1: 3, 2: 2, 3: 2, 4: 1, 9: 1, 30: 1}


def small_panel(panel):
    names = [r.station for r in panel.select("station").distinct().orderBy("station").limit(3).collect()]
    return panel.filter(F.col("station").isin(names))


def test_streamed_features_equal_the_batch(spark, panel, monkeypatch):
    from stationcast.operators import features, fill

    days = small_panel(panel)
    landing = base.landed_in_order(days, "obs_date", 4)
    target, state, progress = (scratch_path(spark, n) for n in ("streamed", "state", "progress"))
    run = lambda **more: history.stream_features(spark, landing, days.schema, target, state, progress, files_per_batch=1, **more)
    # the third micro-batch is stopped after its results, before its state
    whole = history.step

    def stopped(batch, tails, *rest, **more):
        out, after, late = whole(batch, tails, *rest, **more)
        return (out, after.withColumn("station", F.raise_error(F.lit("stopped"))) if len(history._numbers(spark, f"{state}/tails")) == 2 else after, late)

    with monkeypatch.context() as broken:
        broken.setattr(history, "step", stopped)
        try:
            run().awaitTermination()
        except Exception as problem:
            assert "stopped" in str(problem)
        else:
            raise AssertionError("the stream was not stopped")
    assert history._numbers(spark, f"{target}") == [0, 1, 2] and history._numbers(spark, f"{state}/tails") == [0, 1]
    run().awaitTermination()
    batch = features.build_features(fill.forward_fill(days))
    streamed = history.read_streamed(spark, target)
    assert batch.count() > 100 and streamed.count() == batch.count()
    same = [F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in batch.dtypes]
    assert streamed.select(*same).exceptAll(batch.select(*same)).count() == 0
    kept = spark.read.parquet(f"{state}/tails/batch=3")
    assert kept.groupBy("station").count().agg(F.max("count")).first()[0] == history.DEPTH
    assert history._numbers(spark, f"{state}/tails") == [2, 3]


def test_late_rows_are_kept_apart(spark, panel):
    days = small_panel(panel)
    first, last = days.agg(F.min("obs_date"), F.max("obs_date")).first()
    _, tails, _ = history.step(days.filter(F.col("obs_date") < F.date_sub(F.lit(last), 5)), None)
    more = days.filter(F.col("obs_date") >= F.date_sub(F.lit(last), 5))
    lost = days.filter(F.col("obs_date") == F.lit(first))
    nowhere = days.limit(1).withColumn("station", F.lit(None).cast("string"))
    out, after, late = history.step(more.unionByName(lost).unionByName(nowhere), tails, complete=False)
    assert late.count() == lost.count() and out.filter(F.col("obs_date") == F.lit(first)).filter("station is not null").count() == 0
    assert after.filter("station is null").count() == 0
    empty, same, _ = history.step(days.limit(0), tails)
    assert empty.count() == 0 and same.select(tails.columns).exceptAll(tails).count() == 0
