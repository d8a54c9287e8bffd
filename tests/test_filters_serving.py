import datetime as dt
import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from roadpulse.operators import filters, metrics, sampling, scaling, serving

SCHEMA = "station_id int, ts timestamp_ntz, traffic_1 int, traffic_2 int, count_1 int, count_2 int"


def _facts(spark):
    day = dt.datetime(2024, 1, 25)
    rows = [(s, day + dt.timedelta(hours=h), 1 + h % 4, 4 - h % 4, h - 1, s) for s in (2, 5) for h in range(30) if h != 3]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.mark.parametrize("width", [1, 10, 1000])
def test_position_within(spark, width):
    rows = random.Random(1).sample(range(2000), 600)
    df = spark.createDataFrame([(i % 3, v) for i, v in enumerate(rows)], "k int, v int")
    expected = df.withColumn("p", F.row_number().over(Window.partitionBy("k").orderBy("v")) - 1)
    got = filters.position_within(df, ["k"], "v", "p", width)
    assert got.select("k", "v", F.col("p").cast("int")).exceptAll(expected).isEmpty() and got.count() == 600


def test_traffic_at_and_markers(spark):
    stations = spark.createDataFrame([(2, 1.0, 2.0), (5, 1.5, 2.5), (9, 3.0, 4.0)], "station_id int, latitude double, longitude double")
    facts = _facts(spark)
    levels = {r.station_id: r.level for r in serving.traffic_at(facts, stations, "2024-01-25 06:45:00", 2).collect()}
    assert levels == {2: 2, 5: 2, 9: -1}
    absent = serving.traffic_at(facts, stations, "2024-01-25 03:00:00", 1).select("level").distinct().collect()
    assert [r.level for r in absent] == [-1]
    icons = {r.station_id: r.icon for r in serving.markers(facts, stations, "2024-01-25 07:00:00", 1).collect()}
    assert "extreme" in icons[2] and "transparent" in icons[9]


def test_facts_route_by_day(spark):
    facts = _facts(spark)
    both = filters.facts(facts, facts.withColumn("count_2", F.lit(0)), "2024-01-26")
    assert both.count() == facts.count()
    assert both.where("origin = 'history'").agg(F.max("ts")).first()[0] == dt.datetime(2024, 1, 25, 23)
    assert both.where("origin = 'prediction' and count_2 <> 0").isEmpty()


def test_heatmap(spark):
    table = serving.heatmap(_facts(spark), ["2024-01-25", "2024-01-26"], station_id=2, direction=1).orderBy("hour").collect()
    assert [r.hour for r in table] == list(range(24))
    assert table[0]["2024-01-25_count"] == 0 and table[0]["2024-01-26_level"] == 1
    assert table[3]["2024-01-25_level"] is None and table[10]["2024-01-26_level"] is None
    assert table[7]["2024-01-25_colour"] == "color-extreme-traffic"
    assert serving.heatmap(_facts(spark), ["2024-01-25"]).count() == 2 * 2 * 24


def test_lists(spark):
    days = {(r.station_id, r.day): r.hours for r in serving.by_date(_facts(spark)).collect()}
    assert len(days[2, dt.date(2024, 1, 25)]) == 23 and [h.hour for h in days[5, dt.date(2024, 1, 26)]] == list(range(6))
    series = {r.station_id: r for r in serving.station_series(_facts(spark)).collect()}
    assert all(len(series[2][c]) == 29 for c in ("traffic_1", "traffic_2", "days", "months", "years", "hours", "count_1", "count_2"))
    assert series[2].hours[:4] == [0, 1, 2, 4] and series[2].days[-1] == 26


def test_holdout_and_resample(spark):
    rows = [(2, i, "TRAFFIC_1", 1 if i % 10 else (2 if i % 20 else 4)) for i in range(4000)]
    df = spark.createDataFrame(rows, "station_id int, obs_id long, target string, label int")
    split = sampling.holdout(df)
    share = split.where("split = 'test'").count() / 4000
    assert share == pytest.approx(0.2, abs=0.03)
    drawn = sampling.balanced_resample(split, ["station_id", "target", "split"], width=64)
    assert drawn.count() == 4000
    counts = {r.label: r.n_rows for r in sampling.class_counts(drawn, ["station_id"]).collect()}
    assert set(counts) == {1, 2, 4} and min(counts.values()) > 1200
    assert drawn.join(split.withColumnRenamed("split", "own"), "obs_id").where("split <> own").isEmpty()
    assert not sampling.differing_rows(df.select("obs_id", "label"), drawn.select("obs_id", "label")).isEmpty()
    assert sampling.differing_rows(df, df.repartition(5)).isEmpty()


def test_draws_do_not_depend_on_the_partitioning(spark):
    df = spark.range(3000).select(
        (F.col("id") % 2).cast("int").alias("station_id"), F.col("id").alias("obs_id"), F.lit("T").alias("target"), (F.col("id") % 3).cast("int").alias("label")
    )
    before = spark.conf.get("spark.sql.shuffle.partitions")
    results = []
    try:
        for partitions in (1, 4, 32):
            spark.conf.set("spark.sql.shuffle.partitions", partitions)
            drawn = sampling.balanced_resample(df.repartition(partitions), ["station_id", "target"])
            results.append(sorted(map(tuple, drawn.select("draw_id", "obs_id").collect())))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert results[0] == results[1] == results[2]


def test_scalers(spark):
    rows = [(1, float(v), 3.0, h, h % 7) for h, v in enumerate([1, 2, 3, 4] * 6)]
    df = spark.createDataFrame(rows, "station_id int, temperature double, niederschlag double, hour int, week_day int")
    fitted = df.join(scaling.fit_features(df, ["station_id"]), "station_id")
    vectors = [r.x for r in fitted.orderBy("hour").select(scaling.feature_vector().alias("x")).collect()]
    assert all(len(x) == 33 and sum(x[:24]) == 1 and sum(x[24:31]) == 1 for x in vectors)
    assert vectors[0][0] == 1 and vectors[0][24] == 1 and vectors[0][31] == 0.0
    assert vectors[0][32] == pytest.approx((1 - 2.5) / 1.118033988749895)
    with pytest.raises(Exception, match="unknown hour"):
        fitted.withColumn("hour", F.lit(99)).select(scaling.feature_vector()).collect()
    loose = fitted.withColumn("hour", F.lit(99)).select(scaling.feature_vector(strict=False).alias("x")).first().x
    assert sum(loose[:24]) == 0


def test_minmax(spark):
    df = spark.createDataFrame([(1, 2), (1, 6), (2, 5), (2, 5)], "station_id int, label int")
    scaled = df.join(scaling.fit_minmax(df, ["station_id"], "label"), "station_id").withColumn("s", scaling.minmax(F.col("label")))
    rows = scaled.select("station_id", "label", "s", scaling.undo_minmax(F.col("s")).alias("back")).collect()
    assert sorted(r.s for r in rows if r.station_id == 1) == [0.0, 1.0]
    assert all(r.s == 0.0 and r.back == 5 for r in rows if r.station_id == 2)


def test_metrics(spark):
    df = spark.createDataFrame([(1, 10, 10.0), (1, 0, 0.0), (1, 30, 10.0)], "k int, y int, p double")
    row = metrics.mean_percentage_error(df, ["k"], "y", "p").first()
    assert row.mean_percentage_error == 50.0 and row.undefined_rows == 1
    assert metrics.mean_squared_error(df, ["k"], "y", "p").first().mean_squared_error == pytest.approx(133.333)
    scored = spark.createDataFrame([(1, 1, 1, 2), (1, 2, 1, 1)], "k int, label int, predicted int, n int")
    assert metrics.accuracy(scored, ["k"], weight="n").first().accuracy == 0.667
    best = metrics.best_of(spark.createDataFrame([(1, 3, 0.9), (1, 2, 0.9), (1, 1, 0.10)], "k int, size int, a double"), ["k"], "a", ["size"])
    assert best.first()["size"] == 2


def test_quality_report(spark):
    df = spark.createDataFrame([(0, 5, None), (5, -1, 2.0), (4, 0, -0.1)], "traffic_1 int, count_1 int, niederschlag double")
    rows = {r.column_name: r for r in metrics.quality_report(df).collect()}
    assert (rows["traffic_1"].out_of_range, rows["count_1"].out_of_range, rows["niederschlag"].out_of_range) == (1, 1, 1)
    assert rows["niederschlag"].null_rows == 1 and rows["count_1"].n_rows == 3
    assert filters.null_counts(df).first().niederschlag == 1
