import datetime as dt
import json
import os

import pytest
from conftest import bulletin
from pyspark.sql import functions as F

from roadpulse.functions import calendar
from roadpulse.operators import filters
from roadpulse.plans import scoring, training
from roadpulse.sources import bulletins, history, models, predictions
from roadpulse.streaming import refresh

TODAY = "2018-01-25"
SMALL = training.Settings(n_trees=15)


@pytest.fixture()
def inputs(spark, history_folder, station_file):
    rows = history.read_history(spark, history_folder)
    ts = F.col("ts")
    observations = rows.select(
        "station_id", "ts", "temperature", "niederschlag", "traffic_1", "traffic_2", "count_1", "count_2",
        F.hour("ts").alias("hour"), calendar.week_day(ts).alias("week_day"),
        (F.col("station_id") * F.lit(10_000_000).cast("bigint") + calendar.hours_since_epoch(ts)).alias("obs_id"),
    )
    stations = history.read_stations(spark, station_file).withColumn("weather_index", F.lit(1))
    return observations, stations


def _document(days=3):
    return json.dumps(bulletin(dt.date(2018, 1, 25), days))


def test_train_save_load_score(spark, inputs, tmp_path):
    observations, stations = inputs
    assert training.observed(observations, stations).select("station_id").distinct().count() == 2
    trained = training.train(observations, stations, SMALL)
    report = {(r.station_id, r.target, r.model, r.split, r.metric): r.value for r in trained.metrics.collect()}
    # Accuracies of five classifiers on two sides, importances of three by four features, loss and error on two sides.
    assert len(report) == 2 * 2 * (5 * 2 + 3 * 4 + 2 * 2)
    assert sum(v for k, v in report.items() if k[:3] == (2, "TRAFFIC_1", "simple_tree") and "importance" in k[4]) == pytest.approx(1)
    for target in ("TRAFFIC_1", "TRAFFIC_2"):
        for model in ("tree", "forest", "ensemble"):
            assert report[2, target, model, "test", "accuracy"] > 0.9
    assert report[2, "COUNT_1", "network", "test", "loss"] < 0.05
    store = str(tmp_path / "models")
    for name, table in trained.models.items():
        models.save_models(table, store, name)
    loaded = models.load_ensemble(spark, store) | models.load_regressor(spark, store)
    assert set(loaded) == set(trained.models)
    with pytest.raises(models.ModelMissing):
        models.load_ensemble(spark, store, ["TRAFFIC_3"])
    with pytest.raises(models.ModelMissing):
        models.load_regressor(spark, str(tmp_path / "nowhere"))

    parsed = bulletins.parse_bulletins(spark.createDataFrame([(1, _document())], "weather_index int, json string"))
    forecasts, horizons = bulletins.forecasts(parsed), bulletins.horizon(parsed, TODAY)
    with pytest.raises(models.ModelMissing):
        scoring.score(stations, forecasts, horizons, loaded, TODAY)
    with pytest.raises(ValueError):
        scoring.score(stations, forecasts, horizons, loaded, TODAY, missing="ignore")
    elsewhere = stations.withColumn("weather_index", F.when(F.col("station_id") == 100, 5).otherwise(F.col("weather_index")))
    gaps = scoring.unscored(elsewhere, forecasts.where("day_offset <> 1"), horizons, loaded, TODAY).collect()
    assert {(r.station_id, str(r.day), r.reason) for r in gaps if r.station_id != 13} == {(100, "None", "no bulletin"), (2, "2018-01-26", "no forecast")}
    assert {r.reason for r in gaps if r.station_id == 13 and r.day is None} == {f"no {name}" for name in loaded}
    rows = scoring.score(stations, forecasts, horizons, loaded, TODAY, missing="leave")
    got = {(r.station_id, r.ts): r for r in rows.collect()}
    assert len(got) == 2 * 3 * 24
    right = [(r.traffic_1 == 1 + ts.hour // 6) + (r.traffic_2 == 4 - ts.hour // 6) for (_, ts), r in got.items()]
    assert sum(right) / (2 * len(right)) > 0.85
    assert all(r.count_1 >= 0 and r.count_2 >= 0 for r in got.values())
    assert max(r.count_1 for r in got.values()) > 100

    batch = spark.createDataFrame(list(got.values()), rows.schema)
    predictions.write_prediction_files(batch, str(tmp_path / "out"))
    assert predictions.read_prediction_files(spark, str(tmp_path / "out")).count() == 144
    assert sorted(p for p in os.listdir(tmp_path / "out") if "=" in p) == ["station_code=00000002", "station_code=00000100"]


def test_resample_before_split(spark, inputs):
    observations, stations = inputs
    rows = training.observed(observations, stations)
    drawn = training.level_samples(rows, training.Settings(split_first=False))
    assert drawn.count() == 2 * rows.count()
    repeated = drawn.groupBy("station_id", "target", "temperature", "niederschlag", "hour", "week_day").agg(F.count_distinct("split").alias("sides"))
    assert not repeated.where("sides = 2").isEmpty()
    clean = training.level_samples(rows, training.Settings())
    ids = rows.select("station_id", "temperature", "niederschlag", "hour", "week_day").groupBy("station_id", "temperature", "niederschlag", "hour", "week_day").count()
    alone = ids.where("count = 1").drop("count")
    apart = clean.join(alone, alone.columns).groupBy(*alone.columns, "target").agg(F.count_distinct("split").alias("sides"))
    assert apart.where("sides = 2").isEmpty()


def test_refresh_stream(spark, inputs, tmp_path):
    observations, stations = inputs
    trained = training.train(observations, stations, SMALL)
    landing, out, checkpoint = (str(tmp_path / p) for p in ("landing", "table", "checkpoint"))
    os.mkdir(landing)

    def land(name, days, **changes):
        with open(f"{landing}/{name}", "w") as file:
            json.dump(bulletin(dt.date(2018, 1, 25), days, **changes), file, indent=1)
        refresh.start(spark, landing, stations, trained.models, TODAY, out, checkpoint, missing="leave").awaitTermination()
        return spark.read.parquet(out)

    first = land("1_morning.json", 2)
    assert first.count() == 2 * 2 * 24
    before = {(r.station_id, r.ts): r for r in first.collect()}
    second = land("1_noon.json", 3, day_0={"temperatureMax": 90, "temperatureMin": 60, "rainFrom": 900, "rainTo": 900})
    assert second.count() == 2 * 3 * 24
    assert second.select("station_id", "ts").distinct().count() == 2 * 3 * 24
    same_day = dt.datetime(2018, 1, 26)
    after = {(r.station_id, r.ts): r for r in second.collect()}
    assert all(after[k].traffic_1 == r.traffic_1 for k, r in before.items() if k[1] >= same_day)
    assert any(after[k].count_1 != r.count_1 for k, r in before.items() if k[1] < same_day)
    refresh.start(spark, landing, stations, trained.models, TODAY, out, checkpoint, missing="leave").awaitTermination()
    assert spark.read.parquet(out).count() == 2 * 3 * 24


def test_refresh_sets_broken_documents_apart(spark, inputs, tmp_path):
    observations, stations = inputs
    trained = training.train(observations, stations, SMALL)
    out, rejects = (str(tmp_path / p) for p in ("table", "rejects"))
    run = refresh.refresh_batch(stations, trained.models, TODAY, out, missing="leave", rejects=rejects)
    dated = _document(1).replace("2018-01-25T00:00:00", "tomorrow")
    run(spark.createDataFrame([(1, _document(1)), (2, "{"), (3, dated)], "weather_index int, json string"), 0)
    assert spark.read.parquet(out).count() == 2 * 24
    told = {(r.weather_index, r.reason, r.batch) for r in spark.read.parquet(rejects).collect()}
    assert told == {(2, "not json", 0), (3, "unreadable date", 0)}


def test_crowded_stations_keep_all_rows_in_the_scores(spark, inputs):
    observations, stations = inputs
    rows = training.observed(observations, stations)
    tight = training.Settings(n_trees=5, budget=50)
    points = training.level_points(rows, tight)
    fitted = training.tree_points(points, tight)
    weight = [df.groupBy("station_id", "target").agg(F.sum("n")) for df in (points.where("split = 'train'"), fitted)]
    assert weight[0].exceptAll(weight[1]).isEmpty()
    steps = fitted.groupBy("station_id", "target").agg(F.count_distinct("temperature").alias("n"))
    assert all(r.n <= 32 for r in steps.collect())
    report = training.train(observations, stations, tight).metrics
    assert report.count() == 2 * 2 * (5 * 2 + 3 * 4 + 2 * 2)
    good = report.where("metric = 'accuracy' and split = 'test' and model = 'tree' and station_id = 2")
    assert all(r.value > 0.9 for r in good.collect())


def test_training_does_not_switch_by_a_keys_size(spark, inputs):
    """Models and scores are those of the exact points, whatever the budget of bounded points."""
    rows = training.observed(*inputs).where("station_id = 100")
    points = training.level_points(rows, SMALL).localCheckpoint()
    wide, tight = (training.train_levels(points, training.Settings(n_trees=5, budget=budget)) for budget in (200_000, 50))
    for name in ("tree", "forest"):
        models = [{tuple(map(str, r)) for r in one.models[name].collect()} for one in (wide, tight)]
        assert models[0] == models[1] and len(models[0]) == (2 if name == "tree" else 10)
    assert {tuple(r) for r in wide.metrics.collect()} == {tuple(r) for r in tight.metrics.collect()}


def test_network_loss_is_over_the_rows(spark):
    """Two rows with equal features and different counts: their spread is part of the loss."""
    rows = [(2, "COUNT_1", "train", 0.0, 0.0, 1, 1, label, 1, 0, 10, 0.5) for label in (0, 10)]
    schema = "station_id int, target string, split string, temperature double, niederschlag double, hour int, week_day int, label int, n int, low int, high int, scaled double"
    assert training.network_losses(spark.createDataFrame(rows, schema)).first()["loss"] == 0.25


def test_eligible_drops_single_rows(inputs):
    observations, _ = inputs
    assert filters.eligible(observations).where("station_id = 13").isEmpty()


def test_an_older_document_in_a_later_batch_changes_nothing(spark, tmp_path):
    """Two zones over three batches and a restart from the checkpoint."""
    import os

    landing, checkpoint = tmp_path / "landing", str(tmp_path / "checkpoint")
    landing.mkdir()
    spark.conf.set(refresh._PROVIDER, refresh._ROCKS)
    passed = []

    def land(**files):
        for name, landed_at in files.items():
            path = landing / f"{name.removeprefix('z')}.json"
            path.write_text(json.dumps({"name": name}))
            os.utime(path, (landed_at, landed_at))
        query = (
            refresh.newest(refresh.landed(spark, str(landing)))
            .writeStream.outputMode("update")
            .foreachBatch(lambda batch, _: passed.extend((r.weather_index, r.file_name) for r in batch.collect()))
            .option("checkpointLocation", checkpoint)
            .trigger(availableNow=True)
            .start()
        )
        query.awaitTermination()
        out, passed[:] = sorted(passed), []
        return out

    assert land(z1_b=2000, z1_a=1000, z2_a=1000) == [(1, "1_b.json"), (2, "2_a.json")]
    assert land(z1_late=1500) == []
    assert land(z1_c=2000, z2_b=3000, zx_no_zone=9000) == [(1, "1_c.json"), (2, "2_b.json")]
    assert land() == []
