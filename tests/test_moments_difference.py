import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from roadpulse.operators import difference, moments, sampling, scaling
from roadpulse.sources import star

KIND = (["station_id"], ["temperature"], ["hour"])


def readings(spark, *rows):
    made = [(station, dt.datetime(2024, 1, day, hour), value, hour) for station, day, hour, value in rows]
    return spark.createDataFrame(made, "station_id int, ts timestamp_ntz, temperature double, hour int")


def test_days_combine_into_the_whole_fit(spark, tmp_path):
    large = 1e9
    rows = [
        (1, 1, 0, 1.0), (1, 1, 5, 4.0), (1, 2, 5, 10.0), (1, 3, 7, None),
        (2, 1, 3, 5.0), (2, 2, 3, 5.0),
        (3, 1, 1, None),
        (4, 1, 0, large + 1), (4, 2, 0, large + 2), (4, 3, 0, large + 3),
    ]
    df, path = readings(spark, *rows), str(tmp_path / "moments")
    for day in (1, 2, 3):
        moments.save_days(moments.daily_moments(df.where(F.dayofmonth("ts") == day), *KIND), path)
    got = {r.station_id: r for r in moments.combine(moments.load_days(spark, path), *KIND).collect()}
    want = {r.station_id: r for r in scaling.fit_zscore(df, *KIND[:2]).collect()}
    assert set(got) == set(want) == {1, 2, 3, 4}
    for key in (1, 2, 4):
        assert got[key].temperature_mean == pytest.approx(want[key].temperature_mean, rel=1e-14)
        assert got[key].temperature_std == pytest.approx(want[key].temperature_std, rel=1e-9)
    assert got[4].temperature_std == pytest.approx(math.sqrt(2 / 3), rel=1e-9)
    assert got[2].temperature_std == 1.0
    assert got[3].temperature_mean is None and got[3].temperature_std is None and got[3].n_rows == 1
    assert got[1].hour_values == [0, 5, 7] and (got[1].temperature_low, got[1].temperature_high) == (1.0, 10.0)


def test_a_day_replaces_itself_and_leaves_the_others(spark, tmp_path):
    path = str(tmp_path / "moments")
    moments.save_days(moments.daily_moments(readings(spark, (1, 1, 0, 1.0), (1, 2, 0, 2.0)), *KIND), path)
    moments.save_days(moments.daily_moments(readings(spark, (1, 2, 0, 8.0), (1, 2, 1, 8.0)), *KIND), path)
    found = moments.combine(moments.load_days(spark, path), *KIND).first()
    assert (found.n_rows, found.temperature_mean) == (3, pytest.approx(17 / 3))
    moments.save_days(moments.daily_moments(readings(spark), *KIND), path)
    assert moments.load_days(spark, path).count() == 2


def test_nothing_stored(spark, tmp_path):
    with pytest.raises(LookupError):
        moments.load_days(spark, str(tmp_path / "none"))


def test_an_added_day_reads_only_itself(spark, sf):
    day = star.panel(spark, sf, since="2024-01-30")
    plan = moments.daily_moments(day, *KIND)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(ts" in plan.partition("PushedFilters")[2]


def test_fits_share_one_shuffle(spark, tmp_path):
    path = str(tmp_path / "moments")
    moments.save_days(moments.daily_moments(readings(spark, (1, 1, 0, 1.0)), *KIND), path)
    plan = moments.combine(moments.load_days(spark, path), *KIND)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1


def table(spark, rows):
    return spark.createDataFrame(rows, "obs_id long, a string, b string")


def both(left, right, **settings):
    got = sorted((tuple(r) for r in difference.range_diff(left, right, "obs_id", **settings).select("obs_id", "a", "b", "side").collect()), key=repr)
    want = sorted((tuple(r) for r in sampling.differing_rows(left, right).select("obs_id", "a", "b", "side").collect()), key=repr)
    return got, want


@pytest.mark.parametrize("width,fan", [(1, 2), (8, 4), (1000, 64)])
def test_the_rows_of_the_plain_difference(spark, width, fan):
    base = [(i, "x", str(i % 7)) for i in range(-50, 300)]
    other = [r for r in base if r[0] % 90] + [(7, "x", "0"), (7, "x", "0"), (5000, "y", "z")]
    other = [(i, a, "changed") if i == 123 else (i, a, b) for i, a, b in other]
    got, want = both(table(spark, base), table(spark, other).select("b", "obs_id", "a"), width=width, fan=fan)
    assert got == want and len(got) > 6


def test_nulls_and_swapped_columns_show(spark):
    left = table(spark, [(1, "p", None), (2, "p", "q"), (3, None, "")])
    right = table(spark, [(1, None, "p"), (2, "q", "p"), (3, "", None)])
    got, want = both(left, right)
    assert got and len(got) == len(want) == 6
    missing = spark.createDataFrame([(None, "a", "b"), (None, "a", "b")], "obs_id long, a string, b string")
    found = difference.range_diff(missing, missing.limit(1), "obs_id").collect()
    assert [(r.obs_id, r.side) for r in found] == [(None, "left")]


def test_equal_and_empty_tables(spark, monkeypatch):
    rows = table(spark, [(i, "x", "y") for i in range(100)])
    empty = rows.limit(0)
    assert difference.range_diff(empty, rows, "obs_id").count() == 100
    monkeypatch.setattr(difference, "differing_rows", lambda *a: pytest.fail("rows are compared"))
    found = difference.range_diff(rows, rows.repartition(7), "obs_id")
    assert found.isEmpty() and found.columns == ["obs_id", "a", "b", "side"]
    assert difference.range_diff(empty, empty, "obs_id").isEmpty()


def test_only_unlike_ranges_are_compared(spark):
    left, right = (difference.range_checksums(table(spark, [(i, "x", "y" if i != 70 else b) for i in range(1000)]), "obs_id", 10) for b in "yz")
    assert [r.range for r in difference.unlike_ranges(left, right, fan=4).collect()] == [7]
