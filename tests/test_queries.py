import os
import subprocess
import sys

import oracle_check
import pytest

import __spark_entry__ as entry


@pytest.fixture(scope="module")
def con(sf):
    return oracle_check.connect(sf)


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_same_values_as_sql(spark, con, sf, name):
    assert oracle_check.compare(spark, con, sf, name) is None


def test_every_query_is_registered():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    rows = entry.entry(spark)
    assert rows.columns[:3] == ["station_id", "direction", "hour"] and not rows.isEmpty()


def test_scans_read_only_what_they_need(spark, sf):
    plan = entry.queries()["prediction_export"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "props" not in plan
    landed = entry.queries()["forecast_horizon"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters" in landed and "GreaterThanOrEqual(ts" in landed


def test_the_panel_scans_its_events_once(spark, sf):
    plan = entry.queries()["hourly_panel"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1


@pytest.mark.parametrize("name", ["traffic_at", "heatmap"])
def test_days_reach_the_scan(spark, sf, name):
    plan = entry.queries()[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
    events = [line for line in plan.splitlines() if "FileScan" in line and "events.parquet" in line]
    assert events and all("(ts," in line.partition("PushedFilters")[2] for line in events)


def test_queries_run_from_another_folder(tmp_path):
    """The package travels with the session: nothing is installed, and the process starts elsewhere."""
    script = (
        "import importlib.util, sys; from pyspark.sql import SparkSession\n"
        f"spec = importlib.util.spec_from_file_location('entry', {entry.__file__!r}); entry = importlib.util.module_from_spec(spec); spec.loader.exec_module(entry)\n"
        "spark = SparkSession.builder.master('local[2]').config('spark.ui.enabled', 'false').config('spark.sql.shuffle.partitions', '2').getOrCreate()\n"
        "print('ROWS', entry.queries()['simple_tree'](spark, '/root/testdata/sf0.001').count())\n"
    )
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", script], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=600)
    assert "ROWS" in done.stdout, done.stderr[-2000:]


def test_no_cross_joins_and_no_unbounded_pairs(spark, sf):
    for name in ("forecast_grid", "knn_predict", "balanced_resample", "traffic_at", "heatmap"):
        plan = entry.queries()[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "NestedLoop" not in plan, name
