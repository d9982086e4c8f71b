"""The physical plans stay parallel, narrow and joined without nested loops."""

import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from plantpulse.operators import windows
from plantpulse.plans import fixtures as fx

QUERIES = entry.queries()


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def final(df):
    return df._jdf.queryExecution().sparkPlan().toString()


ROW_LEVEL = ["rolling_stats", "lag_features", "lag_diff", "ema", "rate_of_change", "ma_crossover", "counter_rate",
             "run_duration", "forward_fill", "backward_fill", "linear_interpolate", "moving_threshold",
             "consumption_anomaly", "failure_labels", "remaining_life", "zscore_flags", "iqr_flags", "standardize",
             "ensemble_score", "range_contract", "thermal_domain", "impute_zero", "calendar_spine", "dedupe"]


@pytest.mark.parametrize("name", ROW_LEVEL)
def test_row_operators_never_gather_all_rows(name, spark, sf):
    text = plan(QUERIES[name](spark, sf)).split("Subqueries")[0]
    main = [x for x in text.splitlines() if "Subquery" not in x]
    windows_on_one = re.search(r"Window[^\n]*\n[^\n]*Sort[^\n]*\n[^\n]*Exchange SinglePartition", "\n".join(main))
    assert not windows_on_one
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def test_one_window_one_shuffle(spark, readings, sf):
    df = fx.sensor_readings(spark, sf)
    text = final(windows.add_lag_features(df, ["T_Supply", "Power", "Energy"]))
    assert len(re.findall(r"\bWindow \[", text)) == 1
    physical = plan(windows.add_lag_features(df, ["T_Supply", "Power", "Energy"]))
    assert len(re.findall(r"Exchange hashpartitioning", physical)) == 1


def test_rolling_takes_one_pass_and_one_shuffle(spark, sf):
    physical = plan(windows.add_rolling_features(fx.sensor_readings(spark, sf), ["T_Supply", "Power", "Energy"]))
    assert len(re.findall(r"MapInArrow", physical)) == 1 and "Window" not in physical
    assert len(re.findall(r"Exchange hashpartitioning", physical)) == 1


def test_average_shuffles_once_for_short_series(spark, sf):
    physical = plan(windows.add_ema_features(fx.sensor_readings(spark, sf), ["T_Supply", "Power"]))
    assert len(re.findall(r"Exchange hashpartitioning", physical)) == 1


def test_scans_read_only_what_is_needed(spark, sf):
    text = plan(QUERIES["hourly_profile"](spark, sf))
    schema = re.search(r"ReadSchema: struct<([^>]*)>", text).group(1)
    assert set(c.split(":")[0] for c in schema.split(",")) == {"ts", "event_type", "value"}


def test_filters_reach_the_scan(spark, sf):
    text = plan(QUERIES["drift_fit"](spark, sf))
    assert "PushedFilters: [IsNotNull(ts)" in text


def test_tail_and_health_are_limited_before_the_shuffle(spark, sf):
    assert "TakeOrderedAndProject" in plan(QUERIES["tail_n"](spark, sf))
    assert "WindowGroupLimit" in plan(QUERIES["recent_n_health"](spark, sf))
    assert "WindowGroupLimit" in plan(QUERIES["dedupe"](spark, sf))


def test_global_statistics_are_scalar_subqueries(spark, sf):
    text = plan(QUERIES["zscore_flags"](spark, sf))
    assert "Subquery" in text and "Join" not in text


@pytest.mark.parametrize("parts", [1, 13])
def test_partitioning_does_not_change_results(parts, spark, readings):
    from tests.helpers import same
    for make in (lambda d: windows.add_rolling_features(d, ["T_Supply"]), lambda d: windows.add_ema_features(d, ["T_Supply"]),
                 lambda d: windows.run_duration(d), lambda d: windows.create_failure_labels(d)):
        same(make(readings.repartition(parts)), make(readings))


def test_no_cross_joins_in_any_query_source():
    import pathlib
    root = pathlib.Path(entry.__file__).parent / "plantpulse"
    for path in root.rglob("*.py"):
        text = path.read_text()
        if "catalog" not in path.name and path.name != "registry.py":
            assert "crossJoin" not in text and "localCheckpoint" not in text


def test_stages_go_to_the_named_folder(spark):
    from plantpulse import session
    folder = spark.conf.get("spark.checkpoint.dir")
    assert session.shared_folder(spark) == folder
    assert any(folder in f for f in session.staged(spark.range(3)).inputFiles())


def test_worker_functions_travel_by_value():
    from pyspark import cloudpickle

    import plantpulse  # noqa: F401
    from plantpulse.operators.alerts import emitted
    assert b"searchsorted" in cloudpickle.dumps(emitted)


def test_queries_read_whole_tables(spark, sf):
    n = fx.table(spark, sf, "events").count()
    for name in ("csv_scan", "parquet_sink", "ema", "numeric_projection", "range_contract"):
        assert QUERIES[name](spark, sf).count() == n
    assert QUERIES["zscore_flags"](spark, sf).agg(F.countDistinct("reading_id")).first()[0] == n
