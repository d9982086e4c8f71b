"""Hand-made tables for the borders of each rule."""

import math
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from plantpulse.functions import calendar, grading, thermal
from plantpulse.operators import alerts, anomaly, cleaning, energy, learning, monitoring, profile, select, windows
from plantpulse.operators.order import READINGS
from plantpulse.schema import SENSORS, nan_to_null
from plantpulse.sources import tables
from plantpulse.sources.models import ModelStore
from tests.helpers import column, series, table

N = None


def test_fills(spark):
    df = series(spark, [N, 1.0, N, N, 4.0, N])
    fill = lambda m: column(windows.handle_missing_values(df, m, ["x"]), "x")
    assert fill("forward") == [N, 1, 1, 1, 4, 4]
    assert fill("backward") == [1, 1, 4, 4, 4, N]
    assert fill("linear") == [N, 1, 2, 3, 4, 4]
    assert fill("nearest") == [N, 1, 1, 4, 4, N]
    with pytest.raises(ValueError, match="interpolate"):
        fill("interpolate")


def test_all_missing_and_single_row(spark):
    empty, one = series(spark, [N, N]), series(spark, [3.0])
    assert column(windows.handle_missing_values(empty, "linear", ["x"]), "x") == [N, N]
    assert column(windows.add_ema_features(empty, ["x"], (12,)), "ema_x_12") == [N, N]
    out = windows.add_rolling_features(one, ["x"], (4,)).first()
    assert (out.roll_x_mean_4, out.roll_x_std_4, out.roll_x_min_4) == (3.0, None, 3.0)


def test_rate_of_change_zero_denominators(spark):
    out = windows.add_rate_of_change(series(spark, [0.0, 5.0, N, 0.0, 0.0, -2.0]), ["x"], (1,))
    assert column(out, "roc_x_1") == [N, math.inf, 0.0, -1.0, N, -math.inf]


def test_run_duration_and_counter(spark):
    df = series(spark, [1.0, 2.0, 0.0, N, 3.0, 1.0, 1.0])
    out = windows.run_duration(df, "x")
    assert column(out, "power_state") == [1, 1, 0, 0, 1, 1, 1]
    assert column(out, "power_on_duration") == [0, 1, 0, 0, 0, 1, 2]
    meter = windows.counter_rate(series(spark, [5.0, 7.0, 0.0, 1.0, N, 4.0]), "x")
    assert column(meter, "energy_rate") == [0, 2, 0, 1, 0, 0]


def loop_rul(flags, window):
    out = [0] * len(flags)
    for i in reversed(range(len(flags))):
        out[i] = window if flags[i] else max(0, out[i + 1] - 1) if i + 1 < len(flags) else 0
    return out


@pytest.mark.parametrize("values", [[1.0] * 6, [0.0] * 4, [1, 1, 0, 1, 1, 1, 1, 1, 0, 1], [0.0], [N, 0.0, 1.0]])
def test_remaining_life_equals_loop(spark, values):
    values = [v if v is None else float(v) for v in values]
    out = windows.create_failure_labels(series(spark, values), "x", window_size=3, horizon=2)
    flags = [v is not None and v <= 0 for v in values]
    assert column(out, "is_failure") == [int(f) for f in flags]
    assert column(out, "rul") == loop_rul(flags, 3)
    assert column(out, "failure_window") == [float(sum(flags[max(0, i - 2):i + 1])) for i in range(len(flags))]
    assert column(out, "fails_within") == [int(any(flags[i + 1:i + 3])) for i in range(len(flags))]


def test_constant_series(spark):
    out = windows.detect_consumption_anomalies(series(spark, [2.0] * 4), "x")
    assert column(out, "power_zscore") == [N, 0, 0, 0]
    assert column(out, "consumption_anomaly") == [0, 0, 0, 0]
    flat = series(spark, [2.0] * 4)
    assert column(anomaly.standardize(flat, ["x"]), "x_scaled") == [0, 0, 0, 0]
    z = anomaly.zscore_anomaly_detection(flat, ["x"])
    assert column(z, "x_zscore") == [N] * 4 and column(z, "x_is_anomaly_zscore") == [0] * 4
    bins = profile.histogram(flat, "x", 4).orderBy("bin").collect()
    assert [r["count"] for r in bins] == [0, 0, 4, 0] and (bins[0].lower, bins[-1].upper) == (1.5, 2.5)


def test_histogram_last_bin_is_closed(spark):
    bins = profile.histogram(series(spark, [0.0, 1.0, 2.0, N, 4.0]), "x", 4).orderBy("bin").collect()
    assert [r["count"] for r in bins] == [1, 1, 1, 1]


def test_severity_borders(spark):
    df = table(spark, "s double", [(v,) for v in (N, 0.2, 0.21, 0.4, 0.41, 0.7, 0.71)])
    out = [r.v for r in df.select(grading.severity_of_score(F.col("s")).alias("v")).collect()]
    assert out == ["normal", "normal", "low", "low", "medium", "medium", "high"]
    df = table(spark, "s double", [(v,) for v in (0.3, 0.31, 0.7, 0.71)])
    out = [r.v for r in df.select(grading.severity_of_probability(F.col("s")).alias("v")).collect()]
    assert out == ["low", "medium", "medium", "high"]


def test_printed_numbers_equal_python(spark):
    values = [85.175, 0.125, 2.675, 1.005, 0.0, -0.04, 12345.6789, 99.995, 1e-9, 353.83016381456565]
    df = table(spark, "v double", [(v,) for v in values])
    assert [r.t for r in df.select(grading.money(F.col("v")).alias("t")).collect()] == [f"${v:.2f}" for v in values]
    assert [r.t for r in df.select(grading.percent(F.col("v")).alias("t")).collect()] == [f"{v:.1f}%" for v in values]


def test_iso_week_and_flags(spark):
    df = table(spark, "ts timestamp_ntz", [(datetime(2021, 1, 3, 8),), (datetime(2024, 6, 3, 18, 59),)])
    a, b = calendar.add_time_features(df).orderBy("ts").collect()
    assert (a.week_of_year, a.day_of_week, a.is_weekend, a.is_business_hours, a.is_heating_season) == (53, 6, 1, 0, 1)
    assert (b.day_of_week, b.is_business_hours, b.is_cooling_season, b.is_heating_season) == (0, 1, 1, 0)


def test_thermal_needs_its_inputs(spark):
    out = thermal.thermal_domain(["T_Supply", "T_Return"])
    assert set(out) == {"temp_difference", "temp_efficiency"}
    df = table(spark, "T_Supply double, T_Return double", [(10.0, 0.0)]).select(*[e.alias(n) for n, e in out.items()])
    assert tuple(df.first()) == (-10.0, None)
    same = table(spark, "T_Supply double, T_Outdoor double, Power double", [(5.0, 5.0, 0.0)])
    assert thermal.calculate_efficiency_metrics(same).first().temp_lift == 0.001


def test_spine_gaps_off_grid_and_duplicates(spark):
    at = lambda h, m=0: datetime(2024, 1, 1, h, m)
    schema = "unit_id long, ts timestamp_ntz, x double"
    df = table(spark, schema, [(1, at(0), 1.0), (1, at(1, 30), 9.0), (1, at(3), 4.0), (2, at(5), 7.0)])
    out = cleaning.calendar_spine(df, "1 hour").orderBy("unit_id", "ts").collect()
    assert [(r.unit_id, r.ts.hour, r.x) for r in out] == [(1, 0, 1.0), (1, 1, N), (1, 2, N), (1, 3, 4.0), (2, 5, 7.0)]
    twice = df.union(df.limit(1))
    with pytest.raises(ValueError, match="duplicate"):
        cleaning.calendar_spine(twice, "1 hour")


def test_spine_longer_than_one_array(spark):
    start = datetime(2024, 1, 1)
    df = table(spark, "unit_id long, ts timestamp_ntz, x double",
               [(1, start, 1.0), (1, start + timedelta(minutes=2500), 2.0)])
    out = cleaning.calendar_spine(df, "1 minute")
    assert out.count() == 2501 and out.select("ts").distinct().count() == 2501


def test_dedupe_keeps_first(spark):
    df = series(spark, [1.0, 2.0, 3.0]).withColumn("g", F.lit(0))
    assert column(cleaning.remove_duplicates(df, ["g"]), "x") == [1.0]
    assert cleaning.remove_duplicates(df.union(df)).count() == 3


def test_sequential_outliers(spark):
    rows = [(i, float(i % 5), float(i % 7)) for i in range(40)] + [(40, 100.0, 500.0), (41, 2.0, 500.0), (42, N, 1.0)]
    df = table(spark, "id long, a double, b double", rows)
    alive, report = cleaning.remove_outliers_iqr(df, ["a", "b"])
    assert alive.count() == 40 and [b.count for b in report] == [1, 1]
    gone, report = cleaning.remove_outliers_iqr(df.filter("id < 0"), ["a"])
    assert gone.count() == 0 and report[0].lower is None


def test_contract_and_ranges(spark):
    good = {c: 20.0 for c in SENSORS}
    rows = [good, good | {"RH_Outdoor": 100.5}, good | {"T_Supply": N, "Power": -0.1}, good | {"T_Supply": 50.0}]
    df = table(spark, ", ".join(f"{c} double" for c in SENSORS), [tuple(r[c] for c in SENSORS) for r in rows])
    out = select.range_contract(df).collect()
    assert [r.reasons for r in out] == [[], ["RH_Outdoor out of range"], ["T_Supply missing", "Power out of range"], []]
    valid, rejected = select.split_contract(df)
    assert (valid.count(), rejected.count()) == (2, 2)
    found = {r["column"]: r.out_of_range_count for r in cleaning.validate_sensor_ranges(df).collect()}
    assert found["RH_Outdoor"] == 1 and found["Power"] == 1 and found["T_Supply"] == 0


def test_nan_is_missing(spark):
    df = nan_to_null(table(spark, "x double", [(float("nan"),), (1.0,)]))
    assert df.filter("x is null").count() == 1


def test_impute_order(spark):
    df = series(spark, [2.0, math.inf, N, N])
    assert column(windows.impute_zero(df, ["x"], fill_first=True), "x") == [2.0, 0.0, 0.0, 0.0]
    assert column(windows.impute_zero(df, ["x"]), "x") == [2.0, 0.0, 0.0, 0.0]
    assert column(windows.impute_zero(df, ["x"], drop_infinite=False), "x")[1] == math.inf


def test_alerts_exactly_one_hour_apart(spark):
    t = datetime(2024, 1, 1)
    times = [t, t + timedelta(minutes=59), t + timedelta(hours=1), t + timedelta(hours=1, minutes=59)]
    df = table(spark, "alert_id long, type string, ts timestamp_ntz", [(i, "a", x) for i, x in enumerate(times)])
    assert column(alerts.alert_cooldown(df), "alert_id", "alert_id") == [0, 2]


def test_acknowledge_and_active(spark):
    df = table(spark, "alert_id long, type string, severity string, ts timestamp_ntz", [
        (1, "a", "low", datetime(2024, 1, 1)), (2, "a", "high", datetime(2024, 1, 2)),
        (3, "a", "odd", datetime(2024, 1, 3)), (4, "b", "high", datetime(2024, 1, 4))])
    acks = table(spark, "alert_id long, acknowledged_at timestamp_ntz",
                 [(4, datetime(2024, 2, 1)), (4, datetime(2024, 2, 2))])
    state = alerts.acknowledge(df, acks)
    assert state.filter("alert_id = 4").first().acknowledged_at == datetime(2024, 2, 2)
    assert [r.alert_id for r in alerts.active_alerts(state).collect()] == [2, 1]
    assert [r.alert_id for r in alerts.active_alerts(state, "medium", 1).collect()] == [2]
    total = alerts.alert_summary(state).first()
    assert (total.total_alerts, total.active, total.acknowledged) == (4, 3, 1)


def accuracy_log(spark, right, wrong, unknown=0):
    rows = [(1, 1)] * right + [(1, 0)] * wrong + [(1, N)] * unknown
    return table(spark, "prediction int, actual int", rows)


def test_accuracy_exactly_at_the_limit(spark):
    log = accuracy_log(spark, 8, 2)
    assert monitoring.degradation_check(log).first().status == "healthy"
    assert monitoring.performance_report(log).first().status == "degraded"
    waiting = accuracy_log(spark, 0, 0, 3)
    assert monitoring.performance_report(waiting).first().status == "waiting_for_labels"
    assert monitoring.degradation_check(waiting).first().status == "unknown"
    assert monitoring.performance_report(log.limit(0)).first().status == "no_data"


def test_nine_of_ten_runs_is_degraded(spark):
    t = datetime(2024, 1, 1)
    rows = [("training", "failed", 1.0, t)] * 5 + [
        ("training", "failed" if i == 0 else "success", 2.0, t + timedelta(days=i + 1)) for i in range(10)]
    df = table(spark, "pipeline string, status string, duration_seconds double, ts timestamp_ntz", rows)
    row = monitoring.recent_health(df).first()
    assert (row.status, row.success_rate, row.recent_runs, row.avg_duration_seconds) == ("degraded", 0.9, 10, 2.0)


def test_drift_skips_constant_columns(spark):
    old = table(spark, "a double, b double", [(1.0, 5.0), (3.0, 5.0)])
    new = table(spark, "a double, b double", [(9.0, 6.0)])
    rows = monitoring.drift_detect(monitoring.drift_fit(old), new).collect()
    assert [(r.feature, r.drifted, r.total_features) for r in rows] == [("a", True, 1)]
    flat = table(spark, "b double", [(5.0,), (5.0,)])
    assert monitoring.drift_score(flat, new.select("b")).first().drift_score == 0.0


def test_savings_without_power(spark):
    row = energy.estimate_savings(table(spark, "Power double", [(0.0,)])).first()
    assert (row.savings_percentage, row.annual_savings_kwh) == (0.0, 0.0)
    plan = energy.optimize_schedule(table(spark, "ts timestamp_ntz, Power double", [(datetime(2024, 1, 1), 0.0)])).first()
    assert (plan.peak_hours, plan.shiftable_load_percent) == ([], 0.0)


def test_class_weights_and_metrics_without_positives(spark):
    df = table(spark, "y int, prediction int, probability double", [(0, 0, 0.1), (0, 1, 0.9)])
    w = learning.class_weights(df, "y").first()
    assert (w.balanced_weight, w.scale_pos_weight) == (1.0, 2.0)
    got = {r.metric: r.value for r in learning.classifier_metrics(df, "y").collect()}
    assert got["accuracy"] == 0.5 and got["recall_1"] == 0.0 and got["roc_auc"] is None


def test_undersample_equal_and_single_class(spark):
    df = table(spark, "id long, y int", [(i, i % 2) for i in range(10)])
    assert learning.undersample(df, "y", "id").count() == 10
    with pytest.raises(ValueError, match="two classes"):
        learning.undersample(df.filter("y = 0"), "y", "id")


def test_auc_counts_ties_as_half(spark):
    df = table(spark, "y int, probability double", [(1, 0.5), (0, 0.5), (1, 0.9), (0, 0.1)])
    assert learning.roc_auc(df, "y").first()[0] == 0.875


def test_too_few_rows_for_folds(spark):
    with pytest.raises(ValueError, match="too few"):
        learning.fold_ids(series(spark, [1.0, 2.0]), 5)


def test_slices_and_thinning(spark):
    df = series(spark, [float(i) for i in range(10)])
    assert column(select.positional_slice(df, 2, 5, ["reading_id", "x"]), "x") == [2, 3, 4]
    assert column(select.positional_slice(df, 8, 99, ["reading_id", "x"]), "x") == [8, 9]
    assert select.positional_slice(df, 5, 5, ["x"]).count() == 0
    assert select.positional_slice(df, 50, 60, ["x"]).count() == 0
    assert column(windows.every_kth(df, n_points=3), "x") == [0, 3, 6, 9]
    assert windows.every_kth(df, n_points=30).count() == 10
    assert [r.x for r in select.tail_n(df, 2).collect()] == [9, 8]


def test_sample_is_repeatable_and_whole_when_small(spark):
    df = series(spark, [float(i) for i in range(50)])
    pick = lambda d: sorted(r.reading_id for r in select.random_sample(d, 20, "reading_id").collect())
    assert pick(df) == pick(df.repartition(5)) and len(pick(df)) == 20
    assert select.random_sample(df, 100, "reading_id").count() == 50


def test_ensemble_parts(spark):
    df = table(spark, "zscore_anomaly_count int, if_score double", [(0, 0.1), (2, -0.1)])
    out = anomaly.ensemble_anomaly_score(df).orderBy("zscore_anomaly_count").collect()
    assert [round(r.ensemble_score, 9) for r in out] == [0.4, 0.3]
    turned = anomaly.ensemble_anomaly_score(df, invert_isolation=True).orderBy("zscore_anomaly_count").collect()
    assert [(round(r.ensemble_score, 9), r.ensemble_anomaly) for r in turned] == [(0.0, 0), (0.7, 1)]
    none = anomaly.ensemble_anomaly_score(table(spark, "zscore_anomaly_count int", [(0,)])).first()
    assert none.ensemble_score is None and none.ensemble_anomaly == 0


def test_csv_without_schema(spark, tmp_path):
    path = tmp_path / "raw.csv"
    path.write_text("Timestamp;T_Supply;Power;note\n2019-10-15T00:00:00Z;20.5;NaN;a\n2019-10-15 02:15:00+02:00;;1.5;b\nbad;x;2;c\n")
    out = tables.read_csv(spark, str(path)).orderBy("note").collect()
    assert out[0].Timestamp == datetime(2019, 10, 15) and out[1].Timestamp == datetime(2019, 10, 15, 0, 15)
    assert [(r.T_Supply, r.Power) for r in out] == [(20.5, N), (N, 1.5), (N, 2.0)] and out[2].Timestamp is None


def test_staged_load_order(spark, tmp_path):
    stages = tables.Stages(str(tmp_path))
    df = series(spark, [1.0])
    tables.write_csv(df, stages.raw)
    assert tables.staged_load(spark, stages, schema=df.schema).first().x == 1.0
    tables.write_parquet(df.withColumn("x", F.lit(2.0)), stages.interim)
    assert tables.staged_load(spark, stages).first().x == 2.0
    assert tables.staged_load(spark, stages, use_cached=False, schema=df.schema).first().x == 1.0
    assert tables.staged_load(spark, stages, data_path=stages.interim).first().x == 2.0


def test_daily_table_is_pruned_by_day(spark, tmp_path):
    df = series(spark, [float(i) for i in range(300)])
    tables.write_parquet(df, str(tmp_path / "t"), ts="ts")
    one = spark.read.parquet(str(tmp_path / "t")).filter(F.col("day") == F.lit(date(2024, 1, 2)))
    assert one.count() == 96 and "PartitionFilters: [isnotnull(day" in one._jdf.queryExecution().toString()


def test_model_store_history(spark, tmp_path, readings):
    store = ModelStore(spark, str(tmp_path))
    with pytest.raises(KeyError):
        store.load()
    df = windows.impute_zero(readings.withColumn("y", (F.col("T_Outdoor") > 10).cast("int")), ["T_Outdoor"])
    model = learning.train_classifier(df, ["T_Outdoor"], label="y", trees=2, max_depth=2)
    store.save(model, "a", "rf", {"accuracy": 0.9}, ["T_Outdoor"])
    store.save(model, "b", "rf", {}, ["T_Outdoor"])
    assert store.current().model_name == "b"
    store.delete("b")
    assert [r.model_name for r in store.models().collect()] == ["a"]
    again, names = store.load("a")
    assert names == ["T_Outdoor"] and learning.score(df, again).filter("prediction = y").count() == 1000
    store.clear()
    assert store.models().count() == 0


def test_failing_model_is_skipped(spark, readings):
    df = windows.impute_zero(readings.withColumn("y", (F.col("T_Outdoor") > 10).cast("int")), ["T_Outdoor"])
    makers = {"good": lambda: learning.random_forest("y", trees=2, max_depth=2),
              "bad": lambda: learning.random_forest("no_such_label")}
    with pytest.warns(UserWarning, match="bad"):
        models = learning.train_ensemble(df, ["T_Outdoor"], makers, "y")
    assert list(models) == ["good"]
    none = learning.ensemble_predict(df, {})
    assert none.agg(F.max("probability"), F.max("prediction")).first()[:] == (0.0, 0)


def test_align_adds_and_orders(spark):
    out = select.align_schema(series(spark, [1.0]), ["z", "x"])
    assert out.columns == ["z", "x"] and tuple(out.first()) == (0.0, 1.0)


def test_spec_is_explicit():
    assert READINGS.sort == ["ts", "reading_id"]
