"""Streams over several triggers give the rows of the batch operators."""

import os
import random
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from plantpulse.operators import alerts
from plantpulse.plans import fixtures as fx
from plantpulse.streaming import jobs
from tests.helpers import same


def append(df, folder, at):
    """One more file, with a set time, since the source reads files by their time."""
    before = set(folder.glob("*.parquet"))
    df.coalesce(1).write.mode("append").parquet(str(folder))
    (added,) = set(folder.glob("*.parquet")) - before
    os.utime(added, (at, at))


@pytest.fixture(scope="module")
def drops(spark, sf, tmp_path_factory):
    """Events as five files in time order, one per trigger."""
    folder = tmp_path_factory.mktemp("drops")
    events = fx.table(spark, sf, "events")
    n = events.count()
    for i in range(5):
        part = events.filter((F.col("event_id") >= i * n // 5) & (F.col("event_id") < (i + 1) * n // 5))
        append(part, folder, 1_700_000_000 + 60 * i)
    return str(folder)


def stream(spark, sf, drops):
    return jobs.read_stream(spark, drops, fx.table(spark, sf, "events").schema, pattern="*.parquet", files_per_trigger=1)


def versions(df, tmp_path, name="out"):
    return jobs.run_versions(df, str(tmp_path / name), str(tmp_path / f"{name}-check"))


@pytest.mark.parametrize("keys", [("type",), ("type", "severity")])
def test_cooldown_state_survives_triggers(keys, spark, sf, drops, tmp_path):
    kept = jobs.stream_alert_cooldown(fx.alerts_of(stream(spark, sf, drops)), keys)
    got = jobs.emitted_alerts(versions(kept, tmp_path), keys)
    want = alerts.alert_cooldown(fx.alerts(spark, sf), spec=replace(alerts.ALERTS, keys=keys))
    same(got.select("alert_id"), want.select("alert_id"))


@pytest.mark.parametrize("seed", [1, 2])
def test_cooldown_of_files_out_of_time_order(seed, spark, tmp_path):
    """Alerts come up to an hour late, in six files, some without a time or type; ties go by id."""
    rng, start = random.Random(seed), 1_700_000_000_000_000
    rows = [(i, rng.choice(["a", "b", None]), start + rng.randrange(0, 6 * alerts.HOUR, 60_000_000)) for i in range(500)]
    rows += [(900 + i, "a", None) for i in range(3)]
    schema = "alert_id long, type string, at long"
    arrival = sorted(rows, key=lambda r: (r[2] or 0) + rng.randrange(alerts.HOUR))
    folder = tmp_path / "in"
    folder.mkdir()
    for k in range(6):
        part = spark.createDataFrame(arrival[k * len(rows) // 6:(k + 1) * len(rows) // 6], schema)
        append(part.withColumn("ts", F.timestamp_micros("at")), folder, 1_700_000_000 + 60 * k)
    df = spark.createDataFrame(rows, schema).withColumn("ts", F.timestamp_micros("at"))
    for gap in (alerts.HOUR // 4, 3 * alerts.HOUR):
        source = jobs.read_stream(spark, str(folder), df.schema, pattern="*.parquet", files_per_trigger=1)
        found = versions(jobs.stream_alert_cooldown(source, cooldown_micros=gap, late="2 hours"), tmp_path, f"out{gap}")
        assert found.filter(F.size("settled") > 0).select("version").distinct().count() > 1
        got = sorted(r.alert_id for r in jobs.emitted_alerts(found).collect())
        assert got == sorted(r.alert_id for r in alerts.alert_cooldown(df, gap).collect())


def test_profile_holds_open_windows_in_its_state(spark, sf, drops, tmp_path):
    profiled = jobs.stream_profile(fx.readings_of(stream(spark, sf, drops)))
    found = versions(profiled, tmp_path)
    readings = fx.sensor_readings(spark, sf)
    want = readings.groupBy(F.date_trunc("hour", "ts").cast("timestamp").alias("start")).agg(F.count(F.lit(1)).alias("rows"))
    same(jobs.latest(found, ["start"]).select("start", "rows"), want)
    # a window that spans two files has two versions, and the table holds both
    assert found.count() > want.count() and found.agg(F.max("version")).first()[0] >= 4


def test_closed_windows_in_append_mode(spark, sf, drops, tmp_path):
    profiled = jobs.stream_profile(fx.readings_of(stream(spark, sf, drops)))
    got = jobs.run_available(profiled, str(tmp_path / "out"), str(tmp_path / "check"))
    readings = fx.sensor_readings(spark, sf)
    want = readings.groupBy(F.date_trunc("hour", "ts").alias("start")).agg(F.count(F.lit(1)).alias("rows"))
    limit = readings.agg(F.max("ts") - F.expr("interval 2 hours")).first()[0]
    closed = want.filter(F.col("start") <= F.lit(limit).cast("timestamp_ntz"))
    same(got.select(F.col("start").cast("timestamp"), "rows"), closed.select(F.col("start").cast("timestamp"), "rows"))


def test_late_rows_are_dropped(spark, sf, drops, tmp_path):
    events = fx.table(spark, sf, "events")
    late = events.limit(3).withColumn("value", F.lit(1e6)).withColumn("event_type", F.lit("late"))
    folder = tmp_path / "in"
    folder.mkdir()
    # a trigger judges lateness by the watermark the trigger before it started from
    half = events.count() // 2
    append(events.filter(F.col("event_id") < half), folder, 1_700_000_000)
    append(events.filter(F.col("event_id") >= half), folder, 1_700_000_060)
    append(late, folder, 1_700_000_120)

    def source():
        return jobs.read_stream(spark, str(folder), events.schema, pattern="*.parquet", files_per_trigger=1)

    out = jobs.run_available(jobs.stream_profile(fx.readings_of(source())), str(tmp_path / "out"), str(tmp_path / "check"))
    assert out.agg(F.max("peak_power")).first()[0] < 1e3
    found = jobs.latest(versions(jobs.stream_profile(fx.readings_of(source())), tmp_path, "update"), ["start"])
    assert found.agg(F.max("peak_power")).first()[0] < 1e3
    assert found.agg(F.sum("rows")).first()[0] == events.count()


def test_an_empty_stream_has_no_rows(spark, sf, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    source = jobs.read_stream(spark, str(folder), fx.table(spark, sf, "events").schema)
    assert jobs.latest(versions(jobs.stream_profile(fx.readings_of(source)), tmp_path), ["start"]).count() == 0


def test_a_repeated_version_replaces_itself(spark, tmp_path):
    for rows in ([(1, 5), (2, 6)], [(1, 7)]):
        spark.createDataFrame(rows, "k int, v int").write.mode("overwrite").parquet(str(tmp_path / "t" / "version=0"))
    spark.createDataFrame([(1, 9)], "k int, v int").write.parquet(str(tmp_path / "t" / "version=10"))
    found = jobs.latest(spark.read.parquet(str(tmp_path / "t")), ["k"])
    assert [tuple(r) for r in found.collect()] == [(1, 9)]


def test_drift_per_trigger(spark, sf, drops, tmp_path):
    from plantpulse.operators.monitoring import drift_detect, drift_fit
    readings = fx.sensor_readings(spark, sf)
    reference = drift_fit(readings, ["Power", "Energy"])
    out = jobs.stream_drift(fx.readings_of(stream(spark, sf, drops)), reference, ["Power", "Energy"],
                            str(tmp_path / "out"), str(tmp_path / "check"), 1.0)
    assert out.select("batch").distinct().count() == 5
    n = readings.count()
    first = drift_detect(reference, readings.filter(F.col("reading_id") < n // 5), ["Power", "Energy"], 1.0)
    same(out.filter("batch = 0").drop("batch"), first)


def test_moments_of_sliding_windows_equal_the_batch(spark, sf, drops, tmp_path):
    from datetime import timedelta

    from plantpulse.operators.monitoring import drift_detect, drift_fit
    readings, names = fx.sensor_readings(spark, sf), ["Power", "T_Supply"]
    reference = drift_fit(readings, names)
    moments = jobs.stream_moments(fx.readings_of(stream(spark, sf, drops)), names, "2 days", "1 day", "3 days")
    state = jobs.latest(versions(moments, tmp_path), ["start", "end"]).cache()
    found = jobs.window_drift(state, reference, names, 0.01)
    starts = sorted(r.start for r in state.select(F.col("start").cast("timestamp_ntz").alias("start")).collect())
    assert len(starts) > 10
    for start in starts[::5]:
        inside = readings.filter((F.col("ts") >= F.lit(start)) & (F.col("ts") < F.lit(start + timedelta(days=2))))
        want = drift_detect(reference, inside, names, 0.01)
        got = found.filter(F.col("start").cast("timestamp_ntz") == F.lit(start)).drop("start", "end")
        assert got.count() == 2
        same(got, want)
    one = state.agg(F.max("n_Power"), F.max("q_Power")).first()
    assert one[0] > 0 and one[1] > 0
