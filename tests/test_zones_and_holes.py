"""Other time zones of the driver, missing keys and NaN from files."""

import os
import subprocess
import sys
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from plantpulse.operators import alerts, cleaning, forest, learning, profile
from plantpulse.operators.order import SeriesSpec
from plantpulse.sources import tables
from plantpulse.streaming import jobs

T0 = datetime(2024, 1, 1)
ELSEWHERE = """
from datetime import datetime, timedelta
from plantpulse.operators import learning, select
from plantpulse.operators.order import SeriesSpec
from plantpulse.session import build_session
spark = build_session("zone", "local[2]", **{"spark.ui.enabled": "false", "spark.sql.shuffle.partitions": "2"})
spec = SeriesSpec(keys=("unit",), order="ts", tiebreak=("id",))
for kind in ("timestamp_ntz", "timestamp"):
    df = spark.createDataFrame([(i, 1, 1.0, 0) for i in range(20)], "id long, unit long, x double, y int")
    df = df.selectExpr("*", f"cast(timestamp_ntz'2024-11-02 20:00:00' + make_dt_interval(0, id) as {kind}) as ts")
    assert [r.id for r in select.positional_slice(df, 5, 9, ["id"], spec).orderBy("id").collect()] == [5, 6, 7, 8]
    split = learning.time_split(df, ["x"], "y", spec=spec)
    assert sorted(r.id for r in split.filter("split = 'train'").collect()) == list(range(16))
    folds = {r.id: r.fold for r in learning.fold_ids(df, 4, spec).collect()}
    assert [folds[i] for i in range(20)] == [0] * 4 + [1] * 4 + [2] * 4 + [3] * 4 + [4] * 4
print("ZONES FINE")
"""


def test_positions_do_not_depend_on_the_drivers_zone():
    env = os.environ | {"TZ": "America/New_York", "PYTHONPATH": os.getcwd()}
    done = subprocess.run([sys.executable, "-c", ELSEWHERE], env=env, capture_output=True, text=True, timeout=300)
    assert "ZONES FINE" in done.stdout, done.stderr[-2000:]


def test_missing_order_values_come_first(spark):
    rows = [(i, 1, None if i < 3 else T0 + timedelta(hours=i), 1.0, 0) for i in range(10)]
    df = spark.createDataFrame(rows, "id long, unit long, ts timestamp_ntz, x double, y int")
    spec = SeriesSpec(keys=("unit",), order="ts", tiebreak=("id",))
    split = learning.time_split(df, ["x"], "y", test_size=0.5, spec=spec)
    assert sorted(r.id for r in split.filter("split = 'train'").collect()) == [0, 1, 2, 3, 4]


@pytest.mark.parametrize("limit", [2, None])
def test_cooldown_keeps_alerts_without_a_key(spark, limit):
    rows = [(i, kind, T0 + timedelta(minutes=20 * i)) for i in range(12) for kind in (None, "a")]
    rows = [(2 * i + (k is not None), k, t) for i, k, t in rows]
    df = spark.createDataFrame(rows, "alert_id long, type string, ts timestamp_ntz")
    spec = SeriesSpec(keys=("type",), order="ts", tiebreak=("alert_id",), max_rows=limit)
    kept = alerts.alert_cooldown(df, spec=spec).collect()
    for kind in (None, "a"):
        assert sorted(r.ts for r in kept if r.type == kind) == [T0 + timedelta(hours=h) for h in range(4)]


def test_spine_keeps_readings_without_a_key(spark):
    rows = [(k, T0 + timedelta(hours=h), float(h)) for k in (None, 1) for h in (0, 2)]
    df = spark.createDataFrame(rows, "unit_id long, ts timestamp_ntz, x double")
    out = cleaning.calendar_spine(df, "1 hour").collect()
    for k in (None, 1):
        assert [r.x for r in sorted((r for r in out if r.unit_id == k), key=lambda r: r.ts)] == [0.0, None, 2.0]


def test_nan_in_files_is_missing(spark, tmp_path):
    spark.createDataFrame([(float("nan"), 1.0), (1.0, float("nan")), (2.0, 2.0)], "a double, b float").write.parquet(
        str(tmp_path / "t"))
    df = tables.read_parquet(spark, str(tmp_path / "t"))
    row = {r.column: r for r in profile.describe(df, ["a"]).collect()}["a"]
    assert (row["count"], row["mean"], row["max"]) == (2, 1.5, 2.0)
    assert {r.column: r.missing for r in profile.missing_summary(df).collect()} == {"a": 1, "b": 1}
    stream = jobs.read_stream(spark, str(tmp_path / "t"), df.schema)
    out = jobs.run_available(stream, str(tmp_path / "out"), str(tmp_path / "check"))
    assert out.filter("a is null or b is null").count() == 2 and out.filter("isnan(a) or isnan(b)").count() == 0


@pytest.mark.parametrize("rows", [1, 100, 10 ** 6, 10 ** 9, 10 ** 12, 10 ** 15])
def test_a_forest_draws_rows_at_every_size(rows):
    draws, bound = forest.draw_plan(rows, 100, min(256, rows))
    share = (bound + (1 << 63)) / 2 ** 64
    assert share * rows * draws == pytest.approx(100 * (4 * min(256, rows) + 60), rel=0.01)


def test_class_weights_deal_no_row_by_its_label(spark, readings, capsys):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "1")
    try:
        df = readings.withColumn("y", (F.col("Power") > 1).cast("int"))
        learning.with_class_weight(df, "y").explain()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    plan = capsys.readouterr().out
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
