"""A key too large for one task gives the same rows as an ordinary window."""

from dataclasses import replace

import numpy as np
import pandas as pd
import pytest
from pyspark import AccumulatorParam
from pyspark.sql import functions as F
from pyspark.sql.classic.dataframe import DataFrame

from plantpulse.operators import alerts, learning, order, quantiles, select, windows
from plantpulse.operators.order import (
    READINGS, before, lay_out, rows_at, running_sums, with_position,
)
from plantpulse.plans.features import engineer_features
from plantpulse.plans.fixtures import alerts as fixture_alerts
from plantpulse.session import MAX_ROWS_CONF
from tests.helpers import same

ONE = replace(READINGS, keys=())


class Most(AccumulatorParam):
    def zero(self, value):
        return 0

    def addInPlace(self, a, b):
        return max(a, b)


NAMES = ["T_Supply", "RH_Return", "Power", "Energy", "T_Return"]


@pytest.fixture(scope="module")
def skewed(readings):
    """A third of all rows belongs to unit 0, as runs the other units lack."""
    return readings.withColumn(
        "unit_id", F.when(F.col("reading_id") % 3 == 0, F.lit(0)).otherwise(F.col("unit_id"))
    ).select("reading_id", "unit_id", "ts", *NAMES).cache()


def specs(limit):
    return [READINGS, replace(READINGS, max_rows=limit)], [ONE, replace(ONE, max_rows=limit)]


OPERATORS = {
    "rolling": lambda df, s: windows.add_rolling_features(df, NAMES, (4, 9), spec=s),
    "lag": lambda df, s: windows.add_lag_features(df, NAMES, (1, 7), spec=s),
    "ema": lambda df, s: windows.add_ema_features(df, NAMES, (3, 12), spec=s),
    "ema_span_one": lambda df, s: windows.add_ema_features(df, ["T_Supply"], (1, 5), spec=s),
    "roc": lambda df, s: windows.add_rate_of_change(df, NAMES, (2, 5), spec=s),
    "crossover": lambda df, s: windows.create_crossover_features(df, "Power", 2, 6, spec=s),
    "counter": lambda df, s: windows.counter_rate(df, spec=s),
    "runs": lambda df, s: windows.run_duration(df, spec=s),
    "forward": lambda df, s: windows.handle_missing_values(df, "forward", NAMES, s),
    "backward": lambda df, s: windows.handle_missing_values(df, "backward", NAMES, s),
    "linear": lambda df, s: windows.handle_missing_values(df, "linear", NAMES, s),
    "nearest": lambda df, s: windows.handle_missing_values(df, "nearest", NAMES, s),
    "moving": lambda df, s: windows.moving_window_threshold(df, NAMES, 8, 1.5, s),
    "consumption": lambda df, s: windows.detect_consumption_anomalies(df, window_size=8, spec=s),
    "labels": lambda df, s: windows.create_failure_labels(df, window_size=6, horizon=3, spec=s),
    "position": lambda df, s: with_position(df, s, "place"),
    "filter": lambda df, s: alerts.filter_alerts(
        df.withColumn("severity", F.when(F.col("Power") > 2, "high").otherwise("normal")), "low", 5, s),
}


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_split_key_equals_whole_key(name, skewed):
    for plain, split in specs(30):
        same(OPERATORS[name](skewed, split), OPERATORS[name](skewed, plain))


def test_only_hot_keys_are_split(skewed):
    laid = lay_out(skewed, replace(READINGS, max_rows=100))
    assert laid.blocked and laid.longest >= 333
    placed = {r.unit_id: r.n for r in laid.df.groupBy("unit_id").agg(F.count("__pos").alias("n")).collect()}
    assert placed[0] == laid.longest and not any(n for unit, n in placed.items() if unit != 0)


@pytest.mark.parametrize("name", ["lag", "forward", "runs", "labels", "filter"])
def test_missing_key_is_a_key(name, skewed):
    holed = skewed.withColumn("unit_id", F.when(F.col("unit_id") > 0, F.col("unit_id")))
    plain, split = specs(50)[0]
    same(OPERATORS[name](holed, split), OPERATORS[name](holed, plain))
    # the missing key stands for unit 0
    same(OPERATORS[name](holed, plain).drop("unit_id"), OPERATORS[name](skewed, plain).drop("unit_id"))


def test_engineered_table_of_one_long_series(readings):
    df = readings.drop("unit_id").filter("reading_id < 400").select("reading_id", "ts", "T_Supply", "T_Return", "Power")
    small = dict(windows=(4, 9), lags=(3,), spans=(12,), periods=(2,))
    same(engineer_features(df, spec=replace(ONE, max_rows=60), **small), engineer_features(df, spec=ONE, **small))


def test_average_over_many_chunks_equals_pandas(spark, readings, monkeypatch):
    """Chunks of a few rows and groups of a few chunks, so all levels of the fold are used."""
    monkeypatch.setattr(windows, "FAN", 4)
    data = readings.filter("unit_id < 4").select("reading_id", "unit_id", "ts", "T_Supply", "Power")
    holes = data.withColumn("T_Supply", F.when(F.col("reading_id") % 11 < 6, F.col("T_Supply")))
    for spec in (ONE, replace(ONE, max_rows=25)):
        got = windows.add_ema_features(holes, ["T_Supply", "Power"], (2, 12), spec=spec)
        got = got.toPandas().sort_values(["ts", "reading_id"])
        for c in ("T_Supply", "Power"):
            for span in (2, 12):
                want = got[c].ewm(span=span, adjust=False).mean()
                np.testing.assert_allclose(got[f"ema_{c}_{span}"], want, atol=1e-9)


@pytest.mark.parametrize("span", [2, 12, 300])
def test_average_chunks_never_underflow(spark, span):
    n = 9000
    data = pd.DataFrame({"reading_id": range(n), "unit_id": 1, "x": np.sin(np.arange(n)) * 50})
    data.loc[data.reading_id.between(100, 4000), "x"] = np.nan
    df = spark.createDataFrame(data).withColumn("ts", F.timestamp_seconds("reading_id"))
    df = df.withColumn("x", F.when(~F.isnan("x"), F.col("x")))
    got = windows.add_ema_features(df, ["x"], (span,)).orderBy("reading_id").toPandas()
    want = data.x.ewm(span=span, adjust=False).mean()
    np.testing.assert_allclose(got[f"ema_x_{span}"], want, atol=1e-8)


def test_cooldown_blocks_equal_one_pass(spark, sf):
    df = fixture_alerts(spark, sf).drop("metadata")
    for gap in (alerts.HOUR, 7 * alerts.HOUR, 60_000_000):
        plain = alerts.alert_cooldown(df, gap)
        split = alerts.alert_cooldown(df, gap, replace(alerts.ALERTS, max_rows=20))
        assert 0 < plain.count() <= df.count()
        same(split, plain)


@pytest.mark.parametrize("gap", [1, 3, 10, 45])
def test_block_leaves_follow_the_greedy_rule(gap):
    rng = np.random.default_rng(gap)
    for _ in range(50):
        values = np.sort(rng.integers(0, 200, rng.integers(1, 60)))
        whole = values[alerts.emitted(values, gap)]
        start, out = values[0], []
        for block in np.array_split(values, 5):
            at = int(np.searchsorted(block, start))
            if at < len(block):
                out += list(block[alerts.emitted(block, gap, start=at)])
                start = alerts.leaves(block, gap)[at]
        assert out == list(whole)


@pytest.mark.parametrize("spread, gap", [(1, 10_000), (10, 10_000), (1000, 10_000), (5, 37), (1, 1)])
def test_cooldown_of_a_dense_key_in_small_blocks(spark, spread, gap):
    """Thousands of alerts of one key, all within one cooldown or with many exits a block, ties, a missing key and time."""
    rng = np.random.default_rng(spread)
    hot = np.sort(rng.integers(0, 700 * spread, 700))
    rows = [(i, "a", int(v)) for i, v in enumerate(hot)] + [(1000 + i, "b", i * 7) for i in range(15)] + [
        (2000 + i, None, i) for i in range(90)] + [(3000, "a", None)]
    df = spark.createDataFrame(rows, "alert_id long, type string, at long").withColumn("ts", F.timestamp_micros("at"))
    plain = alerts.alert_cooldown(df, gap)
    want = {int(hot[i]) for i in alerts.emitted(hot, gap)}
    assert {r["at"] for r in plain.filter("type = 'a'").collect()} == want
    same(alerts.alert_cooldown(df, gap, replace(alerts.ALERTS, max_rows=20)), plain)


def test_groups_of_a_dense_key_stay_within_the_limit(spark, monkeypatch):
    """All exits of all blocks differ; no frame that reaches Python has more rows than the limit."""
    sizes = spark.sparkContext.accumulator(0)
    largest = spark.sparkContext.accumulator(0, Most())
    run, block = alerts.emitted, alerts.leaves

    def watched(fn):
        def call(values, *args, **more):
            largest.add(len(values))
            sizes.add(1)
            return fn(values, *args, **more)
        return call

    monkeypatch.setattr(alerts, "emitted", watched(run))
    monkeypatch.setattr(alerts, "leaves", watched(block))
    df = spark.range(3000).select(F.col("id").alias("alert_id"), F.lit("a").alias("type"), F.timestamp_micros("id").alias("ts"))
    kept = alerts.alert_cooldown(df, 10_000, replace(alerts.ALERTS, max_rows=20)).collect()
    assert [r.alert_id for r in kept] == [0]
    assert sizes.value >= 150 and largest.value <= 20


def test_running_sums_over_blocks(spark):
    df = spark.range(500).select(F.xxhash64("id").alias("k"), (F.col("id") % 7).alias("v"))
    spark.conf.set(MAX_ROWS_CONF, "40")
    try:
        got = running_sums(df, "k", {"s": "v"}).toPandas().sort_values("k")
    finally:
        spark.conf.unset(MAX_ROWS_CONF)
    assert list(got.s) == [0, *got.v.cumsum()[:-1]]


def test_rows_at_and_before(readings):
    first, tenth, _, beyond = rows_at(readings, READINGS, [0, 10, 999, 10_000])
    assert readings.filter(before(READINGS, tenth)).count() == 10
    assert readings.filter(before(READINGS, first)).count() == 0
    assert readings.filter(before(READINGS, beyond)).count() == readings.count()


def test_a_selection_orders_few_rows(spark, monkeypatch):
    """Positions over many rows, ties, missing times and both ends; only a small part of the keys is laid out."""
    n = 40_000
    df = spark.range(n).select(
        F.col("id").alias("reading_id"), F.lit(1).alias("unit_id"),
        F.when(F.col("id") % 50 > 0, F.timestamp_seconds(F.pmod(F.xxhash64("id"), F.lit(9_000)))).alias("ts"))
    ordered = [tuple(r) for r in df.orderBy("ts", "reading_id").select("ts", "reading_id").collect()]
    laid = []

    def watched(frame, *args):
        laid.append(frame.count())
        return with_position(frame, *args)

    monkeypatch.setattr(order, "with_position", watched)
    at = [0, 1, 799, 800, 801, 12_345, 39_998, 39_999, 40_000, 99_999]
    found = rows_at(df, READINGS, at)
    got = [spark.range(1).select(b.alias("b")).first().b for b in found]
    assert [None if b is None else tuple(b) for b in got] == [ordered[p] if p < n else None for p in at]
    assert 0 < laid[0] < 0.1 * n
    laid.clear()
    got = {r.reading_id for r in select.positional_slice(df, 500, 30_000, ["reading_id"]).collect()}
    assert got == {i for _, i in ordered[500:30_000]} and laid[0] < 0.1 * n


def test_a_bracket_that_misses_is_widened(spark, monkeypatch):
    monkeypatch.setattr(order, "BRACKET", -0.3)
    df = spark.range(200).select(F.col("id").alias("reading_id"), F.timestamp_seconds(F.pmod(F.hash("id"), F.lit(90))).alias("ts"))
    ordered = [r.reading_id for r in df.orderBy("ts", "reading_id").collect()]
    for p, bound in zip((3, 150), rows_at(df, READINGS, [3, 150])):
        assert spark.range(1).select(bound.alias("b")).first().b.reading_id == ordered[p]


def test_text_keys_and_empty_tables_are_selected_too(spark):
    df = spark.range(50).select(F.col("id").alias("reading_id"), F.md5(F.col("id").cast("string")).alias("ts"))
    ordered = [r.reading_id for r in df.orderBy("ts").collect()]
    bound = rows_at(df, READINGS, [20])[0]
    assert spark.range(1).select(bound.alias("b")).first().b.reading_id == ordered[20]
    empty = spark.createDataFrame([], "reading_id long, ts timestamp")
    assert select.positional_slice(empty, 0, 5, ["reading_id"]).count() == 0


@pytest.mark.parametrize("rows", [1, 3, 1000])
@pytest.mark.parametrize("parts", [4, 1024])
def test_quantiles_are_exact(spark, rows, parts, monkeypatch):
    monkeypatch.setattr(quantiles, "PARTS", parts)
    rng = np.random.default_rng(rows)
    data = pd.DataFrame({
        "a": rng.normal(size=rows), "b": np.where(rng.random(rows) < 0.4, 1.0, rng.normal(size=rows)),
        "c": np.round(rng.random(rows) * 5), "d": np.full(rows, 2.5), "e": 10.0 ** rng.integers(-300, 300, rows),
        "f": 1.0 + rng.integers(0, 5, rows) * 2.0 ** -52, "g": rng.integers(-3, 3, rows) * 1e-310,
        "h": -np.abs(rng.normal(size=rows)) * 1e307})
    df = spark.createDataFrame(data)
    at = [0.0, 0.05, 0.25, 0.5, 0.75, 0.95, 1.0]
    got = quantiles.quantile_values(df, list(data), at)
    for c in data:
        np.testing.assert_allclose(got[c], data[c].quantile(at), rtol=1e-12)


def test_quantiles_skip_missing_values_and_take_infinite_ones(spark):
    rows = [(None, None), (float("nan"), None), (2.0, None), (float("inf"), None), (float("-inf"), None), (1.0, None)]
    df = spark.createDataFrame(rows, "a double, b double")
    got = quantiles.quantile_values(df, ["a", "b"], [0.0, 1 / 3, 2 / 3])
    assert got["a"] == [float("-inf"), 1.0, 2.0] and got["b"] == [None] * 3
    assert quantiles.quantile_values(df.limit(0), ["a"], [0.5]) == {"a": [None]}


def test_large_ranges_are_cut_and_little_reaches_the_driver(spark, monkeypatch):
    """Ranges above the row limit are cut further; 120 columns bring a few rows each to the driver."""
    rng = np.random.default_rng(3)
    data = pd.DataFrame({f"c{k}": rng.normal(1000 * k, 1.0 + k % 7, 400) for k in range(120)})
    data["c0"] = 5.0 + rng.integers(0, 300, 400) * 1e-6
    data["c1"] = 1.5e308 + rng.random(400) * 1e306
    brought = []
    collect = DataFrame.collect
    monkeypatch.setattr(DataFrame, "collect", lambda df: brought.append(collect(df)) or brought[-1])
    spark.conf.set(MAX_ROWS_CONF, "20")
    try:
        got = quantiles.quantile_values(spark.createDataFrame(data), list(data), [0.25, 0.5, 0.75])
    finally:
        spark.conf.unset(MAX_ROWS_CONF)
    for c in data:
        np.testing.assert_allclose(got[c], data[c].quantile([0.25, 0.5, 0.75]), rtol=1e-12)
    assert len(brought) > 2 and max(map(len, brought)) <= 6 * 120


def test_leading_digits_never_fall(spark):
    rng = np.random.default_rng(4)
    x = np.sort(np.concatenate([rng.normal(size=2000), 2.0 ** np.arange(-1070, 1023), -(2.0 ** np.arange(-1070, 1023)),
                                np.nextafter(2.0 ** np.arange(-1000, 1000), 0), [5e-324, -5e-324, np.inf, -np.inf, 0.0]]))
    df = spark.createDataFrame(pd.DataFrame({"v": x})).selectExpr("v", f"{quantiles.DIGITS} as d")
    place = df.toPandas().sort_values("v")["d"].to_numpy()
    assert (place[1:] >= place[:-1]).all()


def test_undersample_and_auc_with_a_large_class(spark, readings):
    df = windows.create_failure_labels(readings)
    log = df.select((F.col("T_Outdoor") / 40).alias("probability"), "is_failure")
    plain = learning.undersample(df, "is_failure", "reading_id").select("reading_id"), learning.roc_auc(log, "is_failure")
    spark.conf.set(MAX_ROWS_CONF, "25")
    try:
        split = learning.undersample(df, "is_failure", "reading_id").select("reading_id"), learning.roc_auc(log, "is_failure")
    finally:
        spark.conf.unset(MAX_ROWS_CONF)
    for a, b in zip(split, plain):
        same(a, b)
