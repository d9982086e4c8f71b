"""The pass over Arrow batches gives the columns of the window functions."""

from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from plantpulse.operators import bounded, windows
from plantpulse.operators.order import READINGS, lay_out, over_rows
from plantpulse.plans import features
from tests.helpers import same

NAMES = ["T_Supply", "RH_Return", "Power", "hour"]
PLAN = bounded.Plan(tuple(NAMES), (1, 4, 9), (1, 7), (2, 5), ("Power", "T_Supply"), "Energy")


def by_windows(df, spec, names=NAMES):
    out = over_rows(lay_out(df, spec), windows.rolling_exprs(names, (1, 4, 9)), back=8).frame()
    out = windows.add_lag_features(out, names, (1, 7), spec=spec)
    out = windows.add_rate_of_change(out, names, (2, 5), spec=spec)
    for c in PLAN.crossed:
        out = windows.create_crossover_features(out, c, spec=spec)
    return windows.counter_rate(out, spec=spec)


@pytest.fixture(scope="module")
def frame(readings):
    """Gaps, zeroes, a hot unit, one without a key, a constant run and whole numbers."""
    df = readings.select(
        "reading_id", F.when(F.col("reading_id") % 3 == 0, F.lit(0)).when(F.col("unit_id") != 2, F.col("unit_id")).alias("unit_id"),
        "ts", "T_Supply", F.when(F.col("reading_id") % 10 < 6, F.col("RH_Return")).alias("RH_Return"),
        F.when(F.col("reading_id") < 300, 0.1).otherwise(F.col("Power")).alias("Power"), "Energy",
        F.when(F.col("reading_id") % 5 > 0, F.hour("ts")).alias("hour")).cache()
    yield df
    df.unpersist()


@pytest.mark.parametrize("batch", [7, 64, 4096])
@pytest.mark.parametrize("limit", [None, 60])
def test_equals_window_functions(spark, frame, monkeypatch, batch, limit):
    """Whole series and blocks of a hot one, in batches shorter and longer than a window."""
    monkeypatch.setattr(bounded, "ROWS_AT_ONCE", batch)
    for spec in (READINGS, replace(READINGS, keys=())):
        got = bounded.bounded_features(lay_out(frame, replace(spec, max_rows=limit)), PLAN).frame()
        want = by_windows(frame, spec)
        assert {(f.name, f.dataType) for f in got.schema} == {(f.name, f.dataType) for f in want.schema}
        same(got, want)


def test_constant_windows_have_no_deviation_and_large_values_leave_no_trace():
    x = np.concatenate([np.full(50, 0.1), [1e12], np.full(50, 0.1)])
    mean, std, least, most = bounded.trailing(x, np.arange(101), 4)
    assert std[49] < 1e-15 and std[-1] < 1e-15 and most[-1] == 0.1 and abs(mean[-1] - 0.1) < 1e-15
    assert np.isnan(std[0]) and std[1] < 1e-15 and most[50] == 1e12


def test_an_empty_table(frame):
    got = bounded.bounded_features(lay_out(frame.limit(0), READINGS), PLAN).frame()
    assert got.count() == 0 and "roc_Power_5" in got.columns


def test_a_window_takes_steps_by_its_logarithm(monkeypatch):
    """And a gap, an infinite value or the start of a series ends no other window."""
    rng = np.random.default_rng(3)
    x, place = rng.normal(size=400) * 1e3, np.arange(400) % 130
    x[rng.uniform(size=400) < 0.3], x[77] = np.nan, np.inf
    calls, joined = [], bounded.joined
    monkeypatch.setattr(bounded, "joined", lambda *a: calls.append(1) or joined(*a))
    found = bounded.trailing_all(x, place, (4, 24, 96))
    assert len(calls) <= 8
    for n, (mean, std, least, most) in found.items():
        for i in range(400):
            v = x[max(0, i - min(n - 1, place[i])):i + 1]
            v = v[~np.isnan(v)]
            with np.errstate(invalid="ignore"):
                want = [v.mean(), v.std(ddof=1) if len(v) > 1 else np.nan, v.min(), v.max()] if len(v) else [np.nan] * 4
            np.testing.assert_allclose([mean[i], std[i], least[i], most[i]], want, rtol=1e-11, atol=1e-9)


@pytest.mark.parametrize("batch", [7, 4096])
def test_averages_share_the_pass(spark, frame, monkeypatch, batch):
    monkeypatch.setattr(bounded, "ROWS_AT_ONCE", batch)
    spans = (1, 3, 12)
    names = ["reading_id", *[f"ema_{c}_{s}" for c in NAMES for s in spans]]
    plan = replace(PLAN, windows=(), lags=(), periods=(), crossed=(), counter=None, spans=spans)
    got = bounded.bounded_features(lay_out(frame, READINGS), plan).frame().select(*names)
    want = windows.add_ema_features(frame, NAMES, spans).select(*names)
    assert got.dtypes == want.dtypes
    same(got, want, 12)


def test_the_engineered_table_scans_averages_of_blocks_only(frame, monkeypatch):
    calls, ema = [], features.ema
    monkeypatch.setattr(features, "ema", lambda *a: calls.append(1) or ema(*a))
    names = [features.engineer_features(frame, NAMES, spec=replace(READINGS, max_rows=n)).columns for n in (None, 60)]
    assert len(calls) == 1 and names[0] == names[1]
