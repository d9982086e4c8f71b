"""The full engineered table: calendar, rolling, lag, average, change and thermal columns."""

from __future__ import annotations

from pyspark.sql import DataFrame

from plantpulse.functions.calendar import add_time_features
from plantpulse.functions.thermal import thermal_domain
from plantpulse.operators.bounded import Plan, bounded_features
from plantpulse.operators.order import READINGS, SeriesSpec, lay_out
from plantpulse.operators.windows import LAGS, PERIODS, SPANS, WINDOWS, ema, run_lengths
from plantpulse.schema import numeric_columns


def engineer_features(
    df: DataFrame, numeric_cols: list[str] | None = None, windows=WINDOWS, lags=LAGS, spans=SPANS,
    periods=PERIODS, spec: SeriesSpec = READINGS,
) -> DataFrame:
    """All feature steps over one layout of the series.

    The numeric list is taken after the calendar columns were added, so those
    are windowed too. All bounded frames and the averages share one ordered pass in
    Arrow batches over one shuffle; where a key is cut into blocks, the averages are scanned first.
    """
    timed = add_time_features(df, spec.order)
    names = numeric_cols or numeric_columns(timed, exclude=[*spec.keys, *spec.sort])
    series = lay_out(timed, spec, heavy=True)
    if series.blocked:
        series, spans = ema(series, names, spans), ()
    if "Power" in timed.columns:
        series = run_lengths(series)
    series = bounded_features(series, Plan(
        tuple(names), tuple(windows), tuple(lags), tuple(periods), spans=tuple(spans), crossed=tuple(names[:3]),
        counter="Energy" if "Energy" in timed.columns else None))
    out = series.frame().withColumns(thermal_domain(timed.columns))
    return out.select(*_in_order(timed.columns, out.columns))


def _in_order(first: list[str], columns: list[str]) -> list[str]:
    """Given columns first, then the added ones by family."""
    families = ("roll_", "lag_", "ema_", "roc_", "", "ma_")

    def family(name: str) -> int:
        return next((i for i, f in enumerate(families) if f and name.startswith(f)), 4)

    added = [c for c in columns if c not in set(first)]
    return [*first, *sorted(added, key=family)]
