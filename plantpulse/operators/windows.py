"""Row-window features over an ordered series."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plantpulse.operators.bounded import Plan, bounded_features
from plantpulse.operators.order import (
    HERE, READINGS, Series, SeriesSpec, in_groups, last_seen, lay_out, next_seen, over_rows, with_row_number,
)
from plantpulse.schema import flag

WINDOWS, LAGS, SPANS, PERIODS = (4, 24, 96), (4, 24, 96), (12, 24, 48), (4, 24)


def rolling_exprs(columns, windows=WINDOWS, prefix="roll"):
    stats = {"mean": F.avg, "std": F.stddev_samp, "min": F.min, "max": F.max}

    def build(w):
        frames = {n: w.rowsBetween(1 - n, HERE) for n in windows}
        return {f"{prefix}_{c}_{s}_{n}": agg.over(frames[n])
                for c in columns for s, agg in ((s, fn(c)) for s, fn in stats.items()) for n in windows}
    return build


def lag_exprs(columns, lags=LAGS, prefix="lag"):
    def build(w):
        out = {}
        for c in columns:
            for n in lags:
                then = F.lag(c, n).over(w)
                out |= {f"{prefix}_{c}_{n}": then, f"{prefix}_{c}_diff_{n}": F.col(c) - then}
        return out
    return build


def crossover_exprs(column, short=4, long=24, prefix="ma"):
    def build(w):
        fast = F.avg(column).over(w.rowsBetween(1 - short, HERE))
        slow = F.avg(column).over(w.rowsBetween(1 - long, HERE))
        return {
            f"{prefix}_{column}_short_{short}": fast,
            f"{prefix}_{column}_long_{long}": slow,
            f"{prefix}_{column}_crossover_{short}_{long}": fast - slow,
        }
    return build


def add_rolling_features(
    df: DataFrame, columns: list[str], windows=WINDOWS, prefix="roll", spec: SeriesSpec = READINGS,
) -> DataFrame:
    """Trailing mean, std, min and max; missing readings are skipped. All columns in one pass over Arrow batches."""
    plan = Plan(tuple(columns), windows=tuple(windows), rolled=prefix)
    return bounded_features(lay_out(df, spec, heavy=True), plan).frame()


def add_lag_features(
    df: DataFrame, columns: list[str], lags=LAGS, prefix="lag", spec: SeriesSpec = READINGS,
) -> DataFrame:
    """Value n rows back and the difference to it."""
    return over_rows(lay_out(df, spec), lag_exprs(columns, lags, prefix), back=max(lags)).frame()


def create_crossover_features(
    df: DataFrame, column: str, short_window=4, long_window=24, prefix="ma", spec: SeriesSpec = READINGS,
) -> DataFrame:
    build = crossover_exprs(column, short_window, long_window, prefix)
    return over_rows(lay_out(df, spec), build, back=max(short_window, long_window) - 1).frame()


def rate_of_change(series: Series, columns, periods=PERIODS, prefix="roc") -> Series:
    filled = {f"__f_{c}": F.col(c) for c in columns}
    series = last_seen(series, filled)

    def ratio(now: Column, then: Column) -> Column:
        now, then = now.cast("double"), then.cast("double")
        infinite = F.when(now > 0, F.lit(math.inf)).when(now < 0, F.lit(-math.inf))
        return F.when(then == 0, infinite).otherwise(F.try_divide(now, then) - 1)

    series = over_rows(series, lambda w: {
        f"{prefix}_{c}_{n}": ratio(F.col(f"__f_{c}"), F.lag(f"__f_{c}", n).over(w))
        for c in columns for n in periods
    }, back=max(periods))
    return series.put(series.df.drop(*filled))


def add_rate_of_change(
    df: DataFrame, columns: list[str], periods=PERIODS, prefix="roc", spec: SeriesSpec = READINGS,
) -> DataFrame:
    """x / x[n rows back] - 1 over the forward-filled series; x/0 is infinite, 0/0 missing."""
    return rate_of_change(lay_out(df, spec), columns, periods, prefix).frame()


def counter_exprs(energy="Energy"):
    return lambda w: {
        "energy_rate": F.greatest(
            F.coalesce(F.col(energy) - F.lag(energy).over(w), F.lit(0.0)), F.lit(0.0)),
    }


def counter_rate(df: DataFrame, energy: str = "Energy", spec: SeriesSpec = READINGS) -> DataFrame:
    """Increment of a cumulative meter; the first reading and a reset give 0."""
    return over_rows(lay_out(df, spec), counter_exprs(energy), back=1).frame()


def run_lengths(series: Series, power="Power", threshold=0.0) -> Series:
    on = flag(F.col(power) > threshold)
    series = with_row_number(series.put(series.df.withColumn("power_state", on)), "__i")
    series = over_rows(series, lambda w: {
        "__turn": F.when(~F.lag("power_state").over(w).eqNullSafe(F.col("power_state")), F.col("__i")),
    }, back=1)
    series = last_seen(series, {"__since": F.col("__turn")})
    duration = ((F.col("__i") - F.col("__since")) * F.col("power_state")).cast("long")
    return series.put(series.df.withColumn("power_on_duration", duration).drop("__i", "__turn", "__since"))


def run_duration(df: DataFrame, power="Power", threshold=0.0, spec: SeriesSpec = READINGS) -> DataFrame:
    """On/off state and the 0-based position within the current on-run (0 while off)."""
    return run_lengths(lay_out(df, spec), power, threshold).frame()


def moving_window_threshold(
    df: DataFrame, columns: list[str], window_size=24, std_multiplier=3.0, spec: SeriesSpec = READINGS,
) -> DataFrame:
    """Flag readings further than k rolling deviations from the rolling mean."""
    def build(w):
        near = w.rowsBetween(1 - window_size, HERE)
        return {
            f"{c}_is_anomaly_mw": flag(
                F.abs(F.col(c) - F.avg(c).over(near)) > std_multiplier * F.stddev_samp(c).over(near))
            for c in columns
        }
    out = over_rows(lay_out(df, spec), build, back=window_size - 1).frame()
    return out.withColumn("mw_anomaly_count", sum((F.col(f"{c}_is_anomaly_mw") for c in columns), F.lit(0)))


def detect_consumption_anomalies(
    df: DataFrame, power_col="Power", threshold_std=2.0, window_size=24, spec: SeriesSpec = READINGS,
) -> DataFrame:
    """Rolling z-score of power; a zero deviation counts as 1, a missing one never flags."""
    def build(w):
        near = w.rowsBetween(1 - window_size, HERE)
        return {
            "power_rolling_mean": F.avg(power_col).over(near),
            "power_rolling_std": F.stddev_samp(power_col).over(near),
        }
    out = over_rows(lay_out(df, spec), build, back=window_size - 1).frame()
    std = F.col("power_rolling_std")
    out = out.withColumn(
        "power_zscore", (F.col(power_col) - F.col("power_rolling_mean")) / F.when(std == 0, 1.0).otherwise(std))
    return out.withColumn("consumption_anomaly", flag(F.abs("power_zscore") > threshold_std))


def create_failure_labels(
    df: DataFrame, target_col="Power", threshold=0.0, window_size=24, horizon: int | None = None,
    spec: SeriesSpec = READINGS,
) -> DataFrame:
    """Failure flag, failures in the trailing window, and rows of remaining life.

    `failure_imminent` looks back like the labels it reproduces; `horizon` adds
    `fails_within`, which looks at the next rows instead.
    """
    series = lay_out(df.withColumn("is_failure", flag(F.col(target_col) <= threshold)), spec)
    series = with_row_number(series, "__i")

    def build(w):
        ahead = F.min(F.when(F.col("is_failure") == 1, F.col("__i"))).over(w.rowsBetween(HERE, window_size - 1))
        left = F.coalesce(F.greatest(F.lit(0), F.lit(window_size) - (ahead - F.col("__i"))), F.lit(0))
        out = {
            "failure_window": F.sum("is_failure").over(w.rowsBetween(1 - window_size, HERE)).cast("double"),
            "rul": left.cast("int"),
        }
        if horizon:
            out["fails_within"] = F.coalesce(F.max("is_failure").over(w.rowsBetween(1, horizon)), F.lit(0))
        return out

    series = over_rows(series, build, back=window_size - 1, ahead=max(window_size - 1, horizon or 0))
    out = series.frame().withColumn("failure_imminent", flag(F.col("failure_window") > 0))
    rest = ["is_failure", "failure_window", "failure_imminent", "rul"] + (["fails_within"] if horizon else [])
    return out.select(*[c for c in df.columns if c not in rest], *rest)


def forward_fill(df: DataFrame, columns: list[str], spec: SeriesSpec = READINGS) -> DataFrame:
    return last_seen(lay_out(df, spec), {c: F.col(c) for c in columns}).frame().select(*df.columns)


def backward_fill(df: DataFrame, columns: list[str], spec: SeriesSpec = READINGS) -> DataFrame:
    return next_seen(lay_out(df, spec), {c: F.col(c) for c in columns}).frame().select(*df.columns)


def interpolate(df: DataFrame, columns: list[str], method="linear", spec: SeriesSpec = READINGS) -> DataFrame:
    """Fill gaps by row position, `linear` (trailing gaps take the last value) or `nearest`."""
    if method not in ("linear", "nearest"):
        raise ValueError(f"unknown fill method {method!r}: use forward, backward, linear or nearest")
    series = with_row_number(lay_out(df, spec), "__i")
    known = {c: F.when(F.col(c).isNotNull(), F.struct(F.col("__i").alias("i"), F.col(c).alias("v"))) for c in columns}
    series = last_seen(series, {f"__a_{c}": known[c] for c in columns})
    series = next_seen(series, {f"__b_{c}": known[c] for c in columns})

    def blend(c: str) -> Column:
        a, b, i = F.col(f"__a_{c}"), F.col(f"__b_{c}"), F.col("__i")
        inner = a.isNotNull() & b.isNotNull()
        if method == "linear":
            slope = F.try_divide(b["v"] - a["v"], (b["i"] - a["i"]).cast("double"))
            return F.coalesce(c, F.when(inner, a["v"] + slope * (i - a["i"])), a["v"])
        return F.coalesce(c, F.when(inner, F.when(i - a["i"] <= b["i"] - i, a["v"]).otherwise(b["v"])))

    out = series.put(series.df.withColumns({c: blend(c) for c in columns}))
    return out.frame().select(*df.columns)


def handle_missing_values(
    df: DataFrame, method="forward", columns: list[str] | None = None, spec: SeriesSpec = READINGS,
) -> DataFrame:
    from plantpulse.schema import numeric_columns

    names = columns or numeric_columns(df, exclude=spec.sort + list(spec.keys))
    if method == "forward":
        return forward_fill(df, names, spec)
    if method == "backward":
        return backward_fill(df, names, spec)
    return interpolate(df, names, method, spec)


def impute_zero(df: DataFrame, columns: list[str], fill_first=False, drop_infinite=True,
                spec: SeriesSpec = READINGS) -> DataFrame:
    """Missing and infinite values to 0, after a forward fill if asked; inf is never filled forward."""
    if fill_first:
        df = forward_fill(df, columns, spec)

    def clean(c: str) -> Column:
        value = F.coalesce(F.col(c), F.lit(0))
        return F.when(F.abs(value) == math.inf, 0.0).otherwise(value) if drop_infinite else value

    return df.withColumns({c: clean(c) for c in columns})


def every_kth(df: DataFrame, k: int | None = None, n_points: int | None = None,
              spec: SeriesSpec = READINGS) -> DataFrame:
    """Rows 0, k, 2k, … of the whole table in order; k = rows // n_points when given."""
    from dataclasses import replace

    from plantpulse.operators.order import with_position

    if k is None:
        rows = df.count()
        k = rows // n_points if rows > n_points else 1
    whole = replace(spec, keys=())
    return with_position(df, whole, "__at").filter(F.col("__at") % k == 0).drop("__at")


# --- exponential moving average -------------------------------------------------

FAN = 512


def ema(series: Series, columns, spans=SPANS, prefix="ema") -> Series:
    """Exponential moving average as a scan of affine maps y -> A*y + B.

    Within a chunk of rows the composed map is a running product and a running
    sum (two window passes); the chunk length keeps the product far from
    underflow. Chunk maps are then folded to give each chunk its entry value.
    """
    alphas = {(c, s): 2.0 / (s + 1.0) for c in columns for s in spans if s > 1}
    if len(alphas) < len(columns) * len(spans):
        series = last_seen(series, {f"{prefix}_{c}_{s}": F.col(c) for c in columns for s in spans if s <= 1})
        return ema(series, columns, [s for s in spans if s > 1], prefix) if alphas else series
    names = {key: f"{prefix}_{key[0]}_{key[1]}" for key in alphas}
    chunk_rows = max(1, min(4096, int(500 / -math.log(1.0 - max(alphas.values())))))
    series = with_row_number(series, "__i")
    series = last_seen(series, {f"__p_{c}": F.when(F.col(c).isNotNull(), F.col("__i")) for c in columns},
                       inclusive=False)
    df = series.df.withColumn("__chunk", F.floor(F.col("__i") / chunk_rows))
    decay, gain = {}, {}
    for j, ((c, s), alpha) in enumerate(alphas.items()):
        # a weight below exp(-150) is lost in double precision anyway
        longest_gap = math.ceil(150 / -math.log(1.0 - alpha))
        kept = f"pow({1.0 - alpha!r}D, least(__i - `__p_{c}`, {longest_gap}))"
        decay[f"__d{j}"] = F.expr(
            f"case when `{c}` is not null and `__p_{c}` is not null then ln({kept} / ({kept} + {alpha!r}D)) "
            "else 0D end")
        gain[f"__g{j}"] = F.expr(
            f"case when `{c}` is null then 0D when `__p_{c}` is null then double(`{c}`) "
            f"else `{c}` * {alpha!r}D / ({kept} + {alpha!r}D) end")
    keys = [*series.spec.keys, "__chunk"]
    w = Window.partitionBy(*keys).orderBy(*series.spec.sort).rowsBetween(Window.unboundedPreceding, HERE)
    every = range(len(names))
    df = df.withColumns(decay | gain)
    df = in_groups(df, {f"__l{j}": F.sum(f"__d{j}").over(w) for j in every})
    df = in_groups(df, {f"__s{j}": F.sum(F.expr(f"__g{j} * exp(-__l{j})")).over(w) for j in every})
    carried = {}
    if series.longest > chunk_rows:
        totals = (f"array({', '.join(f'exp(__l{j})' for j in every)}) as a",
                  f"array({', '.join(f'exp(__l{j}) * __s{j}' for j in every)}) as b")
        ends = df.selectExpr(*[f"`{k}`" for k in keys], "__i", *totals).groupBy(*keys).agg(
            F.max_by(F.struct("a", "b"), F.col("__i")).alias("m"))
        ends = ends.select(*series.spec.keys, F.col("__chunk").alias("c"), "m.a", "m.b")
        entry = _entries(ends, series.spec.keys, -(-series.longest // chunk_rows))
        entry = entry.select(*[F.col(k).alias(f"__e_{k}") for k in series.spec.keys],
                             F.col("c").alias("__e_c"), F.col("b").alias("__entry"))
        df = df.join(entry, [F.col("__chunk") == F.col("__e_c")] + [
            F.col(k).eqNullSafe(F.col(f"__e_{k}")) for k in series.spec.keys], "left")
        carried = {j: f" + coalesce(__entry[{j}], 0D)" for j in every}
    value = {
        name: F.expr(f"case when coalesce(`__p_{c}`, if(`{c}` is null, null, __i)) is not null "
                     f"then exp(__l{j}) * (__s{j}{carried.get(j, '')}) end")
        for j, ((c, _), name) in enumerate(names.items())
    }
    rest = [c for c in series.df.columns if c != "__i" and not c.startswith("__p_")]
    return series.put(df.withColumns(value).select(*rest, *names.values()))


def _entries(maps: DataFrame, keys: tuple[str, ...], longest: int) -> DataFrame:
    """For maps (a, b) numbered c = 0, 1, … per key: the value with which each is entered.

    Groups of FAN maps are scanned as one array each; their compositions form a
    table FAN times smaller, which is treated the same way.
    """
    group = F.floor(F.col("c") / FAN).alias("g")
    packed = maps.groupBy(*keys, group).agg(F.sort_array(F.collect_list(F.struct("c", "a", "b"))).alias("ms"))
    width = F.size(F.element_at("ms", 1)["a"])
    start = F.struct(
        F.array_repeat(F.lit(1.0), width).alias("a"), F.array_repeat(F.lit(0.0), width).alias("b"),
        F.expr("cast(array() as array<struct<c:bigint,a:array<double>,b:array<double>>>)").alias("out"))

    def step(acc, m):
        return F.struct(
            F.zip_with(acc["a"], m["a"], lambda x, y: x * y).alias("a"),
            F.zip_with(F.zip_with(m["a"], acc["b"], lambda x, y: x * y), m["b"], lambda x, y: x + y).alias("b"),
            F.concat(acc["out"], F.array(F.struct(m["c"].alias("c"), acc["a"].alias("a"), acc["b"].alias("b")))
                     ).alias("out"))

    packed = packed.withColumn("scan", F.aggregate("ms", start, step))
    inner = packed.select(*keys, "g", F.explode("scan.out").alias("o")).select(*keys, "g", "o.c", "o.a", "o.b")
    if longest <= FAN:
        return inner.select(*keys, "c", "b")
    outer = _entries(
        packed.select(*keys, F.col("g").alias("c"), F.col("scan.a").alias("a"), F.col("scan.b").alias("b")),
        keys, -(-longest // FAN))
    outer = outer.select(*[F.col(k).alias(f"__o_{k}") for k in keys], F.col("c").alias("__o_g"),
                         F.col("b").alias("__o_b"))
    joined = inner.join(outer, [F.col("g") == F.col("__o_g")] + [
        F.col(k).eqNullSafe(F.col(f"__o_{k}")) for k in keys], "left")
    value = F.zip_with(F.zip_with(F.col("a"), F.col("__o_b"), lambda x, y: x * y), F.col("b"), lambda x, y: x + y)
    return joined.select(*keys, "c", value.alias("b"))


def add_ema_features(
    df: DataFrame, columns: list[str], spans=SPANS, prefix="ema", spec: SeriesSpec = READINGS,
) -> DataFrame:
    """y = (1-a)y + ax with a = 2/(span+1); a gap of g rows weighs the old value by (1-a)^g."""
    return ema(lay_out(df, spec, heavy=True), columns, spans, prefix).frame()
