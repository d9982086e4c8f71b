"""Queries over ordered series, cleaning and anomaly detection."""

from __future__ import annotations

from pyspark.sql import functions as F

from plantpulse.functions.calendar import add_time_features
from plantpulse.functions.grading import classify_alert_severity
from plantpulse.operators import alerts, anomaly, cleaning, forest, monitoring, windows
from plantpulse.plans import fixtures as fx
from plantpulse.plans.features import engineer_features
from plantpulse.plans.registry import ALERTS_SQL, ORDERED_SQL, RUNS_SQL, query, r, rounded, sql
from plantpulse.schema import SENSORS

W = "partition by unit_id order by ts, reading_id"
FIVE = ["T_Supply", "T_Return", "T_Saturation", "T_Outdoor", "Power"]


def base(spark, sf, *columns):
    return fx.sensor_readings(spark, sf).select("reading_id", "unit_id", "ts", *columns)


def trim(df):
    return df.drop("unit_id", "ts")


# --- E: row windows -------------------------------------------------------------

def _rolling(c: str) -> list[str]:
    out = []
    for n in (4, 24, 96):
        frame = f"over ({W} rows between {n - 1} preceding and current row)"
        out += [r(f"avg({c}) {frame}", f"roll_{c}_mean_{n}", 8 if c == "Energy" else 10), r(f"stddev_samp({c}) {frame}", f"roll_{c}_std_{n}"),
                r(f"min({c}) {frame}", f"roll_{c}_min_{n}"), r(f"max({c}) {frame}", f"roll_{c}_max_{n}")]
    return out


@query("rolling_stats", sql("select reading_id, " + ", ".join(x for c in SENSORS for x in _rolling(c)) + " from sensor_readings"))
def rolling_stats(spark, sf):
    out = windows.add_rolling_features(base(spark, sf, *SENSORS), SENSORS)
    means = {f"roll_{c}_mean_{n}": 8 if c == "Energy" else 10 for c in SENSORS for n in (4, 24, 96)}
    return rounded(trim(out).drop(*SENSORS), **means)


@query("lag_features", sql("select reading_id, " + ", ".join(
    r(f"lag({c}, {n}) over ({W})", f"lag_{c}_{n}") for c in SENSORS for n in (4, 24, 96)) + " from sensor_readings"))
def lag_features(spark, sf):
    out = windows.add_lag_features(base(spark, sf, *SENSORS), SENSORS)
    return rounded(out.select("reading_id", *[f"lag_{c}_{n}" for c in SENSORS for n in (4, 24, 96)]))


@query("lag_diff", sql("select reading_id, " + ", ".join(
    r(f"{c} - lag({c}, {n}) over ({W})", f"lag_{c}_diff_{n}") for c in SENSORS for n in (4, 24, 96))
    + " from sensor_readings"))
def lag_diff(spark, sf):
    out = windows.add_lag_features(base(spark, sf, *SENSORS), SENSORS)
    return rounded(out.select("reading_id", *[f"lag_{c}_diff_{n}" for c in SENSORS for n in (4, 24, 96)]))


def _ema_sql(c: str) -> str:
    def step(span: int) -> str:
        a = f"{2 / (span + 1)!r}::double"
        w = f"pow(1 - {a}, s.g + 1)"
        return (f"case when o.{c} is null then s.y{span} when s.y{span} is null then o.{c} "
                f"else ({w} * s.y{span} + {a} * o.{c}) / ({w} + {a}) end")
    spans = (12, 24, 48)
    first = ", ".join(f"{c} as y{s}" for s in spans)
    steps = ", ".join(step(s) for s in spans)
    return f"""ema_{c}(unit_id, rn, reading_id, g, {', '.join(f'y{s}' for s in spans)}) as (
  select unit_id, rn, reading_id, 0::bigint, {first} from ordered where rn = 1
  union all
  select o.unit_id, o.rn, o.reading_id, case when o.{c} is null then s.g + 1 else 0 end, {steps}
  from ema_{c} s join ordered o on o.unit_id = s.unit_id and o.rn = s.rn + 1)"""


@query("ema", sql("select a.reading_id, " + ", ".join(
    r(f"ema_{c}.y{s}", f"ema_{c}_{s}", 6 if c == "Energy" else 8) for c in SENSORS for s in (12, 24, 48))
    + f" from ordered a {' '.join(f'join ema_{c} using (reading_id)' for c in SENSORS)}",
    ORDERED_SQL, *[_ema_sql(c) for c in SENSORS], recursive=True))
def ema(spark, sf):
    out = windows.add_ema_features(base(spark, sf, *SENSORS), SENSORS)
    return rounded(trim(out).drop(*SENSORS), 8, **{f"ema_Energy_{s}": 6 for s in (12, 24, 48)})


FILLED_SQL = "filled as (select reading_id, unit_id, ts, " + ", ".join(
    f"last_value({c} ignore nulls) over ({W} rows unbounded preceding) as {c}" for c in SENSORS) + " from sensor_readings)"


def _roc(c: str, n: int) -> str:
    then = f"lag({c}, {n}) over ({W})"
    return (f"case when {then} = 0 then case when {c} > 0 then cast('inf' as double) when {c} < 0 then "
            f"cast('-inf' as double) end else round({c} / nullif({then}, 0) - 1, 8) + 0e0 end as roc_{c}_{n}")


@query("rate_of_change", sql("select reading_id, " + ", ".join(_roc(c, n) for c in SENSORS for n in (4, 24))
                             + " from filled", FILLED_SQL))
def rate_of_change(spark, sf):
    out = windows.add_rate_of_change(base(spark, sf, *SENSORS), SENSORS)
    return rounded(trim(out).drop(*SENSORS), 8)


def _ma(n: int) -> str:
    return f"avg(T_Supply) over ({W} rows between {n - 1} preceding and current row)"


@query("ma_crossover", sql(f"""select reading_id, {r(_ma(4), 'ma_T_Supply_short_4', 9)},
  {r(_ma(24), 'ma_T_Supply_long_24', 9)}, {r(f'{_ma(4)} - {_ma(24)}', 'ma_T_Supply_crossover_4_24', 9)}
  from sensor_readings"""))
def ma_crossover(spark, sf):
    out = windows.create_crossover_features(base(spark, sf, "T_Supply"), "T_Supply")
    return rounded(trim(out).drop("T_Supply"), 9)


@query("counter_rate", sql(f"""select reading_id, {r(f'greatest(coalesce(Energy - lag(Energy) over ({W}), 0), 0)', 'energy_rate')}
  from sensor_readings"""))
def counter_rate(spark, sf):
    return rounded(trim(windows.counter_rate(base(spark, sf, "Energy"))).drop("Energy"))


@query("run_duration", sql(f"""select reading_id, power_state,
  (row_number() over (partition by unit_id, run order by ts, reading_id) - 1) * power_state as power_on_duration
  from (select *, sum(turn) over ({W} rows unbounded preceding) as run from (
    select *, case when lag(power_state) over ({W}) is distinct from power_state then 1 else 0 end as turn
    from (select *, cast(coalesce(Power > 0, false) as int) as power_state from sensor_readings)))"""))
def run_duration(spark, sf):
    return trim(windows.run_duration(base(spark, sf, "Power"))).drop("Power")


GAPS = ["T_Supply", "RH_Return"]


@query("forward_fill", sql("select reading_id, " + ", ".join(
    r(f"last_value({c} ignore nulls) over ({W} rows unbounded preceding)", c) for c in GAPS) + " from sensor_readings"))
def forward_fill(spark, sf):
    return rounded(trim(windows.handle_missing_values(base(spark, sf, *GAPS), "forward", GAPS)))


@query("backward_fill", sql("select reading_id, " + ", ".join(
    r(f"first_value({c} ignore nulls) over ({W} rows between current row and unbounded following)", c)
    for c in GAPS) + " from sensor_readings"))
def backward_fill(spark, sf):
    return rounded(trim(windows.handle_missing_values(base(spark, sf, *GAPS), "backward", GAPS)))


def _seen_sql(c: str) -> str:
    known = f"case when {c} is not null then rn end"
    back, on = f"{W} rows unbounded preceding", f"{W} rows between current row and unbounded following"
    return (f"seen_{c} as (select reading_id, rn, {c} as v, last_value({c} ignore nulls) over ({back}) as a, "
            f"max({known}) over ({back}) as ai, first_value({c} ignore nulls) over ({on}) as b, "
            f"min({known}) over ({on}) as bi from ordered)")


@query("linear_interpolate", sql(f"""select x.reading_id, {', '.join(
    r(f'coalesce({t}.v, {t}.a + ({t}.b - {t}.a) * ({t}.rn - {t}.ai) / ({t}.bi - {t}.ai), {t}.a)', c, 9)
    for t, c in zip('xy', GAPS))} from seen_T_Supply x join seen_RH_Return y using (reading_id)""",
    ORDERED_SQL, _seen_sql("T_Supply"), _seen_sql("RH_Return")))
def linear_interpolate(spark, sf):
    return rounded(trim(windows.handle_missing_values(base(spark, sf, *GAPS), "linear", GAPS)), 9)


@query("interpolate_other", sql(f"""select x.reading_id, {', '.join(
    r(f'coalesce({t}.v, case when {t}.a is not null and {t}.b is not null then case when {t}.rn - {t}.ai <= {t}.bi - {t}.rn then {t}.a else {t}.b end end)', c)
    for t, c in zip('xy', GAPS))} from seen_T_Supply x join seen_RH_Return y using (reading_id)""",
    ORDERED_SQL, _seen_sql("T_Supply"), _seen_sql("RH_Return")))
def interpolate_other(spark, sf):
    return rounded(trim(windows.handle_missing_values(base(spark, sf, *GAPS), "nearest", GAPS)))


NEAR = f"over ({W} rows between 23 preceding and current row)"


def _mw(c: str, k: float) -> str:
    return (f"cast(coalesce(abs({c} - avg({c}) {NEAR}) > {k}::double * stddev_samp({c}) {NEAR}, false) as int)")


@query("moving_threshold", sql(f"""select *, {' + '.join(f'{c}_is_anomaly_mw' for c in SENSORS)} as mw_anomaly_count
  from (select reading_id, {', '.join(f'{_mw(c, 2.0)} as {c}_is_anomaly_mw' for c in SENSORS)} from sensor_readings)"""))
def moving_threshold(spark, sf):
    return trim(windows.moving_window_threshold(base(spark, sf, *SENSORS), SENSORS, 24, 2.0)).drop(*SENSORS)


@query("consumption_anomaly", sql(f"""select reading_id, {r('m', 'power_rolling_mean', 10)}, {r('s', 'power_rolling_std')},
  {r('(Power - m) / case when s = 0 then 1 else s end', 'power_zscore')},
  cast(coalesce(abs((Power - m) / case when s = 0 then 1 else s end) > 2, false) as int) as consumption_anomaly
  from (select *, avg(Power) {NEAR} as m, stddev_samp(Power) {NEAR} as s from sensor_readings)"""))
def consumption_anomaly(spark, sf):
    out = windows.detect_consumption_anomalies(base(spark, sf, "Power"))
    return rounded(trim(out).drop("Power"), power_rolling_mean=10)


@query("failure_labels", sql(f"""select reading_id, is_failure, failure_window,
  cast(failure_window > 0 as int) as failure_imminent from (select reading_id, is_failure,
  cast(sum(is_failure) {NEAR} as double) as failure_window
  from (select *, cast(coalesce(Power <= 0, false) as int) as is_failure from sensor_readings))"""))
def failure_labels(spark, sf):
    return trim(windows.create_failure_labels(base(spark, sf, "Power"))).drop("Power", "rul")


@query("remaining_life", sql("""select reading_id, rul from life""", ORDERED_SQL,
    "sized as (select *, count(*) over (partition by unit_id) as n from ordered)",
    """life(unit_id, rn, reading_id, rul) as (
  select unit_id, rn, reading_id, case when Power <= 0 then 24 else 0 end from sized where rn = n
  union all
  select o.unit_id, o.rn, o.reading_id, case when o.Power <= 0 then 24 else greatest(0, l.rul - 1) end
  from life l join sized o on o.unit_id = l.unit_id and o.rn = l.rn - 1)""", recursive=True))
def remaining_life(spark, sf):
    return windows.create_failure_labels(base(spark, sf, "Power")).select("reading_id", "rul")


GRADED_SQL = """graded as (select *, case severity when 'low' then 1 when 'medium' then 2 when 'high' then 3 else 0 end
  as severity_level from (select *, case when Power > 3 then 'high' when Power > 2 then 'medium'
  when Power > 1 then 'low' else 'normal' end as severity from ordered))"""
# greedy rule per unit: the next kept row is the first at least four rows after the last kept one
GREEDY_SQL = """wanted as (select unit_id, rn, reading_id from graded where severity_level >= 1),
kept(unit_id, rn) as (
  select unit_id, min(rn) from wanted group by unit_id
  union all
  select k.unit_id, (select min(w.rn) from wanted w where w.unit_id = k.unit_id and w.rn >= k.rn + 4)
  from kept k where k.rn is not null)"""


@query("alert_run_group", sql("""select g.reading_id, g.severity, g.severity_level::int as severity_level,
  (k.rn is not null)::int as kept from graded g left join kept k on k.unit_id = g.unit_id and k.rn = g.rn
  where g.severity_level >= 1""", ORDERED_SQL, GRADED_SQL, GREEDY_SQL, recursive=True))
def alert_run_group(spark, sf):
    df = base(spark, sf, "Power")
    grade = F.when(F.col("Power") > 3, "high").when(F.col("Power") > 2, "medium").when(
        F.col("Power") > 1, "low").otherwise("normal")
    df = df.withColumn("severity", grade)
    every = alerts.filter_alerts(df, "low").select("reading_id", "severity", "severity_level")
    kept = alerts.filter_alerts(df, "low", cooldown=4).select("reading_id", F.lit(1).alias("kept"))
    return every.join(kept, "reading_id", "left").withColumn("kept", F.coalesce("kept", F.lit(0)))


EMITTED_SQL = """emitted(type, ts) as (
  select type, min(ts) from alerts group by type
  union all
  select e.type, (select min(a.ts) from alerts a where a.type = e.type and a.ts >= e.ts + interval 1 hour)
  from emitted e where e.ts is not null),
kept as (select * from alerts semi join (select * from emitted where ts is not null) e
  on alerts.type = e.type and alerts.ts = e.ts)"""


@query("alert_cooldown", sql("select alert_id, type, ts, severity from kept", ALERTS_SQL, EMITTED_SQL, recursive=True))
def alert_cooldown(spark, sf):
    return alerts.alert_cooldown(fx.alerts(spark, sf)).select("alert_id", "type", "ts", "severity")


@query("every_kth", sql(f"""select reading_id, ts, {r('Power', 'Power')} from
  (select *, row_number() over (order by ts, reading_id) - 1 as i, count(*) over () as n from sensor_readings)
  where i % case when n > 3000 then n // 3000 else 1 end = 0"""))
def every_kth(spark, sf):
    return rounded(windows.every_kth(base(spark, sf, "Power"), n_points=3000).drop("unit_id"))


@query("recent_n_health", sql(f"""select pipeline, count(*) as recent_runs,
  {r("avg(case when status = 'success' then 1e0 else 0e0 end)", 'success_rate')},
  {r('avg(duration_seconds)', 'avg_duration_seconds')}, max(ts) as last_run,
  case when avg(case when status = 'success' then 1e0 else 0e0 end) > 0.9 then 'healthy' else 'degraded' end as status
  from (select *, row_number() over (partition by pipeline order by ts desc, event_id desc) as rn from pipeline_runs)
  where rn <= 10 group by 1""", RUNS_SQL))
def recent_n_health(spark, sf):
    return rounded(monitoring.recent_health(fx.pipeline_runs(spark, sf), order=("ts", "event_id")))


@query("engineered_table")
def engineered_table(spark, sf):
    """All 656 engineered columns next to the readings."""
    return engineer_features(fx.sensor_readings(spark, sf))


def _sensor_features_sql() -> str:
    """Every engineered column over the ten sensors, from one ordered table."""
    out = ["o.reading_id"]
    for c in SENSORS:
        out += [x.replace(f"({c})", f"(o.{c})").replace(W, "partition by o.unit_id order by o.rn") for x in _rolling(c)]
        lags = [(n, f"lag(o.{c}, {n}) over w") for n in (4, 24, 96)]
        out += [r(e, f"lag_{c}_{n}") for n, e in lags] + [r(f"o.{c} - {e}", f"lag_{c}_diff_{n}") for n, e in lags]
        out += [r(f"y.{c}_{s}", f"ema_{c}_{s}", 4) for s in (12, 24, 48)]
        out += [_roc(c, n).replace(W, "partition by o.unit_id order by o.rn").replace(f"lag({c},", f"lag(f.{c},")
                .replace(f"when {c} ", f"when f.{c} ").replace(f"round({c} /", f"round(f.{c} /") for n in (4, 24)]
    for c in SENSORS[:3]:
        short, long = (f"avg(o.{c}) over (partition by o.unit_id order by o.rn rows between {n - 1} preceding and current row)"
                       for n in (4, 24))
        out += [r(short, f"ma_{c}_short_4", 10), r(long, f"ma_{c}_long_24", 10),
                r(f"{short} - {long}", f"ma_{c}_crossover_4_24", 9)]
    out += [r("greatest(coalesce(o.Energy - lag(o.Energy) over w, 0), 0)", "energy_rate"),
            r("o.T_Return - o.T_Supply", "temp_difference"), r("o.T_Supply / nullif(o.T_Return, 0)", "temp_efficiency", 9),
            r("o.T_Supply - o.T_Outdoor", "temp_lift"), r("o.RH_Return - o.RH_Supply", "rh_difference"),
            r("o.T_Saturation - o.T_Supply", "saturation_margin"), r("o.T_Return - o.SP_Return", "setpoint_deviation")]
    filled = "filled as (select reading_id, " + ", ".join(
        f"last_value({c} ignore nulls) over ({W} rows unbounded preceding) as {c}" for c in SENSORS) + " from sensor_readings)"
    averages = "averages as (select reading_id, " + ", ".join(
        f"e_{c}.y{s} as {c}_{s}" for c in SENSORS for s in (12, 24, 48)) + " from " + " join ".join(
        f"ema_{c} e_{c}" + (" using (reading_id)" if i else "") for i, c in enumerate(SENSORS)) + ")"
    body = (f"select {', '.join(out)} from ordered o join filled f using (reading_id) "
            "join averages y using (reading_id) window w as (partition by o.unit_id order by o.rn)")
    return sql(body, ORDERED_SQL, filled, *[_ema_sql(c) for c in SENSORS], averages, recursive=True)


@query("engineered_sensors", _sensor_features_sql())
def engineered_sensors(spark, sf):
    """The engineered table over the ten sensors only, without calendar columns and run lengths."""
    df = fx.sensor_readings(spark, sf)
    out = engineer_features(df, SENSORS)
    calendar = set(add_time_features(df).columns) | {"power_state", "power_on_duration"}
    out = out.select("reading_id", *[c for c in out.columns if c not in calendar])
    digits = {c: 10 for c in out.columns if "_mean_" in c or c.startswith("ma_") and "crossover" not in c}
    digits |= {c: 8 for c in out.columns if c.startswith("roll_Energy_mean")}
    digits |= {c: 9 for c in out.columns if "crossover" in c or c == "temp_efficiency"}
    digits |= {c: 8 for c in out.columns if c.startswith("roc_")} | {c: 4 for c in out.columns if c.startswith("ema_")}
    return rounded(out, **digits)


# --- I: cleaning and anomalies --------------------------------------------------

def _chain(source: str) -> tuple[list[str], str]:
    ctes, last = [], source
    for i, c in enumerate(SENSORS):
        spread = f"1.5e0 * (quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25))"
        ctes.append(f"bound{i} as (select quantile_cont({c}, 0.25) - {spread} as lo, "
                    f"quantile_cont({c}, 0.75) + {spread} as hi from {last})")
        ctes.append(f"alive{i} as (select a.* from {last} a, bound{i} where {c} between lo and hi)")
        last = f"alive{i}"
    return ctes, last


CHAIN, ALIVE = _chain("sensor_readings")


@query("iqr_filter_sequential", sql("\nunion all\n".join(
    f"""select '{c}' as "column", (select count(*) from {'alive' + str(i - 1) if i else 'sensor_readings'}, bound{i}
    where {c} < lo or {c} > hi) as count, {r('lo', 'lower_bound')}, {r('hi', 'upper_bound')},
    (select count(*) from {ALIVE}) as survivors from bound{i}""" for i, c in enumerate(SENSORS)), *CHAIN))
def iqr_filter_sequential(spark, sf):
    df = fx.sensor_readings(spark, sf)
    alive, bounds = cleaning.remove_outliers_iqr(df, SENSORS)
    return rounded(cleaning.outlier_bounds_table(df, bounds).withColumn("survivors", F.lit(alive.count()).cast("long")))


CLEAN_CHAIN, CLEAN_ALIVE = _chain("gapless")
GAPLESS_SQL = "gapless as (select reading_id, unit_id, ts, " + ", ".join(
    f"last_value({c} ignore nulls) over ({W} rows unbounded preceding) as {c}" for c in SENSORS
) + " from (select distinct * from sensor_readings))"


@query("clean_pipeline", sql("select reading_id, unit_id, ts, " + ", ".join(r(c, c) for c in SENSORS)
                             + f" from {CLEAN_ALIVE}", GAPLESS_SQL, *CLEAN_CHAIN))
def clean_pipeline(spark, sf):
    return rounded(cleaning.clean_readings(fx.sensor_readings(spark, sf), columns=SENSORS))


ZSTATS = "zs as (select " + ", ".join(f"avg({c}) as {c}_m, stddev_samp({c}) as {c}_s" for c in FIVE) + " from sensor_readings)"


def _zflag(c: str) -> str:
    return f"cast(coalesce(abs(({c} - {c}_m) / {c}_s) > 3, false) as int)"


@query("zscore_flags", sql("select reading_id, " + ", ".join(r(f"({c} - {c}_m) / {c}_s", f"{c}_zscore") for c in FIVE)
    + ", " + ", ".join(f"{_zflag(c)} as {c}_is_anomaly_zscore" for c in FIVE) + ", "
    + " + ".join(_zflag(c) for c in FIVE) + " as zscore_anomaly_count from sensor_readings, zs", ZSTATS))
def zscore_flags(spark, sf):
    out = anomaly.zscore_anomaly_detection(base(spark, sf, *FIVE), FIVE)
    return rounded(trim(out).drop(*FIVE))


IQRS = "qs as (select " + ", ".join(
    f"quantile_cont({c}, 0.25) as {c}_1, quantile_cont({c}, 0.75) as {c}_3" for c in SENSORS) + " from sensor_readings)"


def _iflag(c: str) -> str:
    spread = f"1.5e0 * ({c}_3 - {c}_1)"
    return f"cast(coalesce({c} < {c}_1 - {spread} or {c} > {c}_3 + {spread}, false) as int)"


@query("iqr_flags", sql("select reading_id, " + ", ".join(f"{_iflag(c)} as {c}_is_anomaly_iqr" for c in SENSORS) + ", "
    + " + ".join(_iflag(c) for c in SENSORS) + " as iqr_anomaly_count from sensor_readings, qs", IQRS))
def iqr_flags(spark, sf):
    out = anomaly.iqr_anomaly_detection(base(spark, sf, *SENSORS), SENSORS)
    return trim(out).drop(*SENSORS)


@query("standardize", sql("select reading_id, " + ", ".join(
    r(f"(coalesce({c}, 0) - (select avg(coalesce({c}, 0)) from sensor_readings)) / "
      f"(select stddev_pop(coalesce({c}, 0)) from sensor_readings)", f"{c}_scaled") for c in FIVE)
    + " from sensor_readings"))
def standardize(spark, sf):
    out = anomaly.standardize(base(spark, sf, *FIVE), FIVE)
    return rounded(trim(out).drop(*FIVE))


@query("isolation_forest_fit")
def isolation_forest_fit(spark, sf):
    """Size and depth of each grown tree."""
    df = base(spark, sf, *FIVE)
    model = forest.isolation_forest_fit(df, FIVE, "reading_id")
    nodes = spark.createDataFrame(model.nodes)
    return rounded(nodes.groupBy("tree").agg(
        F.count(F.lit(1)).alias("nodes"), F.count_if(F.col("feature") < 0).alias("leaves"),
        F.max("depth").alias("deepest")))


@query("isolation_forest_score")
def isolation_forest_score(spark, sf):
    df = base(spark, sf, *FIVE)
    model = forest.isolation_forest_fit(df, FIVE, "reading_id")
    return rounded(forest.isolation_forest_score(df, model).select("reading_id", "if_score", "if_anomaly"))


VECTOR = [f"v{i}" for i in range(64)]


@query("reconstruction_fit")
def reconstruction_fit(spark, sf):
    df = fx.vectors(spark, sf)
    fit = anomaly.reconstruction_fit(df, VECTOR, 32)
    rows = [(i, float(v)) for i, v in enumerate(fit.model.explainedVariance.toArray())]
    return rounded(spark.createDataFrame(rows, "component int, explained double"))


@query("reconstruction_flags")
def reconstruction_flags(spark, sf):
    df = fx.vectors(spark, sf)
    scored = anomaly.reconstruction_fit(df, VECTOR, 32).error(df)
    return rounded(anomaly.error_flags(scored.select("vec_id", "mse")))


@query("reconstruction_threshold", sql(f"""select reading_id, {r('mse', 'mse')},
  {r('(select quantile_cont(mse, 0.95) from errors)', 'threshold')},
  cast(coalesce(mse > (select quantile_cont(mse, 0.95) from errors), false) as int) as is_anomaly from errors""",
  "errors as (select reading_id, (T_Return - T_Supply) * (T_Return - T_Supply) as mse from sensor_readings)"))
def reconstruction_threshold(spark, sf):
    """The threshold step on given errors: the supply as a guess of the return."""
    gap = F.col("T_Return") - F.col("T_Supply")
    errors = base(spark, sf, "T_Supply", "T_Return").select("reading_id", (gap * gap).alias("mse"))
    return rounded(anomaly.error_flags(errors))


ENSEMBLE_SQL = f"""counted as (select reading_id, {' + '.join(_zflag(c) for c in FIVE)} as z,
  {' + '.join(_iflag(c) for c in FIVE)} as i from sensor_readings, zs, qs)"""


@query("ensemble_score", sql(f"""select reading_id, {r('0.3e0 * z / (select max(z) from counted) + 0.3e0 * i / (select max(i) from counted)', 'ensemble_score')},
  cast(0.3e0 * z / (select max(z) from counted) + 0.3e0 * i / (select max(i) from counted) > 0.5 as int) as ensemble_anomaly
  from counted""", ZSTATS, IQRS, ENSEMBLE_SQL))
def ensemble_score(spark, sf):
    df = base(spark, sf, *FIVE)
    out = anomaly.iqr_anomaly_detection(anomaly.zscore_anomaly_detection(df, FIVE), FIVE)
    out = anomaly.ensemble_anomaly_score(out)
    return rounded(out.select("reading_id", "ensemble_score", "ensemble_anomaly"))


@query("anomaly_severity")
def anomaly_severity(spark, sf):
    """Z-score and isolation scores combined and graded, rows per grade."""
    df = base(spark, sf, *FIVE)
    model = forest.isolation_forest_fit(df, FIVE, "reading_id")
    scored = forest.isolation_forest_score(anomaly.zscore_anomaly_detection(df, FIVE), model)
    graded = classify_alert_severity(anomaly.ensemble_anomaly_score(scored))
    return graded.groupBy("severity").agg(F.count(F.lit(1)).alias("n"))
