"""Queries over sources, projections, joins, limits, set operations and scalar columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from plantpulse import session
from plantpulse.functions import calendar, grading, thermal
from plantpulse.operators import anomaly, cleaning, energy, learning, monitoring, profile, select, windows
from plantpulse.operators.alerts import acknowledge, active_alerts
from plantpulse.operators.scorer import WeightedScorer
from plantpulse.plans import fixtures as fx
from plantpulse.plans.registry import (
    ALERTS_SQL, GRID_SQL, LOG_SQL, NEW_SQL, OLD_SQL, per_column, query, r, rounded, sql,
)
from plantpulse.schema import CHECK_RANGES, CONTRACT_RANGES, DESCRIPTIONS, SENSORS
from plantpulse.sources import tables
from plantpulse.sources.models import ModelStore

ALL_R = ", ".join(r(c, c) for c in SENSORS)


# --- A: sources and sinks -------------------------------------------------------

@query("csv_scan", sql(f"select reading_id, unit_id, ts, {ALL_R} from sensor_readings"))
def csv_scan(spark, sf):
    path = session.new_folder(spark, "csv_drop")
    df = fx.sensor_readings(spark, sf)
    tables.write_csv(df, path)
    return rounded(tables.read_csv(spark, path, df.schema))


@query("csv_scan_untyped", sql(f"""select reading_id::bigint as reading_id, ts, {ALL_R},
  {r('reading_id * 0.5e0', 'Extra')}, 'u' || unit_id as unit, reading_id % 3 = 0 as third from sensor_readings"""))
def csv_scan_untyped(spark, sf):
    """Without a schema: sensors by name, other columns by their cells."""
    path = session.new_folder(spark, "csv_drop")
    df = fx.sensor_readings(spark, sf).withColumns({
        "Extra": F.col("reading_id") * 0.5, "unit": F.concat(F.lit("u"), F.col("unit_id").cast("string")),
        "third": F.col("reading_id") % 3 == 0}).drop("unit_id")
    tables.write_csv(df, path)
    out = tables.read_csv(spark, path, date_column="ts")
    return rounded(out.withColumn("ts", F.col("ts").cast("timestamp_ntz")))


@query("parquet_scan", "select event_id, ts, user_id, value from events")
def parquet_scan(spark, sf):
    return tables.read_parquet(spark, f"{sf}/events.parquet", ["event_id", "ts", "user_id", "value"])


@query("parquet_sink", sql(f"select reading_id, unit_id, ts, cast(ts as date) as day, {r('Power', 'Power')} "
                           "from sensor_readings"))
def parquet_sink(spark, sf):
    path = session.new_folder(spark, "parquet_sink")
    tables.write_parquet(fx.sensor_readings(spark, sf), path, ts="ts")
    return rounded(tables.read_parquet(spark, path, ["reading_id", "unit_id", "ts", "day", "Power"]))


@query("staged_load", sql(f"select reading_id, {r('T_Outdoor', 'T_Outdoor')}, {r('Power', 'Power')} "
                          "from sensor_readings"))
def staged_load(spark, sf):
    stages = tables.Stages(session.new_folder(spark, "stages"))
    df = fx.sensor_readings(spark, sf)
    tables.write_csv(df, stages.raw)
    raw = tables.staged_load(spark, stages, schema=df.schema)
    tables.write_parquet(raw, stages.interim)
    return rounded(tables.staged_load(spark, stages).select("reading_id", "T_Outdoor", "Power"))


@query("column_catalog", sql(per_column(SENSORS, "select '{c}' as \"column\", d.text as description, "
       "count({c}) as present from sensor_readings, (select * from descriptions where name = '{c}') d group by 1, 2"),
       "descriptions(name, text) as (values " + ", ".join(f"('{c}', '{t}')" for c, t in DESCRIPTIONS.items()) + ")"))
def column_catalog(spark, sf):
    return profile.column_catalog(fx.sensor_readings(spark, sf))


@query("report_json_sink", sql(f"""select {r('100e0 * count(*) filter (Power > 0) / count(*)', 'duty_cycle_percent')},
  {r('sum(Power)', 'total_energy', 4)}, {r('avg(Power)', 'average_power', 8)},
  {r('avg(Power) * 0.15e0 * 24 * 365 * 0.12e0', 'annual_savings_cost', 4)} from sensor_readings"""))
def report_json_sink(spark, sf):
    path = session.new_folder(spark, "report")
    report = energy.optimization_report(fx.sensor_readings(spark, sf))
    tables.write_report(report, path)
    back = spark.read.schema(
        "consumption_profile struct<duty_cycle_percent double, total_energy double, average_power double>, "
        "estimated_savings struct<annual_savings_cost double>").json(path)
    back = back.select("consumption_profile.duty_cycle_percent", "consumption_profile.total_energy",
                       "consumption_profile.average_power", "estimated_savings.annual_savings_cost")
    return rounded(back, total_energy=4, average_power=8, annual_savings_cost=4)


@query("preview", sql(f"select reading_id, unit_id, ts, {ALL_R} from sensor_readings order by ts, reading_id limit 100"))
def preview(spark, sf):
    return rounded(select.preview(fx.sensor_readings(spark, sf), 100))


@query("model_store", """select * from (values ('forest', 'random_forest', 1e0, 10, true), ('tree', 'random_forest', 2e0, 3, false))
  t(model_name, model_type, version, features, current) cross join (select count(*) as scored, count(distinct event_id) as readings from events)""")
def model_store(spark, sf):
    """Registry rows after saves (one made twice), a newer version and a deletion, and the rows the current model scores."""
    store = ModelStore(spark, session.new_folder(spark, "models"))
    df = windows.impute_zero(windows.create_failure_labels(fx.sensor_readings(spark, sf)), SENSORS)
    small = learning.train_classifier(df, SENSORS[:3], "random_forest", "is_failure", trees=3, max_depth=3)
    model = learning.train_classifier(df, SENSORS, "random_forest", "is_failure", trees=5, max_depth=5)
    store.save(small, "gone", "random_forest", {"version": 0.0}, SENSORS[:3])
    store.save(small, "tree", "random_forest", {"version": 1.0}, SENSORS[:3], run="a")
    store.save(small, "tree", "random_forest", {"version": 2.0}, SENSORS[:3], run="b")
    store.save(small, "tree", "random_forest", {"version": 3.0}, SENSORS[:3], run="b")
    store.delete("gone")
    store.save(model, "forest", "random_forest", {"version": 1.0}, SENSORS)
    again, names = store.load()
    scored = learning.score(df, again)
    counts = scored.agg(F.count(F.lit(1)).alias("scored"), F.countDistinct("reading_id").alias("readings"))
    rows = store.models().select(
        "model_name", "model_type", F.col("metrics")["version"].alias("version"), F.size("features").alias("features"),
        (F.col("model_name") == store.current().model_name).alias("current"))
    return rows.select("*", *[counts.select(c).scalar().alias(c) for c in counts.columns])


# --- B: projections and filters -------------------------------------------------

@query("numeric_projection", sql(f"select reading_id, unit_id, {ALL_R} from sensor_readings"))
def numeric_projection(spark, sf):
    return rounded(select.numeric_projection(fx.sensor_readings(spark, sf)))


@query("feature_projection", sql(f"select {ALL_R} from sensor_readings"))
def feature_projection(spark, sf):
    df = windows.create_failure_labels(fx.sensor_readings(spark, sf))
    return rounded(select.feature_projection(df, ("reading_id", "unit_id")))


@query("positional_slice", sql("""select reading_id, ts, """ + r("T_Supply", "T_Supply") + ", " + r("Power", "Power") + """
  from (select *, row_number() over (order by ts, reading_id) - 1 as i from sensor_readings)
  where i >= 100 and i < 1100"""))
def positional_slice(spark, sf):
    return rounded(select.positional_slice(
        fx.sensor_readings(spark, sf), 100, 1100, ["reading_id", "ts", "T_Supply", "Power"]))


def _checks() -> str:
    return "\nunion all\n".join(
        f"select '{c}' as \"column\", count(*) filter ({c} < {lo} or {c} > {hi}) as out_of_range_count, "
        f"cast({lo} as double) as min_allowed, cast({hi} as double) as max_allowed from sensor_readings"
        for c, (lo, hi) in CHECK_RANGES.items())


@query("range_check", sql(_checks()))
def range_check(spark, sf):
    return cleaning.validate_sensor_ranges(fx.sensor_readings(spark, sf))


def _reasons() -> str:
    cases = []
    for c, (lo, hi) in CONTRACT_RANGES.items():
        beyond = f"{c} < {lo}" + (f" or {c} > {hi}" if hi is not None else "")
        cases.append(f"case when {c} is null then '{c} missing' when {beyond} then '{c} out of range' end")
    return f"concat_ws(', ', {', '.join(cases)})"


CONTRACT_SQL = sql(f"""select reading_id, reasons, cast(reasons = '' as int) as is_valid
  from (select reading_id, {_reasons()} as reasons from sensor_readings)""")


@query("range_contract", CONTRACT_SQL)
def range_contract(spark, sf):
    out = select.range_contract(fx.sensor_readings(spark, sf))
    return out.select("reading_id", F.concat_ws(", ", "reasons").alias("reasons"), "is_valid")


@query("drop_missing", sql(f"""select reading_id, {r('T_Supply', 'T_Supply')}, {r('RH_Return', 'RH_Return')}
  from sensor_readings where T_Supply is not null and RH_Return is not null"""))
def drop_missing(spark, sf):
    df = fx.sensor_readings(spark, sf).select("reading_id", "T_Supply", "RH_Return")
    return rounded(select.drop_missing(df, ["T_Supply", "RH_Return"]))


@query("impute_zero", sql(f"""select reading_id,
  {r("coalesce(last_value(T_Supply ignore nulls) over w, 0)", "t_supply_filled")},
  {r("case when isinf(coalesce(last_value(ratio ignore nulls) over w, 0)) then 0 else coalesce(last_value(ratio ignore nulls) over w, 0) end", "ratio_filled", None)},
  {r("coalesce(T_Supply, 0)", "t_supply_zero")},
  {r("case when ratio is null or isinf(ratio) then 0 else ratio end", "ratio_zero", None)},
  {r("coalesce(RH_Return, 0)", "rh_return_zero")}
  from (select *, case when T_Return = 0 and Power = 0 then null when T_Return = 0 then cast('inf' as double)
               else Power / T_Return end as ratio from sensor_readings)
  window w as (partition by unit_id order by ts, reading_id rows unbounded preceding)"""))
def impute_zero(spark, sf):
    ratio = F.when(F.col("T_Return") == 0, F.when(F.col("Power") > 0, float("inf"))).otherwise(
        F.try_divide("Power", "T_Return"))
    df = fx.sensor_readings(spark, sf).withColumn("ratio", ratio).select(
        "reading_id", "unit_id", "ts", F.col("T_Supply").alias("t_supply_filled"),
        F.col("ratio").alias("ratio_filled"), F.col("T_Supply").alias("t_supply_zero"),
        F.col("ratio").alias("ratio_zero"), F.col("RH_Return").alias("rh_return_zero"))
    df = windows.impute_zero(df, ["t_supply_filled", "ratio_filled"], fill_first=True)
    df = windows.impute_zero(df, ["t_supply_zero", "ratio_zero"])
    df = windows.impute_zero(df, ["rh_return_zero"], drop_infinite=False)
    return rounded(df.drop("unit_id", "ts"), ratio_filled=None, ratio_zero=None)


HOURS_SQL = """hourly as (select cast(hour(ts) as int) as hour, avg(Power) as mean, sum(Power) as total
  from sensor_readings group by 1),
cuts as (select quantile_cont(mean, 0.25) as q1, quantile_cont(mean, 0.75) as q3 from hourly)"""


@query("membership_filter", sql(f"""select reading_id, cast(hour(ts) as int) as hour, {r('Power', 'Power')}
  from sensor_readings where hour(ts) in (select hour from hourly, cuts where mean > q3)""", HOURS_SQL))
def membership_filter(spark, sf):
    df = fx.sensor_readings(spark, sf).select("reading_id", F.hour("ts").alias("hour"), "ts", "Power")
    peak = energy.peak_hours(df).filter(F.col("kind") == "peak").select("hour")
    return rounded(select.membership_filter(df, peak, "hour").drop("ts"))


@query("on_state", sql("""select reading_id, cast(coalesce(Power > 0, false) as int) as on_state,
  cast(coalesce(Power > 0.5, false) as int) as on_state_half from sensor_readings"""))
def on_state(spark, sf):
    return fx.sensor_readings(spark, sf).select(
        "reading_id", select.on_state().alias("on_state"), select.on_state("Power", 0.5).alias("on_state_half"))


@query("align_schema", sql(f"""select {r('Power', 'Power')}, 0e0 as roll_Power_mean_4, {r('T_Supply', 'T_Supply')},
  0e0 as missing_feature, reading_id from sensor_readings"""))
def align_schema(spark, sf):
    return rounded(select.align_schema(fx.sensor_readings(spark, sf), [
        "Power", "roll_Power_mean_4", "T_Supply", "missing_feature", "reading_id"]))


@query("quantile_flag", sql("""select is_anomaly, count(*) as n from (
  select cast(Power > (select quantile_cont(Power, 0.95) from sensor_readings) as int) as is_anomaly
  from sensor_readings) group by 1"""))
def quantile_flag(spark, sf):
    return select.quantile_flag(fx.sensor_readings(spark, sf)).groupBy("is_anomaly").agg(
        F.count(F.lit(1)).alias("n"))


# --- C: joins -------------------------------------------------------------------

@query("calendar_spine", sql(f"""select s.unit_id, s.ts, g.reading_id, {r('g.T_Supply', 'T_Supply')}, {r('g.Power', 'Power')}
  from (select unit_id, unnest(generate_series(min(ts), max(ts), interval 1 hour)) as ts
        from sensor_grid group by unit_id) s
  left join sensor_grid g on g.unit_id = s.unit_id and g.ts = s.ts""", GRID_SQL))
def calendar_spine(spark, sf):
    grid = fx.sensor_grid(spark, sf).select("unit_id", "ts", "reading_id", "T_Supply", "Power")
    return rounded(cleaning.calendar_spine(grid, "1 hour"))


@query("row_semi_join", sql(f"""select reading_id, unit_id, {r('Power', 'Power')} from sensor_readings
  where reading_id in (select event_id from events where event_type = 'signup')"""))
def row_semi_join(spark, sf):
    ids = fx.table(spark, sf, "events").filter("event_type = 'signup'").select(
        F.col("event_id").alias("reading_id"))
    df = fx.sensor_readings(spark, sf).select("reading_id", "unit_id", "Power")
    return rounded(select.row_semi_join(df, ids, "reading_id"))


@query("global_stat_broadcast", sql(f"""select reading_id, {r('Power', 'Power')}, {r('m', 'power_mean')},
  {r('s', 'power_std')}, {r('t', 'supply_max')} from sensor_readings,
  (select avg(Power) as m, stddev_samp(Power) as s, max(T_Supply) as t from sensor_readings)"""))
def global_stat_broadcast(spark, sf):
    df = fx.sensor_readings(spark, sf).select("reading_id", "Power", "T_Supply")
    out = anomaly.attach_stats(df, {"power_mean": F.avg("Power"), "power_std": F.stddev_samp("Power"),
                                    "supply_max": F.max("T_Supply")})
    return rounded(out.drop("T_Supply"))


STATS_SQL = per_column(SENSORS, "select '{c}' as feature, "
                       "(select avg({c}) from reference_window) as reference_mean, "
                       "(select stddev_samp({c}) from reference_window) as reference_std, "
                       "(select avg({c}) from new_window) as new_mean")


@query("stats_join", sql(f"select feature, {r('reference_mean', 'reference_mean')}, {r('reference_std', 'reference_std')}, "
                         f"{r('new_mean', 'new_mean')} from ({STATS_SQL})", OLD_SQL, NEW_SQL))
def stats_join(spark, sf):
    old, new = fx.split_windows(fx.sensor_readings(spark, sf))
    return rounded(monitoring.stats_join(
        monitoring.drift_fit(old, SENSORS), monitoring.drift_fit(new, SENSORS)))


@query("code_lookup", sql("""select alert_id, severity,
  case severity when 'low' then 1 when 'medium' then 2 when 'high' then 3 else 0 end as severity_level,
  ['Mon', 'Tue', 'Wed', 'Thu', 'Fri', 'Sat', 'Sun'][isodow(ts)] as day_name from alerts""", ALERTS_SQL))
def code_lookup(spark, sf):
    return fx.alerts(spark, sf).select(
        "alert_id", "severity", grading.severity_level(F.col("severity")).alias("severity_level"),
        calendar.day_name(F.weekday("ts")).alias("day_name"))


SCORER = WeightedScorer({
    "T_Supply": 0.03, "T_Return": -0.02, "SP_Return": 0.01, "T_Saturation": 0.02, "T_Outdoor": 0.05,
    "RH_Supply": -0.01, "RH_Return": 0.02, "RH_Outdoor": 0.005, "Energy": 0.0001, "Power": -1.5}, 0.1)


def scorer_sql(scorer: WeightedScorer, name: str) -> str:
    """Readings with gaps as zero, with probability p and prediction."""
    filled = ", ".join(f"coalesce({c}, 0) as {c}" for c in SENSORS)
    z = " + ".join([f"{scorer.bias}e0", *[f"{w}e0 * {c}" if "e" not in str(w) else f"{w} * {c}" for c, w in scorer.weights.items()]])
    return f"""{name} as (select *, cast(p > 0.5 as int) as prediction from (select *, 1 / (1 + exp(-({z}))) as p
  from (select reading_id, ts, {filled} from sensor_readings)))"""


SCORER_SQL = scorer_sql(SCORER, "scored")


@query("score_alignment", sql(f"select reading_id, prediction, {r('p', 'probability')} from scored", SCORER_SQL))
def score_alignment(spark, sf):
    """Predictions sit on the row they belong to; no positional join."""
    df = windows.impute_zero(fx.sensor_readings(spark, sf), SENSORS)
    return rounded(learning.score(df, SCORER).select("reading_id", "prediction", "probability"))


# --- F: sorts, limits, samples --------------------------------------------------

@query("sort_by_time", sql(f"select reading_id, unit_id, ts, {r('Power', 'Power')} from sensor_readings order by ts, reading_id"))
def sort_by_time(spark, sf):
    df = fx.sensor_readings(spark, sf).select("reading_id", "unit_id", "ts", "Power")
    return rounded(df).orderBy("ts", "reading_id")


@query("tail_n", sql(f"select reading_id, ts, {r('Power', 'Power')} from sensor_readings order by ts desc, reading_id desc limit 500"))
def tail_n(spark, sf):
    return rounded(select.tail_n(fx.sensor_readings(spark, sf).select("reading_id", "ts", "Power"), 500))


@query("top_features")
def top_features(spark, sf):
    df = windows.impute_zero(windows.create_failure_labels(fx.sensor_readings(spark, sf)), SENSORS)
    model = learning.train_classifier(df, SENSORS, "random_forest", trees=50)
    return rounded(learning.top_features(model, SENSORS, spark))


@query("active_alerts", sql("""select alert_id, type, ts, severity from alerts
  where alert_id % 4 <> 0 and severity in ('medium', 'high') order by ts desc, alert_id desc limit 50""", ALERTS_SQL))
def active_alerts_(spark, sf):
    open_ = acknowledge(fx.alerts(spark, sf), fx.alert_acks(spark, sf))
    return active_alerts(open_, "medium", 50).select("alert_id", "type", "ts", "severity")


@query("random_sample", sql(f"""select reading_id, {r('T_Outdoor', 'T_Outdoor')}, {r('Power', 'Power')},
  {r('T_Supply', 'T_Supply')} from sensor_readings order by md5(reading_id::varchar || ':42'), reading_id limit 1000"""))
def random_sample(spark, sf):
    df = fx.sensor_readings(spark, sf).select("reading_id", "T_Outdoor", "Power", "T_Supply")
    return rounded(select.random_sample(df, 1000, "reading_id"))


# --- G: set operations ----------------------------------------------------------

@query("index_union", sql("""select reading_id from sensor_readings where Power <= 0
  union select reading_id from sensor_readings where T_Supply is null order by 1"""))
def index_union(spark, sf):
    df = fx.sensor_readings(spark, sf)
    return select.index_union(df.filter("Power <= 0").select("reading_id"),
                              df.filter("T_Supply is null").select("reading_id")).orderBy("reading_id")


@query("log_append", sql("""select cast(ts as date) as day, count(*) as n, sum(prediction)::bigint as failures
  from prediction_log group by 1""", LOG_SQL))
def log_append(spark, sf):
    path = session.new_folder(spark, "log")
    log = fx.prediction_log(spark, sf)
    tables.append_log(log.filter("reading_id % 2 = 0"), path)
    tables.append_log(log.filter("reading_id % 2 = 1"), path)
    return tables.read_log(spark, path).groupBy("day").agg(
        F.count(F.lit(1)).alias("n"), F.sum("prediction").alias("failures"))


# --- H: scalar columns ----------------------------------------------------------

PARTS_SQL = """cast(hour(ts) as int) as hour, cast(isodow(ts) - 1 as int) as day_of_week,
  cast(day(ts) as int) as day_of_month, cast(weekofyear(ts) as int) as week_of_year,
  cast(month(ts) as int) as month, cast(quarter(ts) as int) as quarter, cast(year(ts) as int) as year"""


@query("calendar_parts", sql(f"select reading_id, {PARTS_SQL} from sensor_readings"))
def calendar_parts(spark, sf):
    df = fx.sensor_readings(spark, sf)
    return df.select("reading_id", *[e.alias(n) for n, e in calendar.calendar_parts("ts").items()])


@query("cyclical_encoding", sql("select reading_id, " + ", ".join(
    r(f"{fn}(2 * pi() * {part} / {n})", f"{name}_{fn}")
    for name, part, n in (("hour", "hour(ts)", 24), ("day_of_week", "(isodow(ts) - 1)", 7), ("month", "month(ts)", 12))
    for fn in ("sin", "cos")) + " from sensor_readings"))
def cyclical_encoding(spark, sf):
    df = fx.sensor_readings(spark, sf)
    return rounded(df.select("reading_id", *[e.alias(n) for n, e in calendar.cyclical_encoding("ts").items()]))


@query("calendar_flags", sql("""select reading_id,
  cast(hour(ts) between 8 and 18 and isodow(ts) <= 5 as int) as is_business_hours,
  cast(isodow(ts) >= 6 as int) as is_weekend, cast(month(ts) >= 10 or month(ts) <= 4 as int) as is_heating_season,
  cast(month(ts) between 6 and 9 as int) as is_cooling_season from sensor_readings"""))
def calendar_flags(spark, sf):
    df = fx.sensor_readings(spark, sf)
    return df.select("reading_id", *[e.alias(n) for n, e in calendar.calendar_flags("ts").items()])


@query("thermal_domain", sql(f"""select reading_id, {r('T_Return - T_Supply', 'temp_difference')},
  {r('T_Supply / nullif(T_Return, 0)', 'temp_efficiency')}, {r('T_Supply - T_Outdoor', 'temp_lift')},
  {r('RH_Return - RH_Supply', 'rh_difference')}, {r('T_Saturation - T_Supply', 'saturation_margin')},
  {r('T_Return - SP_Return', 'setpoint_deviation')} from sensor_readings"""))
def thermal_domain(spark, sf):
    df = fx.sensor_readings(spark, sf)
    return rounded(df.select("reading_id", *[e.alias(n) for n, e in thermal.thermal_domain(df.columns).items()]))


@query("efficiency_metrics", sql(f"""select reading_id, {r('lift', 'temp_lift')}, {r('Power / abs(lift)', 'power_per_degree', None)},
  {r('abs(lift) / (Power + 0.001e0)', 'efficiency_ratio', None)} from (select *, case when T_Supply - T_Outdoor = 0 then 0.001e0
  else T_Supply - T_Outdoor end as lift from sensor_readings)"""))
def efficiency_metrics(spark, sf):
    df = thermal.calculate_efficiency_metrics(fx.sensor_readings(spark, sf))
    return rounded(df.select("reading_id", "temp_lift", "power_per_degree", "efficiency_ratio"),
                   power_per_degree=None, efficiency_ratio=None)


@query("severity_ensemble", sql("""select reading_id, case when s > 0.7 then 'high' when s > 0.4 then 'medium'
  when s > 0.2 then 'low' else 'normal' end as severity from (select reading_id,
  case when T_Supply is null then null else (reading_id % 11) / 10e0 end as s from sensor_readings)"""))
def severity_ensemble(spark, sf):
    df = fx.sensor_readings(spark, sf).withColumn(
        "ensemble_score", F.when(F.col("T_Supply").isNotNull(), (F.col("reading_id") % 11) / 10.0))
    return grading.classify_alert_severity(df).select("reading_id", "severity")


@query("severity_probability", sql("""select reading_id, case when probability > 0.7 then 'high'
  when probability > 0.3 then 'medium' else 'low' end as severity from prediction_log""", LOG_SQL))
def severity_probability(spark, sf):
    return fx.prediction_log(spark, sf).select(
        "reading_id", grading.severity_of_probability(F.col("probability")).alias("severity"))


@query("recommendations", sql("""select reading_id, concat_ws(' | ',
  case when prediction = 1 then 'Immediate maintenance recommended' end,
  case when prediction = 1 and Power > 3.0 then 'High power consumption detected - check compressor' end,
  case when prediction = 1 and abs(T_Supply - T_Return) > 5 then 'Large temperature differential - inspect heat exchange' end,
  case when prediction = 0 then 'Equipment operating normally' end,
  case when prediction = 0 and probability > 0.3 then 'Monitor closely - approaching threshold' end) as advice
  from (select * replace (cast(Power < 0.1 or Power > 3.5 as int) as prediction) from prediction_log)""", LOG_SQL))
def recommendations(spark, sf):
    df = fx.prediction_log(spark, sf).withColumn(
        "prediction", ((F.col("Power") < 0.1) | (F.col("Power") > 3.5)).cast("int"))
    advice = grading.recommendations(F.col("prediction"), F.col("probability"))
    return df.select("reading_id", F.concat_ws(" | ", advice).alias("advice"))


@query("format_labels", sql("""select reading_id, printf('outdoor_%.1fC', T_Outdoor) as outdoor,
  printf('$%.2f', RH_Supply * 0.25e0) as money, printf('%.1f%%', RH_Supply * 0.5e0) as share,
  strftime(ts, '%Y-%m-%d %H:%M:%S') as time_text, cast(ts as date) as day,
  case when Power < 0.1 then 'Failure' else 'Normal' end as class from sensor_readings"""))
def format_labels(spark, sf):
    return fx.sensor_readings(spark, sf).select(
        "reading_id", grading.outdoor_label(F.col("T_Outdoor")).alias("outdoor"),
        grading.money(F.col("RH_Supply") * 0.25).alias("money"),
        grading.percent(F.col("RH_Supply") * 0.5).alias("share"),
        F.substring(F.col("ts").cast("string"), 1, 19).alias("time_text"), F.to_date("ts").alias("day"),
        grading.class_name((F.col("Power") < 0.1).cast("int")).alias("class"))


@query("clip_abs_replace", sql(f"""select reading_id, {r('greatest(T_Outdoor, 0)', 'clipped')}, {r('abs(T_Outdoor)', 'magnitude')},
  {r('nullif(T_Return, 0)', 'zero_missing')}, {r('case when T_Return = 0 then 1 else T_Return end', 'zero_one')},
  {r('case when T_Return = 0 then null else Power / T_Return end', 'finite_ratio')} from sensor_readings"""))
def clip_abs_replace(spark, sf):
    back = F.col("T_Return")
    ratio = F.when(back == 0, float("inf")).otherwise(F.try_divide(F.col("Power"), back))
    return rounded(fx.sensor_readings(spark, sf).select(
        "reading_id", F.greatest("T_Outdoor", F.lit(0.0)).alias("clipped"), F.abs("T_Outdoor").alias("magnitude"),
        thermal.nonzero(back).alias("zero_missing"), F.when(back == 0, 1.0).otherwise(back).alias("zero_one"),
        thermal.finite(ratio).alias("finite_ratio")))


@query("log_map_fields", sql(f"""select reading_id, 'Power,T_Supply' as names, {r('T_Supply', 'supply')},
  {r('Power', 'power')}, prediction, actual from prediction_log""", LOG_SQL))
def log_map_fields(spark, sf):
    log = fx.prediction_log(spark, sf)
    rows = tables.prediction_records(log.withColumn("when", F.struct("reading_id", "ts")),
                                     ["T_Supply", "Power"], ts="when", actual="actual")
    return rounded(rows.select(
        "ts.reading_id", F.concat_ws(",", F.sort_array(F.map_keys("features"))).alias("names"),
        F.col("features")["T_Supply"].alias("supply"), F.col("features")["Power"].alias("power"),
        "prediction", "actual"))
