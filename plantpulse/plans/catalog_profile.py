"""Queries over whole-table profiles and energy reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from plantpulse.operators import cleaning, energy, profile
from plantpulse.plans import fixtures as fx
from plantpulse.plans.catalog_tables import HOURS_SQL
from plantpulse.plans.registry import LOG_SQL, per_column, query, r, rounded, sql
from plantpulse.schema import SENSORS

PEAK, OFF_PEAK = [6, 7, 8, 9, 10, 11], [0, 1, 2, 21, 22, 23]


@query("hourly_profile", sql(f"""select cast(hour(ts) as int) as hour, {r('avg(Power)', 'mean', 9)},
  {r('sum(Power)', 'sum', 4)}, {r('stddev_samp(Power)', 'std')} from sensor_readings group by 1"""))
def hourly_profile(spark, sf):
    return rounded(profile.hourly_profile(fx.sensor_readings(spark, sf)), mean=9, sum=4)


@query("daily_profile", sql(f"""select cast(isodow(ts) - 1 as int) as day_of_week, {r('avg(Power)', 'mean', 9)},
  {r('sum(Power)', 'sum', 4)} from sensor_readings group by 1"""))
def daily_profile(spark, sf):
    return rounded(profile.daily_profile(fx.sensor_readings(spark, sf)), mean=9, sum=4)


@query("monthly_profile", sql(f"""select cast(month(ts) as int) as month, {r('avg(Power)', 'mean', 9)},
  {r('sum(Power)', 'sum', 4)} from sensor_readings group by 1"""))
def monthly_profile(spark, sf):
    return rounded(profile.monthly_profile(fx.sensor_readings(spark, sf)), mean=9, sum=4)


@query("energy_kpis", sql(f"""select {r('100e0 * count(*) filter (Power > 0) / count(*)', 'duty_cycle_percent')},
  {r('sum(Power)', 'power_sum', 4)}, {r('avg(Power)', 'average_power', 9)}, {r('max(Power)', 'peak_power')},
  count(*) filter (Power > 0) as on_rows, {r('max(Energy)', 'energy_max')}, count(*) as rows from sensor_readings"""))
def energy_kpis(spark, sf):
    return rounded(profile.energy_kpis(fx.sensor_readings(spark, sf)), power_sum=4, average_power=9)


NAMES = ["reading_id", "unit_id", "ts", *SENSORS]


def half_even(expr: str, digits: int) -> str:
    """Round half to even in exact decimal arithmetic, after 10 digits."""
    d = f"(cast({expr} as decimal(30, 10)) * {10 ** digits})"
    up = f"case when {d} - floor({d}) > 0.5 or ({d} - floor({d}) = 0.5 and abs(floor({d})) % 2 = 1) then 1 else 0 end"
    return f"(floor({d}) + {up})::double / {10 ** digits}e0 + 0e0"


def _quality_sql() -> str:
    rows = []
    for c in NAMES:
        kind = {"ts": "timestamp_ntz", "reading_id": "bigint", "unit_id": "bigint"}.get(c, "double")
        stats = ["null::double"] * 5 if c == "ts" else [
            half_even(f"({e})::double", 4) for e in (
                f"avg({c})", f"stddev_samp({c})", f"min({c})", f"max({c})", f"median({c})")]
        rows.append(
            f"select '{c}' as \"column\", '{kind}' as dtype, count(*) as total_rows, {len(NAMES)}::int as total_columns, "
            f"count(*) - count({c}) as missing_count, "
            + half_even(f"100e0 * (count(*) - count({c})) / count(*)", 2) + " as missing_percentage, "
            + ", ".join(f"{e} as {n}" for e, n in zip(stats, ("mean", "std", "min", "max", "median")))
            + " from sensor_readings")
    return "\nunion all\n".join(rows)


@query("quality_report", sql(_quality_sql()))
def quality_report(spark, sf):
    return profile.quality_report(fx.sensor_readings(spark, sf))


@query("missing_summary", sql("select * from (" + per_column(NAMES, """select '{c}' as "column",
  count(*) - count({c}) as missing, """ + r("100e0 * (count(*) - count({c})) / count(*)", "percentage")
       + " from sensor_readings") + ") where missing > 0"))
def missing_summary(spark, sf):
    return rounded(profile.missing_summary(fx.sensor_readings(spark, sf)))


DESCRIBE_SQL = per_column(SENSORS, f"""select '{{c}}' as "column", count({{c}}) as count, {r('avg({c})', 'mean')},
  {r('stddev_samp({c})', 'std')}, {r('min({c})', 'min')}, {r('quantile_cont({c}, 0.25)', 'q25')},
  {r('quantile_cont({c}, 0.5)', 'q50')}, {r('quantile_cont({c}, 0.75)', 'q75')}, {r('max({c})', 'max')}
  from sensor_readings""")


@query("describe", sql(DESCRIBE_SQL))
def describe(spark, sf):
    return rounded(profile.describe(fx.sensor_readings(spark, sf), SENSORS))


QS = [0.05, 0.25, 0.5, 0.75, 0.95]


@query("exact_quantile", sql("\nunion all\n".join(
    f"select '{c}' as \"column\", {q}::double as quantile, {r(f'quantile_cont({c}, {q})', 'value')} from sensor_readings"
    for c in SENSORS for q in QS)))
def exact_quantile(spark, sf):
    return rounded(profile.exact_quantile(fx.sensor_readings(spark, sf), SENSORS, QS))


def histogram_sql(column: str) -> str:
    return f"""select b.bin, {r('lo + b.bin * (hi - lo) / 50', 'lower')},
  {r('lo + (b.bin + 1) * (hi - lo) / 50', 'upper')}, coalesce(n, 0) as count
  from (select unnest(range(50))::int as bin) b
  cross join (select min({column}) as lo, max({column}) as hi from sensor_readings) e
  left join (select least(floor(50 * ({column} - lo) / (hi - lo)), 49)::int as bin, count(*) as n
             from sensor_readings, (select min({column}) as lo, max({column}) as hi from sensor_readings)
             where {column} is not null group by 1) h on h.bin = b.bin"""


@query("histogram", sql(histogram_sql("Power")))
def histogram(spark, sf):
    return rounded(profile.histogram(fx.sensor_readings(spark, sf), "Power"))


CORRELATION_SQL = "\nunion all\n".join(
    f"select '{a}' as column_a, '{b}' as column_b, {r(f'corr({a}, {b})', 'correlation')} from sensor_readings"
    for a in SENSORS for b in SENSORS)


@query("correlation_matrix", sql(CORRELATION_SQL))
def correlation_matrix(spark, sf):
    return rounded(profile.correlation_matrix(fx.sensor_readings(spark, sf), SENSORS))


@query("value_counts", "select event_type, count(*) as count from events group by 1 order by 2 desc, 1")
def value_counts(spark, sf):
    return profile.value_counts(fx.table(spark, sf, "events"), "event_type")


QUARTILES_SQL = "quartiles as (select " + ", ".join(
    f"quantile_cont({c}, {q}) as {c}_q{n}" for c in SENSORS for n, q in ((1, 0.25), (2, 0.5), (3, 0.75))
) + " from sensor_readings)"
INSIDE = "{c} between {c}_q1 - 1.5e0 * ({c}_q3 - {c}_q1) and {c}_q3 + 1.5e0 * ({c}_q3 - {c}_q1)"


@query("boxplot_stats", sql(per_column(SENSORS, f"""select '{{c}}' as "column", {r('any_value({c}_q1)', 'q25')},
  {r('any_value({c}_q2)', 'q50')}, {r('any_value({c}_q3)', 'q75')},
  {r(f'min({{c}}) filter ({INSIDE})', 'whisker_low')}, {r(f'max({{c}}) filter ({INSIDE})', 'whisker_high')},
  count(*) filter (not ({INSIDE})) as outliers from sensor_readings, quartiles"""), QUARTILES_SQL))
def boxplot_stats(spark, sf):
    return rounded(profile.boxplot_stats(fx.sensor_readings(spark, sf), SENSORS))


@query("outlier_counts", sql(per_column(SENSORS, f"""select '{{c}}' as "column", count(*) filter (not ({INSIDE})) as outliers,
  {r(f'100e0 * count(*) filter (not ({INSIDE})) / count(*)', 'percentage')} from sensor_readings, quartiles"""),
    QUARTILES_SQL))
def outlier_counts(spark, sf):
    return rounded(profile.outlier_counts(fx.sensor_readings(spark, sf), SENSORS))


# exact copies and same-key rows are made from the given rows, two of every seventh
TWICE_SQL = """twice as (select * from sensor_readings union all
  select * from sensor_readings where reading_id % 7 = 0)"""


@query("dedupe", sql(f"""select 'all' as kind, reading_id, unit_id, {r('Power', 'Power')} from
  (select distinct * from twice) union all
  select 'unit_hour' as kind, reading_id, unit_id, {r('Power', 'Power')} from (select *, row_number() over
  (partition by unit_id, hour(ts) order by ts, reading_id) as rn from sensor_readings) where rn = 1""", TWICE_SQL))
def dedupe(spark, sf):
    df = fx.sensor_readings(spark, sf)
    whole = cleaning.remove_duplicates(df.unionByName(df.filter("reading_id % 7 = 0")))
    hours = cleaning.remove_duplicates(df.withColumn("h", F.hour("ts")), ["unit_id", "h"])
    keep = ["reading_id", "unit_id", "Power"]
    return rounded(whole.select(F.lit("all").alias("kind"), *keep).unionByName(
        hours.select(F.lit("unit_hour").alias("kind"), *keep)))


@query("feature_summary", sql(per_column([c for c in SENSORS if c != "Power"], f"""select '{{c}}' as feature,
  count(*) - count({{c}}) as missing_count, {r('var_samp({c})', 'variance', 4)}, 9::int as total_features
  from sensor_readings""")))
def feature_summary(spark, sf):
    df = fx.sensor_readings(spark, sf).select(*SENSORS)
    return rounded(profile.feature_summary(df, "Power"), variance=4)


@query("peak_hours", sql("""select 'peak' as kind, hour from hourly, cuts where mean > q3
  union all select 'off_peak', hour from hourly, cuts where mean < q1""", HOURS_SQL))
def peak_hours(spark, sf):
    return energy.peak_hours(fx.sensor_readings(spark, sf))


SHIFT = "100e0 * (select sum(total) from hourly, cuts where mean > q3) / (select sum(total) from hourly)"


@query("shiftable_load", sql(f"select {r(SHIFT, 'shiftable_load_percent')}", HOURS_SQL))
def shiftable_load(spark, sf):
    return rounded(energy.optimize_schedule(fx.sensor_readings(spark, sf)).select("shiftable_load_percent"))


@query("savings", sql(f"""select unit_id, {r('b', 'baseline_power', 12)}, {r('b * 0.85e0', 'optimized_power', 12)},
  {r('(b - b * 0.85e0) * 24', 'daily_savings_kwh')}, {r('(b - b * 0.85e0) * 24 * 365', 'annual_savings_kwh')},
  {r('(b * 24 * 0.12e0 - b * 0.85e0 * 24 * 0.12e0)', 'daily_savings_cost')},
  {r('(b * 24 * 0.12e0 - b * 0.85e0 * 24 * 0.12e0) * 365', 'annual_savings_cost')},
  {r('case when b > 0 then (b - b * 0.85e0) / b * 100 else 0 end', 'savings_percentage')}
  from (select unit_id, avg(Power) as b from sensor_readings group by 1)"""))
def savings(spark, sf):
    return rounded(energy.estimate_savings(fx.sensor_readings(spark, sf), ("unit_id",)),
                   baseline_power=12, optimized_power=12)


@query("tou_savings", sql(f"""select {r('p', 'mean_peak')}, {r('o', 'mean_off_peak')},
  {r('(p - o) * 6 * 365 * 0.12e0', 'savings', 4)} from (select
  avg(Power) filter (hour(ts) in (6, 7, 8, 9, 10, 11)) as p,
  avg(Power) filter (hour(ts) in (0, 1, 2, 21, 22, 23)) as o from sensor_readings)"""))
def tou_savings(spark, sf):
    return rounded(energy.tou_savings(fx.sensor_readings(spark, sf), PEAK, OFF_PEAK), savings=4)


@query("optimization_report", sql(f"""select {r('duty', 'duty_cycle_percent')}, {r('total', 'total_energy', 4)},
  {r('mean', 'average_power', 9)}, {r('top', 'peak_power')}, {r(SHIFT, 'shiftable_load_percent')},
  {r('mean * 0.15e0 * 24 * 365', 'annual_savings_kwh', 4)}, {r('mean * 0.15e0 * 24 * 365 * 0.12e0', 'annual_savings_cost', 4)},
  'Shift high-power operations to off-peak hours: [' ||
    (select string_agg(hour::varchar, ', ' order by hour) from hourly, cuts where mean < q1) || '] | ' ||
  printf('Potential annual savings: $%.2f', mean * 0.15e0 * 24 * 365 * 0.12e0) || ' | ' ||
  printf('Reduce duty cycle by optimizing setpoints during %.1f%% idle time', duty) as recommendations,
  {r('(select sum(mean) from hourly)', 'sum_of_hourly_means')}
  from (select 100e0 * count(*) filter (Power > 0) / count(*) as duty, sum(Power) as total, avg(Power) as mean,
        max(Power) as top from sensor_readings)""", HOURS_SQL))
def optimization_report(spark, sf):
    out = energy.optimization_report(fx.sensor_readings(spark, sf))
    means = F.aggregate(F.map_values("consumption_profile.hourly_profile.mean"), F.lit(0.0), lambda a, v: a + v)
    return rounded(out.select(
        "consumption_profile.duty_cycle_percent", "consumption_profile.total_energy",
        "consumption_profile.average_power", "consumption_profile.peak_power",
        "schedule_optimization.shiftable_load_percent", "estimated_savings.annual_savings_kwh",
        "estimated_savings.annual_savings_cost", F.concat_ws(" | ", "recommendations").alias("recommendations"),
        means.alias("sum_of_hourly_means")),
        total_energy=4, average_power=9, annual_savings_kwh=4, annual_savings_cost=4)


@query("data_info", sql(f"""select count(*) as rows, {len(NAMES)}::int as columns, min(ts) as start, max(ts) as "end",
  epoch_us(max(ts)) - epoch_us(min(ts)) as duration_micros,
  {' + '.join(f'(count(*) - count({c}))' for c in NAMES)} as missing_values from sensor_readings"""))
def data_info(spark, sf):
    return profile.data_info(fx.sensor_readings(spark, sf))


@query("median_defaults", sql(per_column(SENSORS, "select '{c}' as \"column\", " + r("median({c})", "median")
                                         + " from sensor_readings")))
def median_defaults(spark, sf):
    return rounded(profile.median_defaults(fx.sensor_readings(spark, sf), SENSORS))


@query("prediction_summary", sql(f"""select count(*) as total, count(*) filter (prediction = 1) as failures,
  count(*) filter (prediction = 0) as normal, {r('avg(probability)', 'mean_probability')} from prediction_log""", LOG_SQL))
def prediction_summary(spark, sf):
    return rounded(profile.prediction_summary(fx.prediction_log(spark, sf)))


BUNDLE = SENSORS  # the hourly part alone is limited, to five columns


def _bundle_sql() -> str:
    parts = [per_column(NAMES, """select * from (select 'missing' as section, '{c}' as item, 0 as position,
      100e0 * (count(*) - count({c})) / count(*) as value from sensor_readings) where value > 0""")]
    stats = {"count": "count({c})::double", "mean": "avg({c})", "std": "stddev_samp({c})", "min": "min({c})",
             "q25": "quantile_cont({c}, 0.25)", "q50": "quantile_cont({c}, 0.5)",
             "q75": "quantile_cont({c}, 0.75)", "max": "max({c})"}
    parts += [per_column(BUNDLE, f"select 'statistics', '{{c}}.{s}', 0, {e} from sensor_readings")
              for s, e in stats.items()]
    parts += [f"select 'histogram', '{c}', bin, count::double from ({histogram_sql(c)})" for c in BUNDLE]
    parts += [f"select 'correlation', '{a}~{b}', 0, corr({a}, {b}) from sensor_readings" for a in BUNDLE for b in BUNDLE]
    parts += [per_column(BUNDLE[:5], "select 'hourly', '{c}', hour(ts)::int, avg({c}) from sensor_readings group by 3")]
    return f"select section, item, position::int as position, {r('value', 'value')} from (" + "\nunion all\n".join(parts) + ")"


@query("dataset_profile", sql(_bundle_sql()))
def dataset_profile(spark, sf):
    return rounded(profile.profile_table(fx.sensor_readings(spark, sf), BUNDLE))
