"""Energy schedule, savings and setpoint reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plantpulse.functions.grading import money, outdoor_label, percent
from plantpulse.session import staged

DAYS = 365
PRICE = 0.12
CUT = 0.85


def hourly_means(df: DataFrame, ts="ts", power="Power") -> DataFrame:
    return df.groupBy(F.hour(ts).alias("hour")).agg(
        F.avg(power).alias("mean"), F.sum(power).alias("sum"))


def schedule_hours(hourly: DataFrame) -> DataFrame:
    """Peak and off-peak hours from at most 24 hourly means, in one row."""
    cut = hourly.agg(F.percentile("mean", F.array(F.lit(0.25), F.lit(0.75))).alias("q"))
    q = cut.select("q").scalar()
    return hourly.agg(
        F.sort_array(F.collect_list(F.when(F.col("mean") > q[1], F.col("hour")))).alias("peak_hours"),
        F.sort_array(F.collect_list(F.when(F.col("mean") < q[0], F.col("hour")))).alias("off_peak_hours"),
        F.coalesce(F.sum(F.when(F.col("mean") > q[1], F.col("sum"))), F.lit(0.0)).alias("__peak"),
        F.coalesce(F.sum("sum"), F.lit(0.0)).alias("__all"))


def shiftable(peak: Column, total: Column) -> Column:
    return F.when(total > 0, F.try_divide(peak, total) * 100).otherwise(0.0)


def peak_hours(df: DataFrame, ts="ts", power="Power") -> DataFrame:
    """One row per peak or off-peak hour."""
    one = schedule_hours(hourly_means(df, ts, power))
    kinds = F.map_from_arrays(F.array(F.lit("peak"), F.lit("off_peak")), F.array("peak_hours", "off_peak_hours"))
    return one.select(F.explode(kinds).alias("kind", "hours")).select("kind", F.explode("hours").alias("hour"))


def optimize_schedule(df: DataFrame, ts="ts", power="Power") -> DataFrame:
    one = schedule_hours(hourly_means(df, ts, power))
    return one.select("peak_hours", "off_peak_hours",
                      shiftable(F.col("__peak"), F.col("__all")).alias("shiftable_load_percent"))


def savings_exprs(baseline: Column, optimized: Column, hours_per_day: float = 24.0,
                  price: float = PRICE) -> dict[str, Column]:
    kwh = (baseline - optimized) * hours_per_day
    cost = baseline * hours_per_day * price - optimized * hours_per_day * price
    return {
        "daily_savings_kwh": kwh, "annual_savings_kwh": kwh * DAYS,
        "daily_savings_cost": cost, "annual_savings_cost": cost * DAYS,
        "savings_percentage": F.when(
            baseline > 0, F.try_divide(baseline - optimized, baseline) * 100).otherwise(0.0),
    }


def estimate_savings(df: DataFrame, keys: tuple[str, ...] = (), power="Power", share: float = CUT,
                     hours_per_day: float = 24.0, price: float = PRICE) -> DataFrame:
    """Savings of running at `share` of the mean power, per key or for all."""
    base = df.groupBy(*keys).agg(F.avg(power).alias("baseline_power"))
    base = base.withColumn("optimized_power", F.col("baseline_power") * share)
    return base.withColumns(
        savings_exprs(F.col("baseline_power"), F.col("optimized_power"), hours_per_day, price))


def tou_savings(df: DataFrame, peak: list[int], off_peak: list[int], ts="ts", power="Power") -> DataFrame:
    """Yearly savings of moving load between two fixed lists of hours."""
    hour = F.hour(ts)
    out = df.agg(F.avg(F.when(hour.isin(peak), F.col(power))).alias("mean_peak"),
                 F.avg(F.when(hour.isin(off_peak), F.col(power))).alias("mean_off_peak"))
    return out.withColumn(
        "savings", (F.col("mean_peak") - F.col("mean_off_peak")) * len(off_peak) * DAYS * PRICE)


def power_cells(df: DataFrame, ts="ts", power="Power", energy="Energy") -> DataFrame:
    """Counts, moments and maxima per hour, weekday and month: at most 2016 rows, one scan, staged."""
    on = F.count_if(F.col(power) > 0)
    return staged(df.groupBy(
        F.hour(ts).alias("hour"), F.weekday(ts).alias("day_of_week"), F.month(ts).alias("month")).agg(
        F.count(F.lit(1)).alias("rows"), F.count(power).alias("n"), F.avg(power).alias("mean"),
        F.var_pop(power).alias("var"), F.sum(power).alias("sum"), F.max(power).alias("peak"), on.alias("on"),
        F.max(energy).alias("energy")), "cells")


def rolled_up(cells: DataFrame, key: str, std: bool = False) -> DataFrame:
    """The profile by one part of the time, from the cells: mean, sum and sample deviation."""
    w = Window.partitionBy(key)
    total = F.sum(F.col("n") * F.col("mean"))
    away = F.col("mean") - F.try_divide(total.over(w), F.sum("n").over(w))
    spread = F.sum(F.col("n") * (F.col("var") + F.col("__away") * F.col("__away")))
    more = [F.sqrt(F.try_divide(spread, F.sum("n") - 1)).alias("std")] if std else []
    return cells.withColumn("__away", away).groupBy(key).agg(
        F.try_divide(total, F.sum("n")).alias("mean"), F.coalesce(F.sum("sum"), F.lit(0.0)).alias("sum"), *more)


def optimization_report(df: DataFrame, ts="ts", power="Power", energy="Energy") -> DataFrame:
    """The whole energy report as one nested row.

    Every part follows from counts, moments and maxima per hour, weekday and month, so the readings
    are scanned once and only small tables meet.
    """
    cells = power_cells(df, ts, power, energy)

    def profile(table: DataFrame, key: str) -> Column:
        stats = [c for c in table.columns if c != key]
        maps = [F.map_from_entries(F.sort_array(F.collect_list(F.struct(key, s)))).alias(s) for s in stats]
        return table.agg(F.struct(*maps).alias("m")).scalar()

    hourly = rolled_up(cells, "hour", std=True)
    rows = F.coalesce(F.sum("rows"), F.lit(0))
    kpis = cells.agg(
        (F.try_divide(F.coalesce(F.sum("on"), F.lit(0)), rows) * 100).alias("duty_cycle_percent"),
        F.coalesce(F.sum("sum"), F.lit(0.0)).alias("power_sum"),
        F.try_divide(F.sum(F.col("n") * F.col("mean")), F.sum("n")).alias("average_power"),
        F.max("peak").alias("peak_power"))
    plan = schedule_hours(hourly).select(F.struct(
        "peak_hours", "off_peak_hours",
        shiftable(F.col("__peak"), F.col("__all")).alias("shiftable_load_percent")).alias("s")).scalar()
    savings = savings_exprs(F.col("average_power"), F.col("average_power") * CUT)
    out = kpis.select(
        F.struct(
            profile(hourly, "hour").alias("hourly_profile"),
            profile(rolled_up(cells, "day_of_week"), "day_of_week").alias("daily_profile"),
            profile(rolled_up(cells, "month"), "month").alias("monthly_profile"),
            "duty_cycle_percent", F.col("power_sum").alias("total_energy"), "average_power", "peak_power",
        ).alias("consumption_profile"),
        plan.alias("schedule_optimization"),
        F.struct(*[e.alias(n) for n, e in savings.items()]).alias("estimated_savings"))
    hours = F.concat(F.lit("["), F.concat_ws(", ", F.transform(
        F.col("schedule_optimization.off_peak_hours"), lambda h: h.cast("string"))), F.lit("]"))
    # Report sentences.
    return out.withColumn("recommendations", F.array(
        F.concat(F.lit("Shift high-power operations to off-peak hours: "), hours),
        F.concat(F.lit("Potential annual savings: "), money(F.col("estimated_savings.annual_savings_cost"))),
        F.concat(F.lit("Reduce duty cycle by optimizing setpoints during "),
                 percent(F.col("consumption_profile.duty_cycle_percent")), F.lit(" idle time"))))


def simple_regression(df: DataFrame, feature: str, target: str) -> DataFrame:
    """One-feature least squares with its training error, from sums only."""
    both = df.select(F.col(feature).cast("double").alias("x"), F.col(target).cast("double").alias("y")).na.drop()
    n = F.count(F.lit(1))
    fit = both.agg(
        F.regr_slope("y", "x").alias("slope"), F.regr_intercept("y", "x").alias("intercept"),
        F.regr_r2("y", "x").alias("r2_score"), F.var_pop("y").alias("__vy"), n.alias("rows"))
    mse = F.col("__vy") * (1 - F.col("r2_score"))
    return fit.select("slope", "intercept", mse.alias("mse"), F.sqrt(mse).alias("rmse"), "r2_score", "rows")


def recommend_setpoints(df: DataFrame, outdoor="T_Outdoor", setpoint="SP_Return", points: int = 10) -> DataFrame:
    """Fitted setpoint at evenly spaced outdoor temperatures."""
    paired = F.col(outdoor).isNotNull() & F.col(setpoint).isNotNull()
    y, x = F.when(paired, F.col(setpoint)), F.when(paired, F.col(outdoor))
    fit = df.agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"),
                 F.min(outdoor).alias("lo"), F.max(outdoor).alias("hi"))
    at = fit.select("*", F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("i"))
    temp = F.col("lo") + F.col("i") * (F.col("hi") - F.col("lo")) / (points - 1)
    return at.select("slope", "intercept", "i", temp.alias("outdoor"), outdoor_label(temp).alias("label"),
                     (F.col("intercept") + F.col("slope") * temp).alias("setpoint"))
