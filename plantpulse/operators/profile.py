"""Aggregate profiles of a whole table."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plantpulse.operators.quantiles import quantiles
from plantpulse.schema import DESCRIPTIONS, numeric_columns


def long_stats(
    df: DataFrame, columns: list[str], stats: dict[str, Callable[[str], Column]], name: str = "feature",
) -> DataFrame:
    """One row per column from a single aggregation pass."""
    if not columns:
        raise ValueError("no columns to aggregate")
    rows = [F.struct(F.lit(c).alias(name), *[fn(c).alias(s) for s, fn in stats.items()]) for c in columns]
    return df.agg(F.array(*rows).alias("rows")).select(F.inline("rows"))


def is_missing(column: str) -> Column:
    return F.col(column).isNull()


def power_profile(df: DataFrame, part: Column, name: str, power="Power", std=False) -> DataFrame:
    aggs = [F.avg(power).alias("mean"), F.coalesce(F.sum(power), F.lit(0.0)).alias("sum")]
    if std:
        aggs.append(F.stddev_samp(power).alias("std"))
    return df.groupBy(part.alias(name)).agg(*aggs)


def hourly_profile(df: DataFrame, ts="ts", power="Power") -> DataFrame:
    return power_profile(df, F.hour(ts), "hour", power, std=True)


def daily_profile(df: DataFrame, ts="ts", power="Power") -> DataFrame:
    return power_profile(df, F.weekday(ts), "day_of_week", power)


def monthly_profile(df: DataFrame, ts="ts", power="Power") -> DataFrame:
    return power_profile(df, F.month(ts), "month", power)


def kpi_exprs(power="Power", energy="Energy") -> list[Column]:
    on = F.count_if(F.col(power) > 0)
    return [
        F.try_divide(on, F.count(F.lit(1))).alias("__share"),
        F.coalesce(F.sum(power), F.lit(0.0)).alias("power_sum"),
        F.avg(power).alias("average_power"),
        F.max(power).alias("peak_power"),
        on.alias("on_rows"),
        F.max(energy).alias("energy_max"),
        F.count(F.lit(1)).alias("rows"),
    ]


def energy_kpis(df: DataFrame, power="Power", energy="Energy") -> DataFrame:
    """Duty cycle and power figures. `power_sum` is a sum of samples, `on_rows` counts readings."""
    out = df.agg(*kpi_exprs(power, energy))
    return out.select((F.col("__share") * 100).alias("duty_cycle_percent"),
                      *[c for c in out.columns if c != "__share"])


def missing_summary(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Columns with missing values: how many, and what share."""
    stats = long_stats(df, columns or df.columns, {
        "missing": lambda c: F.count_if(is_missing(c)),
        "percentage": lambda c: F.try_divide(F.count_if(is_missing(c)) * 100.0, F.count(F.lit(1))),
    }, "column")
    return stats.filter(F.col("missing") > 0)


def quality_report(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Per column: type, missing count and share, and rounded statistics of numeric columns."""
    names = columns or df.columns
    types = dict(df.dtypes)
    numeric = [c for c in numeric_columns(df) if c in names]
    medians = quantiles(df, numeric, [0.5])
    blank = F.lit(None).cast("double")

    def stat(fn: Callable[[str], Column]) -> Callable[[str], Column]:
        # the inner rounding takes summation noise off exact halves
        return lambda c: F.bround(F.round(fn(c).cast("double"), 10), 4) if c in medians else blank

    return long_stats(df, names, {
        "dtype": lambda c: F.lit(types[c]),
        "total_rows": lambda c: F.count(F.lit(1)),
        "total_columns": lambda c: F.lit(len(names)),
        "missing_count": lambda c: F.count_if(is_missing(c)),
        "missing_percentage": lambda c: F.bround(
            F.try_divide(F.count_if(is_missing(c)) * 100.0, F.count(F.lit(1))), 2),
        "mean": stat(F.avg), "std": stat(F.stddev_samp), "min": stat(F.min), "max": stat(F.max),
        "median": stat(lambda c: medians[c][0]),
    }, "column")


def describe(df: DataFrame, columns: list[str]) -> DataFrame:
    quarter = quantiles(df, columns, [0.25, 0.5, 0.75])
    return long_stats(df, columns, {
        "count": F.count, "mean": F.avg, "std": F.stddev_samp,
        "min": lambda c: F.min(c).cast("double"),
        "q25": lambda c: quarter[c][0], "q50": lambda c: quarter[c][1], "q75": lambda c: quarter[c][2],
        "max": lambda c: F.max(c).cast("double"),
    }, "column")


def exact_quantile(df: DataFrame, columns: list[str], at: list[float]) -> DataFrame:
    found = quantiles(df, columns, at)
    rows = long_stats(df, columns, {"v": lambda c: found[c]}, "column")
    return rows.select("column", F.posexplode("v").alias("i", "value")).select(
        "column", F.element_at(F.array(*[F.lit(float(q)) for q in at]), F.col("i") + 1).alias("quantile"), "value")


def histogram(df: DataFrame, column: str, bins: int = 50) -> DataFrame:
    return histograms(df, [column], bins).drop("column")


def histograms(df: DataFrame, columns: list[str], bins: int = 50) -> DataFrame:
    """Counts in equal bins over [min, max], the last bin closed, empty bins kept.

    Two passes for all columns together; a constant column gets half a unit of
    margin on either side. Rows are counted per (column, bin) before the shuffle.
    """
    def bounds(c: str) -> Column:
        low, high = F.min(c).cast("double"), F.max(c).cast("double")
        margin = F.when(low == high, 0.5).otherwise(0.0)
        return F.struct((low - margin).alias("lo"), (high + margin).alias("hi")).alias(c)

    ends = df.agg(F.struct(*[bounds(c) for c in columns]).alias("e")).scalar()
    e = F.col("__e")
    hits = F.array_compact(F.array(*[
        F.when(F.col(c).isNotNull(), F.struct(
            F.lit(c).alias("column"),
            (F.least(F.width_bucket(F.col(c).cast("double"), e[c]["lo"], e[c]["hi"], F.lit(bins)),
                     F.lit(bins)) - 1).cast("int").alias("bin")))
        for c in columns]))
    counts = df.withColumn("__e", ends).select(F.inline(hits)).groupBy("column", "bin").agg(F.count(F.lit(1)).alias("n"))
    edges = F.array(*[F.struct(F.lit(c).alias("column"), e[c]["lo"].alias("lo"), e[c]["hi"].alias("hi"))
                      for c in columns])
    spine = df.sparkSession.range(bins).withColumn("__e", ends).select(
        F.col("id").cast("int").alias("bin"), F.inline(edges))
    width = (F.col("hi") - F.col("lo")) / bins
    # at most bins x columns counts
    return spine.join(F.broadcast(counts), ["column", "bin"], "left").select(
        "column", "bin", (F.col("lo") + F.col("bin") * width).alias("lower"),
        (F.col("lo") + (F.col("bin") + 1) * width).alias("upper"), F.coalesce("n", F.lit(0)).alias("count"))


# rows whose products one task holds at once
GRAM_ROWS = 2048


def correlation_matrix(df: DataFrame, columns: list[str]) -> DataFrame:
    """Pearson correlation per column pair over the rows where both are present; missing where one is constant.

    Products of matrices: with the columns centred at their means and a mask of what is present, counts, sums, squares
    and products of all pairs are masks and values multiplied, slice by slice of an Arrow batch. A task adds
    them up and sends one row for each pair, so work and shuffle are linear in the rows of the table.
    """
    means = df.agg(*[F.avg(F.col(c).cast("double")).alias(f"m{i}") for i, c in enumerate(columns)]).first()
    center = np.array([m if m is not None and math.isfinite(m) else 0.0 for m in means])
    k = len(columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((5, k, k))
        for batch in batches:
            for at in range(0, batch.num_rows, GRAM_ROWS):
                part = batch.slice(at, GRAM_ROWS)
                x = np.column_stack([c.to_numpy(zero_copy_only=False) for c in part.columns]).astype(float) - center
                known, endless = ~np.isnan(x), np.isinf(x)
                x[~known | endless] = 0.0
                mask = known.astype(float)
                sums += [mask.T @ mask, x.T @ mask, (x * x).T @ mask, x.T @ x, endless.astype(float).T @ mask]
        a, b = np.triu_indices(k)
        n, s, q, p, odd = sums
        yield pa.RecordBatch.from_arrays([*map(pa.array, (
            a.astype(np.int32), b.astype(np.int32), n[a, b], s[a, b], s[b, a], q[a, b], q[b, a], p[a, b],
            odd[a, b] + odd[b, a]))], names=["a", "b", *totals])

    totals = ["n", "x", "y", "xx", "yy", "xy", "odd"]
    numbers = df.select(*[F.col(c).cast("double").alias(f"c{i}") for i, c in enumerate(columns)])
    parts = numbers.mapInArrow(run, "a int, b int, " + ", ".join(f"{t} double" for t in totals))
    per = parts.groupBy("a", "b").agg(*[F.sum(t).alias(t) for t in totals])
    n = F.when(F.col("n") > 0, F.col("n"))
    spread = {v: F.col(v + v) - F.col(v) * F.col(v) / n for v in ("x", "y")}
    # what rounding leaves of a constant column is no spread
    known = (spread["x"] > 1e-12 * F.col("xx")) & (spread["y"] > 1e-12 * F.col("yy")) & (F.col("odd") == 0)
    value = (F.col("xy") - F.col("x") * F.col("y") / n) / F.sqrt(spread["x"]) / F.sqrt(spread["y"])
    half = per.select("a", "b", F.when(known, F.least(F.greatest(value, F.lit(-1.0)), F.lit(1.0))).alias("correlation"))
    both = F.array_distinct(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b"))))
    names = F.array(*[F.lit(c) for c in columns])
    return half.select(F.inline(both), "correlation").select(
        names[F.col("a")].alias("column_a"), names[F.col("b")].alias("column_b"), "correlation")


def value_counts(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(column).agg(F.count(F.lit(1)).alias("count")).orderBy(F.desc("count"), column)


def boxplot_stats(df: DataFrame, columns: list[str], whisker: float = 1.5) -> DataFrame:
    """Quartiles, the furthest points inside the whisker range, and the points beyond."""
    quarter = quantiles(df, columns, [0.25, 0.5, 0.75])

    def within(c: str) -> Column:
        q = quarter[c]
        spread = (q[2] - q[0]) * whisker
        return F.when((F.col(c) >= q[0] - spread) & (F.col(c) <= q[2] + spread), F.col(c))

    inside = df.withColumns({f"__in_{c}": within(c) for c in columns})
    return long_stats(inside, columns, {
        "q25": lambda c: quarter[c][0], "q50": lambda c: quarter[c][1], "q75": lambda c: quarter[c][2],
        "whisker_low": lambda c: F.min(f"__in_{c}"), "whisker_high": lambda c: F.max(f"__in_{c}"),
        "outliers": lambda c: F.count(c) - F.count(f"__in_{c}"),
    }, "column")


def outlier_counts(df: DataFrame, columns: list[str], threshold: float = 1.5) -> DataFrame:
    """Independent IQR outliers per column, as count and share of all rows."""
    quarter = quantiles(df, columns, [0.25, 0.75])

    def outside(c: str) -> Column:
        q = quarter[c]
        spread = (q[1] - q[0]) * threshold
        return (F.col(c) < q[0] - spread) | (F.col(c) > q[1] + spread)

    return long_stats(df, columns, {
        "outliers": lambda c: F.count_if(outside(c)),
        "percentage": lambda c: F.try_divide(F.count_if(outside(c)) * 100.0, F.count(F.lit(1))),
    }, "column")


def unfolded(df: DataFrame, columns: list[str], numeric: set[str]) -> DataFrame:
    """One (feature, missing, value) row per cell, to aggregate wide tables by column.

    The cells are combined before the shuffle, so hundreds of columns need one
    small aggregate and one scan.
    """
    nothing = F.lit(None).cast("double")
    cells = [F.struct(
        F.lit(c).alias("feature"), is_missing(c).alias("missing"),
        (F.col(c).cast("double") if c in numeric else nothing).alias("value")) for c in columns]
    return df.select(F.inline(F.array(*cells)))


def feature_summary(df: DataFrame, target_col: str) -> DataFrame:
    """Per feature: missing count, variance of floating columns, and the feature total."""
    names = [c for c in df.columns if c != target_col]
    cells = unfolded(df, names, {c for c, t in df.dtypes if t == "double"})
    return cells.groupBy("feature").agg(
        F.count_if("missing").alias("missing_count"), F.var_samp("value").alias("variance"),
        F.lit(len(names)).alias("total_features"))


def data_info(df: DataFrame, ts: str = "ts") -> DataFrame:
    missing = sum((F.count_if(is_missing(c)) for c in df.columns), F.lit(0))
    return df.agg(
        F.count(F.lit(1)).alias("rows"), F.lit(len(df.columns)).alias("columns"),
        F.min(ts).alias("start"), F.max(ts).alias("end"),
        (F.unix_micros(F.max(ts).cast("timestamp")) - F.unix_micros(F.min(ts).cast("timestamp"))
         ).alias("duration_micros"),
        missing.alias("missing_values"))


def median_defaults(df: DataFrame, columns: list[str]) -> DataFrame:
    found = quantiles(df, columns, [0.5])
    return long_stats(df, columns, {"median": lambda c: found[c][0]}, "column")


def prediction_summary(df: DataFrame, prediction="prediction", probability="probability") -> DataFrame:
    return df.agg(
        F.count(F.lit(1)).alias("total"), F.count_if(F.col(prediction) == 1).alias("failures"),
        F.count_if(F.col(prediction) == 0).alias("normal"), F.avg(probability).alias("mean_probability"))


def hourly_patterns(df: DataFrame, columns: list[str], ts: str = "ts") -> DataFrame:
    """Hourly mean of each column, in long form."""
    wide = df.groupBy(F.hour(ts).alias("hour")).agg(*[F.avg(c).alias(c) for c in columns])
    return wide.unpivot("hour", columns, "column", "mean")


def dataset_profile(df: DataFrame, columns: list[str], ts: str = "ts", bins: int = 50) -> dict[str, DataFrame]:
    """The exploratory bundle as named tables."""
    return {
        "info": data_info(df, ts),
        "missing": missing_summary(df),
        "statistics": describe(df, columns),
        "histograms": histograms(df, columns, bins),
        "correlation": correlation_matrix(df, columns),
        "hourly": hourly_patterns(df, columns[:5], ts),
    }


def profile_table(df: DataFrame, columns: list[str], ts: str = "ts", bins: int = 50) -> DataFrame:
    """The bundle flattened to (section, item, position, value)."""
    tables = dataset_profile(df, columns, ts, bins)
    nothing = F.lit(0)
    stats = ["count", "mean", "std", "min", "q25", "q50", "q75", "max"]
    described = tables["statistics"].select("column", *[F.col(s).cast("double") for s in stats])
    parts = [
        tables["missing"].select(F.lit("missing").alias("section"), F.col("column").alias("item"),
                                 nothing.alias("position"), F.col("percentage").alias("value")),
        described.unpivot("column", stats, "stat", "value").select(
            F.lit("statistics"), F.concat_ws(".", "column", "stat"), nothing, "value"),
        tables["histograms"].select(F.lit("histogram"), "column", "bin", F.col("count").cast("double")),
        tables["correlation"].select(
            F.lit("correlation"), F.concat_ws("~", "column_a", "column_b"), nothing, "correlation"),
        tables["hourly"].select(F.lit("hourly"), "column", "hour", "mean"),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.union(part)
    return out


def column_catalog(df: DataFrame, names: dict[str, str] | None = None) -> DataFrame:
    """Description and number of present values of each known column."""
    texts = names or DESCRIPTIONS
    known = [c for c in df.columns if c in texts]
    return long_stats(df, known, {
        "description": lambda c: F.lit(texts[c]), "present": F.count}, "column")
