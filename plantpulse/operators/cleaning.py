"""Gap, duplicate, range and outlier repair."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plantpulse import session
from plantpulse.operators.order import READINGS, SeriesSpec, joined_on
from plantpulse.operators.profile import long_stats
from plantpulse.operators.quantiles import quantile_values
from plantpulse.operators.windows import handle_missing_values
from plantpulse.schema import CHECK_RANGES, numeric_columns

STEPS_PER_ROW = 1000


def check_unique(df: DataFrame, columns: list[str]) -> None:
    repeated = df.groupBy(*columns).count().filter(F.col("count") > 1).first()
    if repeated is not None:
        raise ValueError(f"duplicate {columns}: {repeated.asDict()}")


def calendar_spine(df: DataFrame, step: str, keys: tuple[str, ...] = ("unit_id",), ts: str = "ts",
                   unique: bool = True) -> DataFrame:
    """One row per step between first and last reading; off-grid readings drop out.

    The spine is emitted in two levels, so that a long span never becomes one
    array, and the join is on (keys, time), which spreads a long series.
    """
    if unique:
        check_unique(df, [*keys, ts])
    spans = df.groupBy(*keys).agg(F.min(ts).alias("__from"), F.max(ts).alias("__to"))
    stride = F.expr(f"interval {step}")
    wide = F.expr(f"interval {step} * {STEPS_PER_ROW}")
    spine = spans.select("*", F.explode(F.sequence("__from", "__to", wide)).alias("__at"))
    # each of these rows unfolds into many, so they are spread by number, not by their small size
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spine = spine.repartition(tasks, *keys, "__at")
    last = F.least(F.col("__to"), F.col("__at") + wide - stride)
    spine = spine.select(*keys, F.explode(F.sequence("__at", last, stride)).alias(ts))
    return joined_on(spine, df, [*keys, ts], "left").select(*df.columns)


def remove_duplicates(df: DataFrame, subset: list[str] | None = None,
                      spec: SeriesSpec = READINGS) -> DataFrame:
    """Drop repeated rows; with a subset, the first row in series order stays."""
    if subset is None:
        return df.dropDuplicates()
    w = Window.partitionBy(*subset).orderBy(*spec.sort)
    # row_number = 1 is limited per group before the shuffle, so a hot group stays small
    return df.withColumn("__rn", F.row_number().over(w)).filter(F.col("__rn") == 1).drop("__rn")


def validate_sensor_ranges(df: DataFrame, ranges: dict | None = None) -> DataFrame:
    limits = {c: r for c, r in (ranges or CHECK_RANGES).items() if c in df.columns}
    return long_stats(df, list(limits), {
        "out_of_range_count": lambda c: F.count_if((F.col(c) < limits[c][0]) | (F.col(c) > limits[c][1])),
        "min_allowed": lambda c: F.lit(float(limits[c][0])),
        "max_allowed": lambda c: F.lit(float(limits[c][1])),
    }, "column")


@dataclass(frozen=True)
class OutlierBound:
    column: str
    count: int
    lower: float | None
    upper: float | None


def remove_outliers_iqr(
    df: DataFrame, columns: list[str] | None = None, multiplier: float = 1.5, stored: bool = False,
) -> tuple[DataFrame, list[OutlierBound]]:
    """Drop IQR outliers column by column, quartiles always from the rows still alive.

    Only bounds travel through the driver. The passes read the numeric columns, staged once unless the table is
    `stored` already; the bounds become literal filters on the source.
    """
    names = columns or numeric_columns(df)
    narrow = df.select(*names) if stored else session.staged(df.select(*names), "numeric")
    alive, out, bounds = narrow, df, []
    for name in names:
        low, high = quantile_values(alive, [name], [0.25, 0.75])[name]
        if low is None:
            bounds.append((name, None, None))
            kept = F.lit(False)
        else:
            spread = multiplier * (high - low)
            bounds.append((name, low - spread, high + spread))
            kept = F.col(name).between(*bounds[-1][1:])
        alive, out = alive.filter(kept), out.filter(kept)
    return out, _outlier_report(narrow, bounds)


def _outlier_report(df: DataFrame, bounds: list[tuple]) -> list[OutlierBound]:
    """All outlier counts in one pass: a row counts at its first failing column."""
    alive: Column = F.lit(True)
    counts = []
    for i, (name, low, high) in enumerate(bounds):
        inside = F.lit(False) if low is None else F.coalesce(F.col(name).between(low, high), F.lit(False))
        counts.append(F.count_if(alive & ~inside & F.col(name).isNotNull()).alias(f"n{i}"))
        alive = alive & inside
    if not counts:
        return []
    row = df.agg(*counts).first()
    return [OutlierBound(name, row[f"n{i}"], low, high) for i, (name, low, high) in enumerate(bounds)]


def outlier_bounds_table(df: DataFrame, bounds: list[OutlierBound]) -> DataFrame:
    return df.sparkSession.createDataFrame(
        [(b.column, b.count, b.lower, b.upper) for b in bounds],
        "column string, count bigint, lower_bound double, upper_bound double")


def clean_readings(
    df: DataFrame, fill_method: str = "forward", remove_outliers: bool = True,
    step: str | None = None, columns: list[str] | None = None, spec: SeriesSpec = READINGS,
) -> DataFrame:
    """Duplicates, optional time spine, gaps, then outliers.

    The filled table is written once, because the outlier step reads it many times.
    """
    names = columns or numeric_columns(df, exclude=[*spec.keys, *spec.sort])
    out = remove_duplicates(df)
    if step:
        out = calendar_spine(out, step, spec.keys, spec.order)
    out = handle_missing_values(out, fill_method, names, spec)
    if remove_outliers:
        out, _ = remove_outliers_iqr(session.staged(out, "filled"), names, stored=True)
    return out
