"""Projections, filters, limits and set operations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plantpulse.operators.order import READINGS, SeriesSpec, before, rows_at
from plantpulse.operators.quantiles import quantiles
from plantpulse.schema import CONTRACT_RANGES, LABEL_COLUMNS, TIME, flag, numeric_columns


def numeric_projection(df: DataFrame) -> DataFrame:
    return df.select(*numeric_columns(df))


def feature_columns(df: DataFrame, exclude: tuple[str, ...] = ()) -> list[str]:
    return numeric_columns(df, exclude=[*LABEL_COLUMNS, TIME, *exclude])


def feature_projection(df: DataFrame, exclude: tuple[str, ...] = ()) -> DataFrame:
    return df.select(*feature_columns(df, exclude))


def positional_slice(df: DataFrame, start: int, stop: int, columns: list[str],
                     spec: SeriesSpec = READINGS) -> DataFrame:
    """Rows [start, stop) of the whole table in order, between the sort keys found at its two ends."""
    if stop <= start:
        return df.select(*columns).limit(0)
    first, beyond = rows_at(df, spec, [start, stop])
    return df.filter(~before(spec, first) & before(spec, beyond)).select(*columns)


def range_contract(df: DataFrame, ranges: dict | None = None) -> DataFrame:
    """Mark each reading valid or not, with the list of broken fields."""
    reasons = []
    for name, (low, high) in (ranges or CONTRACT_RANGES).items():
        if name not in df.columns:
            continue
        value = F.col(name)
        inside = (value >= low) if high is None else value.between(low, high)
        reasons.append(F.when(value.isNull(), F.lit(f"{name} missing")).when(
            ~inside, F.lit(f"{name} out of range")))
    return df.withColumn("reasons", F.array_compact(F.array(*reasons))).withColumn(
        "is_valid", (F.size("reasons") == 0).cast("int"))


def split_contract(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    checked = range_contract(df)
    valid = checked.filter(F.col("is_valid") == 1).select(*df.columns)
    return valid, checked.filter(F.col("is_valid") == 0).drop("is_valid")


def drop_missing(df: DataFrame, subset: list[str]) -> DataFrame:
    return df.na.drop(subset=subset)


def membership_filter(df: DataFrame, members: DataFrame, column: str) -> DataFrame:
    """Rows whose value is in a one-column table; Spark picks broadcast or shuffle by its size."""
    return df.join(members.select(F.col(members.columns[0]).alias(column)), column, "left_semi")


def row_semi_join(df: DataFrame, ids: DataFrame, column: str) -> DataFrame:
    return df.join(ids.select(column), column, "left_semi")


def on_state(power: str = "Power", threshold: float = 0.0) -> Column:
    return flag(F.col(power) > threshold)


def align_schema(df: DataFrame, columns: list[str]) -> DataFrame:
    """Exactly these columns in this order; absent ones become 0."""
    have = set(df.columns)
    return df.select(*[F.col(c) if c in have else F.lit(0.0).alias(c) for c in columns])


def quantile_flag(df: DataFrame, column: str = "Power", q: float = 0.95, name: str = "is_anomaly") -> DataFrame:
    return df.withColumn(name, flag(F.col(column) > quantiles(df, [column], [q])[column][0]))


def tail_n(df: DataFrame, n: int, spec: SeriesSpec = READINGS) -> DataFrame:
    return df.orderBy(*[F.col(c).desc() for c in spec.sort]).limit(n)


def preview(df: DataFrame, n: int = 100, spec: SeriesSpec = READINGS) -> DataFrame:
    return df.orderBy(*spec.sort).limit(n)


def random_sample(df: DataFrame, n: int, key: str, seed: int = 42) -> DataFrame:
    """A repeatable sample of at most n rows: the n smallest hashes of the row key."""
    return df.orderBy(F.md5(F.concat_ws(":", F.col(key).cast("string"), F.lit(str(seed)))), key).limit(n)


def index_union(left: DataFrame, right: DataFrame) -> DataFrame:
    return left.union(right).distinct()
