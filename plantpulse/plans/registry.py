"""Named queries and the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plantpulse.plans.fixtures import READING_EXPRS, SPLIT_DAY

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            spark.conf.set("spark.sql.session.timeZone", "UTC")
            return fn(spark, sf_dir)
        if name in QUERIES:
            raise ValueError(f"query {name} is already registered")
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return add


def rounded(df: DataFrame, digits: int = 6, **special: int | None) -> DataFrame:
    """Round every floating column, so that summation order cannot show; None leaves one as it is."""
    def cell(f: T.StructField) -> Column:
        if not isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            return F.col(f.name)
        places = special.get(f.name, digits)
        return F.col(f.name) if places is None else F.round(F.col(f.name), places).alias(f.name)
    return df.select(*[cell(f) for f in df.schema.fields])


# --- SQL building blocks --------------------------------------------------------

def r(expr: str, name: str, digits: int | None = 6) -> str:
    """Rounded SQL column; adding 0 turns a negative zero into zero."""
    if digits is None:
        return f"({expr}) + 0e0 as {name}"
    return f"round({expr}, {digits}) + 0e0 as {name}"


K = "(select *, cast(regexp_extract(props, '([0-9]+)', 1) as int) as k from events) e"
READINGS_SQL = f"sensor_readings as (select {', '.join(READING_EXPRS)} from {K})"
GRID_SQL = """sensor_grid as (select * from (
  select * exclude (ts), date_trunc('hour', ts) as ts,
         row_number() over (partition by unit_id, date_trunc('hour', ts) order by reading_id) as dup
  from sensor_readings) g where dup = 1)"""
ALERTS_SQL = f"""alerts as (select event_id as alert_id, event_type as type, ts,
  case when value > 100 then 'high' when value > 50 then 'medium' else 'low' end as severity,
  cast(k as varchar) as k from {K} where event_type in ('error', 'signup'))"""
LOG_SQL = """prediction_log as (select reading_id, unit_id, ts, T_Supply, T_Return, Power,
  cast(Power < 0.1 as int) as prediction, 1 / (1 + Power) as probability,
  case when reading_id % 5 <> 0 then cast(Power <= 0 as int) end as actual from sensor_readings)"""
RUNS_SQL = """pipeline_runs as (select event_id,
  case when event_id % 2 = 0 then 'training' else 'inference' end as pipeline,
  case when event_type = 'error' then 'failed' else 'success' end as status,
  value as duration_seconds, ts from events)"""
OLD_SQL = f"reference_window as (select * from sensor_readings where ts < timestamp '{SPLIT_DAY}')"
NEW_SQL = f"new_window as (select * from sensor_readings where ts >= timestamp '{SPLIT_DAY}')"
# one row per reading in unit order, numbered from 1
ORDERED_SQL = """ordered as (select *, row_number() over (partition by unit_id order by ts, reading_id) as rn
  from sensor_readings)"""


def sql(body: str, *ctes: str, recursive: bool = False) -> str:
    head = "with recursive " if recursive else "with "
    return head + ",\n".join([READINGS_SQL, *ctes]) + "\n" + body


def per_column(columns: list[str], row: str) -> str:
    """One SELECT per column, glued by UNION ALL; {c} is the column name."""
    return "\nunion all\n".join(row.replace("{c}", c) for c in columns)
