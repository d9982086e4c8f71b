"""Sensor tables derived from the given event and vector tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plantpulse.sources.tables import read_parquet

# Each sensor value as an expression over one event; k is the number inside props.
READING_EXPRS = [
    "event_id as reading_id", "user_id as unit_id", "ts",
    "case when event_id % 13 = 0 then null else 15e0 + (event_id * 7 % 23) * 0.5e0 end as T_Supply",
    "case when event_id % 97 = 0 then 0e0 else 18e0 + (event_id * 5 % 17) * 0.5e0 end as T_Return",
    "20e0 + (k % 5) * 0.5e0 as SP_Return",
    "12e0 + (event_id * 3 % 19) * 0.5e0 as T_Saturation",
    "k * 0.4e0 - 5e0 as T_Outdoor",
    "40e0 + (event_id * 11 % 61) as RH_Supply",
    "case when event_id % 17 = 0 then null else 30e0 + (event_id * 13 % 51) end as RH_Return",
    "20e0 + (k % 86) as RH_Outdoor",
    "case when event_id % 101 = 0 then 0e0 else event_id * 0.25e0 end as Energy",
    "case when event_type = 'error' then 0e0 else value / 100e0 end as Power",
]
SPLIT_DAY = "2024-01-16"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return read_parquet(spark, f"{sf_dir}/{name}.parquet")


def with_k(events: DataFrame) -> DataFrame:
    return events.withColumn("k", F.regexp_extract("props", "([0-9]+)", 1).cast("int"))


def readings_of(events: DataFrame) -> DataFrame:
    return with_k(events).selectExpr(*READING_EXPRS)


def sensor_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readings_of(table(spark, sf_dir, "events"))


def sensor_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First reading of each unit and hour, at the full hour."""
    df = sensor_readings(spark, sf_dir).withColumn("hour_ts", F.date_trunc("hour", "ts").cast("timestamp_ntz"))
    w = Window.partitionBy("unit_id", "hour_ts").orderBy("reading_id")
    df = df.withColumn("dup", F.row_number().over(w)).filter("dup = 1")
    rest = [c for c in df.columns if c not in ("unit_id", "ts", "hour_ts", "dup")]
    return df.select("unit_id", F.col("hour_ts").alias("ts"), *rest)


def split_windows(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    day = F.lit(SPLIT_DAY).cast("timestamp_ntz")
    return df.filter(F.col("ts") < day), df.filter(F.col("ts") >= day)


def alerts_of(events: DataFrame) -> DataFrame:
    severity = F.when(F.col("value") > 100, "high").when(F.col("value") > 50, "medium").otherwise("low")
    return with_k(events).filter(F.col("event_type").isin("error", "signup")).select(
        F.col("event_id").alias("alert_id"), F.col("event_type").alias("type"), "ts",
        severity.alias("severity"), F.create_map(F.lit("k"), F.col("k").cast("string")).alias("metadata"))


def alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alerts_of(table(spark, sf_dir, "events"))


def alert_acks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alerts(spark, sf_dir).filter("alert_id % 4 = 0").select(
        "alert_id", F.col("ts").alias("acknowledged_at"))


def prediction_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sensor_readings(spark, sf_dir).select(
        "reading_id", "unit_id", "ts", "T_Supply", "T_Return", "Power",
        (F.col("Power") < 0.1).cast("int").alias("prediction"),
        (1 / (1 + F.col("Power"))).alias("probability"),
        F.when(F.col("reading_id") % 5 != 0, (F.col("Power") <= 0).cast("int")).alias("actual"))


def pipeline_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        "event_id", F.when(F.col("event_id") % 2 == 0, "training").otherwise("inference").alias("pipeline"),
        F.when(F.col("event_type") == "error", "failed").otherwise("success").alias("status"),
        F.col("value").alias("duration_seconds"), "ts")


def vectors(spark: SparkSession, sf_dir: str, width: int = 64) -> DataFrame:
    df = table(spark, sf_dir, "embeddings")
    return df.select("vec_id", "label", *[
        F.col("embedding")[i].cast("double").alias(f"v{i}") for i in range(width)])
