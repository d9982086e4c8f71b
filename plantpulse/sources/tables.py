"""Readers, writers and the raw -> interim -> processed stages."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plantpulse.schema import TIME, nan_to_null, sensor_schema
from plantpulse.sources import log
from plantpulse.sources.log import exists

# types of a column without a schema, the narrowest first
CELL_TYPES = ("boolean", "bigint", "double")


def read_csv(spark: SparkSession, path: str, schema: T.StructType | None = None, sep: str = ";",
             date_column: str = TIME, parse_dates: bool = True) -> DataFrame:
    """Delimited scan; times become UTC, NaN becomes missing.

    With a schema the files are scanned once. Without one the known sensors are typed by name, and every
    other column is boolean, integer or double, the first of them that all of its cells are, which one counting
    pass decides; a missing cell is neither boolean nor integer, but may be a double. Otherwise, and
    without a filled cell, a column stays text. Cells of a sensor that are no number become missing; `bad_cells` counts them.
    """
    if schema is not None:
        return nan_to_null(_text_reader(spark, sep).schema(schema).csv(path))
    df = _text_reader(spark, sep).csv(path)
    known = {f.name: f.dataType for f in sensor_schema().fields if f.name != TIME}
    others = [c for c in df.columns if c not in known and c != date_column]
    if others:
        row = df.agg(*[F.count_if(~_reads_as(c, kind)).alias(f"{c} {kind}")
                       for c in others for kind in CELL_TYPES],
                     *[F.count(c).alias(f"{c} filled") for c in others]).first()
        for c in others:
            fits = [kind for kind in CELL_TYPES if row[f"{c} {kind}"] == 0]
            if fits and row[f"{c} filled"]:
                known[c] = fits[0]
    typed = df.select(*[F.col(c).try_cast(known[c]).alias(c) if c in known else F.col(c) for c in df.columns])
    if parse_dates and date_column in df.columns:
        typed = typed.withColumn(date_column, F.try_to_timestamp(F.col(date_column)))
    return nan_to_null(typed)


def bad_cells(spark: SparkSession, path: str, schema: T.StructType | None = None, sep: str = ";") -> DataFrame:
    """(column, bad): cells that are not empty and cannot be read as the column's type, where there are any."""
    types = {f.name: f.dataType for f in (schema or sensor_schema()).fields}
    df = _text_reader(spark, sep).csv(path)
    checked = [c for c in df.columns if c in types]
    wide = df.agg(*[F.count_if(_unreadable(c, types[c])).alias(c) for c in checked])
    return wide.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(c).alias("bad")) for c in checked]))).filter("bad > 0")


def _text_reader(spark: SparkSession, sep: str):
    return spark.read.options(sep=sep, header=True, mode="PERMISSIVE", nullValue="")


def _unreadable(column: str, kind: T.DataType | str):
    return F.col(column).isNotNull() & F.col(column).try_cast(kind).isNull()


def _reads_as(column: str, kind: str):
    cell = F.col(column)
    if kind == "boolean":  # not the other words and digits that a cast takes
        return F.coalesce(F.lower(F.trim(cell)).isin("true", "false"), F.lit(False))
    return cell.try_cast(kind).isNotNull() | (cell.isNull() if kind == "double" else F.lit(False))


def write_csv(df: DataFrame, path: str, sep: str = ";") -> None:
    exact = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"
    df.write.mode("overwrite").options(
        sep=sep, header=True, timestampNTZFormat=exact, timestampFormat=exact + "XXX").csv(path)


def read_parquet(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """Columnar scan; NaN becomes missing, as at every scan."""
    df = spark.read.parquet(path)
    return nan_to_null(df.select(*columns) if columns else df)


def write_parquet(df: DataFrame, path: str, ts: str | None = None, mode: str = "overwrite") -> None:
    """Write a table, split by day when a time column is named so that scans can skip days."""
    if ts is None:
        df.write.mode(mode).parquet(path)
        return
    # a range by time gives each task few days, and a full day several tasks
    (df.withColumn("day", F.to_date(ts)).repartitionByRange("day", ts).sortWithinPartitions("day")
     .write.mode(mode).partitionBy("day").parquet(path))


@dataclass(frozen=True)
class Stages:
    """Folders of the three stages of one data set."""

    root: str
    name: str = "readings"

    @property
    def raw(self) -> str:
        return f"{self.root}/raw/{self.name}.csv"

    @property
    def interim(self) -> str:
        return f"{self.root}/interim/{self.name}.parquet"

    @property
    def processed(self) -> str:
        return f"{self.root}/processed/{self.name}.parquet"


def staged_load(spark: SparkSession, stages: Stages, use_cached: bool = True, data_path: str | None = None,
                schema: T.StructType | None = None) -> DataFrame:
    """Explicit path by suffix, else the interim table if it exists, else the raw file."""
    if data_path:
        if data_path.rstrip("/").endswith(".parquet"):
            return read_parquet(spark, data_path)
        return read_csv(spark, data_path, schema)
    if use_cached and exists(spark, stages.interim):
        return read_parquet(spark, stages.interim)
    return read_csv(spark, stages.raw, schema)


def write_report(report: DataFrame, path: str) -> None:
    """A nested report as JSON lines; Spark writes dates and times as text."""
    report.write.mode("overwrite").json(path)


def append_log(df: DataFrame, path: str, ts: str = "ts", writer: str | None = None,
               batch: str | int | None = None) -> bool:
    """Add records to an append-only table; a commit of a writer that is there already adds nothing."""
    return log.append(df, path, ts, writer, batch)


def read_log(spark: SparkSession, path: str) -> DataFrame:
    return log.read(spark, path)


def prediction_records(df: DataFrame, features: list[str], ts="ts", prediction="prediction",
                       probability="probability", actual: str | None = None) -> DataFrame:
    """Log rows with the model inputs as a map and the outcome if it is known."""
    pairs = [x for f in features for x in (F.lit(f), F.col(f).cast("double"))]
    known = F.col(actual).cast("int") if actual else F.lit(None).cast("int")
    return df.select(F.col(ts).alias("ts"), F.create_map(*pairs).alias("features"),
                     F.col(prediction).cast("int").alias("prediction"), F.col(probability).alias("probability"),
                     known.alias("actual"))


def run_records(df: DataFrame, metrics: list[str], name="pipeline", ts="ts") -> DataFrame:
    """Log rows of finished jobs with their metrics as a map."""
    pairs = [x for m in metrics for x in (F.lit(m), F.col(m).cast("double"))]
    measured = F.create_map(*pairs) if pairs else F.create_map().cast("map<string,double>")
    return df.select(F.col(name).alias("pipeline"), "status", "duration_seconds",
                     measured.alias("metrics"), F.col(ts).alias("ts"))
