"""Structured Streaming jobs that match their batch operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.ml import Transformer
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from plantpulse.operators.alerts import HOUR, emitted, micros
from plantpulse.operators.learning import advised, score
from plantpulse.operators.monitoring import drift_detect, drift_figures
from plantpulse.operators.select import align_schema, range_contract
from plantpulse.schema import flag, nan_to_null


def read_stream(spark: SparkSession, folder: str, schema: T.StructType, fmt: str = "parquet",
                pattern: str | None = None, files_per_trigger: int | None = None, **options) -> DataFrame:
    reader = spark.readStream.format(fmt).schema(schema).options(**options)
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return nan_to_null(reader.load(folder))


def run_available(stream: DataFrame, path: str, checkpoint: str, mode: str = "append",
                  timeout: int = 600) -> DataFrame:
    """Process what is there and return the written table."""
    query = (stream.writeStream.format("parquet").option("path", path)
             .option("checkpointLocation", checkpoint).outputMode(mode)
             .trigger(availableNow=True).start())
    try:
        if not query.awaitTermination(timeout):
            raise TimeoutError(f"stream still running after {timeout} s")
    finally:
        query.stop()
    return stream.sparkSession.read.schema(stream.schema).parquet(path)


def run_batches(stream: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str,
                timeout: int = 600, mode: str = "append") -> None:
    query = (stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).outputMode(mode)
             .trigger(availableNow=True).start())
    try:
        if not query.awaitTermination(timeout):
            raise TimeoutError(f"stream still running after {timeout} s")
    finally:
        query.stop()


VERSION = "version"


def run_versions(stream: DataFrame, path: str, checkpoint: str, timeout: int = 600) -> DataFrame:
    """Process what is there in update mode and return a table of all versions of the rows the stream holds.

    Every micro-batch writes the rows it changed as one version. Its number names the folder, so a repeated
    batch replaces itself; `latest` picks the current rows.
    """
    spark = stream.sparkSession
    spark.createDataFrame([], stream.schema).write.mode("overwrite").parquet(f"{path}/{VERSION}=-1")

    def handle(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/{VERSION}={number}")

    run_batches(stream, handle, checkpoint, timeout, "update")
    schema = T.StructType([*stream.schema.fields, T.StructField(VERSION, T.LongType())])
    return spark.read.schema(schema).parquet(path)


def latest(versions: DataFrame, keys: list[str]) -> DataFrame:
    """The current row of each key: that of the last version which holds one."""
    rest = [c for c in versions.columns if c not in (*keys, VERSION)]
    newest = versions.groupBy(*keys).agg(F.max_by(F.struct(*rest), VERSION).alias("__row"))
    return newest.select(*keys, "__row.*")


def stream_contract(readings: DataFrame, ranges: dict | None = None) -> DataFrame:
    """Stateless check of each reading, with the reasons of rejection."""
    return range_contract(readings, ranges)


def stream_score(readings: DataFrame, model: Transformer, features: list[str]) -> DataFrame:
    """Score each reading; missing and infinite inputs count as 0."""
    clean = readings.withColumns({
        f: F.when(F.abs(F.coalesce(F.col(f), F.lit(0.0))) == float("inf"), 0.0)
        .otherwise(F.coalesce(F.col(f), F.lit(0.0))) for f in features if f in readings.columns})
    extra = [c for c in clean.columns if c not in features]
    return advised(score(align_schema(clean, [*extra, *features]), model))


def stream_profile(readings: DataFrame, width: str = "1 hour", late: str = "1 hour", ts: str = "ts",
                   power: str = "Power") -> DataFrame:
    """Power profile per tumbling event-time window; rows later than `late` are dropped.

    In append mode a window is written once the watermark has passed it. In update mode (`run_versions`) every
    trigger writes the windows it changed, so `latest` by start holds the open ones too, from the stream's own state.
    """
    timed = readings.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)
    out = timed.groupBy(F.window(ts, width)).agg(
        F.count(F.lit(1)).alias("rows"), F.avg(power).alias("mean_power"), F.sum(power).alias("power_sum"),
        F.max(power).alias("peak_power"), F.sum(flag(F.col(power) > 0)).alias("on_rows"))
    return out.select(F.col("window.start").alias("start"), *out.columns[1:])


def stream_alert_cooldown(alerts: DataFrame, keys: tuple[str, ...] = ("type",), ts: str = "ts",
                          key: str = "alert_id", cooldown_micros: int = HOUR, late: str = "1 hour") -> DataFrame:
    """For each key and trigger that concerns it: alerts emitted for good, and those that stand for now.

    Event time decides. What is later than the watermark waits in the state, in order of time, since an alert that
    comes later may still go before it; a timer brings the key back when the watermark has passed the first of
    them. An alert below the watermark is settled by the greedy rule: earlier ones can no longer come. So
    alerts may arrive in any order within `late` of the newest, and a replay gives the same ones; what is later
    is dropped, as are alerts without a time. `emitted_alerts` reads the result.

    A task holds one Arrow batch and one key's waiting alerts, at most those of the last `late` of event time that the
    last settled one does not suppress, as packed numbers; the state of a key goes when its cooldown is over.
    """
    narrow = alerts.withColumn(ts, F.col(ts).cast("timestamp")).filter(F.col(ts).isNotNull()).withWatermark(ts, late)
    narrow = narrow.select(*keys, ts, F.col(key).alias("__id"), micros(ts).alias("__v"))
    one = T.StructType([T.StructField(key, narrow.schema["__id"].dataType), T.StructField("at", T.LongType())])
    out = T.StructType([*[narrow.schema[k] for k in keys], T.StructField("settled", T.ArrayType(one)),
                        T.StructField("open", T.ArrayType(one))])
    state_type = T.StructType([T.StructField("last", T.LongType()), T.StructField("upto", T.LongType()),
                               T.StructField("at", T.BinaryType()),
                               T.StructField("ids", T.ArrayType(narrow.schema["__id"].dataType))])

    def keep(group: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, upto, at, ids = state.get if state.exists else (None, None, b"", [])
        values, names = [np.frombuffer(at, np.int64)], list(ids)
        if not state.hasTimedOut:
            for batch in batches:
                fresh = batch[["__v", "__id"]]
                if last is not None:
                    fresh = fresh[fresh["__v"] >= last + cooldown_micros]
                if upto is not None:
                    fresh = fresh[fresh["__v"] > upto]
                values.append(fresh["__v"].to_numpy(np.int64))
                names += fresh["__id"].tolist()
        values = np.concatenate(values)
        order = sorted(range(len(values)), key=lambda i: (values[i], names[i]))
        values, names = values[order], [names[i] for i in order]
        mark = state.getCurrentWatermarkMs() * 1000
        picked = emitted(values, cooldown_micros, None if last is None else last + cooldown_micros)
        sure = [i for i in picked if values[i] <= mark]
        if sure:
            last = int(values[sure[-1]])
        waits = np.flatnonzero((values > mark) & (last is None or values >= last + cooldown_micros))
        # the state is needed until the waiting alerts are settled and the cooldown of the last one is over
        until = int(values[waits[0]]) if len(waits) else (last or 0) + cooldown_micros
        if until > mark:
            state.update((last, mark, values[waits].tobytes(), [names[i] for i in waits]))
            state.setTimeoutTimestamp(max(until // 1000, state.getCurrentWatermarkMs()) + 1)
        elif state.exists:
            state.remove()
        told = [[{key: names[i], "at": int(values[i])} for i in some] for some in (sure, [i for i in picked if values[i] > mark])]
        yield pd.DataFrame([[*group, *told]], columns=[f.name for f in out])

    return narrow.groupBy(*keys).applyInPandasWithState(keep, out, state_type, "update", GroupStateTimeout.EventTimeTimeout)


def emitted_alerts(versions: DataFrame, keys: tuple[str, ...] = ("type",)) -> DataFrame:
    """All alerts settled in any version, and those that stand in the latest version of their key."""
    settled = versions.select(*keys, F.inline("settled"))
    return settled.unionByName(latest(versions.drop("settled"), list(keys)).select(*keys, F.inline("open")))


def stream_drift(readings: DataFrame, reference: DataFrame, columns: list[str], path: str, checkpoint: str,
                 threshold: float = 3.0) -> DataFrame:
    """Drift of every micro-batch against stored statistics, appended to a table.

    What a trigger holds depends on the arrival of files; `stream_moments` and `window_drift` give the drift of
    event-time windows. A batch number names its folder, so a repeated batch replaces itself.
    """
    spark = readings.sparkSession

    def handle(batch: DataFrame, number: int) -> None:
        found = drift_detect(reference, batch, columns, threshold)
        found.write.mode("overwrite").parquet(f"{path}/batch={number}")

    run_batches(readings, handle, checkpoint)
    return spark.read.parquet(path)


def stream_moments(readings: DataFrame, columns: list[str], width: str = "1 day", slide: str | None = None,
                   late: str = "1 hour", ts: str = "ts") -> DataFrame:
    """Per sliding event-time window: count, sum and sum of squares of each column, kept as the stream's state.

    The moments of partial groups add up, so neither a trigger nor a task needs the rows of a window together.
    """
    timed = readings.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)
    value = {c: F.col(c).cast("double") for c in columns}
    out = timed.groupBy(F.window(ts, width, slide or width)).agg(*[e for c, v in value.items() for e in (
        F.count(v).alias(f"n_{c}"), F.sum(v).alias(f"s_{c}"), F.sum(v * v).alias(f"q_{c}"))])
    return out.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), *out.columns[1:])


def window_drift(moments: DataFrame, reference: DataFrame, columns: list[str], threshold: float = 3.0) -> DataFrame:
    """Drift of every window against stored statistics, from its moments (`latest` by start and end)."""
    rows = F.array(*[F.struct(F.lit(c).alias("feature"), F.try_divide(F.col(f"s_{c}"), F.col(f"n_{c}")).alias("mean"))
                     for c in columns])
    return drift_figures(reference, moments.select("start", "end", F.inline(rows)), threshold, ["start", "end"])
