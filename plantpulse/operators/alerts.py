"""Alert filtering, cooldown, acknowledgement and summaries."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plantpulse.functions.grading import SEVERITY_LEVELS, severity_level
from plantpulse.operators.order import (
    BLOCK, POS, Series, SeriesSpec, joined_on, lay_out, next_seen, with_position, with_row_number,
)
from plantpulse.session import staged

HOUR = 3_600_000_000
ALERTS = SeriesSpec(keys=("type",), order="ts", tiebreak=("alert_id",))


def micros(ts: str) -> Column:
    return F.unix_micros(F.col(ts).cast("timestamp"))


def emitted(values: np.ndarray, gap: int, not_before: int | None = None, start: int = 0) -> np.ndarray:
    """Indexes kept by the greedy rule from `start` on: the next kept value is at least `gap` after the last."""
    i = start if not_before is None else max(start, int(np.searchsorted(values, not_before)))
    kept = []
    while i < len(values):
        kept.append(i)
        i = int(np.searchsorted(values, values[i] + gap))
    return np.array(kept, dtype=int)


def leaves(values: np.ndarray, gap: int) -> np.ndarray:
    """For each row of a block, were it kept, the least value that may be kept after the block."""
    n = len(values)
    after = np.searchsorted(values, values + gap)
    last = np.where(after < n, after, np.arange(n))
    while True:
        further = last[last]
        if (further == last).all():
            return values[last] + gap
        last = further


def greedy_gap(series: Series, value: Column, gap: int) -> DataFrame:
    """Rows kept when each must lie at least `gap` after the last kept row of its key.

    Only the key, the value and the row position reach Python; rows without a value are not kept. A key above
    the row limit is cut into blocks. What follows a kept row depends on that row alone, so the first row
    kept in each block is found by following successors from block to block, all blocks at once;
    then the blocks run side by side.
    """
    spec, columns = series.spec, [c for c in series.df.columns if c != POS]
    keys = list(spec.keys)
    series = with_row_number(series.put(series.df.withColumn("__v", value)), "__i")
    present = series.df.filter(F.col("__v").isNotNull())
    if not series.blocked:
        return _keep(series.df, _run(present.select(*keys, "__i", "__v"), keys, gap), spec).select(*columns)
    cut = present.withColumn(BLOCK, F.floor(F.col("__i") / series.limit))
    narrow = cut.select(*keys, BLOCK, "__i", "__v")
    entries = block_entries(narrow, cut.filter(F.col(POS).isNotNull()).select(*narrow.columns), gap, series)
    kept = _run(joined_on(narrow, entries, [*keys, BLOCK], "inner"), [*keys, BLOCK], gap)
    return _keep(series.df, kept, spec).select(*columns)


def _fields(df: DataFrame, *names: str) -> T.StructType:
    return T.StructType([df.schema[n] for n in names])


def _run(df: DataFrame, group: list[str], gap: int) -> DataFrame:
    entry = "__entry" in df.columns

    def keep(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("__i")
        start = int(np.searchsorted(pdf["__i"].to_numpy(), pdf["__entry"].iloc[0])) if entry else 0
        return pdf.iloc[emitted(pdf["__v"].to_numpy(), gap, start=start)][group + ["__i"]]

    return df.groupBy(*group).applyInPandas(keep, _fields(df, *group, "__i"))


def block_entries(narrow: DataFrame, hot: DataFrame, gap: int, series: Series) -> DataFrame:
    """(keys, block, __entry): the first row kept of each block that has one.

    A list ranking. Every row of a hot key is linked to the row that follows where the greedy rule leaves
    its block: each block gives the value it is left at (`leaves`), and one ordered pass over these values
    and the rows finds the next row at or after each. From a key's first row the links are then followed by
    pointer doubling, so a chain over n blocks takes about log2(n) rounds of joins. No task or group ever
    holds more than a block.
    """
    keys = list(series.spec.keys)

    def ends(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("__i")
        return pdf.assign(__at=leaves(pdf["__v"].to_numpy(), gap))[keys + ["__i", "__at"]]

    left = T.StructType([*_fields(hot, *keys, "__i").fields, T.StructField("__at", T.LongType())])
    left = staged(hot.groupBy(*keys, BLOCK).applyInPandas(ends, left), "leaves")
    targets = left.select(*keys, "__at").distinct().withColumn("__kind", F.lit(0)).withColumn(
        "__i", F.lit(None).cast("long"))
    rows = hot.select(*keys, F.col("__v").alias("__at"), F.lit(1).alias("__kind"), "__i")
    order = SeriesSpec(keys=series.spec.keys, order="__at", tiebreak=("__kind", "__i"), max_rows=series.limit)
    met = next_seen(lay_out(targets.unionByName(rows), order, heavy=True), {"__to": F.col("__i")}).frame()
    met = met.filter((F.col("__kind") == 0) & F.col("__to").isNotNull()).select(*keys, "__at", "__to")
    links = staged(joined_on(left, met, [*keys, "__at"], "inner").select(*keys, "__i", "__to"), "links")
    first = staged(narrow.groupBy(*keys).agg(F.min("__i").alias("__i")), "first")
    # only rows that some link leads to can be entered
    entered = links.select(*keys, F.col("__to").alias("__i")).unionByName(first).distinct()
    jump = staged(joined_on(links, entered, [*keys, "__i"], "left_semi"), "jump")
    reached = first
    while True:
        more = staged(joined_on(jump, reached, [*keys, "__i"], "left_semi").select(
            *keys, F.col("__to").alias("__i")), "more")
        if not more.limit(1).count():
            break
        reached = reached.unionByName(more)
        onward = jump.select(*keys, F.col("__i").alias("__to"), F.col("__to").alias("__then"))
        jump = staged(joined_on(jump, onward, [*keys, "__to"], "inner").select(
            *keys, "__i", F.col("__then").alias("__to")), "jump")
    return reached.select(*keys, F.floor(F.col("__i") / series.limit).alias(BLOCK), F.col("__i").alias("__entry"))


def _keep(df: DataFrame, kept: DataFrame, spec: SeriesSpec) -> DataFrame:
    return joined_on(df, kept, [*spec.keys, "__i"], "left_semi")


def alert_cooldown(df: DataFrame, cooldown_micros: int = HOUR, spec: SeriesSpec = ALERTS) -> DataFrame:
    """Alerts not suppressed by an emitted one of the same key within the cooldown."""
    return greedy_gap(lay_out(df, spec, heavy=True), micros(spec.order), cooldown_micros)


def filter_alerts(df: DataFrame, min_severity: str = "low", cooldown: int | None = None,
                  spec: SeriesSpec = SeriesSpec()) -> DataFrame:
    """Rows of at least this severity; with `cooldown`, at least that many rows apart per key.

    The distance counts rows of the unfiltered series.
    """
    level = SEVERITY_LEVELS.get(min_severity, 1)
    graded = df.withColumn("severity_level", severity_level(F.col("severity")))
    wanted = F.col("severity_level") >= level
    if cooldown is None:
        return graded.filter(wanted)
    series = with_row_number(lay_out(graded, spec, heavy=True), "__row")
    series = series.put(series.df.filter(wanted))
    return greedy_gap(series, F.col("__row").cast("long"), cooldown).drop("__row")


def alert_log(df: DataFrame, cooldown_micros: int = HOUR, spec: SeriesSpec = ALERTS) -> DataFrame:
    """Emitted alerts numbered from 1 in time order."""
    kept = alert_cooldown(df, cooldown_micros, spec)
    numbered = with_position(kept, SeriesSpec(keys=(), order=spec.order, tiebreak=spec.tiebreak), "__n")
    return numbered.select((F.col("__n") + 1).cast("long").alias("id"), *df.columns,
                           F.lit(False).alias("acknowledged"))


def acknowledge(alerts: DataFrame, acks: DataFrame, key: str = "alert_id") -> DataFrame:
    """Alerts with the time of their latest acknowledgement, if any."""
    latest = acks.groupBy(key).agg(F.max("acknowledged_at").alias("acknowledged_at"))
    out = alerts.drop("acknowledged").join(latest, key, "left")
    return out.withColumn("acknowledged", F.col("acknowledged_at").isNotNull())


def active_alerts(alerts: DataFrame, min_severity: str = "low", limit: int = 50,
                  ts: str = "ts", key: str = "alert_id") -> DataFrame:
    level = SEVERITY_LEVELS.get(min_severity, 1)
    open_ = alerts.filter(~F.col("acknowledged") & (
        F.coalesce(severity_level(F.col("severity")), F.lit(0)) >= level))
    return open_.orderBy(F.col(ts).desc(), F.col(key).desc()).limit(limit)


def alert_summary(alerts: DataFrame) -> DataFrame:
    """Counts per severity and, on each row, the totals."""
    per = alerts.groupBy("severity").agg(
        F.count(F.lit(1)).alias("count"), F.count_if("acknowledged").alias("acknowledged"))
    t = per.agg(F.struct(F.sum("count").alias("n"), F.sum("acknowledged").alias("a")).alias("t")).scalar()
    return per.select("severity", "count", t["n"].alias("total_alerts"),
                      (t["n"] - t["a"]).alias("active"), t["a"].alias("acknowledged"))
