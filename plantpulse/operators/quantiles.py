"""Exact linear-interpolated quantiles by counting leading digits, one method at every size."""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plantpulse import session

PARTS = 1024
# v rounded to eleven significant bits, which never falls as v grows: a product with SPLIT divides a double into a head
# and the rest. Beyond HUGE it would overflow; such values count as the largest double.
SPLIT, HUGE, LARGEST = float((1 << 42) + 1), 1e290, 1.7976931348623157e308
DIGITS = (f"case when abs(v) <= {HUGE!r}D then v * {SPLIT!r}D - (v * {SPLIT!r}D - v) "
          f"when abs(v) = double('inf') then v when v > 0 then {LARGEST!r}D else -{LARGEST!r}D end")


def quantiles(df: DataFrame, columns: list[str], at: list[float]) -> dict[str, Column]:
    """Per column an array of constants, the quantiles, which are found before it returns."""
    found = quantile_values(df, columns, at)
    return {c: F.array(*[F.lit(v).cast("double") for v in vs]) for c, vs in found.items()}


def quantile_values(df: DataFrame, columns: list[str], at: list[float]) -> dict[str, list[float | None]]:
    """The quantiles of each column; None where a column has no value.

    A selection by digits. The first pass counts the values of all columns by their leading digits, as numbers of
    eleven significant bits. A running sum over these counts finds the digits that hold a wanted
    rank. The second pass reads just the values with these digits: where they fit one task they are counted
    one by one, in order, otherwise by a finer cut of their range, and so on. Most tables need the two
    passes. Counts are summed within each task before the shuffle, the running sums stay in the engine,
    and the driver sees at most two rows for each column and quantile in a pass.
    """
    if not columns:
        return {}
    limit = session.max_rows_per_task(df.sparkSession)

    # expressions as text: hundreds of columns cost one call to the engine instead of several each
    def values(some: list[int]) -> DataFrame:
        names = {i: columns[i].replace("`", "``") for i in some}
        cells = ", ".join(f"struct({i} as t, cast(`{c}` as double) + 0D as v)" for i, c in names.items())
        return df.selectExpr(f"inline(array({cells}))").where("v is not null and not isnan(v)")

    stats = [F.expr(e) for e in ("count(1) as n", "min(v) as low", "max(v) as high")]
    counts = values(list(range(len(columns)))).selectExpr("t", "v", f"{DIGITS} as place").groupBy("t", "place").agg(*stats)
    placed = counts.selectExpr("t", "n", "low", "high", "sum(n) over (partition by t order by place) - n as below",
                               "sum(n) over (partition by t) as total")
    ranks = ", ".join(f"cast({fn}((total - 1) * {float(q)!r}D) as long)" for q in at for fn in ("floor", "ceil"))
    hits = placed.where(f"exists(array({ranks}), r -> r >= below and r < below + n)").collect()
    totals = {r.t: r.total for r in hits}
    value: dict[tuple[int, int], float] = {}
    open_ = []
    for t, n in totals.items():
        wanted = sorted({(rank, rank) for q in at for rank in _neighbours(n, q)})
        open_ += _narrow(t, [r for r in hits if r.t == t], wanted, value)
    while open_:
        table = df.sparkSession.createDataFrame(pa.table({
            "k": pa.array(range(len(open_)), pa.int32()), "s": pa.array([o[0] for o in open_], pa.int32()),
            "low": [o[1] for o in open_], "high": [o[2] for o in open_], "small": [o[3] <= limit for o in open_],
            "ranks": pa.array([[rank for _, rank in o[4]] for o in open_], pa.list_(pa.int64()))}))
        # at most two ranges for each column and quantile
        inside = values(sorted({o[0] for o in open_})).join(
            F.broadcast(table), F.expr("t = s and v between low and high"))
        cut = f"cast(least(floor((v - low) / (high - low) * {PARTS}), {PARTS - 1}) as double)"
        counts = inside.selectExpr("k", "v", "ranks", f"case when small then v else {cut} end as place").groupBy(
            "k", "place").agg(*stats, F.expr("any_value(ranks) as ranks"))
        placed = counts.selectExpr("*", "sum(n) over (partition by k order by place) - n as below")
        hits = placed.where("exists(ranks, r -> r >= below and r < below + n)").collect()
        open_ = [part for k, (t, _, _, _, wanted) in enumerate(open_)
                 for part in _narrow(t, [r for r in hits if r.k == k], wanted, value)]
    return {c: [_blend(value, i, totals.get(i, 0), q) for q in at] for i, c in enumerate(columns)}


def _narrow(t: int, hits: list, wanted: list[tuple[int, int]], value: dict) -> list[tuple]:
    """Move each rank, (in the column, in the range), into the row that holds it; a row of one value settles its ranks."""
    out = []
    for r in hits:
        own = [(first, rank - r.below) for first, rank in wanted if r.below <= rank < r.below + r.n]
        if r.low == r.high:
            value.update({(t, first): r.low for first, _ in own})
        elif own:
            out.append((t, r.low, r.high, r.n, own))
    return out


def _neighbours(n: int, q: float) -> tuple[int, int]:
    place = (n - 1) * q
    return math.floor(place), math.ceil(place)


def _blend(value: dict, column: int, n: int, q: float) -> float | None:
    if n == 0:
        return None
    low, high = (value[column, r] for r in _neighbours(n, q))
    return low if low == high else low + (high - low) * ((n - 1) * q - math.floor((n - 1) * q))
