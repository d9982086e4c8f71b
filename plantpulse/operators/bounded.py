"""Many bounded row-window columns at once, in one ordered pass over Arrow batches.

Hundreds of window functions over one row make plans that take longer to prepare than to run. Here the rows of a
series are sorted once, and every family of columns (trailing statistics, lags, changes, crossovers) is
computed by numpy over whole columns. The rows of a task stream through; from one batch to the next only the
last rows of the open series are kept.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plantpulse.operators.order import BLOCK, OWN, Series, copied_blocks, last_seen

GROUP = "__group"
KINDS = {"tinyint": (pa.int8(), T.ByteType()), "smallint": (pa.int16(), T.ShortType()), "int": (pa.int32(), T.IntegerType()),
         "bigint": (pa.int64(), T.LongType()), "float": (pa.float32(), T.FloatType()), "double": (pa.float64(), T.DoubleType())}


@dataclass(frozen=True)
class Plan:
    """What to compute: windows, lags, periods and spans of averages over `columns`, crossovers of some, the rate of a counter.

    Exponential averages look back over the whole series, so they are computed for whole series only, not for blocks.
    """

    columns: tuple[str, ...]
    windows: tuple[int, ...] = ()
    lags: tuple[int, ...] = ()
    periods: tuple[int, ...] = ()
    crossed: tuple[str, ...] = ()
    counter: str | None = None
    short: int = 4
    long: int = 24
    rolled: str = "roll"
    spans: tuple[int, ...] = ()

    @property
    def reach(self) -> int:
        """Rows that a value can depend on, besides its own."""
        return max([0, *[n - 1 for n in self.windows], *self.lags, *self.periods,
                    *([self.long - 1] if self.crossed else []), int(self.counter is not None)])

    def outputs(self, kinds: dict[str, str]) -> list[tuple[str, str]]:
        """(name, type) of every added column; least and largest values, lags and differences keep the column's type."""
        out = []
        for c in self.columns:
            out += [(f"{self.rolled}_{c}_{s}_{n}", "double" if s in ("mean", "std") else kinds[c])
                    for s in STATS for n in self.windows]
            for n in self.lags:
                out += [(f"lag_{c}_{n}", kinds[c]), (f"lag_{c}_diff_{n}", kinds[c])]
            out += [(f"ema_{c}_{n}", "double" if n > 1 else kinds[c]) for n in self.spans]
            out += [(f"roc_{c}_{n}", "double") for n in self.periods]
        for c in self.crossed:
            out += [(f"ma_{c}_{s}", "double") for s in (
                f"short_{self.short}", f"long_{self.long}", f"crossover_{self.short}_{self.long}")]
        return out + ([("energy_rate", "double")] if self.counter else [])


STATS = ("mean", "std", "min", "max")


def shifted(x: np.ndarray, place: np.ndarray, n: int, blank: float) -> np.ndarray:
    """x of n rows before within the series; `blank` where the series is shorter. place: row number in the series."""
    out = np.full(len(x), blank)
    if n < len(x):
        out[n:] = x[:-n] if n else x
    out[place < n] = blank
    return out


def joined(a: tuple, b: tuple, k: int, place: np.ndarray) -> tuple:
    """Frames a of the last k rows, each with the frame b that ends just before it; see `trailing` for what a frame holds."""
    if k >= len(place):
        return a
    inside = place[k:] >= k
    (n1, s1, q1, lo1, hi1), (n2, s2, q2, lo2, hi2) = (v[k:] for v in a), (v[:-k] for v in b)
    n2, s2, q2 = (np.where(inside, v, 0.0) for v in (n2, s2, q2))
    n = n1 + n2
    both = n1 * n2
    gap = s1 / n1 - s2 / n2
    q = q1 + q2 + np.where(both > 0, gap * gap * (both / n), 0.0)
    new = (n, s1 + s2, q, np.minimum(lo1, np.where(inside, lo2, np.inf)), np.maximum(hi1, np.where(inside, hi2, -np.inf)))
    return tuple(np.concatenate([old[:k], v]) for old, v in zip(a, new))


def trailing_all(x: np.ndarray, place: np.ndarray, sizes: tuple[int, ...]) -> dict[int, tuple[np.ndarray, ...]]:
    """For each size mean, sample deviation, least and largest of the last so many rows; missing values (NaN) are skipped.

    A frame holds its known values' count, sum, squares about their mean, least and largest. Frames of 1, 2, 4, ... rows
    come from two of half the length, and a size is put together from those, so a row costs log(size) steps. Frames are
    only ever added, so a large value leaves no trace in later windows; a constant window has no deviation.
    """
    gone = np.isnan(x)
    zero = np.zeros(len(x))
    out: dict[int, tuple | None] = {n: None for n in sizes}
    with np.errstate(all="ignore"):
        frame, rows = (np.where(gone, 0.0, 1.0), np.where(gone, 0.0, x), zero, np.where(gone, np.inf, x), np.where(gone, -np.inf, x)), 1
        while True:
            for n in out:
                if n & rows:  # the rows of the lower bits are the later ones
                    out[n] = frame if out[n] is None else joined(out[n], frame, n % rows, place)
            if 2 * rows > max(sizes, default=0):
                break
            frame, rows = joined(frame, frame, rows, place), 2 * rows
        return {n: _statistics(*f) for n, f in out.items()}


def _statistics(count, total, squares, least, most) -> tuple[np.ndarray, ...]:
    mean = total / count
    std = np.sqrt(np.where(least == most, 0.0, squares) / (count - 1))
    none = count == 0
    return tuple(np.where(bad, np.nan, v) for v, bad in (
        (mean, none), (std, (count < 2) | ~np.isfinite(mean)), (least, none), (most, none)))


def trailing(x: np.ndarray, place: np.ndarray, n: int) -> tuple[np.ndarray, ...]:
    """`trailing_all` of one size."""
    return trailing_all(x, place, (n,))[n]


def filled(x: np.ndarray, place: np.ndarray, before: float) -> np.ndarray:
    """x with gaps closed by the last value of the series; `before` is that of the series' rows of earlier batches."""
    at = np.arange(len(x))
    known = ~np.isnan(x)
    last = np.maximum.accumulate(np.where(known, at, -1))
    start = at - place  # below 0 for a series that has begun in an earlier batch
    out = np.where(last >= np.maximum(start, 0), x[np.maximum(last, 0)], np.nan)
    return np.where(np.isnan(out) & (start < 0), before, out)


class _Averages:
    """Exponential averages y = (k*y + a*x) / (k + a) with k = (1-a)^gap, row after row for all columns and spans at once."""

    def __init__(self, columns: int, spans: tuple[int, ...]):
        self.alphas = [2.0 / (s + 1.0) if s > 1 else 1.0 for s in spans]
        # weights of the old value by the rows since; one below exp(-150) is lost in double precision anyway
        self.kept = [(1.0 - a) ** np.arange(2 if a == 1.0 else int(150 / -np.log(1.0 - a)) + 2) for a in self.alphas]
        # values after the last row, and how many rows ago the last known value was (0: never)
        self.now, self.ago = np.zeros((columns, len(spans))), np.zeros(columns, np.int64)

    def run(self, x: np.ndarray, place: np.ndarray) -> np.ndarray:
        """x: (rows, columns) with NaN for missing values; place: row number in the series. (rows, columns, spans)."""
        known, at = ~np.isnan(x), np.arange(len(x))[:, None]
        start = at - place[:, None]  # below 0 for a series that has begun in an earlier batch
        last = np.maximum.accumulate(np.where(known, at, -1), axis=0)
        last = np.vstack([np.full((1, x.shape[1]), -1), last[:-1]])
        gap = np.where(last >= np.maximum(start, 0), at - last, np.where((start < 0) & (self.ago > 0), at + self.ago, 0))
        value, first = np.where(known, x, 0.0), known & (gap == 0)
        decay, out = np.empty((*x.shape, len(self.alphas))), np.empty((*x.shape, len(self.alphas)))
        for j, (alpha, kept) in enumerate(zip(self.alphas, self.kept)):
            k = kept[np.minimum(gap, len(kept) - 1)]
            decay[..., j] = np.where(known, np.where(first, 0.0, k / (k + alpha)), 1.0)
            out[..., j] = np.where(first, value, value * alpha / (k + alpha))
        new, y = (place == 0).tolist(), self.now
        with np.errstate(invalid="ignore"):
            for i, (d, row) in enumerate(zip(decay, out)):
                if not new[i]:
                    row += d * y
                y = row
        self.now = y.copy()
        since = np.where(known[-1], 1, np.where(gap[-1] > 0, gap[-1] + 1, 0))
        self.ago = since
        out[~(known | (gap > 0))] = np.nan
        return out


def ratio(now: np.ndarray, then: np.ndarray) -> np.ndarray:
    """now / then - 1; infinite with the sign of now over 0, missing for 0 over 0."""
    with np.errstate(all="ignore"):
        return np.where(then == 0, np.where(now > 0, np.inf, np.where(now < 0, -np.inf, np.nan)), now / then - 1)


ROWS_AT_ONCE = 4096


def _pass(batches: Iterator[pa.RecordBatch], plan: Plan, names: list[str], outputs: list[tuple[str, str]],
          carried: bool, own: str | None) -> Iterator[pa.RecordBatch]:
    """The added columns of rows that come sorted by series; `carried` says that filled columns are given."""
    # of the open series: its group, rows so far, last rows of each column, last value of each column
    group, rows, tail, fill = None, 0, {}, {}
    averages = _Averages(len(plan.columns), plan.spans)
    needed = [*plan.columns, *[f"__f_{c}" for c in plan.columns if carried and plan.periods]]
    needed += [c for c in (*plan.crossed, plan.counter) if c and c not in needed]
    for whole in batches:
        for a in range(0, whole.num_rows, ROWS_AT_ONCE):
            batch = whole.slice(a, ROWS_AT_ONCE)
            groups = batch.column(GROUP).to_numpy()
            n, new = len(groups), np.ones(batch.num_rows, bool)
            new[1:] = groups[1:] != groups[:-1]
            same = group is not None and groups[0] == group
            new[0] = not same
            starts = np.where(new, np.arange(n), -1)
            starts = np.maximum.accumulate(starts)
            place = np.arange(n) - starts
            if same:
                place[starts < 0] = rows + np.arange(int((starts < 0).sum()))
            old = min(plan.reach, rows) if same else 0
            x, value, means = {}, {}, {}
            for c in needed:
                raw = batch.column(c).cast(pa.float64()).to_numpy(zero_copy_only=False)
                x[c] = np.concatenate([tail[c][len(tail[c]) - old:], raw]) if old else raw
            spot = np.concatenate([np.arange(rows - old, rows), place]) if old else place
            for c in plan.columns:
                # the crossovers of a column share its frames
                ends = (plan.short, plan.long) if c in plan.crossed else ()
                found = trailing_all(x[c], spot, tuple({*plan.windows, *ends}))
                for w in plan.windows:
                    for s, v in zip(STATS, found[w]):
                        value[f"{plan.rolled}_{c}_{s}_{w}"] = v[old:]
                means |= {(c, w): found[w][0][old:] for w in ends}
                for w in plan.lags:
                    then = shifted(x[c], spot, w, np.nan)
                    value[f"lag_{c}_{w}"], value[f"lag_{c}_diff_{w}"] = then[old:], (x[c] - then)[old:]
                if plan.periods:
                    if carried:
                        f = x[f"__f_{c}"]
                    else:
                        fresh = filled(x[c][old:], place, fill.get(c, np.nan) if same else np.nan)
                        f = np.concatenate([tail["__f_" + c][len(tail["__f_" + c]) - old:], fresh]) if old else fresh
                        x["__f_" + c] = f
                        fill[c] = f[-1]
                    for w in plan.periods:
                        value[f"roc_{c}_{w}"] = ratio(f, shifted(f, spot, w, np.nan))[old:]
            if plan.spans:
                smooth = averages.run(np.column_stack([x[c][old:] for c in plan.columns]), place)
                value |= {f"ema_{c}_{s}": np.ascontiguousarray(smooth[:, i, j])
                          for i, c in enumerate(plan.columns) for j, s in enumerate(plan.spans)}
            for c in plan.crossed:
                if c not in plan.columns:
                    found = trailing_all(x[c], spot, (plan.short, plan.long))
                    means |= {(c, w): found[w][0][old:] for w in found}
                fast, slow = means[c, plan.short], means[c, plan.long]
                for s, v in ((f"short_{plan.short}", fast), (f"long_{plan.long}", slow),
                             (f"crossover_{plan.short}_{plan.long}", fast - slow)):
                    value[f"ma_{c}_{s}"] = v
            if plan.counter:
                step = x[plan.counter] - shifted(x[plan.counter], spot, 1, np.nan)
                value["energy_rate"] = np.maximum(np.where(np.isnan(step), 0.0, step)[old:], 0.0)
            group, rows = groups[-1], int(place[-1]) + 1
            tail = {c: v[-plan.reach:].copy() if plan.reach else v[:0] for c, v in x.items()}
            columns = [batch.column(c) for c in names]
            for name, kind in outputs:
                v = value[name]
                gone = np.isnan(v)
                if kind not in ("double", "float"):
                    v = np.where(gone, 0, v)
                columns.append(pa.array(v, mask=gone).cast(KINDS[kind][0]))
            out = pa.RecordBatch.from_arrays(columns, names=[*names, *[name for name, _ in outputs]])
            yield out.filter(batch.column(own)) if own else out


def bounded_features(series: Series, plan: Plan) -> Series:
    """Add the columns of a plan to a laid-out series.

    Keys above the row limit come as blocks with copies of the rows before them, as for any bounded frame; the filled
    values that a change needs are carried over their blocks first. NaN counts as missing; whole numbers are
    exact up to 2^53.
    """
    if series.blocked and plan.spans:
        raise ValueError("averages over blocks of a key need a scan first")
    kinds = dict(series.df.dtypes)
    outputs = plan.outputs(kinds)
    carried = bool(series.blocked and plan.periods)
    if carried:
        series = last_seen(series, {f"__f_{c}": F.col(c) for c in plan.columns})
    names = [c for c in series.df.columns if not c.startswith("__f_")]
    keys, own = [*series.spec.keys], None
    df = series.df
    if series.blocked:
        df, keys, own = copied_blocks(series, plan.reach), [*keys, BLOCK], OWN
    grouped = df.withColumn(GROUP, F.xxhash64(*(keys or [F.lit(0)])))
    # the number of tasks that the session names, since the size of the rows does not show what their work costs
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) if keys else 1
    laid = grouped.repartition(tasks, *keys).sortWithinPartitions(*keys, *series.spec.sort)
    schema = T.StructType([*[laid.schema[c] for c in names], *[T.StructField(n, KINDS[k][1]) for n, k in outputs]])
    done = laid.mapInArrow(lambda batches: _pass(batches, plan, names, outputs, carried, own), schema)
    return series.put(done)
