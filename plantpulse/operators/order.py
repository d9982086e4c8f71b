"""Ordered series that stay bounded when one key holds most of the rows.

Every order-dependent operator names its keys and its order in a SeriesSpec.
A key whose rows fit one task is handled by an ordinary window over the key. A
key above the limit is range-sorted over many tasks, given exact positions,
and cut into blocks by position: bounded frames copy the few rows around each
block border ("halo"), unbounded frames carry one summary row per block.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plantpulse import session

POS, BLOCK, OWN = "__pos", "__block", "__own"
BROADCAST_ROWS = 100_000
ROWS_WORTH_A_TASK = 5_000
FIRST, BEFORE, HERE, LAST = Window.unboundedPreceding, -1, Window.currentRow, Window.unboundedFollowing


@dataclass(frozen=True)
class SeriesSpec:
    keys: tuple[str, ...] = ("unit_id",)
    order: str = "ts"
    tiebreak: tuple[str, ...] = ("reading_id",)
    max_rows: int | None = None

    @property
    def sort(self) -> list[str]:
        return [self.order, *self.tiebreak]


READINGS = SeriesSpec()


@dataclass(frozen=True)
class Series:
    """A frame with known layout; `blocked` means hot keys carry a position."""

    df: DataFrame
    spec: SeriesSpec
    limit: int
    longest: int
    blocked: bool

    def put(self, df: DataFrame) -> Series:
        return replace(self, df=df)

    def window(self, *more: str) -> WindowSpec:
        parts = [*self.spec.keys, *more] or [F.lit(0)]
        return Window.partitionBy(*parts).orderBy(*self.spec.sort)

    def frame(self) -> DataFrame:
        return self.df.drop(POS) if self.blocked else self.df


def lay_out(df: DataFrame, spec: SeriesSpec, heavy: bool = False) -> Series:
    """Count rows per key (key columns only) and index just the keys above the limit.

    `heavy` spreads the keys over a fixed number of tasks, for work whose cost
    the size of the shuffled rows does not show.
    """
    limit = spec.max_rows or session.max_rows_per_task(df.sparkSession)
    sizes = df.groupBy(*spec.keys).agg(F.count(F.lit(1)).alias("n"))
    hot = sizes.filter(F.col("n") > limit)
    size = sizes.agg(
        F.max("n").alias("longest"), F.sum(F.when(F.col("n") > limit, F.col("n"))).alias("rows"),
        F.sum("n").alias("total"), F.count_if(F.col("n") > limit).alias("keys"),
    ).first()
    if not size.rows:
        if heavy and spec.keys:
            df = df.repartition(_tasks(df, size.total or 0, limit), *spec.keys)
        return Series(df, spec, limit, size.longest or 0, False)
    if not spec.keys:
        return Series(_positions(df, spec, size.rows, 1, limit), spec, limit, size.longest, True)
    marks = hot.select(*[F.col(k).alias(f"__h_{k}") for k in spec.keys], F.lit(True).alias("__hot"))
    if size.keys <= BROADCAST_ROWS:
        marks = F.broadcast(marks)
    marked = df.join(
        marks, [F.col(k).eqNullSafe(F.col(f"__h_{k}")) for k in spec.keys], "left")
    cold = marked.filter(F.col("__hot").isNull()).select(*df.columns, F.lit(None).cast("long").alias(POS))
    warm = _positions(marked.filter(F.col("__hot")).select(*df.columns), spec, size.rows, size.keys, limit)
    return Series(cold.unionByName(warm), spec, limit, size.longest, True)


def _tasks(df: DataFrame, rows: int, limit: int) -> int:
    """The configured number of shuffle tasks; fewer for few rows, more when they would hold too many."""
    spark = df.sparkSession
    useful = max(spark.sparkContext.defaultParallelism, rows // ROWS_WORTH_A_TASK)
    configured = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return max(min(configured, useful), rows // (8 * limit) + 1)


def _positions(df: DataFrame, spec: SeriesSpec, rows: int, keys: int, limit: int) -> DataFrame:
    """Exact 0-based position within each key, from a range sort over many tasks.

    A range sort on (keys, order, tiebreak) spreads one key over many partitions.
    The sorted rows are written once, so partition numbers cannot change between
    the counting pass and the use, nor when an executor is lost.
    """
    parts = _tasks(df, rows, limit)
    by = [*spec.keys, *spec.sort]
    laid = session.staged(
        df.repartitionByRange(parts, *by).sortWithinPartitions(*by)
        .withColumn("__id", F.monotonically_increasing_id()), "sorted")
    laid = laid.withColumns({
        "__part": F.shiftright("__id", 33),
        "__local": F.col("__id").bitwiseAND(F.lit((1 << 33) - 1)),
    })
    runs = laid.groupBy(*spec.keys, "__part").agg(
        F.count(F.lit(1)).alias("__n"), F.min("__local").alias("__start"))
    # one row per partition and key: at most partitions + hot keys rows
    before = Window.partitionBy(*([*spec.keys] or [F.lit(0)])).orderBy("__part").rowsBetween(FIRST, BEFORE)
    runs = runs.select(
        *[F.col(k).alias(f"__r_{k}") for k in spec.keys], F.col("__part").alias("__r_part"),
        (F.coalesce(F.sum("__n").over(before), F.lit(0)) - F.col("__start")).alias("__shift"))
    same = [F.col("__part") == F.col("__r_part")]
    same += [F.col(k).eqNullSafe(F.col(f"__r_{k}")) for k in spec.keys]
    if parts + keys <= BROADCAST_ROWS:
        runs = F.broadcast(runs)
    return laid.join(runs, same).select(
        *df.columns, (F.col("__local") + F.col("__shift")).alias(POS))


def over_rows(
    series: Series, build: Callable[[WindowSpec], dict[str, Column]], back: int = 0, ahead: int = 0,
) -> Series:
    """Add window columns whose frames reach at most `back` rows back and `ahead` rows on."""
    if not series.blocked:
        return series.put(in_groups(series.df, build(series.window())))
    done = in_groups(copied_blocks(series, back, ahead), build(series.window(BLOCK)))
    return series.put(done.filter(OWN).drop(BLOCK, OWN))


def copied_blocks(series: Series, back: int, ahead: int = 0) -> DataFrame:
    """The rows of a blocked series with their block, and copies (OWN false) of those that frames of other blocks reach."""
    size = max(series.limit, 4 * (back + ahead), 1)
    block = F.floor(F.col(POS) / size)
    offset = F.col(POS) - block * size
    home = F.coalesce(block, F.lit(0))
    copies = [F.struct(home.alias(BLOCK), F.lit(True).alias(OWN))]
    if back:
        copies.append(F.when(offset >= size - back, F.struct((home + 1).alias(BLOCK), F.lit(False).alias(OWN))))
    if ahead:
        copies.append(F.when(offset < ahead, F.struct((home - 1).alias(BLOCK), F.lit(False).alias(OWN))))
    return series.df.select("*", F.inline(F.array_compact(F.array(*copies))))


# more functions than this in one window make its generated code too long to be compiled
GROUP = 72


def in_groups(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Add window columns in groups; same window, so no further shuffle or sort."""
    items = list(columns.items())
    for i in range(0, len(items), GROUP):
        df = df.withColumns(dict(items[i:i + GROUP]))
    return df


def with_row_number(series: Series, name: str) -> Series:
    """0-based position within the series."""
    if not series.blocked:
        return series.put(series.df.withColumn(name, F.row_number().over(series.window()) - F.lit(1)))
    return over_rows(series, lambda w: {name: F.coalesce(F.col(POS), F.row_number().over(w) - F.lit(1))})


def last_seen(series: Series, values: dict[str, Column], inclusive: bool = True) -> Series:
    """Latest non-missing value of each expression, up to (or strictly before) the row."""
    return _seen(series, values, FIRST, HERE if inclusive else BEFORE, forward=True)


def next_seen(series: Series, values: dict[str, Column]) -> Series:
    """Earliest non-missing value of each expression, from the row on."""
    return _seen(series, values, HERE, LAST, forward=False)


def _seen(series: Series, values: dict[str, Column], start: int, end: int, forward: bool) -> Series:
    pick = F.last if forward else F.first
    if not series.blocked:
        if not forward:
            df = series.df.withColumn("__place", F.row_number().over(series.window()))
            done = in_groups(df, {n: F.last(v, True).over(_backwards(series)) for n, v in values.items()})
            return series.put(done.drop("__place"))
        w = series.window().rowsBetween(start, end)
        return series.put(in_groups(series.df, {n: pick(v, True).over(w) for n, v in values.items()}))
    raw = {f"__v{i}": v for i, v in enumerate(values.values())}
    carry = {v: f"__c{i}" for i, v in enumerate(raw)}
    df = series.df.withColumns(raw).withColumn(
        BLOCK, F.coalesce(F.floor(F.col(POS) / series.limit), F.lit(0)))
    best = F.max_by if forward else F.min_by
    keys = [*series.spec.keys, BLOCK]
    ends = df.filter(F.col(POS).isNotNull()).groupBy(*keys).agg(
        *[best(v, F.when(F.col(v).isNotNull(), F.col(POS))).alias(v) for v in raw])
    beyond = Window.partitionBy(*([*series.spec.keys] or [F.lit(0)])).orderBy(BLOCK).rowsBetween(
        *((FIRST, BEFORE) if forward else (1, LAST)))
    ends = ends.select(
        *[F.col(k).alias(f"__e_{k}") for k in keys],
        *[pick(v, True).over(beyond).alias(c) for v, c in carry.items()])
    if forward:
        w = series.window(BLOCK).rowsBetween(start, end)
    else:
        df = df.withColumn("__place", F.row_number().over(series.window(BLOCK)))
        w = _backwards(series, BLOCK)
    local = df.withColumns({n: F.last(v, True).over(w) for n, v in zip(values, raw)}).drop("__place")
    joined = local.join(ends, [F.col(k).eqNullSafe(F.col(f"__e_{k}")) for k in keys], "left")
    joined = joined.withColumns({n: F.coalesce(F.col(n), F.col(carry[v])) for n, v in zip(values, raw)})
    return series.put(joined.drop(BLOCK, *raw, *carry.values(), *[f"__e_{k}" for k in keys]))


def _backwards(series: Series, *more: str) -> WindowSpec:
    """The rows from the last one down to the current one, by their place `__place`.

    A frame that runs from the row to the end of its partition is read anew for each row; this one grows.
    """
    parts = [*series.spec.keys, *more] or [F.lit(0)]
    return Window.partitionBy(*parts).orderBy(F.col("__place").desc()).rowsBetween(FIRST, HERE)


def with_position(df: DataFrame, spec: SeriesSpec, name: str) -> DataFrame:
    """Exact 0-based position within the series, as a new column."""
    return with_row_number(lay_out(df, spec), name).frame()


def joined_on(left: DataFrame, right: DataFrame, keys: list[str], how: str) -> DataFrame:
    """A join in which a missing key equals a missing key; the keys are those of the left side."""
    other = right.withColumnsRenamed({k: f"__r_{k}" for k in keys})
    same = [F.col(k).eqNullSafe(F.col(f"__r_{k}")) for k in keys]
    return left.join(other, same, how).drop(*[f"__r_{k}" for k in keys])


# half the width of a bracket and the accuracy of the sketch that places it, as shares of the rows
BRACKET, SKETCH = 0.0005, 10_000


def rows_at(df: DataFrame, spec: SeriesSpec, positions: list[int] | Callable[[int], list[int]]) -> list[Column]:
    """The sort key (a struct) at each position of the whole table; null past its end.

    The positions may be given as a function of the number of rows.

    A selection, not a sort. The sort columns are staged; a quantile sketch of the leading one brackets each
    position, one pass counts the rows before and within each bracket, and only the rows within are put in
    order. A bracket that misses its position becomes the whole table. The keys never leave the engine, so
    neither the driver's time zone nor a type of its own can change them.
    """
    narrow = session.staged(df.select(*spec.sort), "keys")
    lead = F.col(spec.order)
    size = narrow.agg(F.count(F.lit(1)).alias("n"), F.count(lead).alias("known")).first()
    positions = positions(size.n) if callable(positions) else positions
    missing = size.n - size.known
    everything = (F.lit(0).cast("long"), F.lit(True))
    brackets = [everything] * len(positions)
    if size.known and not isinstance(narrow.schema[spec.order].dataType, T.StringType):
        shares = [min(1.0, max(0.0, (p - missing) / size.known + step)) for p in positions for step in (-BRACKET, BRACKET)]
        sketch = session.staged(narrow.agg(
            F.percentile_approx(lead, F.array(*[F.lit(s) for s in shares]), F.lit(SKETCH)).alias("q")), "sketch")
        ends = [sketch.select(F.col("q")[k]).scalar() for k in range(len(shares))]
        for i, p in enumerate(positions):
            low, high = ends[2 * i], ends[2 * i + 1]
            brackets[i] = (F.lit(0).cast("long"), lead.isNull()) if p < missing else (
                F.lit(missing) + F.count_if(lead < low), F.coalesce((lead >= low) & (lead <= high), F.lit(False)))
        counts = narrow.agg(*[F.struct(F.lit(0) + below if p < missing else below, F.count_if(within)).alias(f"c{i}")
                              for i, (p, (below, within)) in enumerate(zip(positions, brackets))]).first()
        below = [counts[f"c{i}"][0] for i in range(len(positions))]
        for i, p in enumerate(positions):
            if not below[i] <= p < below[i] + counts[f"c{i}"][1]:
                below[i], brackets[i] = 0, everything
    else:
        below = [0] * len(positions)
    wanted = [i for i, p in enumerate(positions) if p < size.n]
    hit = F.array_compact(F.array(*[F.when(brackets[i][1], F.lit(i)) for i in wanted], F.lit(None).cast("int")))
    hits = narrow.select(*spec.sort, F.explode(hit).alias("__bracket"))
    placed = with_position(hits, replace(spec, keys=("__bracket",)), "__at")
    found = [F.max(F.when((F.col("__bracket") == i) & (F.col("__at") == p - below[i]), F.struct(*spec.sort))).alias(f"b{i}")
             for i, p in enumerate(positions)]
    row = session.staged(placed.agg(*found), "bounds")
    return [row.select(f"b{i}").scalar() for i in range(len(positions))]


def before(spec: SeriesSpec, bound: Column) -> Column:
    """Does the row sort before this key? Missing values sort first; every row is before a missing key."""
    return F.coalesce(F.struct(*spec.sort) < bound, F.lit(True))


def running_sums(df: DataFrame, by: str, sums: dict[str, str]) -> DataFrame:
    """Exclusive running sums in order of a unique column `by`."""
    limit = session.max_rows_per_task(df.sparkSession)
    series = lay_out(df, SeriesSpec(keys=(), order=by, tiebreak=()))
    if not series.blocked:
        w = Window.partitionBy(F.lit(0)).orderBy(by).rowsBetween(FIRST, BEFORE)
        return df.withColumns({n: F.coalesce(F.sum(c).over(w), F.lit(0)) for n, c in sums.items()})
    cut = series.df.withColumn(BLOCK, F.floor(F.col(POS) / limit))
    across = Window.partitionBy(F.lit(0)).orderBy("__b").rowsBetween(FIRST, BEFORE)
    totals = cut.groupBy(F.col(BLOCK).alias("__b")).agg(*[F.sum(c).alias(f"__t_{n}") for n, c in sums.items()])
    totals = totals.select("__b", *[
        F.coalesce(F.sum(f"__t_{n}").over(across), F.lit(0)).alias(f"__o_{n}") for n in sums])
    w = Window.partitionBy(BLOCK).orderBy(by).rowsBetween(FIRST, BEFORE)
    local = cut.withColumns({n: F.coalesce(F.sum(c).over(w), F.lit(0)) for n, c in sums.items()})
    joined = local.join(totals, F.col(BLOCK) == F.col("__b"))
    return joined.select(*df.columns, *[(F.col(n) + F.col(f"__o_{n}")).alias(n) for n in sums])
