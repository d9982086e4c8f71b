"""Isolation forest: trees grown in parallel tasks, rows scored in Arrow batches."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plantpulse.operators.quantiles import quantile_values
from plantpulse.schema import flag
from plantpulse.session import staged

NODE = "tree int, node int, feature int, threshold double, left int, right int, depth double"
EULER = 0.5772156649015329


@dataclass(frozen=True)
class IsolationForest:
    """At most trees x 2*sample nodes, whatever the size of the training table."""

    columns: list[str]
    center: list[float]
    scale: list[float]
    nodes: pd.DataFrame
    sample: int
    offset: float = 0.0


def average_path(n):
    """Mean depth of an unsuccessful search among n rows."""
    n = np.asarray(n, dtype=float)
    harmonic = np.log(np.maximum(n - 1, 1)) + EULER
    return np.where(n > 2, 2 * harmonic - 2 * (n - 1) / np.maximum(n, 1), np.where(n == 2, 1.0, 0.0))


def grow(tree: int, x: np.ndarray, seed: int) -> list[tuple]:
    """Random splits between the extremes of a random column, to the usual depth limit."""
    rng = np.random.default_rng([seed, tree])
    limit = math.ceil(math.log2(max(len(x), 2)))
    nodes, todo = [], [(0, np.arange(len(x)), 0)]
    next_id = 1
    while todo:
        node, rows, depth = todo.pop()
        low, high = x[rows].min(axis=0), x[rows].max(axis=0)
        usable = np.flatnonzero(high > low)
        if depth >= limit or len(rows) <= 1 or not len(usable):
            nodes.append((tree, node, -1, 0.0, -1, -1, depth + float(average_path(len(rows)))))
            continue
        feature = int(rng.choice(usable))
        cut = float(rng.uniform(low[feature], high[feature]))
        side = x[rows, feature] <= cut
        nodes.append((tree, node, feature, cut, next_id, next_id + 1, 0.0))
        todo += [(next_id, rows[side], depth + 1), (next_id + 1, rows[~side], depth + 1)]
        next_id += 2
    return nodes


def _scaled(forest_columns, center, scale):
    return [((F.coalesce(F.col(c).cast("double"), F.lit(0.0)) - m) / s).alias(f"__x{i}")
            for i, (c, m, s) in enumerate(zip(forest_columns, center, scale))]


def draw_plan(rows: int, trees: int, size: int) -> tuple[int, int]:
    """Draws for each row, and the largest 64-bit hash that wins one.

    Four times the rows that the trees need are drawn on average, and some more where these are few,
    so that no tree stays below its size.
    """
    wanted = trees * (4 * size + 60)
    draws = max(1, math.ceil(wanted / max(rows, 1)))
    share = min(1.0, wanted / max(rows * draws, 1))
    return draws, min(int(share * 2.0 ** 64) - (1 << 63), (1 << 63) - 1)


def isolation_forest_fit(
    df: DataFrame, columns: list[str], key: str, contamination: float = 0.1, trees: int = 100,
    sample: int = 256, seed: int = 42,
) -> IsolationForest:
    """Draw `sample` rows per tree by hash, grow one tree per group, set the offset exactly."""
    filled = {c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in columns}
    row = df.agg(F.count(F.lit(1)).alias("n"), *[F.avg(e).alias(f"m_{c}") for c, e in filled.items()],
                 *[F.stddev_pop(e).alias(f"s_{c}") for c, e in filled.items()]).first()
    center, scale = [row[f"m_{c}"] for c in columns], [row[f"s_{c}"] or 1.0 for c in columns]
    size = min(sample, max(row.n, 1))
    draws, bound = draw_plan(row.n, trees, size)
    names = [f"__x{i}" for i in range(len(columns))]
    dice = df.select(F.col(key).alias("__key"), *_scaled(columns, center, scale)).select(
        "*", F.explode(F.sequence(F.lit(1), F.lit(draws))).alias("__draw"))
    roll = F.xxhash64("__key", "__draw", F.lit(seed))
    dice = dice.withColumn("__roll", roll).filter(F.col("__roll") <= F.lit(bound))
    dice = dice.withColumns({
        "tree": F.pmod(F.xxhash64("__roll", F.lit(1)), F.lit(trees)).cast("int"),
        "__order": F.xxhash64("__roll", "__key")})
    # the row limit per tree is applied before the shuffle as well as after it
    pick = Window.partitionBy("tree").orderBy("__order")
    drawn = dice.withColumn("__rn", F.row_number().over(pick)).filter(F.col("__rn") <= size)

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        if len(pdf) < size:
            raise ValueError(f"a tree has {len(pdf)} of {size} rows")
        # a fixed row order makes the tree repeatable whatever order the shuffle gave
        pdf = pdf.sort_values("__order")
        rows = grow(int(pdf["tree"].iloc[0]), pdf[names].to_numpy(), seed)
        return pd.DataFrame(rows, columns=["tree", "node", "feature", "threshold", "left", "right", "depth"])

    # at most trees * sample rows are left; a fixed number of tasks keeps the trees apart
    drawn = drawn.select("tree", "__order", *names).repartition(trees, "tree")
    nodes = drawn.groupBy("tree").applyInPandas(build, NODE).toPandas()
    if row.n and nodes["tree"].nunique() < trees:
        raise ValueError(f"{nodes['tree'].nunique()} of {trees} trees have rows")
    forest = IsolationForest(columns, center, scale, nodes, size)
    # every quantile pass reads the scores, so the rows are scored once
    scored = staged(isolation_forest_score(df.select(*columns), forest).select("if_score"), "scores")
    offset = quantile_values(scored, ["if_score"], [contamination])["if_score"][0]
    return IsolationForest(columns, center, scale, nodes, size, offset or 0.0)


def _flat(nodes: pd.DataFrame) -> tuple:
    """All trees as one set of arrays; a leaf leads to itself, so every walk has equal length."""
    t = nodes.sort_values(["tree", "node"]).reset_index(drop=True)
    first = t.groupby("tree")["node"].transform("size").groupby(t["tree"]).first().cumsum().shift(fill_value=0)
    base, own = t["tree"].map(first).to_numpy(), t.index.to_numpy()
    leaf = t["feature"].to_numpy() < 0
    left = np.where(leaf, own, base + t["left"].to_numpy())
    right = np.where(leaf, own, base + t["right"].to_numpy())
    level = np.zeros(len(t), dtype=int)
    for i in np.flatnonzero(~leaf):  # parents come before children
        level[left[i]] = level[right[i]] = level[i] + 1
    return (first.to_numpy(), np.where(leaf, 0, t["feature"].to_numpy()), t["threshold"].to_numpy(),
            left, right, t["depth"].to_numpy(), int(level.max()))


def isolation_forest_score(df: DataFrame, forest: IsolationForest) -> DataFrame:
    """`if_score` = decision value (high = normal), `if_anomaly` = decision below zero."""
    shared = df.sparkSession.sparkContext.broadcast(_flat(forest.nodes))
    norm, offset = float(average_path(forest.sample)) or 1.0, forest.offset

    @F.pandas_udf("double")
    def decide(x: pd.DataFrame) -> pd.Series:
        roots, feature, cut, left, right, depth, steps = shared.value
        data = x.to_numpy()
        out = np.empty(len(data))
        for at in range(0, len(data), 1024):  # rows x trees stay in cache
            part = data[at:at + 1024]
            rows = np.arange(len(part))[:, None]
            node = np.broadcast_to(roots, (len(part), len(roots)))
            for _ in range(steps):
                node = np.where(part[rows, feature[node]] <= cut[node], left[node], right[node])
            out[at:at + 1024] = depth[node].mean(axis=1)
        return pd.Series(-np.power(2.0, -out / norm) - offset)

    inputs = F.struct(*_scaled(forest.columns, forest.center, forest.scale))
    out = df.withColumn("if_score", decide(inputs))
    return out.withColumn("if_anomaly", flag(F.col("if_score") < 0))
