"""Near-duplicate vectors by a forest of random-projection trees with spill."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plantpulse.llm.components import components
from plantpulse.session import staged

COSINE = 0.95
TREES = 10
LEAF_ROWS = 4096
# share of a node's vectors, on either side of the median, that go to both children
SPILL = 0.05
MAX_DEPTH = 24
SEED = 11
ROWS_AT_ONCE = 512


def valid(vector: Column) -> Column:
    """Not null, not empty, no null or non-finite component, not all zero."""
    number = vector.cast("array<double>")
    finite = F.forall(number, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) != float("inf")), F.lit(False)))
    return F.coalesce(finite & F.exists(number, lambda x: x != 0), F.lit(False))


def project(points: DataFrame, trees: int, seed: int) -> DataFrame:
    """One row for each tree and vector: its projections on the directions of the tree's levels."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        directions: dict[int, np.ndarray] = {}
        for batch in batches:
            dims = batch.column(1).to_numpy(zero_copy_only=False)
            for dim in np.unique(dims):
                if dim not in directions:
                    directions[dim] = np.random.default_rng([seed, int(dim)]).standard_normal((dim, trees * MAX_DEPTH))
                part = batch.filter(pa.array(dims == dim))
                shadow = _unit(part.column(2), int(dim)) @ directions[dim]
                for tree in range(trees):
                    own = np.ascontiguousarray(shadow[:, tree * MAX_DEPTH:(tree + 1) * MAX_DEPTH], np.float32)
                    places = pa.array(np.arange(len(own) + 1, dtype=np.int32) * MAX_DEPTH)
                    yield pa.RecordBatch.from_arrays(
                        [part.column(1), pa.array(np.full(len(own), tree, np.int32)),
                         pa.array(np.ones(len(own), np.int64)), part.column(0),
                         pa.ListArray.from_arrays(places, pa.array(own.ravel()))],
                        names=["dim", "tree", "node", "id", "shadow"])

    kind = points.schema["id"].dataType.simpleString()
    return points.select("id", "dim", "vector").mapInArrow(
        run, f"dim int, tree int, node long, id {kind}, shadow array<float>")


def _unit(vectors: pa.Array, dim: int) -> np.ndarray:
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    x = flat.reshape(-1, dim)
    x = x / np.abs(x).max(axis=1, keepdims=True)  # no square under- or overflows
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def grow(state: DataFrame, leaf_rows: int, spill: float, reach: float = 0.0) -> tuple[DataFrame, DataFrame]:
    """Split nodes until they fit a leaf: (dim, leaf, id) and (dim, leaf, n).

    All nodes of a level are split together. The cut of a node lies at the median of its own vectors'
    projections on the level's direction; the quantiles come from mergeable sketches, and those
    within the share `spill` or half the distance `reach` of the median go both ways. A node is split
    only where a quarter of it lies strictly beyond either spill border, so every child is smaller than
    its parent; a node whose own spread is of the order of `reach` stays whole, whatever its size.
    """
    keys, leaves, sizes = ["dim", "tree", "node"], [], []
    leaf = (F.col("tree").cast("long") * (1 << 40) + F.col("node")).alias("leaf")
    for level in range(MAX_DEPTH + 1):
        shares = F.array(*[F.lit(x) for x in (0.25, 0.5 - spill, 0.5, 0.5 + spill, 0.75)])
        at = F.col("shadow")[min(level, MAX_DEPTH - 1)]
        cuts = state.groupBy(*keys).agg(
            F.count(F.lit(1)).alias("n"), F.percentile_approx(at, shares, F.lit(2000)).alias("q"))
        q = F.col("q")
        cuts = cuts.select(*keys, "n", q[0].alias("first"), F.least(q[1], q[2] - reach / 2).alias("low"),
                           F.greatest(q[3], q[2] + reach / 2).alias("high"), q[4].alias("last"))
        divide = (F.col("n") > leaf_rows) & (F.col("first") < F.col("low")) & (F.col("high") < F.col("last"))
        cuts = staged(cuts.withColumn("divide", divide & F.lit(level < MAX_DEPTH)), "cuts")
        sizes.append(cuts.filter("not divide").select("dim", leaf, "n"))
        if not cuts.filter("divide").limit(1).count():
            leaves.append(state.select("dim", leaf, "id"))
            break
        joined = state.join(cuts, keys)
        leaves.append(joined.filter("not divide").select("dim", leaf, "id"))
        left = F.when(at <= F.col("high"), F.col("node") * 2)
        right = F.when(at >= F.col("low"), F.col("node") * 2 + 1)
        children = F.explode(F.array_compact(F.array(left, right)))
        state = staged(joined.filter("divide").select("dim", "tree", children.alias("node"), "id", "shadow"), "nodes")
    whole, counted = leaves[0], sizes[0]
    for part, size in zip(leaves[1:], sizes[1:]):
        whole, counted = whole.unionByName(part), counted.unionByName(size)
    return whole, counted


def _compare(table: pa.Table, threshold: float) -> pa.Table:
    """Links within one cell: for each linked vector its links owned here and the least id it is joined with.

    A pair may share several leaves. It counts in the least leaf that both are in. Pairs that share the
    earlier leaf with most members of this cell are compared and united there, and not again here.
    """
    leaf, bi, bj = (table.column(n)[0].as_py() for n in ("leaf", "bi", "bj"))
    ids = table.column("id").to_numpy()
    order = np.argsort(ids, kind="stable")
    table, ids = table.take(pa.array(order)), ids[order]
    x = _unit(table.column("vector").combine_chunks(), table.column("dim")[0].as_py())
    block, copies = table.column("block").to_numpy(), table.column("copies").to_numpy()
    member = table.column("leaves").combine_chunks()
    owner = np.repeat(np.arange(len(ids)), np.diff(member.offsets.to_numpy()))
    values = member.flatten().to_numpy()
    before = values < leaf
    names, place = np.unique(values[before], return_inverse=True)
    earlier = np.zeros((len(ids), len(names)), np.float32)
    earlier[owner[before], place] = 1

    done = earlier[:, earlier.sum(axis=0).argmax()] > 0 if len(names) else np.zeros(len(ids), bool)

    links, label, linked = np.zeros(len(ids), np.int64), np.arange(len(ids)), np.zeros(len(ids), bool)
    left, right = np.flatnonzero(block == bi), np.flatnonzero(block == bj)
    sides = [(left[~done[left]], right)]
    if bi != bj:
        sides.append((left[done[left]], right[~done[right]]))
    for side, others in sides:
        shadow = x[others].T
        for a in range(0, len(side), ROWS_AT_ONCE):
            rows = side[a:a + ROWS_AT_ONCE]
            hits = x[rows] @ shadow >= threshold
            if bi == bj:
                hits &= (rows[:, None] < others) | done[others]
            r, c = np.flatnonzero(hits.any(axis=1)), np.flatnonzero(hits.any(axis=0))
            if not len(r):
                continue
            hits, r, c = hits[np.ix_(r, c)], rows[r], others[c]
            own = hits & (earlier[r] @ earlier[c].T == 0)
            links[r] += own @ copies[c]
            links[c] += copies[r] @ own
            linked[r] = linked[c] = True
            for i, near in zip(r, hits):
                groups = np.unique(np.append(label[c[near]], label[i]))
                if len(groups) > 1:
                    label[np.isin(label, groups[1:])] = groups[0]
    at = np.flatnonzero(linked)
    return pa.table({"id": pa.array(ids[at]), "links": pa.array(links[at]), "root": pa.array(ids[label[at]])})


def near_duplicates(vectors: DataFrame, threshold: float = COSINE, trees: int = TREES, leaf_rows: int = LEAF_ROWS,
                    spill: float = SPILL, seed: int = SEED) -> DataFrame:
    """vec_id, n_links, component_id and kept of every vector in (vec_id, embedding).

    Vectors that share a leaf of any tree are compared, in double precision; a link is a cosine of at
    least `threshold`, so there is no false one, and a pair is missed only where every tree has parted
    it. Equal vectors are one point with a number of copies. A leaf above the limit, of vectors that lie
    about as near each other as a link, is compared block against block in tasks of bounded size.

    Vectors that are null, empty, zero, or hold null or non-finite components have no links; vectors of
    different length are not compared. Rows that repeat vec_id and embedding are one vector and give one
    row; a missing vec_id gives n_links 0, no component and kept true. Other columns, clashing names
    included, are not read. An empty table gives no rows.
    """
    rows = vectors.select("vec_id", F.col("embedding").alias("vector")).distinct()
    usable = rows.filter(valid(F.col("vector")) & F.col("vec_id").isNotNull())
    points = staged(usable.groupBy("vector").agg(F.min("vec_id").alias("id"), F.count(F.lit(1)).alias("copies"))
                    .withColumn("dim", F.size("vector")), "points")
    reach = (2 - 2 * threshold) ** 0.5  # of unit vectors whose cosine is the threshold
    leaves, sizes = grow(staged(project(points, trees, seed), "nodes"), leaf_rows, spill, reach)
    listed = staged(leaves.groupBy("id", "dim").agg(F.sort_array(F.collect_list("leaf")).alias("leaves")), "leaves")
    spread = points.join(listed, ["id", "dim"]).select(
        "id", "dim", "vector", "copies", "leaves", F.explode("leaves").alias("leaf"))
    large = staged(sizes.filter(F.col("n") > 2 * leaf_rows).withColumn(
        "blocks", F.ceil(F.col("n") / leaf_rows).cast("int")).drop("n"), "large")
    one = F.lit(1)
    spread = spread.join(large, ["dim", "leaf"], "left").withColumn("blocks", F.coalesce("blocks", one)) \
        if large.limit(1).count() else spread.withColumn("blocks", one)
    spread = spread.withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    cells = spread.withColumn("other", other).select(
        "dim", "leaf", F.least("block", "other").alias("bi"), F.greatest("block", "other").alias("bj"), "block", "id",
        "copies", "vector", "leaves")
    kind = points.schema["id"].dataType.simpleString()
    found = staged(cells.groupBy("dim", "leaf", "bi", "bj").applyInArrow(
        lambda table: _compare(table, threshold), f"id {kind}, links long, root {kind}"), "links")
    counts = found.groupBy("id").agg(F.sum("links").alias("links"))
    joined = components(found.select(F.col("id").alias("a"), F.col("root").alias("b")))
    known = points.select("id", "copies", "vector").join(counts, "id", "left").join(joined, "id", "left")
    known = known.select("vector", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("__links"),
                         F.coalesce("component", "id").alias("__component"))
    whole = rows.join(known, "vector", "left")
    return whole.select(
        "vec_id", F.when(F.col("vec_id").isNull(), 0).otherwise(F.coalesce("__links", F.lit(0))).cast("long").alias("n_links"),
        F.when(F.col("vec_id").isNotNull(), F.coalesce("__component", "vec_id")).alias("component_id"),
        F.coalesce(F.col("vec_id") == F.coalesce("__component", "vec_id"), F.lit(True)).alias("kept"))
