"""Exact nearest vectors by inner product, excluded coarse to fine by statistics of segments.

A vector is cut into segments; of each it keeps the mean and the deviation. Of two vectors the squared
distance is at least the sum over segments of length * ((difference of means)^2 + (difference of
deviations)^2). As distance^2 = |q|^2 + |x|^2 - 2 q.x, that lower bound is an upper bound of the inner product,
the sum over segments of length * (product of means + product of deviations).
"""

from __future__ import annotations

from collections.abc import Iterator
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plantpulse.session import staged

SCALE = 64
TOP = 20
EVERY = 20
# segments of each resolution, coarse to fine; the first also bounds whole blocks
SEGMENTS = (4, 16)
BLOCK_ROWS = 16_384
QUERY_ROWS = 16_384
ROWS_AT_ONCE = 128
PAIRS_AT_ONCE = 1 << 16


def usable(vector: Column) -> Column:
    """Not null and without null or non-finite components."""
    number = vector.cast("array<double>")
    finite = F.forall(number, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) != float("inf")), F.lit(False)))
    return F.coalesce(finite, F.lit(False))


def whole_numbers(vectors: pa.Array, dim: int, scale: int) -> np.ndarray:
    """floor(scale * x), held within a range in which no inner product overflows a long."""
    top = min((1 << 31) - 1, isqrt(((1 << 63) - 1) // max(dim, 1)))
    x = vectors.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(len(vectors), dim)
    return np.clip(np.floor(x * scale), -top, top).astype(np.int64)


def segments(x: np.ndarray, count: int) -> np.ndarray:
    """Means and deviations of the segments, each times the root of the length: one row of 2 * count."""
    out = np.zeros((len(x), 2 * count))
    for k, part in enumerate(np.array_split(np.arange(x.shape[1]), count)):
        if len(part):
            own = x[:, part].astype(np.float64)
            root = len(part) ** 0.5
            out[:, k], out[:, count + k] = root * own.mean(axis=1), root * own.std(axis=1)
    return out


def products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """All inner products, exact: in doubles where they are whole numbers below 2^53, else in longs."""
    most = int(np.abs(q).max(initial=0)) * int(np.abs(x).max(initial=0)) * q.shape[1]
    if most < 1 << 53:
        return (q.astype(np.float64) @ x.astype(np.float64).T).astype(np.int64)
    return q @ x.T


def search(q: np.ndarray, x: np.ndarray, least: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, ...]:
    """(query row, candidate row, score) of every pair whose score is at least the query's `least`.

    own: the candidate row that is the query itself, or -1. The segment bounds exclude pairs, coarse to fine;
    the products of those left are computed pair by pair or, where most are left, as one matrix.
    """
    stats = [(segments(q, s), segments(x, s)) for s in SEGMENTS]
    reach = np.sqrt((q.astype(float) ** 2).sum(axis=1))[:, None], np.sqrt((x.astype(float) ** 2).sum(axis=1).max(initial=0))
    found = []
    for a in range(0, len(q), ROWS_AT_ONCE):
        rows = slice(a, a + ROWS_AT_ONCE)
        # what rounding can take from a bound
        floor = least[rows, None] - 0.5 - 1e-9 * reach[0][rows] * reach[1]
        alive = np.ones((len(floor), len(x)), bool)
        alive[np.flatnonzero(own[rows] >= 0), own[rows][own[rows] >= 0]] = False
        for mine, theirs in stats:
            if alive.mean() < 0.1:
                break
            alive &= mine[rows] @ theirs.T >= floor
        if alive.mean() < 0.1:
            r, c = np.nonzero(alive)
            score = np.empty(len(r), np.int64)
            for b in range(0, len(r), PAIRS_AT_ONCE):
                some = slice(b, b + PAIRS_AT_ONCE)
                score[some] = np.einsum("ij,ij->i", q[rows][r[some]], x[c[some]])
            keep = score >= least[rows][r]
            r, c, score = r[keep], c[keep], score[keep]
        else:
            dense = products(q[rows], x)
            r, c = np.nonzero(alive & (dense >= least[rows, None]))
            score = dense[r, c]
        found.append((r + a, c, score))
    return tuple(np.concatenate(part) for part in zip(*found)) if found else (np.zeros(0, np.int64),) * 3


def best(row: np.ndarray, ids: np.ndarray, score: np.ndarray, top: int) -> np.ndarray:
    """Places of each query's `top` best, in order of query, score from high to low, id from low to high."""
    order = np.lexsort((ids, -score, row))
    row = row[order]
    starts = np.flatnonzero(np.append(True, row[1:] != row[:-1])) if len(row) else np.zeros(0, np.int64)
    rank = np.arange(len(row)) - np.repeat(starts, np.diff(np.append(starts, len(row))))
    return order[rank < top]


def _numbers(column: pa.ChunkedArray | pa.Array, dim: int) -> np.ndarray:
    flat = np.frombuffer(b"".join(column.to_pylist()), dtype=np.int32)
    return flat.reshape(-1, dim).astype(np.int64) if dim else np.zeros((len(column), 0), np.int64)


def _ids(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Ids for ordering; a missing one comes last."""
    return column.fill_null(np.iinfo(np.int64).max).to_numpy()


def _digits(batches: Iterator[pa.RecordBatch], scale: int) -> Iterator[pa.RecordBatch]:
    """(uid, id, dim, place, numbers): place orders vectors by the signs of their finest means, then by length."""
    for batch in batches:
        dims = batch.column(2).to_numpy()
        for dim in np.unique(dims):
            part = batch.filter(pa.array(dims == dim))
            x = whole_numbers(part.column(3), int(dim), scale)
            means = segments(x, SEGMENTS[-1])[:, :SEGMENTS[-1]]
            place = (means >= 0) @ (1.0 * (1 << np.arange(SEGMENTS[-1])))
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(1), part.column(2), pa.array(place),
                 pa.array([v.tobytes() for v in x.astype(np.int32)], pa.binary())],
                names=["uid", "id", "dim", "place", "numbers"])


POINT = ("uid long, id long, dim int, block int, numbers binary, least long, near array<struct<id: long, score: long>>, "
         "hull array<double>, query_hull array<double>")


def _hull(x: np.ndarray, least: np.ndarray | None = None) -> list[float]:
    """Least and greatest means, greatest deviations of the coarse segments, and the least of `least`."""
    s, stats = SEGMENTS[0], segments(x, SEGMENTS[0])
    ends = [*stats[:, :s].min(axis=0), *stats[:, :s].max(axis=0), *stats[:, s:].max(axis=0),
            float(np.sqrt((x.astype(float) ** 2).sum(axis=1)).max())]
    return [*ends, float(least.min())] if least is not None else ends


def _seeds(batches: Iterator[pa.RecordBatch], every: int, top: int) -> Iterator[pa.RecordBatch]:
    """One block: every query's best rows in its own block, and so a score that its answer reaches at least."""
    table = pa.Table.from_batches(list(batches))
    for dim in np.unique(table.column("dim").to_numpy()) if len(table) else []:
        part = table.filter(pa.array(table.column("dim").to_numpy() == dim)).combine_chunks()
        n, x, ids = len(part), _numbers(part.column("numbers"), int(dim)), _ids(part.column("id"))
        valid = part.column("id").is_valid().to_numpy()
        asks = np.flatnonzero(valid & (ids % every == 0))
        low = np.iinfo(np.int64).min
        least, near, hulls = np.full(n, low), [None] * n, [None] * n
        for a in range(0, len(asks), ROWS_AT_ONCE):
            some = asks[a:a + ROWS_AT_ONCE]
            score = products(x[some], x)
            score[np.arange(len(some)), some] = low
            if n > top:
                cut = np.partition(score, n - top, axis=1)[:, n - top]
            else:
                cut = np.full(len(some), low + 1)
            r, c = np.nonzero((score >= cut[:, None]) & (score > low))
            places = best(r, ids[c], score[r, c], top)
            for k, row in enumerate(some):
                near[row] = []
            for k in places:
                near[some[r[k]]].append({"id": int(ids[c[k]]) if valid[c[k]] else None, "score": int(score[r[k], c[k]])})
            for k, row in enumerate(some):
                if len(near[row]) == top:
                    least[row] = near[row][-1]["score"]
        hulls[0] = _hull(x)
        query_hulls = [_hull(x[asks], least[asks].astype(float)) if len(asks) else None] + [None] * (n - 1)
        is_query = np.zeros(n, bool)
        is_query[asks] = True
        kinds = pa.list_(pa.struct([("id", pa.int64()), ("score", pa.int64())]))
        # slices keep the batches small
        out = pa.table({
            "uid": part.column("uid"), "id": part.column("id"), "dim": part.column("dim"), "block": part.column("block"),
            "numbers": part.column("numbers"), "least": pa.array(least, mask=~is_query), "near": pa.array(near, kinds),
            "hull": pa.array(hulls, pa.list_(pa.float64())),
            "query_hull": pa.array(query_hulls, pa.list_(pa.float64()))})
        yield from out.to_batches(max_chunksize=4096)


def _pairs(points: DataFrame, groups: int, blocks: int) -> DataFrame:
    """(dim, part, block) that can hold an answer, by the hulls; a part is a run of blocks whose queries go together."""
    s = SEGMENTS[0]
    part = F.floor(F.col("block") * groups / blocks).cast("int").alias("part")
    q, x = F.col("query_hull"), F.col("hull")
    asks = points.filter(q.isNotNull()).groupBy("dim", part).agg(
        *[F.min(q[k]).alias(f"low{k}") for k in range(s)], *[F.max(q[s + k]).alias(f"high{k}") for k in range(s)],
        *[F.max(q[2 * s + k]).alias(f"dev{k}") for k in range(s)], F.max(q[3 * s]).alias("norm"),
        F.min(q[3 * s + 1]).alias("least"))
    asks = asks.withColumn("part", F.col("part"))
    held = points.filter(x.isNotNull()).select("dim", "block", "hull").withColumn(
        "part", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    bound = sum((F.greatest(*[F.col(f"{e}{k}") * x[o + k] for e in ("low", "high") for o in (0, s)])
                 + F.col(f"dev{k}") * x[2 * s + k] for k in range(s)), F.lit(0.5))
    reached = bound + 1e-9 * F.col("norm") * x[3 * s] >= F.col("least")
    return held.join(asks, ["dim", "part"]).filter(reached).select("dim", "part", "block")


def _compare(table: pa.Table, blocks: int, groups: int, top: int) -> pa.Table:
    """One part of the queries against one block: their best rows there, their own block left out."""
    dim, block = table.column("dim")[0].as_py(), table.column("at")[0].as_py()
    asks = table.column("asks").to_numpy()
    mine, theirs = table.filter(pa.array(asks)), table.filter(pa.array(~asks))
    away = mine.column("block").to_numpy() != block
    mine = mine.filter(pa.array(away))
    q, x = _numbers(mine.column("numbers"), dim), _numbers(theirs.column("numbers"), dim)
    ids, valid = _ids(theirs.column("id")), theirs.column("id").combine_chunks().is_valid().to_numpy(zero_copy_only=False)
    r, c, score = search(q, x, mine.column("least").to_numpy(), np.full(len(q), -1))
    keep = best(r, ids[c], score, top)
    return pa.table({"query": mine.column("uid").take(pa.array(r[keep])),
                     "query_id": mine.column("id").take(pa.array(r[keep])),
                     "id": pa.array(ids[c[keep]], mask=~valid[c[keep]]), "score": pa.array(score[keep])})


def nearest(vectors: DataFrame, top: int = TOP, every: int = EVERY, scale: int = SCALE,
            block_rows: int = BLOCK_ROWS, query_rows: int = QUERY_ROWS) -> DataFrame:
    """query_id, rank, vec_id, score: the `top` largest inner products of each query among all other rows.

    Components count as floor(scale * x). Queries are the rows whose vec_id is divisible by `every`. Vectors are dealt
    to blocks of about `block_rows`, near ones together. A query's best scores in its own block bound its answer from
    below; blocks, then rows, whose segment bound stays under that are left out, and the rest is
    computed exactly. Queries meet a block in parts, each of a run of blocks; a task holds one block and one part,
    about `query_rows` queries and never more than `every` times as many rows.

    Every row but the query's own is a candidate, so repeated rows are candidates of each other and
    repeated queries each give their rows. A row without vec_id is a candidate, last among ties. Vectors that are
    null or hold null or non-finite components take no part; vectors of different length are not compared, and empty
    ones score 0 with each other. Components are held within +-isqrt(2^63 / length). Other columns are not read.
    An empty table gives no rows.
    """
    rows = vectors.select(F.monotonically_increasing_id().alias("uid"), F.col("vec_id").cast("long").alias("id"),
                          F.size("embedding").alias("dim"), F.col("embedding").cast("array<double>").alias("vector"))
    number = vectors.count()
    blocks = max(1, -(-number // block_rows))
    digits = rows.filter(usable(F.col("vector"))).mapInArrow(
        lambda batches: _digits(batches, scale), "uid long, id long, dim int, place double, numbers binary")
    dealt = digits.repartitionByRange(blocks, "dim", "place", "uid").select(
        "uid", "id", "dim", F.spark_partition_id().alias("block"), "numbers")
    points = staged(dealt.mapInArrow(lambda batches: _seeds(batches, every, top), POINT), "points")
    asked = points.filter(F.col("least").isNotNull())
    blocks = (points.agg(F.max("block")).first()[0] or 0) + 1
    groups = max(1, -(-asked.count() // query_rows))
    pairs = staged(_pairs(points, groups, blocks), "pairs")
    part = F.floor(F.col("block") * groups / blocks).cast("int")
    sent = ["dim", "part", "at", "asks", "uid", "id", "block", "numbers", "least"]
    asks = asked.withColumn("part", part).join(pairs.withColumnRenamed("block", "at"), ["dim", "part"])
    held = points.join(pairs, ["dim", "block"])
    both = asks.withColumn("asks", F.lit(True)).select(*sent).unionByName(
        held.withColumn("at", F.col("block")).withColumn("asks", F.lit(False)).select(*sent))
    found = both.groupBy("dim", "part", "at").applyInArrow(
        lambda table: _compare(table, blocks, groups, top), "query long, query_id long, id long, score long")
    seeds = asked.select(F.col("uid").alias("query"), F.col("id").alias("query_id"), F.explode("near").alias("n")).select(
        "query", "query_id", "n.id", "n.score")
    order = Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("id"))
    ranked = seeds.unionByName(found).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("vec_id"), "score")


ORACLE = """
with v as (select row_number() over () as uid, vec_id, len(embedding) as dim,
                  list_transform(embedding, lambda x: floor(64 * x::double)) as x
           from embeddings
           where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select q.uid, q.vec_id as query_id, c.vec_id, list_inner_product(q.x, c.x)::bigint as score
      from v q join v c on q.dim = c.dim and q.uid <> c.uid where q.vec_id % 20 = 0),
r as (select *, row_number() over (partition by uid order by score desc, vec_id) as rank from s)
select query_id, rank::int as rank, vec_id, score from r where rank <= 20
"""
