"""Centroid clustering of whole-number vectors by popcounts of bit planes.

Of a vector of 64 whole numbers in two's complement, bit b of all components is one 64-bit word, its plane b. The
inner product of two vectors is the sum over pairs of planes of popcount(plane & plane) * weight * weight, where
plane b weighs 2^b and the last, of signs, -2^b. Squared distances follow, all in exact integers.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plantpulse.llm.common import key_text
from plantpulse.session import staged

DIM = 64
SCALE = 256
CENTROIDS = 40
ROUNDS = 5
SEED = 2
# components are held within +-LARGEST: 64 squared differences then fit a long
LARGEST = (1 << 27) - 1
ROWS_AT_ONCE = 2048


def usable(vector: Column) -> Column:
    """Exactly 64 components, none null or non-finite."""
    number = vector.cast("array<double>")
    finite = F.forall(number, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) != float("inf")), F.lit(False)))
    return F.coalesce((F.size(vector) == DIM) & finite, F.lit(False))


def planes_of(numbers: np.ndarray) -> np.ndarray:
    """(rows, planes) words of a (rows, 64) matrix of whole numbers; the last plane holds the signs."""
    most = max(int(numbers.max(initial=0)), -1 - int(numbers.min(initial=0)))
    bits = np.arange(most.bit_length() + 1)
    ones = ((numbers[:, None, :] >> bits[:, None]) & 1).astype(np.uint8)
    return np.packbits(ones, axis=2, bitorder="little").view("<u8")[:, :, 0]


def weights(count: int) -> np.ndarray:
    out = np.int64(1) << np.arange(count, dtype=np.int64)
    out[-1:] *= -1
    return out


def numbers_of(planes: np.ndarray) -> np.ndarray:
    """The (rows, 64) matrix back from its planes."""
    bits = np.unpackbits(np.ascontiguousarray(planes).view(np.uint8).reshape(*planes.shape, 8), axis=2, bitorder="little")
    return np.einsum("rpd,p->rd", bits.astype(np.int64), weights(planes.shape[1]))


def inner(planes: np.ndarray, centroid: np.ndarray) -> np.ndarray:
    """Inner products of the rows with one centroid, both as planes."""
    total = np.zeros(len(planes), np.int64)
    for own, w in zip(centroid, weights(len(centroid))):
        if own:
            total += w * (np.bitwise_count(planes & own).astype(np.int64) @ weights(planes.shape[1]))
    return total


def nearest(planes: np.ndarray, norm: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of the nearest centroid, the smaller among equals, and the squared distance."""
    cluster, least = np.zeros(len(planes), np.int32), np.full(len(planes), np.iinfo(np.int64).max)
    for k, own in enumerate(centroids):
        distance = norm - 2 * inner(planes, planes_of(own[None])[0]) + int(own @ own)
        nearer = distance < least
        cluster[nearer], least[nearer] = k, distance[nearer]
    return cluster, least


def _packed(batches: Iterator[pa.RecordBatch], scale: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a in range(0, batch.num_rows, ROWS_AT_ONCE):
            part = batch.slice(a, ROWS_AT_ONCE)
            x = part.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, DIM)
            whole = np.clip(np.floor(x * scale), -LARGEST, LARGEST).astype(np.int64)
            planes = planes_of(whole)
            norm = inner_self(planes)
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array(norm), pa.array([p.tobytes() for p in planes], pa.binary())],
                names=["vec_id", "norm", "planes"])


def inner_self(planes: np.ndarray) -> np.ndarray:
    """Inner product of each row with itself."""
    w, total = weights(planes.shape[1]), np.zeros(len(planes), np.int64)
    for b in range(planes.shape[1]):
        total += w[b] * (np.bitwise_count(planes & planes[:, b:b + 1]).astype(np.int64) @ w)
    return total


def _by_width(batch: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Rows of equal numbers of planes together, a bounded number at once."""
    wide = np.array([len(p.as_py()) for p in batch.column("planes")])
    for width in np.unique(wide):
        rows = np.flatnonzero(wide == width)
        for a in range(0, len(rows), ROWS_AT_ONCE):
            part = batch.take(pa.array(rows[a:a + ROWS_AT_ONCE]))
            yield part, np.frombuffer(b"".join(part.column("planes").to_pylist()), "<u8").reshape(len(part), -1)


def assign(points: DataFrame, centroids: np.ndarray) -> DataFrame:
    """(vec_id, cluster, distance) of every vector."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, planes in _by_width(batch):
                cluster, distance = nearest(planes, part.column("norm").to_numpy(), centroids)
                yield pa.RecordBatch.from_arrays([part.column("vec_id"), pa.array(cluster), pa.array(distance)],
                                                 names=["vec_id", "cluster", "distance"])

    kind = points.schema["vec_id"].dataType.simpleString()
    return points.mapInArrow(run, f"vec_id {kind}, cluster int, distance long")


def sums(points: DataFrame, centroids: np.ndarray) -> DataFrame:
    """(cluster, count, sums): at most one row for each cluster and task before the last addition."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, total = np.zeros(len(centroids), np.int64), np.zeros((len(centroids), DIM), np.int64)
        for batch in batches:
            for part, planes in _by_width(batch):
                cluster, _ = nearest(planes, part.column("norm").to_numpy(), centroids)
                count += np.bincount(cluster, minlength=len(count))
                np.add.at(total, cluster, numbers_of(planes))
        hit = np.flatnonzero(count)
        if len(hit):
            yield pa.RecordBatch.from_arrays(
                [pa.array(hit.astype(np.int32)), pa.array(count[hit]), pa.array(total[hit].tolist(), pa.list_(pa.int64()))],
                names=["cluster", "n", "total"])

    part = points.mapInArrow(run, "cluster int, n long, total array<bigint>")
    added = [F.sum(F.col("total")[d].cast("decimal(38,0)")).alias(f"d{d}") for d in range(DIM)]
    return part.groupBy("cluster").agg(F.sum("n").alias("n"), *added)


def seeds(points: DataFrame, count: int, seed: int) -> np.ndarray:
    """The `count` vectors whose sha256 of seed and id is smallest, in that order."""
    order = F.sha2(F.concat(F.lit(f"{seed}:"), key_text(F.col("vec_id"))), 256)
    first = points.select(order.alias("h"), "planes").orderBy("h", "planes").limit(count).collect()
    return np.array([numbers_of(np.frombuffer(bytes(r.planes), "<u8")[None])[0] for r in first]).reshape(-1, DIM)


def cluster(vectors: DataFrame, centroids: int = CENTROIDS, rounds: int = ROUNDS, scale: int = SCALE,
            seed: int = SEED) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia and centroid_sha256 of every kept vector.

    Kept are rows of exactly 64 components, none null or non-finite; a component counts as floor(scale * x), held
    within +-(2^27 - 1). Vectors are packed to bit planes once; each round reads the planes, assigns every
    vector to its nearest centroid and sends one row of sums for each cluster and task. Only the centroids, at
    most `centroids` rows, come to the driver, where sums are divided in whole numbers, floors down. An
    empty cluster keeps its centroid. With fewer vectors than centroids each vector is one.

    Repeated rows are vectors of their own; a missing vec_id hashes as 'null'; ids that repeat with other vectors
    are ordered by their planes among the first centroids. A sum of distances beyond a long is the largest long.
    Other columns are not read. An empty table gives no rows.
    """
    rows = vectors.filter(usable(F.col("embedding"))).select("vec_id", F.col("embedding").cast("array<double>"))
    points = staged(rows.mapInArrow(
        lambda batches: _packed(batches, scale),
        f"vec_id {rows.schema['vec_id'].dataType.simpleString()}, norm long, planes binary"), "planes")
    centers = seeds(points, centroids, seed)
    for _ in range(rounds if len(centers) else 0):
        for r in sums(points, centers).collect():
            centers[r.cluster] = [int(r[f"d{d}"]) // r.n for d in range(DIM)]
    assigned = staged(assign(points, centers), "assigned") if len(centers) else \
        points.limit(0).selectExpr("vec_id", "cast(0 as int) as cluster", "norm as distance")
    top = F.lit((1 << 63) - 1).cast("decimal(38,0)")
    spent = {r.cluster: int(r.s) for r in assigned.groupBy("cluster").agg(
        F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}
    most = (1 << 63) - 1
    told = [(k, min(s, most), min(sum(spent.values()), most),
             hashlib.sha256(",".join(map(str, centers[k].tolist())).encode()).hexdigest()) for k, s in sorted(spent.items())]
    told = vectors.sparkSession.createDataFrame(
        told, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    # at most one row a centroid
    return assigned.join(F.broadcast(told), "cluster").select(
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def oracle(centroids: int = CENTROIDS, rounds: int = ROUNDS, scale: int = SCALE, seed: int = SEED) -> str:
    """The same in SQL: one pair of tables a round."""
    parts = [f"""v as materialized (
  select row_number() over () as uid, vec_id, list_transform(embedding, lambda x: floor({scale} * x::double)::bigint) as x
  from embeddings
  where len(embedding) = {DIM} and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0)""",
             f"""c0 as materialized (
  select (row_number() over (order by sha256('{seed}:' || vec_id)) - 1)::int as k, x as m from v
  order by sha256('{seed}:' || vec_id) limit {centroids})"""]
    for r in range(rounds + 1):
        parts.append(f"""a{r} as materialized (
  select uid, min(struct_pack(d := d, k := k)) as best from (
    select v.uid, c.k, list_sum(list_transform(list_zip(v.x, c.m), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::bigint as d
    from v, c{r} c) group by uid)""")
        if r < rounds:
            parts.append(f"""s{r} as materialized (
  select a.best.k as k, i, sum(v.x[i])::bigint as s, count(*) as n
  from a{r} a join v using (uid), range(1, {DIM + 1}) t(i) group by 1, 2),
m{r} as materialized (
  select k, list(((s - ((s % n) + n) % n) // n)::bigint order by i) as m from s{r} group by k),
c{r + 1} as materialized (select c.k, coalesce(m.m, c.m) as m from c{r} c left join m{r} m on c.k = m.k)""")
    return "with " + ",\n".join(parts) + f"""
select v.vec_id, a.best.k as cluster, a.best.d as distance,
       (sum(a.best.d) over (partition by a.best.k))::bigint as cluster_inertia, (sum(a.best.d) over ())::bigint as inertia,
       sha256(array_to_string(c.m, ',')) as centroid_sha256
from a{rounds} a join v using (uid) join c{rounds} c on c.k = a.best.k"""


ORACLE = oracle()
