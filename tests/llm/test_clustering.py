import hashlib
import math

import numpy as np

from plantpulse.llm import clustering

SCHEMA = "vec_id long, embedding array<float>, cluster int, distance string, norm long"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 0, "x", 5) for i, v in rows], SCHEMA)


def brute(rows, k=40, rounds=5):
    kept = [(i, [math.floor(256 * float(np.float32(x))) for x in v]) for i, v in rows
            if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)]
    digest = lambda i: hashlib.sha256(f"2:{'null' if i is None else i}".encode()).hexdigest()
    centers = [x for _, x in sorted(kept, key=lambda r: digest(r[0]))[:k]]

    def near(x):
        return min((sum((a - b) ** 2 for a, b in zip(x, c)), n) for n, c in enumerate(centers))

    for _ in range(rounds):
        own = [near(x)[1] for _, x in kept]
        for n in range(len(centers)):
            group = [x for (_, x), m in zip(kept, own) if m == n]
            if group:
                centers[n] = [sum(c) // len(group) for c in zip(*group)]
    ends = [near(x) for _, x in kept]
    inertia = {n: sum(d for d, m in ends if m == n) for n in range(len(centers))}
    return sorted(((i, n, d, inertia[n], sum(inertia.values()),
                    hashlib.sha256(",".join(map(str, centers[n])).encode()).hexdigest())
                   for (i, _), (d, n) in zip(kept, ends)), key=repr)


def ours(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def rows_of(seed, n, clusters):
    rng = np.random.default_rng(seed)
    centers = rng.standard_normal((clusters, 64))
    x = centers[rng.integers(0, clusters, n)] + 0.4 * rng.standard_normal((n, 64))
    return [(i, v) for i, v in enumerate(x.astype(np.float32).tolist())]


def test_equals_whole_number_arithmetic(spark):
    rows = rows_of(1, 300, 8)
    assert ours(clustering.cluster(frame(spark, rows))) == brute(rows)
    assert ours(clustering.cluster(frame(spark, rows), centroids=5, rounds=2)) == brute(rows, 5, 2)
    assert ours(clustering.cluster(frame(spark, rows), centroids=5, rounds=0)) == brute(rows, 5, 0)


def test_odd_rows_repeats_and_a_hot_vector(spark):
    v = [0.25] * 64
    rows = rows_of(2, 60, 3) + [(1000 + i, v) for i in range(40)] + [
        (1000, v), (None, v), (2000, None), (2001, []), (2002, [1.0] * 63), (2003, [1.0] * 65), (2004, [None] + [1.0] * 63),
        (2005, [float("nan")] * 64), (2006, [float("-inf")] + [0.0] * 63), (2007, [0.0] * 64), (2008, [-1.0] * 64),
        (2009, [1000.0, -1000.0] * 32)]
    assert ours(clustering.cluster(frame(spark, rows))) == brute(rows)


def test_fewer_vectors_than_centroids_and_none(spark):
    rows = rows_of(3, 7, 2)
    assert ours(clustering.cluster(frame(spark, rows))) == brute(rows)
    assert clustering.cluster(frame(spark, [])).collect() == []
    assert clustering.cluster(frame(spark, [(1, None)])).columns == [
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]


def test_components_out_of_range_are_held(spark):
    rows = [(i, [3e38 * (-1) ** (i + k) for k in range(64)]) for i in range(50)] + rows_of(4, 20, 2)
    got = clustering.cluster(frame(spark, rows)).collect()
    assert len(got) == 70 and min(r.distance for r in got) >= 0 and min(r.cluster_inertia for r in got) >= 0


def test_planes_hold_the_numbers_and_their_products():
    rng = np.random.default_rng(5)
    for low, high in ((0, 1), (-1, 0), (0, 2), (-3, 4), (-1000, 1000), (-(1 << 27) + 1, 1 << 27)):
        x = rng.integers(low, high, (40, 64))
        planes = clustering.planes_of(x)
        assert (clustering.numbers_of(planes) == x).all()
        assert (clustering.inner_self(planes) == (x * x).sum(axis=1)).all()
        for c in (x[0], rng.integers(-300, 300, 64), np.zeros(64, np.int64)):
            assert (clustering.inner(planes, clustering.planes_of(c[None])[0]) == x @ c).all()
