import math

import numpy as np

from plantpulse.llm import topk

SCHEMA = "vec_id long, embedding array<float>, label int, score string, rank string, uid long"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 0, "x", "y", 5) for i, v in rows], SCHEMA)


def brute(rows, top=20, every=20, scale=64):
    good = [(k, i, [math.floor(scale * float(np.float32(x))) for x in v]) for k, (i, v) in enumerate(rows)
            if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for k, i, q in good:
        if i is not None and i % every == 0:
            scores = [(-sum(a * b for a, b in zip(q, x)), j is None, j) for m, j, x in good if m != k and len(x) == len(q)]
            out += [(i, r + 1, j, -s) for r, (s, _, j) in enumerate(sorted(scores, key=lambda x: (x[0], x[1], x[2] or 0))[:top])]
    return sorted(out, key=repr)


def ours(df):
    return sorted(((r.query_id, r.rank, r.vec_id, r.score) for r in df.collect()), key=repr)


def random_rows(seed, n, dim, scale=1.0, clusters=0):
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((n, dim)) * scale
    if clusters:
        x = rng.standard_normal((clusters, dim))[rng.integers(0, clusters, n)] + 0.1 * x
    return [(int(i), v) for i, v in enumerate(x.astype(np.float32).tolist())]


def test_blocks_and_parts_give_the_answer_of_all_pairs(spark):
    for rows in (random_rows(1, 400, 64), random_rows(2, 400, 24, clusters=6), random_rows(3, 300, 5, scale=3.0)):
        assert ours(topk.nearest(frame(spark, rows), top=7, every=5, block_rows=60, query_rows=25)) == brute(rows, 7, 5)


def test_hot_vector_and_ties_to_the_smaller_id(spark):
    rows = random_rows(4, 90, 8)
    rows = rows + [(100 + i, rows[0][1]) for i in range(150)]
    assert ours(topk.nearest(frame(spark, rows), block_rows=40, query_rows=3)) == brute(rows)


def test_odd_rows(spark):
    v = [1.0, 2.0, 3.0]
    rows = [(20, v), (20, v), (40, [0.5, 0.5, -0.5]), (None, v), (60, None), (80, [1.0, None, 2.0]), (5, [float("nan")] * 3),
            (6, [float("inf"), 0.0, 0.0]), (100, []), (7, []), (120, [1.0, 1.0]), (140, [0.0, 0.0, 0.0]), (-20, [-1.0, 0.0, 0.01])]
    assert ours(topk.nearest(frame(spark, rows))) == brute(rows)


def test_fewer_rows_than_asked_for(spark):
    rows = random_rows(5, 12, 64)
    got = ours(topk.nearest(frame(spark, rows), every=1))
    assert got == brute(rows, every=1) and len(got) == 12 * 11


def test_large_components_stay_exact(spark):
    rows = [(i, [5e4 * (1 + i % 3), -7e4, 3e4 + i] + [1e3] * 61) for i in range(45)]
    assert ours(topk.nearest(frame(spark, rows), block_rows=20)) == brute(rows)
    huge = [(i, [3e38, -3e38] + [float(i)] * 62) for i in range(30)]
    assert topk.nearest(frame(spark, huge)).count() == 2 * 20


def test_a_single_row_and_an_empty_table(spark):
    assert topk.nearest(frame(spark, [(0, [1.0])])).count() == 0
    assert topk.nearest(frame(spark, [])).count() == 0


def test_the_bound_is_never_below_the_product():
    rng = np.random.default_rng(6)
    for dim in (1, 3, 16, 64, 100):
        x = rng.integers(-500, 500, (60, dim))
        exact = topk.products(x, x)
        for count in topk.SEGMENTS:
            stats = topk.segments(x, count)
            assert (stats @ stats.T >= exact - 1e-6).all()


def test_survivors_are_exact_where_few_and_where_many():
    rng = np.random.default_rng(7)
    q, x = rng.integers(-60, 60, (30, 64)), rng.integers(-60, 60, (500, 64))
    exact = q @ x.T
    for share in (0.001, 0.5):
        least = np.quantile(exact, 1 - share, axis=1).astype(np.int64)
        r, c, score = topk.search(q, x, least, np.full(30, -1))
        assert sorted(zip(r, c, score)) == sorted((a, b, exact[a, b]) for a, b in zip(*np.nonzero(exact >= least[:, None])))
    # blocky vectors, whose segments tell nearly all
    blocks = np.repeat(rng.integers(-60, 60, (500, 4)), 16, axis=1)
    exact = blocks[:30] @ blocks.T
    least = np.sort(exact, axis=1)[:, -5]
    r, c, score = topk.search(blocks[:30], blocks, least, np.arange(30))
    want = {(a, b) for a, b in zip(*np.nonzero(exact >= least[:, None])) if a != b}
    assert set(zip(r, c)) == want
