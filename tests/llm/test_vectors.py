import math

import numpy as np

from plantpulse.llm import vectors
from tests.llm.cases import components

SCHEMA = "vec_id long, embedding array<float>, label int, links string, id string"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 0, "x", "y") for i, v in rows], SCHEMA)


def brute(rows, threshold=0.95):
    good = {i: np.array(v, float) for i, v in rows if v and all(x is not None and math.isfinite(x) for x in v) and any(v)}
    links = [(a, b) for a in good for b in good if a < b and len(good[a]) == len(good[b])
             and good[a] @ good[b] / np.linalg.norm(good[a]) / np.linalg.norm(good[b]) >= threshold]
    degree = {i: sum(i in pair for pair in links) for i, _ in rows}
    joined = components([i for i, _ in rows], links)
    return {i: (degree[i], joined[i], joined[i] == i) for i, _ in rows}


def ours(df):
    return {r.vec_id: (r.n_links, r.component_id, r.kept) for r in df.collect()}


def clusters(seed, sizes, dim=16, noise=0.03):
    rng, rows = np.random.default_rng(seed), []
    for size in sizes:
        center = rng.standard_normal(dim)
        rows += [(center + noise * rng.standard_normal(dim)).astype(np.float32).tolist() for _ in range(size)]
    order = rng.permutation(len(rows))
    return [(int(i), rows[k]) for i, k in enumerate(order)]


def test_splits_keep_nearly_all_links(spark):
    rows = clusters(1, [1] * 200 + [2] * 60 + [9] * 10 + [60])
    want, got = brute(rows), ours(vectors.near_duplicates(frame(spark, rows), leaf_rows=40))
    found, all_links = sum(got[i][0] for i in got), sum(want[i][0] for i in want)
    assert 0.97 * all_links <= found <= all_links
    assert all(got[i][0] <= want[i][0] for i in want)
    assert sum(got[i][1:] == want[i][1:] for i in want) >= 0.99 * len(want)


def test_whole_leaves_are_exact(spark, sf):
    df = spark.read.parquet(f"{sf}/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in df.collect()]
    assert ours(vectors.near_duplicates(df)) == brute(rows)


def test_vectors_that_no_direction_parts_are_compared_in_blocks(spark):
    base = np.random.default_rng(4).standard_normal(8)
    rows = [(i, (base * 2.0 ** (i % 40 - 20)).tolist()) for i in range(40)]
    rows = [(i, np.array(v, np.float32).tolist()) for i, v in rows] + [(100 + i, v) for i, v in clusters(5, [1] * 30, 8)]
    assert ours(vectors.near_duplicates(frame(spark, rows), leaf_rows=6)) == brute(rows)


def test_a_dense_group_above_the_leaf_size_keeps_its_links(spark):
    rows = clusters(6, [1] * 300 + [900], 64, 0.17)
    unit = np.array([v for _, v in rows], float)
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    want = (unit @ unit.T >= 0.95).sum(axis=1) - 1
    got = ours(vectors.near_duplicates(frame(spark, rows), leaf_rows=30))
    assert want.max() > 800 and all(got[i][0] <= want[i] for i in got)
    assert sum(got[i][0] for i in got) >= 0.999 * want.sum()


def test_odd_rows(spark):
    v = [1.0, 2.0, 3.0]
    rows = [(5, v), (3, v), (9, [1.0, 2.0, 3.01]), (1, None), (2, []), (4, [0.0, 0.0, 0.0]), (6, [1.0, None, 2.0]),
            (7, [float("nan"), 1.0, 2.0]), (8, [float("inf"), 1.0, 2.0]), (10, [1.0, 2.0]), (11, [2.0, 4.0]), (12, [-1.0, -2.0, -3.0]),
            (13, [-0.0, 0.0, 0.0]), (14, [1e-30, 2e-30, 3e-30])]
    got = ours(vectors.near_duplicates(frame(spark, rows)))
    assert got == brute(rows)
    again = vectors.near_duplicates(frame(spark, rows + [(5, v), (None, v), (None, None)])).collect()
    assert {r.vec_id: (r.n_links, r.component_id, r.kept) for r in again if r.vec_id is not None} == got
    assert [(r.n_links, r.component_id, r.kept) for r in again if r.vec_id is None] == [(0, None, True)] * 2


def test_pair_in_many_leaves_counts_once(spark):
    rows = clusters(8, [30], noise=0.02)
    want = brute(rows)
    got = ours(vectors.near_duplicates(frame(spark, rows), leaf_rows=10, spill=0.2))
    assert all(got[i][0] <= want[i][0] for i in want)


def test_empty_table(spark):
    assert vectors.near_duplicates(frame(spark, [])).count() == 0


def test_a_bad_threshold_finds_nothing_below_it(spark):
    rows = clusters(2, [5, 5], noise=0.3)
    assert ours(vectors.near_duplicates(frame(spark, rows), threshold=0.9)) == brute(rows, 0.9)
