"""The forest whose deep parts are grown and walked in tasks."""

import numpy as np
from pyspark.ml import PipelineModel
from pyspark.sql import functions as F

from plantpulse.operators import learning, randomforest


def rule(spark, rows=3000):
    rng = np.random.default_rng(4)
    x = rng.uniform(size=(rows, 4))
    y = ((x[:, 0] > 0.4) ^ (x[:, 1] > 0.7)) ^ (rng.uniform(size=rows) < 0.1)
    return spark.createDataFrame([(*map(float, v), int(c)) for v, c in zip(x, y)], "a double, b double, c double, d double, y int")


def fitted(df, **params):
    return learning.train_classifier(df, ["a", "b", "c", "d"], "random_forest", "y", trees=8, max_depth=30, **params)


def chances(df, model):
    scored = learning.score(df, model).orderBy("a", "b").collect()
    return np.array([[r.y, r.probability] for r in scored])


def test_no_tree_reaches_the_driver_and_no_task_gets_more_rows_than_it_may(spark):
    """Noise makes trees as large as the table; only their tops are kept with the model."""
    df = rule(spark)
    model = fitted(df, rowsAtATask=200).stages[-1]
    tops = randomforest.json.loads(model.getOrDefault(model.about))["tops"]
    nodes = [len(r.value) // 8 for r in model.rests.select("value").collect()]
    assert sum(nodes) > 2 * sum(len(t["value"]) for t in tops)
    assert max(nodes) < 2 * 200 and len(nodes) > 8 * 5


def test_the_same_forest_wherever_the_trees_are_cut(spark):
    df = rule(spark)
    whole, cut = (chances(df, fitted(df, rowsAtATask=n)) for n in (100_000, 150))
    np.testing.assert_allclose(whole, cut, atol=1e-9)
    y, p = whole.T
    # grown in full, a forest knows nearly all rows that it has learnt from, noise included
    assert ((p > 0.5) == y).mean() > 0.97


def test_the_rule_is_found_in_new_rows_and_after_saving(spark, tmp_path):
    df = rule(spark, 4000).withColumn("new", F.xxhash64("a") % 4 == 0)
    model = fitted(df.filter(~F.col("new")).drop("new"))
    fresh = df.filter("new").drop("new")
    y, p = chances(fresh, model).T
    assert ((p > 0.5) == y).mean() > 0.82
    weights = model.stages[-1].featureImportances.toArray()
    assert min(weights[:2]) > max(weights[2:]) and abs(weights.sum() - 1) < 1e-9
    model.write().overwrite().save(str(tmp_path / "m"))
    np.testing.assert_array_equal(chances(fresh, PipelineModel.load(str(tmp_path / "m"))), np.column_stack([y, p]))


def test_depth_and_single_tree(spark):
    df = rule(spark, 500)
    model = learning.train_classifier(df, ["a", "b", "c", "d"], "random_forest", "y", trees=1, max_depth=2)
    assert len(np.unique(chances(df, model)[:, 1])) <= 4


def test_rests_without_a_cut(spark):
    """Rows of one bin stay one leaf, also where a task finishes them."""
    df = spark.createDataFrame([(float(k % 2), int(k % 10 < 3 * (k % 2))) for k in range(4000)], "a double, y int")
    model = learning.train_classifier(df, ["a"], "random_forest", "y", trees=2, max_depth=5, rowsAtATask=2000)
    scored = learning.score(df, model).groupBy("a").agg(F.min("probability").alias("p"), F.max("probability").alias("q")).collect()
    chance = {r.a: (r.p, r.q) for r in scored}
    assert chance[0.0] == (0.0, 0.0) and chance[1.0][0] == chance[1.0][1] > 0.5
    np.testing.assert_array_equal(model.stages[-1].featureImportances.toArray(), [1.0])


def test_leaves_that_predict_the_same_become_one():
    rng = np.random.default_rng(5)
    cells, y = rng.integers(0, 8, (400, 3)).astype(np.uint8), (rng.uniform(size=400) < 0.2).astype(np.int64)
    tree, gains = randomforest.grow(cells, y, np.ones(400), 7, 30, 3, 2, 8)
    inner = np.flatnonzero(tree["feature"] >= 0)
    a, b = tree["left"][inner], tree["right"][inner]
    assert sorted([0, *a, *b]) == list(range(len(tree["feature"]))) and (gains > 0).all()
    leaves = (tree["feature"][a] < 0) & (tree["feature"][b] < 0)
    assert leaves.any() and ((tree["value"][a] > 0.5) != (tree["value"][b] > 0.5))[leaves].all()
    share = [y[randomforest.walked(tree, cells) == k].mean() for k in np.flatnonzero(tree["feature"] < 0)]
    np.testing.assert_allclose(share, tree["value"][tree["feature"] < 0])


def test_bins_part_the_weight():
    """A rare class with most of the weight gets most of the bins."""
    x = np.arange(1000.0)
    found = randomforest.cuts(x, np.where(x < 50, 19.0, 1.0), 31)
    assert len(found) == 31 and 14 <= (found < 50).sum() <= 16
    np.testing.assert_array_equal(randomforest.cuts(np.array([1.0, 3.0, 3.0]), np.ones(3), 31), [2.0])


def test_leaves_of_equal_shares_have_equal_values():
    """Also in trees of other weight: rows of equal chances stay tied."""
    cells, y = np.array([[0], [0], [0], [1]], np.uint8), np.array([0, 0, 1, 1])
    values = []
    for copies in (1, 7, 1001):
        w = np.where(y == 1, 0.7 / 3, 1 / 9)
        tree, _ = randomforest.grow(np.repeat(cells, copies, axis=0), np.repeat(y, copies), np.repeat(w, copies), 1, 0, 1, 1, 2)
        values.append(tree["value"][0])
    np.testing.assert_allclose(values, (1.4 / 3) / (1.4 / 3 + 2 / 9), rtol=1e-14)


def test_cuts_of_equal_gain_stay_tied_however_often_rows_are_drawn():
    """Two rows drawn once weigh as much as one drawn twice; the first feature is taken."""
    rng = np.random.default_rng(8)
    for _ in range(40):
        w = np.full(6, rng.uniform(0.1, 9))
        x, y = np.array([0, 0, 1, 1, 1, 1]), np.array([1, 1, 1, 1, 1, 0])
        cells, times = np.column_stack([x, [1, 1, 0, 1, 1, 1]]).astype(np.uint8), np.array([1, 1, 2, 1, 1, 6], np.uint8)
        tree, _ = randomforest.grow(cells, y, w, 1, 1, 2, 2, 2, times)
        assert tree["feature"][0] == 0


def test_few_rows_are_cut_as_by_their_histograms():
    rng = np.random.default_rng(6)
    sizes = rng.integers(2, 40, 300)
    node, count = np.repeat(np.arange(300), sizes), sizes.sum()
    cells, y = rng.integers(0, 6, (count, 5)).astype(np.uint8), rng.integers(0, 2, count)
    w = rng.integers(1, 9, count).astype(float)
    chosen = randomforest.subsets(np.arange(300, dtype=np.uint64), 5, 3)
    base = np.arange(count) * 5
    whole = randomforest.best_splits(randomforest.histograms(cells.ravel(), base, y, w, node, chosen, 6), chosen)
    few = randomforest.few_splits(cells.ravel(), base, y, w, sizes, chosen)
    cut = whole[0] > 0
    assert cut.sum() > 200
    for a, b in zip(whole, few):
        np.testing.assert_array_equal(a[cut], b[cut])
    np.testing.assert_array_equal(few[0][~cut], 0)


def test_the_order_of_the_rows_does_not_matter():
    rng = np.random.default_rng(7)
    cells, y = rng.integers(0, 30, (5000, 4)).astype(np.uint8), rng.integers(0, 2, 5000)
    w = np.where(y == 1, 1 / 3, 0.1) * rng.integers(1, 4, 5000) * rng.uniform(0.5, 1, 5000)
    order = rng.permutation(5000)
    (one, gain), (other, again) = (randomforest.grow(cells[o], y[o], w[o], 3, 25, 4, 2, 32) for o in (np.arange(5000), order))
    for k in ("feature", "cut", "left", "right"):
        np.testing.assert_array_equal(one[k], other[k])
    np.testing.assert_allclose(one["value"], other["value"], rtol=1e-12)
    np.testing.assert_allclose(gain, again, rtol=1e-12)


def test_rows_travel_in_runs_and_blocks_do_not_matter(spark, monkeypatch):
    """What is dealt to the tasks is a row for each block and node, not one for each row and tree."""
    df, asked = rule(spark), []
    repartition = type(df).repartition

    def watched(frame, *columns):
        if "root" in columns and "b" in frame.columns:
            asked.append(frame.count())
        return repartition(frame, *columns)

    whole = chances(df, fitted(df, rowsAtATask=400))
    monkeypatch.setattr(type(df), "repartition", watched)
    model = fitted(df, rowsAtATask=400)
    learning.score(df, model).count()
    tops = randomforest.json.loads(model.stages[-1].getOrDefault("about"))["tops"]
    roots = sum(max(t["root"]) >= 0 and len([r for r in t["root"] if r >= 0]) for t in tops)
    blocks = df.rdd.getNumPartitions()
    assert len(asked) == 2 and asked[0] <= blocks * roots and asked[1] <= blocks * (roots + 1) < 8 * 3000
    monkeypatch.setattr(randomforest, "ROWS_AT_ONCE", 1)
    monkeypatch.setattr(randomforest, "NODES_A_ROW", 3)
    monkeypatch.setattr(randomforest, "FEW_ROWS", 0)
    np.testing.assert_allclose(chances(df, fitted(df, rowsAtATask=400)), whole, atol=1e-9)
