"""Level-wise boosting: the trees of MLlib's learner, however the rows are spread, and a bounded number of small passes."""

import numpy as np
import pandas as pd
import pytest
from pyspark.ml.classification import GBTClassifier

from plantpulse.operators import learning, levelwise
from plantpulse.sources.models import ModelStore

NAMES = [f"x{k}" for k in range(5)]


@pytest.fixture(scope="module")
def planted(spark):
    rng = np.random.default_rng(3)
    x = rng.random((3000, 5))
    x[:, 3] = (x[:, 3] * 6).round()
    noisy = (x[:, 0] + x[:, 1] * x[:, 2] + 0.1 * x[:, 3] + 0.3 * rng.normal(size=3000) > 1.1).astype(int)
    df = spark.createDataFrame(pd.DataFrame(x, columns=NAMES).assign(y=noisy)).repartition(4).cache()
    yield df
    df.unpersist()


def nodes(tree, node=0):
    if tree.feature[node] < 0:
        return [tree.value[node]]
    return [tree.feature[node], tree.cut[node], *nodes(tree, tree.left[node]), *nodes(tree, tree.right[node])]


def mllib_nodes(node):
    if node.numDescendants() == 0:
        return [node.prediction()]
    split = node.split()
    return [split.featureIndex(), split.threshold(), *mllib_nodes(node.leftChild()), *mllib_nodes(node.rightChild())]


def test_the_same_model_as_mllib(planted):
    # small nodes have cuts of equal gain, of which MLlib takes any
    ours = learning.train_classifier(planted, NAMES, "xgboost", "y", rounds=6, max_depth=4, minInstancesPerNode=60)
    assert isinstance(ours.stages[-1], levelwise.LevelwiseModel)
    data = learning.with_class_weight(planted.select(*NAMES, "y"), "y", "positive")
    theirs = learning.assembled(NAMES, GBTClassifier(
        labelCol="y", maxIter=6, maxDepth=4, stepSize=0.1, seed=42, weightCol="weight", minInstancesPerNode=60)).fit(data)
    known = list(theirs.stages[-1]._java_obj.trees())
    assert len(known) == len(ours.stages[-1].trees) == 6
    for tree, other in zip(ours.stages[-1].trees, known):
        assert tree.depth == other.depth()
        np.testing.assert_allclose(nodes(tree), mllib_nodes(other.rootNode()), rtol=1e-9)
    np.testing.assert_allclose(ours.stages[-1].treeWeights, theirs.stages[-1].treeWeights)
    np.testing.assert_allclose(ours.stages[-1].featureImportances.toArray(), theirs.stages[-1].featureImportances.toArray(), rtol=1e-9)
    a, b = (m.transform(planted).orderBy(*NAMES).select("rawPrediction", "probability", "prediction").collect() for m in (ours, theirs))
    for mine, other in zip(a, b):
        np.testing.assert_allclose(mine.rawPrediction.toArray(), other.rawPrediction.toArray(), rtol=1e-9, atol=1e-12)
        np.testing.assert_allclose(mine.probability.toArray(), other.probability.toArray(), rtol=1e-9)
        assert mine.prediction == other.prediction


def test_spread_stages_and_groups_do_not_matter(spark, planted, monkeypatch):
    def trees(df):
        return learning.train_classifier(df, NAMES, "xgboost", "y", rounds=5, max_depth=4).stages[-1].trees

    one = trees(planted.coalesce(1))
    monkeypatch.setattr(levelwise, "TREES_PER_STAGE", 2)
    monkeypatch.setattr(levelwise, "NODES_AT_ONCE", 3)
    monkeypatch.setattr(levelwise, "MANY_TASKS", 2)
    monkeypatch.setattr(levelwise, "_tasks", lambda spark, count: 7)  # more tasks than blocks
    for a, b in zip(one, trees(planted.repartition(5)), strict=True):
        np.testing.assert_allclose(nodes(a), nodes(b), rtol=1e-9)
    assert spark.sparkContext._jsc.getPersistentRDDs().size() <= 1  # the planted table alone


def test_histograms_count_the_smaller_children_only(spark, planted, monkeypatch):
    """Each pass below the root counts at most half of the rows."""
    seen, count = [], levelwise.level_sums

    def watched(blocks, tree, depth, wanted, bins):
        out = count(blocks, tree, depth, wanted, bins)
        seen.append((depth, out[:, 0, :, 0].sum()))
        return out

    monkeypatch.setattr(levelwise, "level_sums", watched)
    learning.train_classifier(planted, NAMES, "xgboost", "y", rounds=3, max_depth=5)
    assert len(seen) == 3 * 5
    assert all(n == 3000 if depth == 0 else n <= 1500 for depth, n in seen)


def test_tasks_grow_with_the_rows(spark):
    cores = spark.sparkContext.defaultParallelism
    assert levelwise._tasks(spark, 300) == 1
    assert levelwise._tasks(spark, 1_000_000) == cores
    assert levelwise._tasks(spark, 30_000_000) == 4 * cores


def test_odd_tables(spark):
    df = spark.createDataFrame([(float(k % 7), 1.0, int(k % 7 > 3)) for k in range(70)], "a double, b double, y int")
    plain = learning.train_classifier(df, ["a", "b"], "xgboost", "y", rounds=3)
    tree = plain.stages[-1].trees[0]
    assert (tree.feature, tree.cut[0], tree.value) == ([0, -1, -1], 3.5, pytest.approx([0.0, -1.0, 1.0], abs=1e-12))
    single = learning.train_classifier(df.filter("y = 1"), ["a", "b"], "xgboost", "y", rounds=2)
    assert all(t.feature == [-1] for t in single.stages[-1].trees)
    lone = learning.train_classifier(df.limit(1), ["a", "b"], "xgboost", "y", rounds=2)
    assert all(t.feature == [-1] for t in lone.stages[-1].trees)
    for bad in (df.limit(0), df.selectExpr("a", "b", "y + 1 as y")):
        with pytest.raises(ValueError):
            learning.train_classifier(bad, ["a", "b"], "xgboost", "y", rounds=2)


def test_saved_and_loaded(spark, planted, tmp_path):
    model = learning.train_classifier(planted, NAMES, "xgboost", "y", rounds=2, max_depth=3)
    store = ModelStore(spark, str(tmp_path))
    store.save(model, "m", "xgboost", {}, NAMES)
    again, _ = store.load()
    a, b = (learning.score(planted, m).agg({"probability": "sum"}).first()[0] for m in (model, again))
    assert a == pytest.approx(b)
