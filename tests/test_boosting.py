"""Leaf-wise boosting: shape, splits and scores on planted data."""

import json

import numpy as np
import pandas as pd
import pytest

from plantpulse.operators import boosting, learning
from plantpulse.plans import catalog_models
from plantpulse.sources.models import ModelStore

NAMES = [f"x{k}" for k in range(8)]


@pytest.fixture(scope="module")
def planted(spark):
    """A rare class behind a chain of eight conditions, which only a deep, narrow tree tells."""
    rng = np.random.default_rng(1)
    x = rng.random((4000, 8))
    data = pd.DataFrame(x, columns=NAMES).assign(y=(x > 0.25).all(axis=1).astype(int))
    df = spark.createDataFrame(data).repartition(4).cache()
    yield data, df
    df.unpersist()


def fitted(df, label="y", **params):
    model = learning.train_classifier(df, NAMES, "lightgbm", label, **params)
    return model, json.loads(model.stages[-1].getOrDefault("trees"))


def depth(tree, node=0):
    return 0 if tree["feature"][node] < 0 else 1 + max(depth(tree, tree["left"][node]), depth(tree, tree["right"][node]))


def test_trees_are_deeper_than_level_wise_ones_of_as_many_leaves(planted):
    data, df = planted
    model, found = fitted(df, rounds=6, leaves=14)
    assert all(t["feature"].count(-1) <= 14 for t in found["trees"])
    assert depth(found["trees"][0]) >= 7 > np.ceil(np.log2(14))
    level = learning.train_classifier(df, NAMES, "xgboost", "y", rounds=2, max_depth=4)
    assert max(t.depth for t in level.stages[-1].trees) <= 4
    scored = learning.score(df, model).toPandas()
    assert ((scored.prediction == scored.y).mean()) > 0.97
    assert learning.roc_auc(learning.score(df, model), "y").first()[0] > 0.99


def test_root_split_and_leaf_values_follow_from_the_data(spark, planted):
    data, df = planted
    rows = df.selectExpr(f"array({', '.join(NAMES)}) as x", "cast(y as double) as y", "1D as w")
    edges = boosting.bin_edges(rows, 8, 16)
    tree = boosting.boost(rows, 1, 2, 1.0, 16, 20, 0.5)
    root = tree["trees"][0]
    p = data.y.mean()
    assert tree["start"] == pytest.approx(np.log(p / (1 - p)))
    g, h = p - data.y.to_numpy(), np.full(len(data), p * (1 - p))

    def side(mask):
        return g[mask].sum() ** 2 / (h[mask].sum() + 0.5)

    gains = {(i, k): side(data[NAMES[i]] <= e) + side(data[NAMES[i]] > e) for i in range(8) for k, e in enumerate(edges[i])}
    best = max(gains, key=gains.get)
    assert (root["feature"][0], root["bin"][0]) == best and root["cut"][0] == edges[best[0]][best[1]]
    left = data[NAMES[best[0]]] <= root["cut"][0]
    for child, mask in ((root["left"][0], left), (root["right"][0], ~left)):
        assert root["value"][child] == pytest.approx(-g[mask].sum() / (h[mask].sum() + 0.5))


def test_leaves_are_taken_in_order_of_gain():
    """The same tree as a sequential best-first growth that opens one leaf at a time."""
    rng = np.random.default_rng(2)
    cells = rng.integers(0, 8, (900, 3)).astype(np.uint8)
    g = rng.normal(size=900) + (cells[:, 0] > 3) * (cells[:, 1] > 2) - 0.5 * (cells[:, 2] == 1)

    def hist(mask):
        out = np.zeros((3, 8, 3))
        for i in range(3):
            for k, v in enumerate((g, np.ones(900), np.ones(900))):
                out[i, :, k] = np.bincount(cells[mask, i], v[mask], minlength=8)
        return out

    growth = boosting._Growth(hist(np.ones(900, bool)), 9, 5, 0.0)
    while wanted := growth.grown()[1]:
        fresh = growth.open(wanted)
        at = boosting.leaves(growth.shape(), cells)
        for node, child in zip(wanted, fresh):
            growth.fill(node, hist(at == child))
    tree = growth.tree(1.0, [np.arange(8.0)] * 3)

    parts = [np.ones(900, bool)]
    while len(parts) < 9:
        gains = []
        for n, mask in enumerate(parts):
            for i in range(3):
                for b in range(7):
                    left, right = mask & (cells[:, i] <= b), mask & (cells[:, i] > b)
                    if min(left.sum(), right.sum()) >= 5:
                        gains.append((sum(g[m].sum() ** 2 / m.sum() for m in (left, right)) - g[mask].sum() ** 2 / mask.sum(), n, left, right))
        _, n, left, right = max(gains, key=lambda x: x[0])
        parts[n:n + 1] = [left, right]
    at = boosting.leaves(tree, cells)
    ours = {tuple(np.flatnonzero(at == node)) for node in np.unique(at)}
    assert ours == {tuple(np.flatnonzero(mask)) for mask in parts}


def test_scores_are_carried_over_stages_and_tasks(planted, monkeypatch):
    _, df = planted
    # the sketch of the edges depends on the tasks, the sums do not
    monkeypatch.setattr(boosting, "bin_edges", lambda rows, dims, bins: [np.arange(1, bins) / bins] * dims)
    _, one = fitted(df.coalesce(1), rounds=5, leaves=5)
    monkeypatch.setattr(boosting, "TREES_PER_STAGE", 2)
    _, many = fitted(df.repartition(6), rounds=5, leaves=5)
    for a, b in zip(one["trees"], many["trees"]):
        assert (a["feature"], a["bin"]) == (b["feature"], b["bin"])
        np.testing.assert_allclose(a["value"], b["value"], rtol=1e-6)


def test_saved_and_loaded(spark, planted, tmp_path):
    _, df = planted
    model, _ = fitted(df, rounds=2, leaves=4)
    store = ModelStore(spark, str(tmp_path))
    store.save(model, "m", "lightgbm", {}, NAMES)
    again, _ = store.load()
    a, b = (learning.score(df, m).agg({"probability": "sum"}).first()[0] for m in (model, again))
    assert a == pytest.approx(b)


def test_one_class_missing_values_and_no_rows(spark):
    df = spark.createDataFrame([(float(k % 7), float("nan") if k % 3 else 1.0, int(k % 7 > 3)) for k in range(300)], "a double, b double, y int")
    rows = df.selectExpr("array(a, b) as x", "cast(y as double) as y", "1D as w")
    found = boosting.boost(rows, 2, 4, 0.5, 8, 5, 0.0)
    assert found["trees"][0]["feature"][0] == 0
    single = boosting.boost(rows.selectExpr("x", "1D as y", "w"), 2, 4, 0.5, 8, 5, 0.0)
    assert all(t["feature"] == [-1] for t in single["trees"])
    with pytest.raises(ValueError):
        boosting.boost(rows.limit(0), 1, 4, 0.5, 8, 5, 0.0)


def test_the_queries_fit_all_trees(spark, sf, monkeypatch):
    class Seen(Exception):
        pass

    def seen(*args):
        raise Seen(*args)

    for query, step in ((catalog_models.train_ensemble, "train_ensemble"), (catalog_models.training_history, "timed_training")):
        monkeypatch.setattr(learning, step, seen)
        with pytest.raises(Seen) as call:
            query(spark, sf)
        given = call.value.args[2]
        learner = given["lgb"]() if "lgb" in given else learning.KINDS["lightgbm"][0](**given["lightgbm"])
        assert learner.settings["rounds"] == 100 and learner.settings["most_leaves"] == 31


def test_histograms_count_the_smaller_children_only_and_nothing_stays(spark, planted, monkeypatch):
    """Each pass below the root counts at most half of the rows; the blocks are let go."""
    _, df = planted
    seen, count = [], boosting._histograms

    def watched(blocks, shape, wanted, bins):
        out = count(blocks, shape, wanted, bins)
        seen.append((wanted, sum(v[0, :, 2].sum() for v in out.values())))
        return out

    df.count()  # the cached table itself
    held = spark.sparkContext._jsc.getPersistentRDDs().size()
    monkeypatch.setattr(boosting, "_histograms", watched)
    monkeypatch.setattr(boosting, "TREES_PER_STAGE", 2)
    monkeypatch.setattr(boosting, "MANY_TASKS", 1)
    fitted(df, rounds=5, leaves=8)
    assert [n for wanted, n in seen if wanted == [0]] == [4000] * 5
    assert all(n <= 2000 for wanted, n in seen if wanted != [0]) and len(seen) > 10
    assert spark.sparkContext._jsc.getPersistentRDDs().size() <= held
