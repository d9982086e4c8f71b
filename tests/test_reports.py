"""Published figures, the engineered table, learned models and the batch run."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from plantpulse.operators import anomaly, energy, forest, learning, windows
from plantpulse.operators.order import SeriesSpec
from plantpulse.plans.features import engineer_features
from plantpulse.plans.flow import Settings, run
from plantpulse.schema import SENSORS, TIME

# Published hourly mean and sum of power, hours 0 to 23.
MEANS = [0.4494755244755245, 0.44835509138381197, 0.4481429816913688, 0.8809350649350649, 1.0266539792387543,
         3.1346311263972484, 3.826051546391753, 3.810134715025907, 3.819993031358885, 3.8699676840215442,
         3.873366574330563, 3.850119257086999, 3.7925755995828987, 3.7438250539956806, 3.277703786191537,
         3.100315068493151, 3.133879120879121, 3.1210909090909094, 3.046240740740741, 0.9133854853911404,
         0.45873646850044364, 0.4561647475642161, 0.4537308707124011, 0.4499267015706806]
SUMS = [514.2, 515.16, 514.02, 1017.48, 1186.812, 3645.576, 4453.524, 4412.136, 4385.352, 4311.144, 4194.856,
        3938.672, 3637.08, 3466.782, 2943.378, 2715.876, 2851.83, 2952.552, 2960.946, 969.102, 516.996, 515.01,
        515.892, 515.616]


def test_published_schedule_and_savings(spark):
    hourly = spark.createDataFrame(
        [(h, m, s) for h, (m, s) in enumerate(zip(MEANS, SUMS))], "hour int, mean double, sum double")
    row = energy.schedule_hours(hourly).withColumn(
        "share", energy.shiftable(F.col("__peak"), F.col("__all"))).first()
    assert row.peak_hours == [6, 7, 8, 9, 10, 11]
    assert row.off_peak_hours == [0, 1, 2, 21, 22, 23]
    assert row.share == pytest.approx(44.571877824371605, abs=1e-9)
    assert sum(round(s / m) for s, m in zip(SUMS, MEANS)) == 25691
    mean = sum(SUMS) / 25691
    out = spark.range(1).select(*[e.alias(n) for n, e in energy.savings_exprs(F.lit(mean), F.lit(mean * 0.85)).items()]).first()
    assert out.annual_savings_kwh == pytest.approx(2948.584698454712, abs=1e-6)
    assert out.annual_savings_cost == pytest.approx(353.83016381456565, abs=1e-6)


def test_engineered_table_has_667_columns(spark, readings):
    out = engineer_features(readings)
    added = [c for c in out.columns if c not in ("reading_id", "unit_id")]
    assert len(added) == len(set(added)) == 667
    plan = out._jdf.queryExecution().toString()
    assert "SinglePartition" not in plan


def test_summary_and_drift_of_a_wide_table(spark, readings):
    from plantpulse.operators import monitoring, profile
    from plantpulse.schema import numeric_columns
    wide = engineer_features(readings, ["T_Supply", "Power"]).drop("unit_id", "reading_id")
    names = numeric_columns(wide)
    assert len(names) > monitoring.WIDE
    summary = {r.feature: r for r in profile.feature_summary(wide, "Power").collect()}
    stats = {r.feature: r for r in monitoring.drift_fit(wide, names).collect()}
    data = wide.toPandas()
    assert len(summary) == len(data.columns) - 1 == summary["ts"].total_features and len(stats) == len(names)
    for c in names:
        x = data[c].astype(float).replace([np.inf, -np.inf], np.nan)
        if c != "Power":
            assert summary[c].missing_count == data[c].isna().sum()
        if x.count() > 1 and x.count() == data[c].count():
            assert stats[c].mean == pytest.approx(x.mean()) and stats[c].std == pytest.approx(x.std())
    assert summary["roll_Power_std_4"].variance == pytest.approx(data.roll_Power_std_4.var())


def test_engineered_columns_equal_single_operators(spark, readings):
    names = ["T_Supply", "Power"]
    wide = engineer_features(readings, names)
    for single in (windows.add_rolling_features(readings, names), windows.add_lag_features(readings, names),
                   windows.add_ema_features(readings, names), windows.add_rate_of_change(readings, names)):
        extra = [c for c in single.columns if c not in readings.columns]
        a = wide.select("reading_id", *extra).orderBy("reading_id").toPandas()
        b = single.select("reading_id", *extra).orderBy("reading_id").toPandas()
        np.testing.assert_allclose(a.to_numpy(float), b.to_numpy(float), atol=1e-9)


def test_planted_outliers_score_lowest(spark):
    rng = np.random.default_rng(1)
    data = [(i, float(a), float(b)) for i, (a, b) in enumerate(rng.normal(size=(3000, 2)))]
    data += [(3000 + i, 9.0 + i, -9.0) for i in range(5)]
    df = spark.createDataFrame(data, "id long, a double, b double")
    model = forest.isolation_forest_fit(df, ["a", "b"], "id", contamination=0.1)
    scored = forest.isolation_forest_score(df, model)
    assert sorted(r.id for r in scored.orderBy("if_score").limit(5).collect()) == list(range(3000, 3005))
    assert scored.agg(F.avg("if_anomaly")).first()[0] == pytest.approx(0.1, abs=0.005)
    assert model.nodes.groupby("tree").size().shape[0] == 100
    again = forest.isolation_forest_fit(df.repartition(7), ["a", "b"], "id", contamination=0.1)
    a, b = (m.nodes.sort_values(["tree", "node"]).to_numpy(float) for m in (model, again))
    np.testing.assert_allclose(a, b, atol=1e-9)


def test_forest_on_few_rows(spark):
    df = spark.createDataFrame([(i, float(i)) for i in range(5)], "id long, a double")
    model = forest.isolation_forest_fit(df, ["a"], "id", trees=10)
    assert forest.isolation_forest_score(df, model).count() == 5


def test_reconstruction_finds_rows_off_the_plane(spark):
    rng = np.random.default_rng(2)
    base = rng.normal(size=(500, 2))
    x = np.column_stack([base, base @ [1.0, 2.0], base @ [-1.0, 0.5]])
    x[7, 3] += 25
    df = spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate(x)], "id long, a double, b double, c double, d double")
    fit = anomaly.reconstruction_fit(df, ["a", "b", "c", "d"], 2)
    out = anomaly.error_flags(fit.error(df))
    assert out.orderBy(F.desc("mse")).first().id == 7
    assert out.agg(F.sum("is_anomaly")).first()[0] == 25
    scaled = (x - x.mean(0)) / x.std(0)
    _, _, v = np.linalg.svd(scaled - scaled.mean(0), full_matrices=False)
    want = ((scaled - scaled @ v[:2].T @ v[:2]) ** 2).mean(1)
    got = [r.mse for r in out.orderBy("id").collect()]
    np.testing.assert_allclose(got, want, atol=1e-8)


def test_models_learn_a_clear_rule(spark, readings):
    df = windows.impute_zero(readings, SENSORS).withColumn("y", (F.col("T_Outdoor") > 15).cast("int"))
    split = learning.time_split(df, SENSORS, "y")
    train, test = split.filter("split = 'train'"), split.filter("split = 'test'")
    assert (train.count(), test.count()) == (800, 200)
    for kind, params in {"random_forest": {"trees": 10, "max_depth": 6}, "xgboost": {"rounds": 3},
                         "lightgbm": {"rounds": 3}}.items():
        model = learning.train_classifier(train, SENSORS, kind, "y", **params)
        got = {r.metric: r.value for r in learning.classifier_metrics(learning.score(test, model), "y").collect()}
        assert got["accuracy"] > 0.97 and got["roc_auc"] > 0.97
        assert learning.top_features(model, SENSORS, spark, 3).first().feature == "T_Outdoor"


def test_auc_equals_pairwise_count(spark, readings):
    df = windows.create_failure_labels(readings).select(
        (F.col("T_Outdoor") / 40).alias("probability"), "is_failure").toPandas()
    pos, neg = df[df.is_failure == 1].probability.to_numpy(), df[df.is_failure == 0].probability.to_numpy()
    want = ((pos[:, None] > neg).sum() + 0.5 * (pos[:, None] == neg).sum()) / (len(pos) * len(neg))
    got = learning.roc_auc(spark.createDataFrame(df), "is_failure").first()[0]
    assert got == pytest.approx(want, abs=1e-12)


def test_batch_run(spark, readings, tmp_path):
    """A single series without keys, as a raw file, through every stage."""
    raw = readings.filter("unit_id < 8").select(F.col("ts").cast("timestamp").alias(TIME), *SENSORS)
    settings = Settings(str(tmp_path), SeriesSpec(keys=(), order=TIME, tiebreak=()),
                        models=(("random_forest", (("trees", 3), ("max_depth", 4))),))
    out = run(spark, settings, raw)
    assert len(out["features"].columns) == 667
    assert 0 < out["clean"].count() <= raw.count()
    assert out["clean"].filter(" or ".join(f"{c} is null" for c in SENSORS)).count() == 0
    metrics = {r.metric: r.value for r in out["metrics"].collect()}
    assert metrics["accuracy"] > 0.8
    text = next((tmp_path / "reports" / "energy").glob("part-*.json")).read_text()
    report = json.loads(text)
    assert set(report) == {"consumption_profile", "schedule_optimization", "estimated_savings", "recommendations"}
    assert sum(r["count"] for r in out["severity"].collect()) == out["clean"].count()
