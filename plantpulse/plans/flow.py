"""The batch run: load, clean, features, models, anomalies, energy report."""

from __future__ import annotations

import argparse
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plantpulse.functions.grading import classify_alert_severity
from plantpulse.operators import anomaly, cleaning, energy, forest, learning, profile
from plantpulse.operators.order import SeriesSpec
from plantpulse.operators.select import feature_columns
from plantpulse.operators.windows import create_failure_labels, impute_zero
from plantpulse.plans.features import engineer_features
from plantpulse.schema import SENSORS, TIME
from plantpulse.session import build_session, drop_staged
from plantpulse.sources.models import ModelStore
from plantpulse.sources.tables import Stages, read_parquet, staged_load, write_parquet, write_report

ANOMALY_COLUMNS = ["T_Supply", "T_Return", "T_Saturation", "T_Outdoor", "Power"]


@dataclass(frozen=True)
class Settings:
    root: str
    spec: SeriesSpec = SeriesSpec(keys=(), order=TIME, tiebreak=())
    label: str = "failure_imminent"
    models: tuple[tuple[str, tuple[tuple[str, object], ...]], ...] = (
        ("random_forest", (("trees", 50),)), ("xgboost", ()))
    drop_leaky: bool = False


def clean_stage(spark: SparkSession, stages: Stages, s: Settings, df: DataFrame | None = None) -> DataFrame:
    raw = df if df is not None else staged_load(spark, stages, use_cached=False)
    clean = cleaning.clean_readings(raw, columns=[c for c in SENSORS if c in raw.columns], spec=s.spec)
    write_parquet(clean, stages.interim)
    return read_parquet(spark, stages.interim)


def feature_stage(spark: SparkSession, stages: Stages, s: Settings, clean: DataFrame) -> DataFrame:
    write_parquet(engineer_features(clean, spec=s.spec), stages.processed)
    return read_parquet(spark, stages.processed)


def training_table(features: DataFrame, s: Settings) -> tuple[DataFrame, list[str]]:
    labelled = create_failure_labels(features, spec=s.spec)
    names = feature_columns(labelled, (*s.spec.keys, *s.spec.sort))
    if s.drop_leaky:
        names = [c for c in names if "Power" not in c and not c.startswith("power_")]
    filled = impute_zero(labelled, names, fill_first=True, spec=s.spec)
    return learning.time_split(filled, names, s.label, spec=s.spec), names


def model_stage(spark: SparkSession, store: ModelStore, s: Settings, features: DataFrame) -> DataFrame:
    table, names = training_table(features, s)
    write_parquet(table, f"{s.root}/processed/training.parquet")
    table = read_parquet(spark, f"{s.root}/processed/training.parquet")
    train, test = (table.filter(F.col("split") == part) for part in ("train", "test"))
    out = None
    for kind, params in s.models:
        model = learning.train_classifier(train, names, kind, s.label, **dict(params))
        metrics = learning.classifier_metrics(learning.score(test, model), s.label)
        metrics = metrics.select(F.lit(kind).alias("model"), "metric", "value")
        store.save(model, kind, kind, {r.metric: r.value for r in metrics.collect() if r.value is not None}, names)
        out = metrics if out is None else out.unionByName(metrics)
    return out


def anomaly_stage(clean: DataFrame, s: Settings, columns: list[str] = ANOMALY_COLUMNS) -> DataFrame:
    names = [c for c in columns if c in clean.columns]
    scored = anomaly.zscore_anomaly_detection(clean, names)
    trained = forest.isolation_forest_fit(clean, names, s.spec.sort[-1])
    scored = forest.isolation_forest_score(scored, trained)
    return classify_alert_severity(anomaly.ensemble_anomaly_score(scored))


def run(spark: SparkSession, s: Settings, raw: DataFrame | None = None) -> dict[str, DataFrame]:
    """Run every stage; each writes its table and the next one reads it."""
    stages, store = Stages(s.root), ModelStore(spark, f"{s.root}/store")
    clean = clean_stage(spark, stages, s, raw)
    features = feature_stage(spark, stages, s, clean)
    metrics = model_stage(spark, store, s, features)
    anomalies = anomaly_stage(clean, s)
    write_parquet(anomalies, f"{s.root}/processed/anomalies.parquet")
    report = energy.optimization_report(clean, ts=s.spec.order)
    write_report(report, f"{s.root}/reports/energy")
    anomalies = read_parquet(spark, f"{s.root}/processed/anomalies.parquet")
    return {"clean": clean, "quality": profile.quality_report(clean), "features": features, "metrics": metrics,
            "severity": profile.value_counts(anomalies, "severity"), "report": report}


def main() -> None:
    parser = argparse.ArgumentParser(description="run the batch job on raw/readings.csv under a folder")
    parser.add_argument("root")
    spark = build_session()
    for name, table in run(spark, Settings(parser.parse_args().root)).items():
        if name in ("metrics", "severity"):
            table.show(50, truncate=False)
    drop_staged(spark)


if __name__ == "__main__":
    main()
