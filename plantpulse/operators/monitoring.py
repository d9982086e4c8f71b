"""Drift, model performance and job health."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plantpulse.functions.grading import percent
from plantpulse.operators.alerts import alert_summary
from plantpulse.operators.profile import long_stats, unfolded
from plantpulse.schema import numeric_columns

Z_LIMIT = 3.0
ACCURACY_LIMIT = 0.8
RUNS_LIMIT = 0.9
WIDE = 40


def drift_fit(reference: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Mean, std, min and max per numeric column."""
    names = columns or numeric_columns(reference)
    if len(names) > WIDE:
        return unfolded(reference, names, set(names)).groupBy("feature").agg(
            F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"),
            F.min("value").alias("min"), F.max("value").alias("max"))
    return long_stats(reference, names, {
        "mean": F.avg, "std": F.stddev_samp,
        "min": lambda c: F.min(c).cast("double"), "max": lambda c: F.max(c).cast("double")})


def stats_join(reference: DataFrame, new: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Reference and new statistics side by side; the reference is one row per column, the new ones per `by` and column."""
    return reference.select(
        "feature", F.col("mean").alias("reference_mean"), F.col("std").alias("reference_std"),
    ).join(new.select(*(by or []), "feature", F.col("mean").alias("new_mean")), "feature")


def _z() -> Column:
    return F.try_divide(F.abs(F.col("new_mean") - F.col("reference_mean")), F.col("reference_std"))


def drift_figures(reference: DataFrame, new: DataFrame, threshold: float = Z_LIMIT,
                  by: list[str] | None = None) -> DataFrame:
    """Per feature: z-score of the new mean and whether it drifted; totals on each row, per `by` if given."""
    by = by or []
    both = stats_join(reference, new, by).filter(F.col("reference_std") > 0)
    rows = both.select(*by, "feature", _z().alias("z_score"), (_z() > threshold).alias("drifted"),
                       "reference_mean", "new_mean")
    everything = Window.partitionBy(*(by or [F.lit(0)]))  # one row per feature
    return rows.withColumns({
        "drifted_features": F.count_if("drifted").over(everything),
        "total_features": F.count(F.lit(1)).over(everything)})


def drift_detect(reference: DataFrame, new: DataFrame, columns: list[str] | None = None,
                 threshold: float = Z_LIMIT) -> DataFrame:
    """`drift_figures` of the columns of a table."""
    return drift_figures(reference, drift_fit(new, columns or numeric_columns(new)), threshold)


def drift_score(reference: DataFrame, new: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Mean shift in reference deviations over the shared columns; 0 when none qualifies."""
    names = columns or [c for c in numeric_columns(new) if c in numeric_columns(reference)]
    both = stats_join(drift_fit(reference, names), drift_fit(new, names)).filter(F.col("reference_std") > 0)
    return both.agg(F.coalesce(F.avg(_z()), F.lit(0.0)).alias("drift_score"))


def degradation_check(log: DataFrame, prediction="prediction", actual="actual") -> DataFrame:
    """Accuracy of labelled predictions; exactly at the limit counts as healthy."""
    labelled = log.filter(F.col(actual).isNotNull())
    out = labelled.agg(F.avg((F.col(prediction) == F.col(actual)).cast("double")).alias("accuracy"))
    accuracy = F.col("accuracy")
    return out.select(
        F.when(accuracy.isNull(), "unknown").when(accuracy < ACCURACY_LIMIT, "degraded")
        .otherwise("healthy").alias("status"),
        "accuracy", F.lit(ACCURACY_LIMIT).alias("threshold"),
        F.when(accuracy.isNull(), "No data").otherwise(
            F.concat(F.lit("Model accuracy: "), percent(accuracy * 100, 2))).alias("message"))


def performance_report(log: DataFrame, prediction="prediction", actual="actual",
                       drift: DataFrame | None = None) -> DataFrame:
    """State of the prediction log; exactly at the limit counts as degraded."""
    out = log.agg(
        F.count(F.lit(1)).alias("total_predictions"), F.count(actual).alias("labeled_predictions"),
        F.avg((F.col(prediction) == F.col(actual)).cast("double")).alias("accuracy"))
    status = (F.when(F.col("total_predictions") == 0, "no_data")
              .when(F.col("labeled_predictions") == 0, "waiting_for_labels")
              .when(F.col("accuracy") > ACCURACY_LIMIT, "healthy").otherwise("degraded"))
    shift = drift.select("drift_score").scalar() if drift is not None else F.lit(0.0)
    return out.select(status.alias("status"), *out.columns, shift.alias("drift_score"))


def recent_health(runs: DataFrame, name: str = "pipeline", order: tuple[str, ...] = ("ts",),
                  recent: int = 10) -> DataFrame:
    """Success rate and mean duration of the last runs per job."""
    w = Window.partitionBy(name).orderBy(*[F.col(c).desc() for c in order])
    last = runs.withColumn("__rn", F.row_number().over(w)).filter(F.col("__rn") <= recent)
    out = last.groupBy(name).agg(
        F.count(F.lit(1)).alias("recent_runs"),
        F.avg((F.col("status") == "success").cast("double")).alias("success_rate"),
        F.avg("duration_seconds").alias("avg_duration_seconds"), F.max(order[0]).alias("last_run"))
    health = F.when(F.col("success_rate") > RUNS_LIMIT, "healthy").otherwise("degraded")
    return out.withColumn("status", health)


def monitoring_report(log: DataFrame, alerts: DataFrame, runs: DataFrame,
                      order: tuple[str, ...] = ("ts",)) -> DataFrame:
    """Model performance, alerts and job health as one nested row."""
    model = performance_report(log)
    summary = alert_summary(alerts).agg(F.struct(
        F.coalesce(F.max("total_alerts"), F.lit(0)).alias("total_alerts"),
        F.coalesce(F.max("active"), F.lit(0)).alias("active"),
        F.coalesce(F.max("acknowledged"), F.lit(0)).alias("acknowledged"),
        F.map_from_entries(F.collect_list(F.struct("severity", "count"))).alias("by_severity"),
    ).alias("s")).scalar()
    health = recent_health(runs, order=order).groupBy().agg(F.map_from_entries(F.collect_list(F.struct(
        "pipeline", F.struct("status", "recent_runs", "success_rate", "avg_duration_seconds", "last_run"),
    ))).alias("h")).scalar()
    return model.select(F.struct(*model.columns).alias("model_performance"),
                        summary.alias("alerts"), health.alias("pipelines"))
