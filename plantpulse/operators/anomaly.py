"""Anomaly flags and scores against global statistics."""

from __future__ import annotations

from pyspark.ml.feature import PCA, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plantpulse.operators.quantiles import quantile_values, quantiles
from plantpulse.schema import flag
from plantpulse.session import staged

WEIGHTS = {"zscore": 0.3, "iqr": 0.3, "isolation_forest": 0.4}


STATS = "__stats"


def with_stats(df: DataFrame, aggregates: dict[str, Column], name: str = STATS) -> DataFrame:
    """Put one-row statistics of the table next to every row, as one struct column.

    It is a scalar subquery: computed once, one row, no join.
    """
    one = df.agg(F.struct(*[e.alias(n) for n, e in aggregates.items()]).alias("s")).scalar()
    return df.withColumn(name, one)


def attach_stats(df: DataFrame, aggregates: dict[str, Column]) -> DataFrame:
    out = with_stats(df, aggregates)
    return out.select(*df.columns, *[F.col(STATS)[n].alias(n) for n in aggregates])


def _count(columns: list[str], suffix: str) -> Column:
    return sum((F.col(f"{c}{suffix}") for c in columns), F.lit(0))


def zscore_anomaly_detection(df: DataFrame, columns: list[str], threshold: float = 3.0) -> DataFrame:
    s = F.col(STATS)
    out = with_stats(df, {k: e for c in columns for k, e in (
        (f"{c}_mean", F.avg(c)), (f"{c}_std", F.stddev_samp(c)))})
    z = {f"{c}_zscore": F.try_divide(F.col(c) - s[f"{c}_mean"], s[f"{c}_std"]) for c in columns}
    out = out.withColumns(z).drop(STATS)
    out = out.withColumns({f"{c}_is_anomaly_zscore": flag(F.abs(f"{c}_zscore") > threshold) for c in columns})
    return out.withColumn("zscore_anomaly_count", _count(columns, "_is_anomaly_zscore"))


def iqr_anomaly_detection(df: DataFrame, columns: list[str], multiplier: float = 1.5) -> DataFrame:
    q = quantiles(df, columns, [0.25, 0.75])

    def outside(c: str) -> Column:
        spread = (q[c][1] - q[c][0]) * multiplier
        return flag((F.col(c) < q[c][0] - spread) | (F.col(c) > q[c][1] + spread))

    out = df.withColumns({f"{c}_is_anomaly_iqr": outside(c) for c in columns})
    return out.withColumn("iqr_anomaly_count", _count(columns, "_is_anomaly_iqr"))


def standardize(df: DataFrame, columns: list[str], suffix: str = "_scaled") -> DataFrame:
    """Missing to 0, then (x - mean) / population std, a zero std counting as 1."""
    filled = {c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in columns}
    out = with_stats(df, {k: e for c, x in filled.items() for k, e in (
        (f"{c}_mean", F.avg(x)), (f"{c}_std", F.stddev_pop(x)))})

    def scaled(c: str) -> Column:
        mean, std = F.col(STATS)[f"{c}_mean"], F.col(STATS)[f"{c}_std"]
        return (filled[c] - mean) / F.when(std == 0, 1.0).otherwise(std)

    return out.withColumns({f"{c}{suffix}": scaled(c) for c in columns}).drop(STATS)


def ensemble_anomaly_score(
    df: DataFrame, weights: dict[str, float] | None = None, invert_isolation: bool = False,
) -> DataFrame:
    """Weighted sum of the parts that exist, without re-normalising the weights.

    An isolation score is high for normal rows and is added as it is, unless
    `invert_isolation` turns it round.
    """
    weights = weights or WEIGHTS
    have, stats = set(df.columns), {}
    for part in ("zscore", "iqr"):
        if f"{part}_anomaly_count" in have:
            stats[f"{part}_top"] = F.max(f"{part}_anomaly_count")
    if "if_score" in have:
        stats |= {"if_low": F.min("if_score"), "if_high": F.max("if_score")}
    if not stats:
        return df
    s = F.col(STATS)
    parts = {}
    for part in ("zscore", "iqr"):
        if f"{part}_top" in stats:
            top = s[f"{part}_top"]
            parts[part] = (f"{part}_normalized", F.try_divide(F.col(f"{part}_anomaly_count"), top))
    if "if_low" in stats:
        value = F.try_divide(F.col("if_score") - s["if_low"], s["if_high"] - s["if_low"])
        parts["isolation_forest"] = ("if_normalized", 1 - value if invert_isolation else value)
    out = with_stats(df, stats).withColumns(dict(parts.values())).drop(STATS)
    score = F.lit(0.0)
    for part, weight in weights.items():
        if part in parts:
            score = score + weight * F.col(parts[part][0])
    out = out.withColumn("ensemble_score", score)
    return out.withColumn("ensemble_anomaly", flag(F.col("ensemble_score") > 0.5))


# --- linear reconstruction ------------------------------------------------------

class Reconstruction:
    """Principal components of the standardised columns; rows far from them are odd."""

    def __init__(self, columns: list[str], center: dict[str, float], scale: dict[str, float], model):
        self.columns, self.center, self.scale, self.model = columns, center, scale, model

    def _vector(self, df: DataFrame) -> DataFrame:
        scaled = [((F.coalesce(F.col(c).cast("double"), F.lit(0.0)) - self.center[c]) / self.scale[c])
                  .alias(f"__x_{c}") for c in self.columns]
        names = [f"__x_{c}" for c in self.columns]
        wide = df.select("*", *scaled)
        return VectorAssembler(inputCols=names, outputCol="__x").transform(wide).drop(*names)

    def error(self, df: DataFrame, name: str = "mse") -> DataFrame:
        """Mean squared residual: components are orthonormal, so |x|^2 - |projection|^2."""
        out = self.model.transform(self._vector(df))

        def norm(c: str) -> Column:
            return F.aggregate(vector_to_array(F.col(c)), F.lit(0.0), lambda a, v: a + v * v)

        gap = F.greatest(norm("__x") - norm("__p"), F.lit(0.0)) / len(self.columns)
        return out.withColumn(name, gap).drop("__x", "__p")


def reconstruction_fit(df: DataFrame, columns: list[str], encoding_dim: int = 32) -> Reconstruction:
    filled = {c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in columns}
    row = df.agg(*[F.avg(e).alias(f"m_{c}") for c, e in filled.items()],
                 *[F.stddev_pop(e).alias(f"s_{c}") for c, e in filled.items()]).first()
    fit = Reconstruction(columns, {c: row[f"m_{c}"] for c in columns},
                         {c: row[f"s_{c}"] or 1.0 for c in columns}, None)
    k = min(encoding_dim, len(columns))
    fit.model = PCA(k=k, inputCol="__x", outputCol="__p").fit(fit._vector(df.select(*columns)))
    return fit


def error_flags(df: DataFrame, error: str = "mse", threshold: float | None = None) -> DataFrame:
    """Flag errors above the given threshold, or above their 95th percentile."""
    if threshold is not None:
        out = df.withColumn("threshold", F.lit(float(threshold)))
    else:
        df = staged(df, "errors")  # every quantile pass reads the errors
        out = df.withColumn("threshold", quantiles(df, [error], [0.95])[error][0])
    return out.withColumn("is_anomaly", flag(F.col(error) > F.col("threshold")))


def error_threshold(df: DataFrame, error: str = "mse", q: float = 0.95) -> float:
    return quantile_values(df, [error], [q])[error][0]
