"""Training sets, classifiers, evaluation and scoring."""

from __future__ import annotations

import time
import warnings
from collections.abc import Callable

from pyspark.ml import Estimator, Model, Pipeline, Transformer
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import LinearRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plantpulse.functions.grading import class_name, recommendations, severity_of_probability
from plantpulse.operators.boosting import LeafwiseClassifier
from plantpulse.operators.levelwise import LevelwiseClassifier
from plantpulse.operators.order import (
    READINGS, SeriesSpec, before, lay_out, rows_at, running_sums, with_row_number,
)
from plantpulse.operators.randomforest import ForestClassifier
from plantpulse.operators.select import align_schema, tail_n
from plantpulse.session import staged

LABEL = "failure_imminent"


# --- training sets --------------------------------------------------------------

def time_split(df: DataFrame, features: list[str], label: str = LABEL, test_size: float = 0.2,
               spec: SeriesSpec = READINGS) -> DataFrame:
    """Complete rows with `split` = train for the first int(n*(1-test)) in order, else test.

    Only the sort columns are positioned; the wide rows are split by comparison.
    """
    clean = df.na.drop(subset=[*features, label])
    bound = rows_at(clean, spec, lambda n: [int(n * (1 - test_size))])[0]
    return clean.withColumn("split", F.when(before(spec, bound), "train").otherwise("test"))


def undersample(df: DataFrame, label: str, key: str) -> DataFrame:
    """All rows of the smaller class and as many of the other, drawn by md5 of the row key."""
    sizes = {r[label]: r.n for r in df.groupBy(label).agg(F.count(F.lit(1)).alias("n")).limit(3).collect()}
    if len(sizes) != 2:
        raise ValueError(f"two classes needed, found {sorted(sizes)}")
    least = min(sizes.values())
    drawn = df.withColumn("__draw", F.md5(F.col(key).cast("string")))
    spec = SeriesSpec(keys=(label,), order="__draw", tiebreak=(key,))
    # order the larger class only, and only its key columns
    smaller, larger = sorted(sizes, key=lambda c: (sizes[c], c))
    place = with_row_number(lay_out(
        drawn.filter(F.col(label) == larger).select(label, "__draw", key), spec), "__at").frame()
    ids = place.filter(F.col("__at") < least).select(key)
    return df.filter(F.col(label) == smaller).unionByName(
        df.filter(F.col(label) == larger).join(ids, key, "left_semi").select(*df.columns))


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """n/(k*n_c) per class and the positive-class scale neg/max(pos, 1)."""
    per = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    total = per.agg(F.struct(
        F.sum("n").alias("n"), F.count(F.lit(1)).alias("k"),
        F.coalesce(F.sum(F.when(F.col(label) == 1, F.col("n"))), F.lit(0)).alias("pos"),
        F.coalesce(F.sum(F.when(F.col(label) == 0, F.col("n"))), F.lit(0)).alias("neg")).alias("t")).scalar()
    return per.select(
        label, "n", (total["n"] / (total["k"] * F.col("n"))).alias("balanced_weight"),
        (total["neg"] / F.greatest(total["pos"], F.lit(1))).alias("scale_pos_weight"))


def with_class_weight(df: DataFrame, label: str, scheme: str = "balanced", name: str = "weight") -> DataFrame:
    """Weight column, from one row per class; rows without a label drop out.

    The classes are few rows and are sent to every task, so no row is dealt by its label.
    """
    w = class_weights(df, label)
    if scheme == "balanced":
        value = F.col("balanced_weight")
    else:
        value = F.when(F.col(label) == 1, F.col("scale_pos_weight")).otherwise(1.0)
    return df.join(F.broadcast(w.select(label, value.alias(name))), label)


def fold_ids(df: DataFrame, n_splits: int = 5, spec: SeriesSpec = READINGS) -> DataFrame:
    """Block number per row: fold i validates block i and trains on every smaller one (0 = train only)."""
    def starts(n: int) -> list[int]:
        block = n // (n_splits + 1)
        if block == 0:
            raise ValueError(f"{n} rows are too few for {n_splits} folds")
        return [n - (n_splits - i) * block for i in range(n_splits)]

    fold = F.lit(0)
    for i, bound in enumerate(rows_at(df, spec, starts)):
        fold = F.when(~before(spec, bound), F.lit(i + 1)).otherwise(fold)
    return df.withColumn("fold", fold)


# --- models ---------------------------------------------------------------------

def assembled(features: list[str], estimator: Estimator) -> Pipeline:
    return Pipeline(stages=[VectorAssembler(inputCols=features, outputCol="features"), estimator])


def random_forest(label: str = LABEL, trees: int = 100, max_depth: int = 30, seed: int = 42, **params) -> Estimator:
    settings = {"labelCol": label, "numTrees": trees, "maxDepth": max_depth, "seed": seed,
                "weightCol": "weight", **params}
    return ForestClassifier(**settings)


def boosted_trees(label: str = LABEL, rounds: int = 100, max_depth: int = 6, rate: float = 0.1,
                  seed: int = 42, **params) -> Estimator:
    settings = {"labelCol": label, "maxIter": rounds, "maxDepth": max_depth, "stepSize": rate, "seed": seed,
                "weightCol": "weight", **params}
    return LevelwiseClassifier(**settings)


def leafwise_trees(label: str = LABEL, rounds: int = 100, leaves: int = 31, rate: float = 0.1, **params) -> Estimator:
    return LeafwiseClassifier(labelCol=label, weightCol="weight", rounds=rounds, leaves=leaves, rate=rate, **params)


# estimator and class weights of each kind of model
KINDS = {"random_forest": (random_forest, "balanced"), "lightgbm": (leafwise_trees, "balanced"),
         "xgboost": (boosted_trees, "positive")}


def train_classifier(df: DataFrame, features: list[str], kind: str = "random_forest", label: str = LABEL,
                     **params) -> Model:
    """`random_forest` and `lightgbm` weigh classes evenly, `xgboost` scales the positive class.

    `lightgbm` grows its trees leaf by leaf, `xgboost` level by level.
    """
    make, scheme = KINDS[kind]
    data = with_class_weight(df.select(*features, label), label, scheme)
    return assembled(features, make(label, **params)).fit(data)


def train_ensemble(df: DataFrame, features: list[str], makers: dict[str, Callable[[], Estimator]] | None = None,
                   label: str = LABEL, schemes: dict[str, str] | None = None) -> dict[str, Model]:
    """Fit several models, each with its own class weights; one that fails is skipped with a warning."""
    makers = makers or {"rf": lambda: random_forest(label), "xgb": lambda: boosted_trees(label),
                        "lgb": lambda: leafwise_trees(label)}
    schemes = schemes or {"xgb": "positive"}
    out = {}
    for name, make in makers.items():
        data = with_class_weight(df.select(*features, label), label, schemes.get(name, "balanced"))
        try:
            out[name] = assembled(features, make()).fit(data)
        except Exception as error:
            warnings.warn(f"model {name} failed to train: {error}")
    return out


def score(df: DataFrame, model: Transformer, prediction="prediction", probability="probability") -> DataFrame:
    """Class and class-1 probability next to every row."""
    out = model.transform(df)
    return out.select(
        *df.columns, F.col("prediction").cast("int").alias(prediction),
        vector_to_array(F.col("probability"))[1].alias(probability))


def ensemble_predict(df: DataFrame, models: dict[str, Transformer]) -> DataFrame:
    """Mean class-1 probability over all models, and the class at one half."""
    names = []
    for i, model in enumerate(models.values()):
        names.append(f"__p{i}")
        df = score(df, model, "__class", names[-1]).drop("__class")
    mean = sum((F.col(n) for n in names), F.lit(0.0)) / max(len(names), 1)
    out = df.withColumn("probability", mean).drop(*names)
    return out.withColumn("prediction", (F.col("probability") > 0.5).cast("int"))


def batch_score(df: DataFrame, model: Transformer, features: list[str], last: int | None = None,
                spec: SeriesSpec = READINGS) -> DataFrame:
    """Clean, align and score readings: class, probability, severity and advice."""
    from plantpulse.operators.windows import impute_zero

    rows = df if last is None else tail_n(df, last, spec)
    clean = impute_zero(rows, [c for c in features if c in rows.columns])
    extra = [c for c in clean.columns if c not in features]
    ready = align_schema(clean, [*extra, *features])
    return advised(score(ready, model))


def advised(scored: DataFrame) -> DataFrame:
    prediction, probability = F.col("prediction"), F.col("probability")
    return scored.withColumns({
        "label": class_name(prediction), "severity": severity_of_probability(probability),
        "recommendations": recommendations(prediction, probability)})


def top_features(model: Model, features: list[str], spark, top_n: int = 20) -> DataFrame:
    """Importances of the last stage, largest first; empty when the model has none."""
    stage = model.stages[-1] if hasattr(model, "stages") else model
    vector = getattr(stage, "featureImportances", None)
    pairs = [] if vector is None else [(f, float(v)) for f, v in zip(features, vector.toArray())]
    table = spark.createDataFrame(pairs, "feature string, importance double")
    return table.orderBy(F.desc("importance"), "feature").limit(top_n)


# --- evaluation -----------------------------------------------------------------

def confusion(df: DataFrame, label: str, prediction="prediction") -> DataFrame:
    return df.groupBy(F.col(label).cast("int").alias("label"), F.col(prediction).cast("int").alias("prediction")
                      ).agg(F.count(F.lit(1)).alias("n"))


def classifier_metrics(df: DataFrame, label: str, prediction="prediction", probability="probability") -> DataFrame:
    """Accuracy, confusion counts, per-class and averaged scores and AUC, as (metric, value).

    Everything but the AUC follows from the four confusion counts. The scores are computed once.
    """
    df = staged(df.select(label, prediction, probability), "scored")
    cell = {(a, b): F.coalesce(F.sum(F.when((F.col("label") == a) & (F.col("prediction") == b), F.col("n"))),
                               F.lit(0)).cast("double") for a in (0, 1) for b in (0, 1)}
    c = confusion(df, label, prediction).agg(*[e.alias(f"c{a}{b}") for (a, b), e in cell.items()])
    col = {k: F.col(f"c{k[0]}{k[1]}") for k in cell}
    total = sum(col.values(), F.lit(0.0))
    out: dict[str, Column] = {"accuracy": F.try_divide(col[0, 0] + col[1, 1], total)}
    for a in (0, 1):
        for b in (0, 1):
            out[f"confusion_{a}_{b}"] = col[a, b]

    def ratio(x: Column, y: Column) -> Column:
        return F.coalesce(F.try_divide(x, y), F.lit(0.0))

    support, per = {}, {}
    for k in (0, 1):
        o = 1 - k
        support[k] = col[k, 0] + col[k, 1]
        p, r = ratio(col[k, k], col[k, k] + col[o, k]), ratio(col[k, k], support[k])
        per[k] = {"precision": p, "recall": r, "f1": ratio(2 * p * r, p + r)}
        out |= {f"{m}_{k}": e for m, e in per[k].items()} | {f"support_{k}": support[k]}
    for m in ("precision", "recall", "f1"):
        out[f"{m}_macro"] = (per[0][m] + per[1][m]) / 2
        out[f"{m}_weighted"] = F.try_divide(per[0][m] * support[0] + per[1][m] * support[1], total)
    auc = roc_auc(df, label, probability).scalar()
    rows = F.array(*[F.struct(F.lit(m).alias("metric"), e.alias("value")) for m, e in out.items()],
                   F.struct(F.lit("roc_auc").alias("metric"), auc.alias("value")))
    return c.select(F.inline(rows))


def roc_auc(df: DataFrame, label: str, probability="probability") -> DataFrame:
    """Area under the ROC curve from counts per distinct score; missing with one class only."""
    per = df.groupBy(F.col(probability).alias("score")).agg(
        F.sum(F.when(F.col(label) == 1, 1).otherwise(0)).alias("pos"),
        F.sum(F.when(F.col(label) == 0, 1).otherwise(0)).alias("neg"))
    ranked = running_sums(per, "score", {"below": "neg"})
    wins = F.sum(F.col("pos") * (F.col("below") + F.col("neg") / 2.0))
    return ranked.agg(F.try_divide(wins, F.sum("pos").cast("double") * F.sum("neg")).alias("roc_auc"))


def ts_cross_validate(df: DataFrame, features: list[str], make: Callable[[], Estimator], label: str = LABEL,
                      n_splits: int = 5, spec: SeriesSpec = READINGS) -> DataFrame:
    """Accuracy per expanding fold, with mean and population std on each row."""
    folded = fold_ids(df, n_splits, spec)
    scores = []
    for i in range(1, n_splits + 1):
        train, check = folded.filter(F.col("fold") < i), folded.filter(F.col("fold") == i)
        model = assembled(features, make()).fit(with_class_weight(train, label))
        hit = (F.col("prediction") == F.col(label)).cast("double")
        scores.append((i, model.transform(check).agg(F.avg(hit)).first()[0]))
    table = df.sparkSession.createDataFrame(scores, "fold int, score double")
    s = table.agg(F.struct(F.avg("score").alias("m"), F.stddev_pop("score").alias("s")).alias("s")).scalar()
    return table.select("fold", "score", s["m"].alias("mean_score"), s["s"].alias("std_score"))


# --- regression -----------------------------------------------------------------

def linear_baseline(df: DataFrame, features: list[str], target: str = "Power") -> tuple[Model, DataFrame]:
    """Least squares on complete rows, with mse, rmse and r2 on those rows."""
    clean = df.select(*features, target).na.drop()
    fit = assembled(features, LinearRegression(
        labelCol=target, featuresCol="features", solver="normal", regParam=0.0)).fit(clean)
    gap = F.col(target) - F.col("prediction")
    metrics = fit.transform(clean).agg(
        F.avg(gap * gap).alias("mse"), F.sqrt(F.avg(gap * gap)).alias("rmse"),
        (1 - F.try_divide(F.avg(gap * gap), F.var_pop(target))).alias("r2_score"))
    return fit, metrics


def demand_predict(model: Transformer, df: DataFrame, features: list[str], name="predicted_power") -> DataFrame:
    """Predictions with missing inputs taken as 0."""
    filled = df.withColumns({f: F.coalesce(F.col(f).cast("double"), F.lit(0.0)) for f in features})
    out = model.transform(filled).select(*df.columns, "prediction")
    return out.withColumnRenamed("prediction", name)


def timed_training(df: DataFrame, features: list[str], kinds: dict[str, dict], label: str = LABEL) -> DataFrame:
    """Train each kind, evaluate on the test rows, and return one history row per model."""
    train, test = (df.filter(F.col("split") == part) for part in ("train", "test"))
    rows = []
    for kind, params in kinds.items():
        start = time.time()
        model = train_classifier(train, features, kind, label, **params)
        seconds = time.time() - start
        scored = staged(score(test, model).select(label, "prediction", "probability"), "scored")
        accuracy = scored.agg(F.avg((F.col("prediction") == F.col(label)).cast("double"))).first()[0]
        auc = roc_auc(scored, label).first()[0]
        rows.append((kind, kind, accuracy, auc, seconds, len(features)))
    return df.sparkSession.createDataFrame(
        rows, "model_name string, model_type string, accuracy double, roc_auc double, "
              "training_seconds double, features int").withColumn("trained_at", F.current_timestamp())
