"""A scorer with given weights, for models that are written down instead of trained."""

from __future__ import annotations

from pyspark.ml import Transformer
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class WeightedScorer(Transformer):
    """Logistic score of a weighted sum: adds `probability` (both classes) and `prediction` (class at one half)."""

    def __init__(self, weights: dict[str, float], bias: float = 0.0):
        super().__init__()
        self.weights, self.bias = weights, bias

    def _transform(self, dataset: DataFrame) -> DataFrame:
        z: Column = F.lit(float(self.bias))
        for name, weight in self.weights.items():
            z = z + F.lit(float(weight)) * F.col(name)
        p = 1 / (1 + F.exp(-z))
        scored = dataset.withColumn("probability", array_to_vector(F.array(1 - p, p)))
        return scored.withColumn("prediction", (p > 0.5).cast("double"))
