"""Trained models on shared storage and their registry table."""

from __future__ import annotations

import uuid

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plantpulse.sources import log

REGISTRY = ("model_name string, model_type string, path string, metrics map<string,double>, "
            "features array<string>, saved_at timestamp, event string")


class ModelStore:
    """Models are written whole; the registry only ever grows, deletions included.

    The registry holds one small row per save or delete, never per reading.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    @property
    def registry(self) -> str:
        return f"{self.root}/registry"

    def save(self, model: PipelineModel, name: str, kind: str, metrics: dict[str, float],
             features: list[str], run: str | None = None) -> str:
        """Each save has a folder of its own, so a reader of an older one keeps its files.

        With the name of a run the save is made once: repeated, it writes nothing and gives the same path.
        """
        run = run or uuid.uuid4().hex
        path = f"{self.root}/models/{name}/{log.commit_name(name, run)}"
        if not log.exists(self.spark, log.manifest(self.registry, log.commit_name(name, run))):
            model.write().overwrite().save(path)
            self._record(name, kind, path, metrics, features, "saved", run)
        return path

    def load(self, name: str | None = None) -> tuple[PipelineModel, list[str]]:
        row = self.current() if name is None else self.models().filter(F.col("model_name") == name).first()
        if row is None:
            raise KeyError(f"no model {name or 'saved yet'}")
        return PipelineModel.load(row.path), list(row.features)

    def delete(self, name: str) -> None:
        """Take a model out of the registry; its files stay for older readers."""
        self._record(name, "", "", {}, [], "deleted")

    def clear(self) -> None:
        for row in self.models().select("model_name").collect():
            self.delete(row.model_name)

    def models(self) -> DataFrame:
        """Latest entry of each model that was not deleted since."""
        if not log.live(self.spark, self.registry):
            return self.spark.createDataFrame([], REGISTRY).drop("event")
        rows = log.read(self.spark, self.registry).drop("day")
        latest = rows.groupBy("model_name").agg(F.max_by(F.struct(*rows.columns), F.struct("saved_at", "path")).alias("m"))
        return latest.select("m.*").filter(F.col("event") == "saved").drop("event")

    def current(self):
        return self.models().orderBy(F.desc("saved_at"), "model_name", "path").first()

    def _record(self, name, kind, path, metrics, features, event, run=None) -> None:
        row = self.spark.createDataFrame(
            [(name, kind, path, metrics, features, None, event)], REGISTRY)
        row = row.withColumn("saved_at", F.current_timestamp())
        log.append(row, self.registry, "saved_at", name, run)
