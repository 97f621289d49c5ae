"""Store and load fitted models with what is needed to use them."""

from __future__ import annotations

import json

from pyspark.ml import PipelineModel
from pyspark.sql import SparkSession

from tabwright.plans.learning import Trained


def save_model(trained: Trained, spark: SparkSession, path: str) -> str:
    """Write to a new folder; the label mapping travels inside the model."""
    trained.model.write().save(f"{path}/model")
    about = {
        "algorithm": trained.algorithm, "params": trained.params, "kind": trained.kind,
        "features": trained.features, "target": trained.target, "generated": trained.generated,
    }
    spark.createDataFrame([(json.dumps(about),)], "about string").coalesce(1).write.text(f"{path}/about")
    if trained.examples is not None:
        trained.examples.write.parquet(f"{path}/examples")
    return path


def load_model(spark: SparkSession, path: str) -> Trained:
    about = json.loads(spark.read.text(f"{path}/about").first()["value"])
    trained = Trained(model=PipelineModel.load(f"{path}/model"), **about)
    if trained.algorithm == "KNeighborsClassifier":
        trained.examples = spark.read.parquet(f"{path}/examples")
    return trained
