"""Trained models on shared storage (Spark ML persistence plus a small description)."""

from __future__ import annotations

import json

from pyspark.ml.classification import GBTClassificationModel, LogisticRegressionModel
from pyspark.sql import SparkSession

from tidebar.models.base import Fitted
from tidebar.models.boosting import Booster
from tidebar.models.stacking import stack_from
from tidebar.models.trees import classes_from, regression_from

SECOND = {"logistic": LogisticRegressionModel, "trees": GBTClassificationModel}
TREE = "column int, number int, feature array<int>, cut array<double>, value array<double>"


def save_model(spark: SparkSession, fitted: Fitted, path: str) -> None:
    """Write a tree or stacked model with its feature names and threshold: one row a tree."""
    kind = fitted.stages.get("kind")
    if kind is None:
        raise ValueError("only tree and stacked models can be saved")
    about = {"kind": kind, "features": fitted.features, "threshold": fitted.threshold}
    about |= {k: v for k, v in fitted.stages.items() if isinstance(v, bool)}
    if kind == "stack":
        model = fitted.stages["model"]
        about |= {"second": "logistic" if isinstance(model, LogisticRegressionModel) else "trees", "bases": len(fitted.stages["bases"])}
        for i, base in enumerate(fitted.stages["bases"]):
            save_model(spark, base, f"{path}/base_{i}")
        model.write().overwrite().save(f"{path}/model")
    else:
        booster = fitted.stages["booster"]
        about |= {"objective": booster.objective, "base": booster.base}
        rows = [(k, i, *tree) for k, trees in enumerate(booster.trees) for i, tree in enumerate(trees)]
        spark.createDataFrame(rows, TREE).write.mode("overwrite").parquet(f"{path}/model")
    spark.createDataFrame([(json.dumps(about),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/about")


def load_model(spark: SparkSession, path: str) -> Fitted:
    about = json.loads(spark.read.text(f"{path}/about").first()[0])
    kind = about["kind"]
    if kind == "stack":
        model = SECOND[about["second"]].load(f"{path}/model")
        bases = [load_model(spark, f"{path}/base_{i}") for i in range(about["bases"])]
        return stack_from(model, bases, about["features"], about["use_proba"], about["passthrough"])
    trees = [[] for _ in about["base"]]
    for r in spark.read.parquet(f"{path}/model").orderBy("column", "number").collect():  # the trees of one model
        trees[r["column"]].append((r["feature"], r["cut"], r["value"]))
    booster = Booster(about["features"], about["objective"], about["base"], trees)
    if kind == "regressor":
        return regression_from(booster, about["threshold"], about["continuous"])
    return classes_from(booster)
