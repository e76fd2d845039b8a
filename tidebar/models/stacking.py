"""Stacked boosted trees with a logistic (or tree) second layer."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidebar.models.base import FEATURES, LABEL, WEIGHT, Fitted, Model, balanced_weight, class_counts, create_model, register_model, with_vector
from tidebar.models.boosting import Task, predictions
from tidebar.session import materialize

c = F.col

# fixed values: parameters of the four first-layer models
BASE_MODELS = [
    {"name": "deep", "params": {"n_estimators": 600, "max_depth": 6, "learning_rate": 0.05, "subsample": 0.8,
                                "colsample_bytree": 0.7, "min_child_samples": 20, "random_state": 42}},
    {"name": "shallow", "params": {"n_estimators": 800, "max_depth": 3, "learning_rate": 0.03, "subsample": 0.7,
                                   "colsample_bytree": 0.5, "min_child_samples": 40, "random_state": 123}},
    {"name": "wide", "params": {"n_estimators": 500, "max_depth": 5, "learning_rate": 0.08, "subsample": 0.9,
                                "colsample_bytree": 0.8, "min_child_samples": 15, "random_state": 456}},
    {"name": "conservative", "params": {"n_estimators": 400, "max_depth": 4, "learning_rate": 0.02, "subsample": 0.6,
                                        "colsample_bytree": 0.4, "min_child_samples": 50, "random_state": 789}},
]


def first_layer(df: DataFrame, fitted: Sequence[Fitted], use_proba: bool) -> DataFrame:
    """One column per first-layer model."""
    used = "proba" if use_proba else "y_pred"
    for i, m in enumerate(fitted):
        df = m.score_rows(df).select(*df.columns, c(used).cast("double").alias(f"__m{i}"))
    return df


def second_input(models: int, passthrough: bool) -> VectorAssembler:
    names = [f"__m{i}" for i in range(models)]
    return VectorAssembler(inputCols=[*names, FEATURES] if passthrough else names, outputCol="__meta")


def stack_from(meta, bases: Sequence[Fitted], features: Sequence[str], use_proba: bool, passthrough: bool) -> Fitted:
    """Scoring with trained layers; importance is the mean of the normalised first-layer importances."""
    assemble = second_input(len(bases), passthrough)

    def score(data: DataFrame) -> DataFrame:
        out = meta.transform(assemble.transform(first_layer(data, bases, use_proba)))
        probs = vector_to_array("probability")
        return out.select(
            *data.columns, probs.alias("probs"), probs[1].alias("proba"), c("prediction").cast("int").alias("y_pred")
        )

    sums = [sum(b.importances) or 1.0 for b in bases]
    mean = [sum(b.importances[i] / s for b, s in zip(bases, sums)) / len(bases) for i in range(len(features))]
    stages = {"kind": "stack", "model": meta, "bases": list(bases), "use_proba": use_proba, "passthrough": passthrough}
    return Fitted(list(features), score, mean, stages)


@register_model("stacking")
class Stacking(Model):
    """First-layer probabilities from expanding inner time splits feed the second layer.

    Needs ``row_idx``, the position of the row's time on the calendar of all series, so no split trains on what
    comes after its validation rows. The last n_cv_folds of n_cv_folds + 1 equal parts are validated in turn.
    Validation rows are scored in one pass, each by the models of its split, so the second-layer input needs no joins.
    """

    defaults = {
        "base_models": BASE_MODELS, "meta_model": "logistic", "n_cv_folds": 3, "use_proba": True,
        "passthrough": False, "auto_scale_pos_weight": True,
    }

    def fit(self, df: DataFrame, features: Sequence[str], weight: str | None = None) -> Fitted:
        p = self.params
        if p["meta_model"] not in ("logistic", "boosted_trees"):
            raise ValueError(f"unknown second layer '{p['meta_model']}'")
        rows = with_vector(df, features)
        first, last = df.agg(F.min("row_idx"), F.max("row_idx")).first()
        folds, models = p["n_cv_folds"], p["base_models"]
        size = (last - first + 1) // (folds + 1) if last is not None else 0
        starts = [last + 1 - (folds - k) * size for k in range(folds)]
        # all splits of all first-layer models, and these on all rows, grow side by side
        tasks = [Task(end=end, params=b["params"]) for b in models for end in (*starts, None)]
        base = create_model("boosted_trees", {"auto_scale_pos_weight": p["auto_scale_pos_weight"]})
        fitted = base.fit_tasks(rows, features, tasks, weight)
        final = fitted[folds :: folds + 1]
        valid = rows.filter(c("row_idx") >= starts[0]) if folds else rows.limit(0)
        split = F.least(F.floor((c("row_idx") - F.lit(starts[0])) / F.lit(max(size, 1))), F.lit(folds - 1))
        for i in range(len(models)):
            boosters = [m.stages["booster"] for m in fitted[i * (folds + 1) : i * (folds + 1) + folds]]
            probs = predictions(boosters, split)
            best = (F.array_position("__probs", F.array_max("__probs")) - 1).cast("double")
            valid = valid.withColumn("__probs", probs).withColumn(f"__m{i}", c("__probs")[1] if p["use_proba"] else best).drop("__probs")
        meta_rows = materialize(valid)
        assemble = second_input(len(models), p["passthrough"])
        counts = class_counts(meta_rows)
        scale = balanced_weight(counts, weight) if p["auto_scale_pos_weight"] else balanced_weight({}, weight)
        meta_in = assemble.transform(meta_rows).withColumn(WEIGHT, scale).withColumn(LABEL, c(LABEL).cast("double"))
        if p["meta_model"] == "logistic":
            n = sum(counts.values())
            meta = LogisticRegression(
                featuresCol="__meta", labelCol=LABEL, weightCol=WEIGHT, maxIter=1000, regParam=1.0 / max(n, 1),
                standardization=False,
            ).fit(meta_in)
        else:
            meta = GBTClassifier(
                featuresCol="__meta", labelCol=LABEL, weightCol=WEIGHT, maxIter=100, maxDepth=2, stepSize=0.1, seed=42
            ).fit(meta_in)
        return stack_from(meta, final, features, p["use_proba"], p["passthrough"])
