"""Probability calibration from inner folds."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidebar.models.base import LABEL, Fitted, Model, with_vector
from tidebar.models.boosting import Task
from tidebar.operators.metrics import brier_improvement, brier_score

c = F.col
METHODS = ("none", "platt", "isotonic")


def _calibrator(scored: DataFrame, method: str):
    """Map from ``proba`` to a calibrated probability, fitted on held-out scores."""
    one = VectorAssembler(inputCols=["proba"], outputCol="__p")
    rows = one.transform(scored.select("proba", c(LABEL).cast("double").alias(LABEL)))
    if method == "platt":
        model = LogisticRegression(featuresCol="__p", labelCol=LABEL, maxIter=100).fit(rows)

        def apply(df: DataFrame) -> DataFrame:
            out = model.transform(one.transform(df))
            return out.select(*df.columns, vector_to_array("probability")[1].alias("__cal"))
    else:
        model = IsotonicRegression(featuresCol="__p", labelCol=LABEL).fit(rows)

        def apply(df: DataFrame) -> DataFrame:
            out = model.transform(one.transform(df))
            return out.select(*df.columns, c("prediction").alias("__cal"))

    return apply


def calibrated(
    model: Model, df: DataFrame, features: Sequence[str], method: str = "platt", cv: int = 3,
    weight: str | None = None, row: str = "row_idx",
) -> Fitted:
    """cv models, each calibrated on the part it did not see; probabilities are averaged.

    Parts are runs of consecutive times (``row``: position on the calendar of all series). A part whose rows are all of one
    class cannot be calibrated on: that is an error.
    """
    if method not in METHODS:
        raise ValueError(f"unknown calibration '{method}', use one of {METHODS}")
    if method == "none":
        return model.fit(df, features, weight)
    rows = with_vector(df, features)
    first, last = df.agg(F.min(row), F.max(row)).first()
    part = F.least(F.floor((c(row) - F.lit(first)) * F.lit(cv) / F.lit(last - first + 1)), F.lit(cv - 1))
    seen = {r[0]: r[1] for r in df.groupBy(part.alias("part")).agg(F.count_distinct(LABEL)).collect()}
    if any(seen.get(k, 0) < 2 for k in range(cv)):
        raise ValueError(f"calibration in {cv} parts needs rows of both classes in each; found {seen}")
    edges = [first + -(-k * (last - first + 1) // cv) for k in range(cv + 1)]
    tasks = [Task(skip=(edges[k], edges[k + 1])) for k in range(cv)]
    pairs = []
    for k, fitted in enumerate(model.fit_tasks(rows, features, tasks, weight)):
        pairs.append((fitted, _calibrator(fitted.score_rows(rows.filter(part == k)), method)))

    def score(data: DataFrame) -> DataFrame:
        out = data
        for k, (fitted, apply) in enumerate(pairs):
            one = apply(fitted.score_rows(out).select(*out.columns, "proba"))
            out = one.select(*out.columns, c("__cal").alias(f"__cal{k}"))
        mean = sum((c(f"__cal{k}") for k in range(1, cv)), c("__cal0")) / cv
        out = out.select(*data.columns, mean.alias("proba"))
        return out.withColumn("probs", F.array(1 - c("proba"), c("proba"))).withColumn(
            "y_pred", (c("proba") > 0.5).cast("int")
        )

    importances = [sum(f.importances[i] for f, _ in pairs) / cv for i in range(len(features))]
    return Fitted(list(features), score, importances, {"pairs": pairs})


def calibration_report(plain: Fitted, tuned: Fitted, valid: DataFrame) -> DataFrame:
    """Brier score before and after on validation rows, and the relative gain."""
    scored = plain.score(valid).withColumnRenamed("proba", "__plain").drop("y_pred", "probs")
    scored = tuned.score(scored)
    both = scored.agg(brier_score("__plain", LABEL).alias("orig_brier"), brier_score("proba", LABEL).alias("calib_brier"))
    return both.withColumn("brier_improvement", brier_improvement(c("orig_brier"), c("calib_brier")))
