"""Boosted trees for classes and for a regression turned into classes."""

from __future__ import annotations

from collections.abc import Sequence
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidebar.models.base import LABEL, Fitted, Model, class_counts, register_model
from tidebar.models.boosting import DEFAULTS, Booster, Task, predictions, train
from tidebar.operators.metrics import optimize_threshold

c = F.col


#: Parameters that the models of this module read besides those of the booster.
KNOWN = set(DEFAULTS) | {
    "auto_scale_pos_weight", "row_column", "validation_share", "validation_least", "classification_threshold", "auto_threshold",
    "threshold_metric", "continuous",
}


def checked(params: dict[str, Any]) -> dict[str, Any]:
    """What the booster reads; a name that has no counterpart is an error."""
    unknown = set(params) - KNOWN
    if unknown:
        raise ValueError(f"parameters without a counterpart: {sorted(unknown)}")
    return {k: v for k, v in params.items() if k in DEFAULTS}


def with_row(df: DataFrame, row: str) -> DataFrame:
    return df if row in df.columns else df.withColumn(row, F.lit(0))


def held_from(df: DataFrame, p: dict[str, Any], end: int | None = None) -> int | None:
    """First of the last times, ``validation_share`` of all and ``validation_least`` at least, that tell when to stop."""
    if not p["early_stopping_rounds"]:
        return None
    rows = df if end is None else df.filter(c(p["row_column"]) < end)
    first, last = rows.agg(F.min(p["row_column"]), F.max(p["row_column"])).first()
    times = max(int((last - first + 1) * p["validation_share"]), p["validation_least"])
    if times > last - first:
        raise ValueError(f"early stopping holds out {times} times; there are {last - first + 1}")
    return last - times + 1


def classes_from(booster: Booster) -> Fitted:
    """Scoring with a trained classifier; the class is the likeliest, the lower one in a tie."""

    def score(data: DataFrame) -> DataFrame:
        out = data.withColumn("probs", predictions([booster]))
        best = F.array_position("probs", F.array_max("probs")) - 1
        return out.select(*data.columns, "probs", c("probs")[1].alias("proba"), best.cast("int").alias("y_pred"))

    return Fitted(booster.features, score, booster.importances(), {"kind": "classifier", "booster": booster})


def regression_from(booster: Booster, threshold: float, continuous: bool) -> Fitted:
    """Scoring with a trained regression."""

    def score(data: DataFrame) -> DataFrame:
        raw = predictions([booster])[0]
        value = raw if continuous else F.least(F.greatest(raw, F.lit(0.0)), F.lit(1.0))
        out = data.withColumn("__value", value).select(*data.columns, c("__value").alias("proba"))
        if continuous:
            return out.withColumn("y_pred", c("proba"))
        return out.withColumn("probs", F.array(1 - c("proba"), c("proba"))).withColumn(
            "y_pred", (c("proba") >= threshold).cast("int")
        )

    stages = {"kind": "regressor", "booster": booster, "continuous": continuous}
    return Fitted(booster.features, score, booster.importances(), stages, threshold)


@register_model("boosted_trees")
class BoostedTrees(Model):
    """Gradient-boosted trees: logistic loss for classes 0 and 1, softmax with a tree per class and round for more classes.

    ``early_stopping_rounds`` holds out the last ``validation_share`` of the times in ``row_column``, ``validation_least`` at
    least; it needs more times than that. Training ends when the held-out loss has not fallen for so many rounds, and the trees up to
    the best round are kept. ``auto_scale_pos_weight`` balances two classes.
    """

    defaults = {
        **DEFAULTS, "auto_scale_pos_weight": True, "row_column": "row_idx", "validation_share": 0.1, "validation_least": 50,
    }

    def fit(self, df: DataFrame, features: Sequence[str], weight: str | None = None) -> Fitted:
        return self.fit_tasks(df, features, [Task()], weight)[0]

    def fit_tasks(self, df: DataFrame, features: Sequence[str], tasks: Sequence[Task], weight: str | None = None) -> list[Fitted]:
        """Models of several ranges of times or parameters, grown side by side."""
        p = self.params
        counts = class_counts(df)
        known = []
        for t in tasks:
            own = {**p, **t.params}
            known.append(Task(t.end, t.skip, t.held_from or held_from(df, own, t.end), checked(own)))
        objective, classes = ("binary", 2) if set(counts) <= {0, 1} else ("classes", max(counts) + 1)
        row = p["row_column"]
        boosters = train(with_row(df, row), features, known, objective, classes, LABEL, weight, row, p["auto_scale_pos_weight"])
        return [classes_from(b) for b in boosters]


@register_model("boosted_trees_regressor")
class BoostedTreesRegressor(Model):
    """Regression on the label; the value clipped to 0..1 is the probability.

    With ``auto_threshold`` the class threshold is searched on the training
    rows; ``continuous`` keeps the raw value and makes no class.
    """

    defaults = {
        **DEFAULTS, "n_estimators": 600, "max_depth": 5, "classification_threshold": 0.5, "auto_threshold": False,
        "threshold_metric": "f1", "continuous": False, "row_column": "row_idx", "validation_share": 0.1, "validation_least": 50,
    }

    def fit(self, df: DataFrame, features: Sequence[str], weight: str | None = None) -> Fitted:
        return self.fit_tasks(df, features, [Task()], weight)[0]

    def fit_tasks(self, df: DataFrame, features: Sequence[str], tasks: Sequence[Task], weight: str | None = None) -> list[Fitted]:
        p = self.params
        known = []
        for t in tasks:
            own = {**p, **t.params}
            known.append(Task(t.end, t.skip, t.held_from or held_from(df, own, t.end), checked(own)))
        row = p["row_column"]
        out = []
        for task, booster in zip(known, train(with_row(df, row), features, known, "value", 1, LABEL, weight, row)):
            fitted = regression_from(booster, p["classification_threshold"], p["continuous"])
            if p["auto_threshold"] and not p["continuous"]:
                best = optimize_threshold(fitted.score_rows(task.rows(with_row(df, row), row)), (), p["threshold_metric"], y=LABEL).first()
                fitted = regression_from(booster, float(best["best_threshold"]), False)
            out.append(fitted)
        return out
