"""Model interface and registry over Spark ML estimators."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from typing import Any

from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LABEL, WEIGHT, FEATURES = "label", "__weight", "__features"


def with_vector(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Add the feature vector; rows with missing features must be gone already."""
    if FEATURES in df.columns:
        return df
    return VectorAssembler(inputCols=list(features), outputCol=FEATURES, handleInvalid="error").transform(df)


@dataclass
class Fitted:
    """A trained model: ``score`` adds proba and y_pred, ``importance`` ranks the features."""

    features: list[str]
    score_rows: Callable[[DataFrame], DataFrame]
    importances: list[float]
    stages: dict[str, Any]
    threshold: float | None = None

    def score(self, df: DataFrame) -> DataFrame:
        """Rows plus ``proba`` (class 1, or the regression value) and ``y_pred``."""
        return self.score_rows(with_vector(df, self.features)).drop(FEATURES)

    def importance(self) -> list[tuple[str, float]]:
        return list(zip(self.features, self.importances))


class Model:
    """Subclasses set ``defaults`` and implement :meth:`fit`."""

    defaults: dict[str, Any] = {}

    def __init__(self, params: dict[str, Any] | None = None):
        self.params = {**self.defaults, **(params or {})}

    def fit(self, df: DataFrame, features: Sequence[str], weight: str | None = None) -> Fitted:
        """Train on ``label`` (and an optional weight column) with the given feature columns."""
        raise NotImplementedError

    def fit_tasks(self, df: DataFrame, features: Sequence[str], tasks: Sequence[Any], weight: str | None = None) -> list[Fitted]:
        """One model per task (a range of times); models that can grow side by side override this."""
        return [type(self)({**self.params, **t.params}).fit(t.rows(df), features, weight) for t in tasks]


_MODELS: dict[str, type[Model]] = {}


def register_model(name: str):
    def wrap(cls: type[Model]):
        _MODELS[name] = cls
        return cls

    return wrap


def create_model(name: str, params: dict[str, Any] | None = None) -> Model:
    if name not in _MODELS:
        raise KeyError(f"unknown model '{name}', available: {sorted(_MODELS)}")
    return _MODELS[name](params)


def list_models() -> list[str]:
    return list(_MODELS)


def class_counts(df: DataFrame, label: str = LABEL) -> dict[int, int]:
    """Rows per class: a handful of values, checked."""
    rows = df.groupBy(label).count().limit(101).collect()
    if len(rows) > 100:
        raise ValueError(f"'{label}' has more than 100 values; use a regressor for continuous labels")
    return {int(r[0]): int(r[1]) for r in rows if r[0] is not None}


def balanced_weight(counts: dict[int, int], weight: str | None, label: str = LABEL):
    """Positive rows weigh n_neg / n_pos, on top of a sample weight."""
    base = F.col(weight).cast("double") if weight else F.lit(1.0)
    n_pos, n_neg = counts.get(1, 0), counts.get(0, 0)
    if set(counts) <= {0, 1} and n_pos and n_neg:
        return F.when(F.col(label) == 1, base * F.lit(n_neg / n_pos)).otherwise(base)
    return base
