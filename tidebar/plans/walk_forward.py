"""Walk-forward training and evaluation, and the bull/bear ensemble."""

from __future__ import annotations

from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from functools import reduce
from itertools import product
from operator import and_
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

import tidebar.features  # noqa: F401
import tidebar.models  # noqa: F401
from tidebar.features.builder import apply_null_policy, build_frame, feature_columns
from tidebar.functions.scalars import flag, map_values
from tidebar.models.base import LABEL, Fitted, create_model
from tidebar.models.boosting import Task, predictions
from tidebar.models.calibration import calibrated
from tidebar.operators.folds import FoldPlan, assign_test_folds, number_times, regime_weight, train_end, validation_tail
from tidebar.operators.frame import lay_out
from tidebar.operators.labels import get_label_strategy, label_lookback
from tidebar.operators.metrics import compute_metrics, optimize_threshold
from tidebar.operators.prepare import tail
from tidebar.session import materialize

c = F.col


@dataclass
class Experiment:
    """Everything that defines one run."""

    sets: list[str]
    label: str = "reversal"
    label_params: dict[str, Any] = field(default_factory=lambda: {"T": 14, "X": 0.08})
    label_map: dict[int, int] | None = None
    null_policy: str = "ffill_then_drop"
    model: str = "boosted_trees"
    model_params: dict[str, Any] = field(default_factory=dict)
    top_n: int = 0
    plan: FoldPlan = field(default_factory=FoldPlan)
    metrics: list[str] | None = None
    threshold_optimize: bool = False
    threshold_metric: str = "f1"
    threshold_val_ratio: float = 0.15
    holdout: bool = False  # fit before the threshold tail instead of including it
    calibrate: str = "none"
    regime_weights: dict[str, float] | None = None
    regime_column: str = "regime_price_vs_ma200"


@dataclass
class Result:
    """Tables of one run."""

    predictions: DataFrame
    folds: list[dict[str, Any]]
    features: list[str]
    last_model: Fitted

    def fold_metrics(self, names: Sequence[str] | None = None) -> DataFrame:
        return compute_metrics(self.predictions, ["fold_id"], names)

    def pooled_metrics(self, names: Sequence[str] | None = None, once: bool = False) -> DataFrame:
        """All test rows; ``once`` counts rows of overlapping folds a single time (latest fold)."""
        preds = self.predictions
        if once:
            last = F.max_by(F.struct("y_true", "y_pred"), "fold_id").alias("r")
            preds = preds.groupBy("symbol", "ts").agg(last).select("symbol", "ts", "r.*")
        return compute_metrics(preds, (), names)

    def importance(self) -> DataFrame:
        rows = [(n, float(v)) for n, v in self.last_model.importance()]
        return self.predictions.sparkSession.createDataFrame(rows, "feature string, importance double")


def prepare(bars: DataFrame, exp: Experiment, sources: dict[str, DataFrame] | None = None, **layout) -> DataFrame:
    """Complete feature rows with their label, written once for all folds.

    ``row_idx`` is the position of the row's time among the times of all series, ``n_rows`` the number of these times.
    """
    horizon = exp.label_params.get("T", 14)
    f = build_frame(bars, exp.sets, sources, lookahead=horizon, extra_lookback=label_lookback(exp.label_params), **layout)
    f = get_label_strategy(exp.label)(f, **exp.label_params)
    names = [x for x in f.columns if x not in ("symbol", "ts", LABEL)]
    labels = f.add({"__label": c(LABEL)}).drop(LABEL)
    label = map_values("__label", exp.label_map) if exp.label_map else c("__label")
    f = apply_null_policy(labels, exp.null_policy).add({LABEL: label})
    complete = reduce(and_, [c(n).isNotNull() for n in (*names, LABEL)])
    rows = materialize(f.finish().filter(complete))
    return materialize(number_times(rows))


def latest_rows(bars: DataFrame, exp: Experiment, sources: dict[str, DataFrame] | None = None, **layout) -> DataFrame:
    """The newest bar of every series with its features; no label is asked for."""
    f = apply_null_policy(build_frame(bars, exp.sets, sources, **layout), exp.null_policy)
    return materialize(tail(f.finish(), 1))


def score_latest(rows: DataFrame, models: dict[str, Fitted]) -> DataFrame:
    """symbol, ts and one probability per model, under its name.

    A series whose newest bar lacks a feature that a model needs has a null there.
    """
    out = rows.select("symbol", "ts")
    for name, fitted in models.items():
        complete = reduce(and_, [c(x).isNotNull() for x in fitted.features])
        out = out.join(fitted.score(rows.filter(complete)).select("symbol", "ts", c("proba").alias(name)), ["symbol", "ts"], "left")
    return out


def select_features(rows: DataFrame, features: list[str], exp: Experiment) -> list[str]:
    """Top-n features by importance on the rows that the first fold trains on, in their original order."""
    if not 0 < exp.top_n < len(features):
        return features
    first = rows.filter(c("row_idx") < train_end(exp.plan, 0))
    fitted = create_model(exp.model, exp.model_params).fit(first, features)
    best = sorted(fitted.importance(), key=lambda p: -p[1])[: exp.top_n]
    chosen = {name for name, _ in best}
    return [f for f in features if f in chosen]


def run_fold(rows: DataFrame, features: list[str], exp: Experiment, fold_id: int) -> tuple[DataFrame, dict, Fitted]:
    """Train on all rows of times before the test window (minus purge), score the rows of its times.

    Every series gives what it has: a short or late one is trained on and tested where it has rows.
    """
    plan, end = exp.plan, train_end(exp.plan, fold_id)
    start = plan.init_train + fold_id * plan.step
    train = rows.filter(c("row_idx") < end)
    test = rows.filter((c("row_idx") >= start) & (c("row_idx") < start + plan.oos_window))
    tail_from = end - max(int(end * exp.threshold_val_ratio), 50)
    fit_rows = train.filter(c("row_idx") < tail_from) if exp.threshold_optimize and exp.holdout else train
    weight = None
    if exp.regime_weights and exp.regime_column in rows.columns:
        fit_rows = fit_rows.withColumn("__sample", regime_weight(exp.regime_column, exp.regime_weights))
        weight = "__sample"
    model = create_model(exp.model, exp.model_params)
    if exp.calibrate != "none":
        fitted = calibrated(model, fit_rows, features, exp.calibrate, weight=weight)
    else:
        fitted = model.fit(fit_rows, features, weight)
    scored = fitted.score(test)
    sizes = rows.agg(
        F.sum((c("row_idx") < end).cast("long")).alias("train"),
        F.sum(((c("row_idx") >= start) & (c("row_idx") < start + plan.oos_window)).cast("long")).alias("test"),
    ).first()
    info = {"fold_id": fold_id, "train_size": sizes["train"], "test_size": sizes["test"], "threshold": fitted.threshold}
    if exp.threshold_optimize:
        valid = fitted.score(train.filter(c("row_idx") >= tail_from))
        best = optimize_threshold(valid, (), exp.threshold_metric, y=LABEL).first()
        info["threshold"] = float(best["best_threshold"]) if best else 0.5
        scored = scored.withColumn("y_pred", (c("proba") >= info["threshold"]).cast("int"))
    out = scored.select(
        "symbol", "ts", F.lit(fold_id).alias("fold_id"), c(LABEL).alias("y_true"), "y_pred", "proba"
    )
    return materialize(out), info, fitted


def fold_ids(rows: DataFrame, plan: FoldPlan) -> list[int]:
    """Folds over the common times that leave training rows."""
    longest = rows.agg(F.max("n_rows")).first()[0] or 0
    if longest < plan.init_train + plan.oos_window:
        raise ValueError(f"no fold fits: there are {longest} times")
    count = (longest - plan.init_train - plan.oos_window) // plan.step + 1
    ids = [k for k in range(count) if train_end(plan, k) > 0]
    if not ids:
        raise ValueError("the purge gap removes all training rows")
    return ids


def run_folds(rows: DataFrame, features: list[str], exp: Experiment, ids: list[int]) -> Result:
    """All folds at once: their trees grow side by side, and one pass scores each test row by the model of its fold.

    Same rules as :func:`run_fold`; thresholds of all folds come from one search grouped by fold.
    """
    plan = exp.plan
    tail_from = {k: train_end(plan, k) - max(int(train_end(plan, k) * exp.threshold_val_ratio), 50) for k in ids}
    cut = exp.threshold_optimize and exp.holdout
    fit_rows, weight = rows, None
    if exp.regime_weights and exp.regime_column in rows.columns:
        fit_rows, weight = rows.withColumn("__sample", regime_weight(exp.regime_column, exp.regime_weights)), "__sample"
    tasks = [Task(end=tail_from[k] if cut else train_end(plan, k)) for k in ids]
    fitted = create_model(exp.model, exp.model_params).fit_tasks(fit_rows, features, tasks, weight)
    boosters = [m.stages["booster"] for m in fitted]
    value = boosters[0].objective == "value"

    def scored(numbered: DataFrame) -> DataFrame:
        probs = predictions(boosters, c("fold_id") - F.lit(ids[0]))
        out = numbered.withColumn("__probs", probs)
        if not value:
            best = (F.array_position("__probs", F.array_max("__probs")) - 1).cast("int")
            return out.withColumns({"proba": c("__probs")[1], "y_pred": best})
        if fitted[0].stages["continuous"]:
            return out.withColumns({"proba": c("__probs")[0], "y_pred": c("__probs")[0]})
        limit = F.element_at(F.array(*[F.lit(float(m.threshold)) for m in fitted]), (c("fold_id") - F.lit(ids[0]) + 1).cast("int"))
        out = out.withColumn("proba", F.least(F.greatest(c("__probs")[0], F.lit(0.0)), F.lit(1.0)))
        return out.withColumn("y_pred", (c("proba") >= limit).cast("int"))

    preds = scored(assign_test_folds(rows, plan))
    thresholds = {k: m.threshold for k, m in zip(ids, fitted)}
    if exp.threshold_optimize:
        tails = validation_tail(rows, plan, exp.threshold_val_ratio).filter(c("fold_id") >= ids[0])
        best = optimize_threshold(scored(tails), ["fold_id"], exp.threshold_metric, y=LABEL).collect()  # a row a fold
        thresholds = {k: 0.5 for k in ids} | {r["fold_id"]: float(r["best_threshold"]) for r in best}
        limit = F.element_at(F.array(*[F.lit(thresholds[k]) for k in ids]), (c("fold_id") - F.lit(ids[0]) + 1).cast("int"))
        preds = preds.withColumn("y_pred", (c("proba") >= limit).cast("int"))
    preds = materialize(preds.select("symbol", "ts", c("fold_id").cast("int").alias("fold_id"), c(LABEL).alias("y_true"), "y_pred", "proba"))
    bounds = {r["fold_id"]: r for r in fold_bounds(rows, plan).collect()}  # a row a fold
    folds = [
        {"fold_id": k, "train_size": bounds[k]["train_size"], "test_size": bounds[k]["test_size"], "threshold": thresholds[k]} for k in ids
    ]
    return Result(preds, folds, features, fitted[-1])


def walk_forward(rows: DataFrame, features: list[str], exp: Experiment, parallel: int = 4) -> Result:
    """All folds of prepared rows.

    Models that grow side by side are trained in one go. Others, and calibrated ones, run fold by fold; a few are
    submitted at a time so that the many small jobs of training overlap, and each fold's predictions are written
    out, so a lost executor costs at most one fold.
    """
    ids = fold_ids(rows, exp.plan)
    if exp.calibrate == "none" and exp.model in ("boosted_trees", "boosted_trees_regressor"):
        return run_folds(rows, features, exp, ids)
    with ThreadPoolExecutor(max_workers=parallel) as pool:
        done = list(pool.map(lambda k: run_fold(rows, features, exp, k), ids))
    preds = done[0][0]
    for p, _, _ in done[1:]:
        preds = preds.unionByName(p)
    return Result(preds, [i for _, i, _ in done], features, done[-1][2])


def run_experiment(
    bars: DataFrame, exp: Experiment, sources: dict[str, DataFrame] | None = None, parallel: int = 4, **layout
) -> Result:
    """Bars to out-of-sample predictions: features, labels, selection, walk-forward."""
    rows = prepare(bars, exp, sources, **layout)
    fold_ids(rows, exp.plan)  # too little data fails before any training
    features = [f for f in feature_columns(rows) if f not in ("row_idx", "n_rows")]
    return walk_forward(rows, select_features(rows, features, exp), exp, parallel)


def fold_bounds(rows: DataFrame, plan: FoldPlan) -> DataFrame:
    """Per fold (fold_id, last_train_ts, first_test_ts, train_size, test_size), as run_fold cuts prepared rows.

    Sizes are differences of running counts over the distinct times, read at the times where folds begin and end.
    """
    times = rows.groupBy("ts", "n_rows").agg(F.count(F.lit(1)).alias("n")).withColumn("everything", F.lit(0))
    at = lay_out(times, ["everything"]).cumulative({"upto": ("sum", c("n"))}).finish(keep_row_number="__at")
    at = materialize(at.filter(plan.count(c("n_rows")) > 0))

    def read(position: int, **columns: Column) -> DataFrame:
        """Columns at the time `position` of fold 0, and one step on for each fold after it."""
        offset = c("__at") - F.lit(position)
        fold = (offset / F.lit(plan.step)).cast("long")
        hit = at.filter((offset >= 0) & (offset % F.lit(plan.step) == 0) & (fold < plan.count(c("n_rows"))))
        return hit.select(fold.alias("fold_id"), *[x.alias(n) for n, x in columns.items()])

    train = read(plan.init_train - plan.purge_gap - 1, last_train_ts=c("ts"), train_size=c("upto"))
    begin = read(plan.init_train, first_test_ts=c("ts"), before=c("upto") - c("n"))
    end = read(plan.init_train + plan.oos_window - 1, upto=c("upto"))
    folds = train.join(begin, "fold_id").join(end, "fold_id")
    return folds.select("fold_id", "last_train_ts", "first_test_ts", "train_size", (c("upto") - c("before")).alias("test_size"))


def prepare_grid(
    bars: DataFrame, exp: Experiment, pairs: Sequence[tuple[int, float]], sources: dict[str, DataFrame] | None = None, **layout
) -> tuple[DataFrame, list[str]]:
    """Complete feature rows, written once, with one label column for each (T, X); a label may be null."""
    asked = [{**exp.label_params, "T": T, "X": X} for T, X in pairs]
    f = build_frame(
        bars, exp.sets, sources, lookahead=max(T for T, _ in pairs), extra_lookback=max(map(label_lookback, asked)), **layout
    )
    names = [x for x in f.columns if x not in ("symbol", "ts")]
    columns = [f"label_{i}" for i in range(len(asked))]
    strategy = get_label_strategy(exp.label)
    for name, params in zip(columns, asked):
        f = strategy(f, **params)
        f = f.add({f"__{name}": map_values(LABEL, exp.label_map) if exp.label_map else c(LABEL)}).drop(LABEL)
    f = apply_null_policy(f, exp.null_policy).add({name: c(f"__{name}") for name in columns})
    complete = reduce(and_, [c(n).isNotNull() for n in names])
    return materialize(f.finish().filter(complete)), columns


def parameter_search(
    bars: DataFrame, exp: Experiment, Ts: Sequence[int], Xs: Sequence[float],
    sources: dict[str, DataFrame] | None = None, parallel: int = 4, **layout
) -> DataFrame:
    """One run per label horizon and threshold: (T, X, status, accuracy, f1_macro, cohen_kappa).

    Features are built once, and every pair is a label column of that table. Folds lie on the times that have the pair's label. A few
    runs are submitted at a time. A failed run is recorded with its message and the search goes on.
    """
    pairs = list(product(Ts, Xs))
    if not pairs:
        return bars.sparkSession.createDataFrame([], SEARCHED)
    table, columns = prepare_grid(bars, exp, pairs, sources, **layout)
    features = [x for x in feature_columns(table) if x not in columns]

    def one(pair: tuple[int, float], name: str) -> tuple:
        try:
            rows = table.filter(c(name).isNotNull()).withColumn(LABEL, c(name)).drop(*columns)
            rows = materialize(number_times(rows))
            fold_ids(rows, exp.plan)
            result = walk_forward(rows, select_features(rows, features, exp), exp, parallel)
            m = result.pooled_metrics().first().asDict()
            return pair[0], float(pair[1]), "ok", m.get("accuracy"), m.get("f1_macro"), m.get("cohen_kappa")
        except Exception as err:  # one failed run, of whatever kind, must not end the search
            return pair[0], float(pair[1]), str(err)[:500], None, None, None

    with ThreadPoolExecutor(max_workers=parallel) as pool:
        found = list(pool.map(one, pairs, columns))
    return bars.sparkSession.createDataFrame(found, SEARCHED)


SEARCHED = "T int, X double, status string, accuracy double, f1_macro double, cohen_kappa double"


def combine_by_regime(
    bull: DataFrame, bear: DataFrame, regime: DataFrame, keys: Sequence[str] = ("symbol", "ts", "fold_id")
) -> DataFrame:
    """Bull prediction where ``regime_bull`` is 1, bear prediction elsewhere, against the bull target."""
    left = bull.select(*keys, "y_true", c("y_pred").alias("__bull"))
    right = bear.select(*keys, c("y_pred").alias("__bear"))
    joined = left.join(right, list(keys)).join(regime.select("symbol", "ts", "regime_bull"), ["symbol", "ts"])
    pred = F.when(c("regime_bull") == 1, c("__bull")).otherwise(c("__bear"))
    return joined.select(*keys, "y_true", pred.alias("y_pred"), "regime_bull")


def regime_counts(combined: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return combined.groupBy(*by).agg(
        F.sum((c("regime_bull") == 1).cast("long")).alias("n_bull"),
        F.sum((c("regime_bull") == 0).cast("long")).alias("n_bear"),
    )


def run_ensemble(
    bars: DataFrame, bull: Experiment, bear: Experiment, sources: dict[str, DataFrame] | None = None,
    parallel: int = 4, **layout
) -> tuple[Result, Result, DataFrame]:
    """Two walk-forward runs on common rows and features, switched by the 200-row mean."""
    bull_rows, bear_rows = prepare(bars, bull, sources, **layout), prepare(bars, bear, sources, **layout)
    keep = bull_rows.select("symbol", "ts").join(bear_rows.select("symbol", "ts"), ["symbol", "ts"])
    keep = materialize(keep)
    shared = [f for f in feature_columns(bull_rows) if f in bear_rows.columns and f not in ("row_idx", "n_rows")]

    def common(rows: DataFrame) -> DataFrame:
        return materialize(number_times(rows.join(keep, ["symbol", "ts"], "left_semi")))

    bull_result = walk_forward(common(bull_rows), shared, bull, parallel)
    bear_result = walk_forward(common(bear_rows), shared, bear, parallel)
    f = build_frame(bars, ["regime"], **layout)
    regime = f.finish().select("symbol", "ts", flag(c("close") > c("sma_200")).alias("regime_bull"))
    combined = combine_by_regime(bull_result.predictions, bear_result.predictions, regime)
    return bull_result, bear_result, combined
