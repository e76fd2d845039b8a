"""Model queries on real bars; tree counts are small but for walk_forward_full, the rows are all of them."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.common import order_bars
from tidebar.functions.scalars import map_values
from tidebar.models import create_model
from tidebar.models.calibration import calibrated, calibration_report
from tidebar.models.stacking import BASE_MODELS
from tidebar.operators.folds import FoldPlan
from tidebar.operators.metrics import compute_metrics
from tidebar.plans.signals import decide
from tidebar.plans.walk_forward import (
    Experiment, fold_bounds, latest_rows, parameter_search, prepare, run_ensemble, run_experiment, score_latest, select_features,
)
from tidebar.session import materialize

c = F.col

SMALL = {"n_estimators": 10, "max_depth": 3, "learning_rate": 0.2, "min_child_samples": 20}
PLAN = FoldPlan(init_train=1000, oos_window=250, step=250, purge_gap=14)
BULL = dict(label_params={"T": 14, "X": 0.8}, label_map={0: 0, 1: 0, 2: 1}, plan=PLAN, model_params=SMALL)
BEAR = dict(label_params={"T": 14, "X": 0.8}, label_map={0: 1, 1: 0, 2: 0}, plan=PLAN, model_params=SMALL)
FEATURES = ["return_1d", "return_7d", "rsi_14", "bb_pctb_20", "atr_pct_14", "volatility_20d", "stoch_k_14", "price_vs_sma_20"]


def rows(s, d, **kw):
    """Technical features and labels; folds by position."""
    return prepare(order_bars(s, d), Experiment(["technical"], **{**BULL, **kw}))


def split(df, at=0.8):
    return df.filter(c("row_idx") < c("n_rows") * at), df.filter(c("row_idx") >= c("n_rows") * at)


def report(model, s, d, **kw):
    train, test = split(rows(s, d, **kw))
    scored = model.fit(train, FEATURES).score(test)
    return compute_metrics(scored.select("symbol", c("label").alias("y_true"), "y_pred"), ["symbol"])


def tree_classifier(s, d):
    return report(create_model("boosted_trees", {**SMALL, "early_stopping_rounds": 10}), s, d)


def multiclass(s, d):
    return report(create_model("boosted_trees", SMALL), s, d, label="directional", label_params={"T": 14, "X": 0.5}, label_map=None)


def regressor(s, d):
    return report(create_model("boosted_trees_regressor", {**SMALL, "auto_threshold": True}), s, d)


def continuous(s, d):
    """Percent-return target kept continuous."""
    train, test = split(rows(s, d, label="return_rate", label_params={"T": 14}, label_map=None))
    fitted = create_model("boosted_trees_regressor", {**SMALL, "continuous": True}).fit(train, FEATURES)
    return fitted.score(test).select("symbol", "ts", "label", "y_pred")


def stacking(s, d):
    """Four first-layer models on three inner splits each."""
    bases = [{**b, "params": {**b["params"], "n_estimators": 20, "max_depth": min(b["params"]["max_depth"], 4), "learning_rate": 0.2}} for b in BASE_MODELS]
    return report(create_model("stacking", {"base_models": bases}), s, d)


def calibration(s, d):
    train, test = split(rows(s, d))
    model = create_model("boosted_trees", SMALL)
    plain = model.fit(train, FEATURES)
    out = None
    for method in ("platt", "isotonic"):
        one = calibration_report(plain, calibrated(model, train, FEATURES, method), test).withColumn("method", F.lit(method))
        out = one if out is None else out.unionByName(one)
    return out


def selection(s, d):
    exp = Experiment(["technical"], **BULL, top_n=10)
    data = prepare(order_bars(s, d), exp)
    names = [x for x in data.columns if x not in ("symbol", "ts", "label", "row_idx", "n_rows", "open", "high", "low", "close", "volume", "quote_volume", "trades")]
    return s.createDataFrame([(n,) for n in select_features(data, names, exp)], "feature string")


def experiment(s, d):
    """Folds with regime weights and a threshold searched per fold."""
    exp = Experiment(["technical", "regime"], **BULL, top_n=12, threshold_optimize=True, regime_weights={"bull": 1.5, "bear": 1.2, "sideways": 0.5})
    return run_experiment(order_bars(s, d), exp).fold_metrics()


def experiment_full(s, d):
    """Every fold of the default window and step, with a hundred trees each, grown side by side."""
    params = {"n_estimators": 100, "max_depth": 3, "learning_rate": 0.05, "num_leaves": 8}
    plan = FoldPlan(init_train=1500, oos_window=63, step=21, purge_gap=14)
    exp = Experiment(["volume"], **{**BULL, "plan": plan, "model_params": params}, threshold_optimize=True)
    return run_experiment(order_bars(s, d), exp).fold_metrics()


def search(s, d):
    """Two horizons that leave folds and one that does not, with two thresholds each, on one feature table."""
    exp = Experiment(["volume"], **{**BULL, "model_params": {**SMALL, "n_estimators": 3}})
    found = parameter_search(order_bars(s, d), exp, [7, 14, 4000], [0.5, 0.8])
    fine = c("accuracy").between(0, 1) & c("f1_macro").between(0, 1)
    return found.select("T", "X", (c("status") == "ok").cast("int").alias("ran"), F.coalesce(fine, F.lit(False)).cast("int").alias("scored"))


def ensemble(s, d):
    _, _, both = run_ensemble(order_bars(s, d), Experiment(["volume", "regime"], **BULL), Experiment(["volume"], **BEAR))
    return compute_metrics(both, ["symbol"])


def labelled(rows, mapping):
    return rows.withColumn("label", map_values("label", mapping))


def newest(s, d):
    """Bull and bear probabilities of the newest bar of each series; one feature table trains both models."""
    exp = Experiment(["technical"], **{**BULL, "label_map": None})
    bars = materialize(order_bars(s, d))
    data = prepare(bars, exp)
    models = {
        f"{name}_prob": create_model("boosted_trees", SMALL).fit(labelled(data, cfg["label_map"]), FEATURES)
        for name, cfg in (("bull", BULL), ("bear", BEAR))
    }
    return score_latest(latest_rows(bars, exp), models)


def latest_signal(s, d):
    """Both models on the newest bar of each series, then the signal decision."""
    return decide(newest(s, d)).withColumn("risk_notes", F.concat_ws("|", "risk_notes"))


def latest_signal_keys(s, d):
    """The series and times that are scored, and whether the decision is well formed."""
    codes = c("signal_code").isin("BULL", "BEAR", "NEUTRAL", "VOLATILE")
    fine = c("bull_prob").between(0, 1) & c("bear_prob").between(0, 1) & codes
    return decide(newest(s, d)).select("symbol", "ts", F.coalesce(fine, F.lit(False)).cast("int").alias("well_formed"))


def checks(s, d):
    """Every kind of model on the last fifth of the times: rows per series, and what must hold for their scores."""
    data = materialize(prepare(order_bars(s, d), Experiment(["technical"], **{**BULL, "label_map": None})))
    two = labelled(data, BULL["label_map"])
    train, test = split(two)
    bases = [{"name": f"b{k}", "params": {**SMALL, "max_depth": k}} for k in (2, 3)]
    fitted = {
        "classes": create_model("boosted_trees", {**SMALL, "early_stopping_rounds": 10}).fit(train, FEATURES),
        "regression": create_model("boosted_trees_regressor", {**SMALL, "auto_threshold": True}).fit(train, FEATURES),
        "stacking": create_model("stacking", {"base_models": bases}).fit(train, FEATURES),
        "calibrated": calibrated(create_model("boosted_trees", SMALL), train, FEATURES, "isotonic"),
        "three_classes": create_model("boosted_trees", SMALL).fit(split(data)[0], FEATURES),
    }
    out = None
    for name, model in fitted.items():
        held = (split(data)[1] if name == "three_classes" else test)
        sums = F.abs(F.aggregate("probs", F.lit(0.0), lambda a, x: a + x) - 1) < 1e-6
        best = c("y_pred").isin(0, 1, 2) if name == "three_classes" else (
            c("y_pred") == (c("proba") >= F.lit(model.threshold)).cast("int") if name == "regression" else c("y_pred").isin(0, 1)
        )
        fine = c("proba").between(0, 1) & sums & best & F.lit(len(model.importance()) == len(FEATURES))
        one = model.score(held).groupBy("symbol").agg(
            F.count(F.lit(1)).alias("n_test"), F.min(F.coalesce(fine, F.lit(False)).cast("int")).alias("well_formed")
        ).withColumn("model", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return out


def no_future(s, d):
    """Per fold of 63 and 21 times: last training and first test time, and the rows of either."""
    plan = FoldPlan(init_train=1000, oos_window=63, step=21, purge_gap=14)
    exp = Experiment(["technical"], **{**BULL, "plan": plan})
    return fold_bounds(prepare(order_bars(s, d), exp), plan)


QUERIES = {
    "model_tree_classifier": tree_classifier,
    "model_multiclass": multiclass,
    "model_regressor_to_class": regressor,
    "model_continuous_target": continuous,
    "model_stacking": stacking,
    "model_calibration": calibration,
    "feature_selection": selection,
    "walk_forward_experiment": experiment,
    "walk_forward_full": experiment_full,
    "parameter_search": search,
    "walk_forward_ensemble": ensemble,
    "latest_signal": latest_signal,
    "latest_signal_keys": latest_signal_keys,
    "model_checks": checks,
    "walk_forward_no_future": no_future,
}
