"""Labels, folds, metrics, thresholds, PnL and signals on rule-based scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.common import PLAN, bar_frame, fold_rows, order_bars, scored_rows
from tidebar.features.builder import build_frame
from tidebar.operators.folds import (
    class_weights,
    expanding_folds,
    inner_time_splits,
    number_rows,
    regime_weight,
    series_sizes,
    validation_tail,
    walk_forward_folds,
)
from tidebar.operators.labels import add_labels, class_distribution, get_label_strategy, label_grid
from tidebar.operators.metrics import (
    THRESHOLD_METRICS,
    apply_threshold,
    best_thresholds,
    brier,
    classification_report,
    compute_metrics,
    confusion_matrix,
    majority_baseline,
    optimize_threshold,
    tail_threshold_table,
    threshold_table,
)
from tidebar.operators.pnl import attach_pnl, pnl_metrics, strategy_returns
from tidebar.plans.signals import (
    decide,
    indicator_snapshot,
    kappa_band,
    quality_tier,
    recent_bars,
    signal_distribution,
    signal_efficacy,
    signal_matrix,
)
from tidebar.plans.walk_forward import combine_by_regime, regime_counts

c = F.col


def label_query(strategy, **params):
    def run(s, d):
        return add_labels(order_bars(s, d), strategy, **params).select("symbol", "ts", "label")

    return run


def grid(s, d):
    """Class shares of every (T, X) pair and strategy."""
    f = bar_frame(s, d, lookback=1, lookahead=28)
    parts = []
    for strategy in ("reversal", "directional"):
        rows = label_grid(f, strategy, [7, 14, 28], [0.3, 0.8])
        parts.append(class_distribution(rows.withColumn("strategy", F.lit(strategy)), ["strategy", "symbol", "T", "X"]))
    return parts[0].unionByName(parts[1])


def folds(s, d):
    return walk_forward_folds(series_sizes(scored_rows(s, d)), PLAN)


def fold_assignment(s, d):
    return fold_rows(s, d).select("symbol", "ts", "fold_id", "row_idx")


def weights(s, d):
    return class_weights(scored_rows(s, d).withColumn("label", c("y_true")), PLAN)


def sample_weights(s, d):
    value = F.when(c("sma_200").isNotNull(), (c("close") - c("sma_200")) / c("sma_200"))
    rows = scored_rows(s, d).withColumn("regime", value)
    return rows.select("symbol", "ts", regime_weight("regime", {"bull": 1.5, "bear": 1.2, "sideways": 0.5}).alias("weight"))


def tails(s, d):
    rows = validation_tail(number_rows(scored_rows(s, d)), PLAN)
    return rows.groupBy("symbol", "fold_id").agg(
        F.count(F.lit(1)).alias("n"), F.min("row_idx").alias("first_row"), F.max("row_idx").alias("last_row"),
        F.sum("y_true").alias("positives"),
    )


def pooled_once(s, d):
    """Pooled metrics with overlapping folds counted once (latest fold wins)."""
    last = fold_rows(s, d).groupBy("symbol", "ts").agg(F.max_by(F.struct("y_true", "y_pred"), "fold_id").alias("r"))
    return compute_metrics(last.select("symbol", "r.*"), ["symbol"])


def multiclass(s, d):
    """Three-class predictions: sign of the last 7 rows against the next 7."""
    f = bar_frame(s, d, lookback=7, lookahead=7)
    f = get_label_strategy("directional")(f, T=7, X=0.5).add({"past": f.change("close", 7)})
    rows = f.finish().filter(c("label").isNotNull() & c("past").isNotNull())
    pred = F.when(c("past") >= 0.5, 0).when(c("past") <= -0.5, 2).otherwise(1)
    return rows.select("symbol", c("label").alias("y_true"), pred.alias("y_pred"))


def thresholds(s, d):
    """Every target metric, and one with a precision floor, from one table of counts."""
    goals = {m: (m, 0.0) for m in THRESHOLD_METRICS} | {"precision_at_0.4": ("precision_recall", 0.4)}
    keys = ["symbol", "fold_id"]
    return best_thresholds(threshold_table(fold_rows(s, d), keys), keys, goals).withColumnRenamed("goal", "metric")


def tail_thresholds(s, d):
    """Thresholds from every fold's validation tail, counted without a copy of a row."""
    goals = {m: (m, 0.0) for m in ("f1", "kappa", "youden")}
    table = tail_threshold_table(number_rows(scored_rows(s, d)), PLAN)
    return best_thresholds(table, ["symbol", "fold_id"], goals).withColumnRenamed("goal", "metric")


def applied(s, d):
    rows = fold_rows(s, d)
    best = optimize_threshold(rows, ["symbol", "fold_id"], "youden")
    picked = rows.drop("y_pred").join(best, ["symbol", "fold_id"]).withColumn("y_pred", apply_threshold("proba", "best_threshold"))
    return compute_metrics(picked, ["symbol"], ["accuracy", "f1_binary", "cohen_kappa"])


def equity(s, d):
    return strategy_returns(scored_rows(s, d)).select("symbol", "ts", "strategy_return", "equity", "drawdown")


def with_pnl(s, d):
    rows = scored_rows(s, d)
    return attach_pnl(compute_metrics(rows, ["symbol"], ["accuracy", "f1_macro"]), pnl_metrics(rows))


def _matrix(s, d):
    rows = fold_rows(s, d)
    bear = rows.select("symbol", "ts", "fold_id", c("bear_pred").alias("y_pred"), c("bear_true").alias("y_true"))
    return signal_matrix(rows, bear)


def matrix(s, d):
    return _matrix(s, d).select("symbol", "ts", "fold_id", "bull_pred", "bear_pred", "signal")


def ensemble(s, d):
    """Bull prediction above the 200-row mean, bear prediction otherwise, scored on the bull target."""
    rows = fold_rows(s, d).withColumn("regime_bull", F.coalesce(c("close") > c("sma_200"), F.lit(False)).cast("int"))
    bear = rows.select("symbol", "ts", "fold_id", c("bear_pred").alias("y_pred"))
    both = combine_by_regime(rows, bear, rows.select("symbol", "ts", "regime_bull").distinct())
    return compute_metrics(both, ["symbol"]).join(regime_counts(both, ["symbol"]), "symbol")


def decisions(s, d):
    rows = scored_rows(s, d).select("symbol", "ts", c("proba").alias("bull_prob"), c("bear_proba").alias("bear_prob"))
    out = decide(rows, 0.5, 0.52)
    return out.withColumn("risk_notes", F.concat_ws("|", "risk_notes")).drop("bull_prob", "bear_prob")


def bands(s, d):
    m = compute_metrics(fold_rows(s, d), ["symbol", "fold_id"], ["f1_binary", "precision_binary", "cohen_kappa"])
    return m.select("symbol", "fold_id", kappa_band("cohen_kappa").alias("kappa_band"),
                    quality_tier("f1_binary", "precision_binary").alias("tier"))


def snapshot(s, d):
    return indicator_snapshot(build_frame(order_bars(s, d), ["technical", "volume"]).finish())


def flagship(s, d):
    """Bars, indicators and reversal labels end to end: indicator means per class."""
    f = build_frame(order_bars(s, d), ["technical"], lookahead=14)
    rows = get_label_strategy("reversal")(f, T=14, X=0.8).finish().filter(c("label").isNotNull())
    return rows.groupBy("symbol", "label").agg(
        F.count(F.lit(1)).alias("n"), F.avg("sma_20").alias("sma_20"), F.avg("rsi_14").alias("rsi_14"),
        F.avg("bb_pctb_20").alias("bb_pctb_20"), F.avg("ema_20").alias("ema_20"),
    )


QUERIES = {
    "feature_label_summary": flagship,
    "label_reversal": label_query("reversal", T=14, X=0.8),
    "label_reversal_down_first": label_query("reversal", T=14, X=0.8, tie="down"),
    "label_directional": label_query("directional", T=14, X=0.5),
    "label_return_sign": label_query("return_sign", T=7),
    "label_return_rate": label_query("return_rate", T=14),
    "label_triple_barrier": label_query("triple_barrier", T=14, X=0.7),
    "label_triple_barrier_far": label_query("triple_barrier", T=300, X=3.0, sl_ratio=0.3),
    "label_triple_barrier_far_blocked": label_query("triple_barrier", T=300, X=3.0, sl_ratio=0.3, block_rows=512, cell_rows=64),
    "label_triple_barrier_dynamic": label_query("triple_barrier", T=14, dynamic_threshold=True, sl_ratio=0.5, atr_multiplier=0.8),
    "label_balance_grid": grid,
    "walk_forward_folds": folds,
    "expanding_folds": lambda s, d: expanding_folds(series_sizes(scored_rows(s, d)), PLAN),
    "fold_assignment": fold_assignment,
    "inner_time_splits": lambda s, d: inner_time_splits(series_sizes(scored_rows(s, d)), 3),
    "validation_tail": tails,
    "class_weight": weights,
    "regime_sample_weight": sample_weights,
    "metrics_by_fold": lambda s, d: compute_metrics(fold_rows(s, d), ["symbol", "fold_id"]),
    "metrics_pooled": lambda s, d: compute_metrics(fold_rows(s, d), ["symbol"]),
    "metrics_pooled_once": pooled_once,
    "metrics_multiclass": lambda s, d: compute_metrics(multiclass(s, d), ["symbol"]),
    "confusion_matrix": lambda s, d: confusion_matrix(multiclass(s, d), ["symbol"], [0, 1, 2]),
    "classification_report": lambda s, d: classification_report(multiclass(s, d), ["symbol"]),
    "threshold_search": thresholds,
    "threshold_validation_tail": tail_thresholds,
    "threshold_applied": applied,
    "brier_score": lambda s, d: brier(fold_rows(s, d), ["symbol", "fold_id"]),
    "pnl_returns": equity,
    "pnl_metrics": lambda s, d: pnl_metrics(scored_rows(s, d)),
    "pnl_attached": with_pnl,
    "ensemble_combine": ensemble,
    "signal_decision": decisions,
    "signal_matrix": matrix,
    "signal_distribution": lambda s, d: signal_distribution(_matrix(s, d), ["symbol"]),
    "signal_distribution_all": lambda s, d: signal_distribution(_matrix(s, d)),
    "signal_efficacy": lambda s, d: signal_efficacy(_matrix(s, d), ["symbol"]),
    "majority_baseline": lambda s, d: majority_baseline(scored_rows(s, d), ["symbol"]),
    "quality_bands": bands,
    "recent_bars": lambda s, d: recent_bars(bar_frame(s, d, lookback=1)),
    "indicator_snapshot": snapshot,
}
