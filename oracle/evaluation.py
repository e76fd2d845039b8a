"""Comparison SQL of labels, folds, metrics, thresholds, PnL and signals."""

from oracle.build import BARS, W, Layers, diff, flag, lag, lead, mean, pct, ratio, roll, std
from oracle.features import TR, technical
from oracle.tables import directional, reversal

KEYS = ["symbol", "ts"]
INIT, OOS, STEP, PURGE = 900, 63, 21, 7


def triple(T, pt, sl, q):
    """First touched barrier by explicit look-ahead: list positions of the first stop and profit."""
    q.add({"pt": pt})
    q.add({"hi": "close * (1 + pt)", "lo": f"close * (1 - pt * {sl}::DOUBLE)",
           "ahead": f"list({{'l': low, 'h': high}}) OVER ({W} ROWS BETWEEN 1 FOLLOWING AND {T} FOLLOWING)"})
    q.add({"stops": "list_position([x.l <= lo for x in ahead], true)", "wins": "list_position([x.h >= hi for x in ahead], true)"})
    return q.add({"label": f"CASE WHEN pt IS NOT NULL AND len(ahead) = {T} THEN CASE "
                           "WHEN stops > 0 AND (coalesce(wins, 0) = 0 OR stops <= wins) THEN 0 WHEN wins > 0 THEN 2 ELSE 1 END END"})


def scored() -> Layers:
    q = directional(7, 0.5)
    q.add({"d": diff("close"), "sma_20": mean("close", 20), "sma_200": mean("close", 200)})
    q.add({"g": "CASE WHEN d IS NOT NULL THEN greatest(d, 0) END", "l": "CASE WHEN d IS NOT NULL THEN greatest(-d, 0) END", "ret": pct("sma_20")})
    q.add({"rsi": f"100 - 100 / (1 + {ratio(mean('g', 14), mean('l', 14))})"})
    q.cte("scored", f"SELECT symbol, ts, close, sma_200, ret, rsi / 100 AS proba, 1 - rsi / 100 AS bear_proba, "
                    f"CASE WHEN label = 2 THEN 1 ELSE 0 END AS y_true, CASE WHEN label = 0 THEN 1 ELSE 0 END AS bear_true "
                    f"FROM {q.last} WHERE rsi IS NOT NULL AND label IS NOT NULL")
    q.cte("s", f"SELECT *, CAST(proba >= 0.5 AS INTEGER) AS y_pred, CAST(bear_proba >= 0.48 AS INTEGER) AS bear_pred, "
               f"row_number() OVER ({W}) - 1 AS row_idx FROM scored")
    return q


def folds(q: Layers, name="f") -> Layers:
    return q.cte(name, f"SELECT symbol, fold_id, 0::BIGINT AS train_start, {INIT} + fold_id * {STEP} AS train_end, "
                       f"{INIT} + fold_id * {STEP} AS test_start, {INIT + OOS} + fold_id * {STEP} AS test_end, "
                       f"{INIT - PURGE} + fold_id * {STEP} AS train_size FROM (SELECT symbol, unnest(range(0, (n - {INIT + OOS}) // {STEP} + 1)) AS fold_id "
                       f"FROM (SELECT symbol, count(*) AS n FROM s GROUP BY 1) WHERE n >= {INIT + OOS})")


def fold_rows() -> Layers:
    q = folds(scored())
    return q.cte("fr", "SELECT s.*, f.fold_id FROM s JOIN f ON s.symbol = f.symbol AND row_idx >= test_start AND row_idx < test_end")


def metrics(q: Layers, table: str, by: str) -> Layers:
    """Confusion counts to all metrics, per class through a class list."""
    on = " AND ".join(f"k.{b} = p.{b}" for b in by.split(", "))
    q.cte("cls", f"SELECT DISTINCT {by}, y_true AS cls FROM {table} UNION SELECT DISTINCT {by}, y_pred FROM {table}")
    kby = ", ".join(f"k.{b}" for b in by.split(", "))
    q.cte("pc", f"SELECT {kby}, k.cls, sum((p.y_true = k.cls)::INT) AS support, sum((p.y_pred = k.cls)::INT) AS predicted, "
                f"sum((p.y_true = k.cls AND p.y_pred = k.cls)::INT) AS hit, count(*) AS total FROM cls k JOIN {table} p ON {on} GROUP BY ALL")
    q.cte("pr", "SELECT *, coalesce(hit / nullif(predicted, 0), 0) AS precision, coalesce(hit / nullif(support, 0), 0) AS recall, "
                "coalesce(2 * hit / nullif(support + predicted, 0), 0) AS f1 FROM pc")
    pos = lambda m: f"CASE WHEN max(cls) <= 1 THEN coalesce(max(CASE WHEN cls = 1 THEN {m} END), 0) END"
    q.cte("agg", f"SELECT {by}, CAST(max(total) AS BIGINT) AS n, sum(hit)::DOUBLE / max(total) AS accuracy, avg(f1) AS f1_macro, sum(f1 * support) / max(total) AS f1_weighted, "
                 f"{pos('f1')} AS f1_binary, avg(precision) AS precision_macro, {pos('precision')} AS precision_binary, avg(recall) AS recall_macro, "
                 f"{pos('recall')} AS recall_binary, sum(support::DOUBLE * predicted) / (max(total)::DOUBLE * max(total)) AS pe FROM pr GROUP BY {by}")
    return q.add({"cohen_kappa": "CASE WHEN pe < 1 THEN 1 - (1 - accuracy) / (1 - pe) END"})


ALL_METRICS = [
    "accuracy", "f1_macro", "f1_weighted", "f1_binary", "precision_macro", "precision_binary", "recall_macro",
    "recall_binary", "cohen_kappa",
]


def thresholds(q: Layers, name: str, metric: str, min_precision: float = 0.0) -> str:
    """Every row against every threshold; returns the CTE with the best one per group."""
    if not any(n == "grid" for n, _ in q.ctes):
        q.cte("grid", "SELECT k / 100::DOUBLE AS t FROM range(20, 81) r(k)")
        q.cte("counts", "SELECT symbol, fold_id, t, sum((proba >= t AND y_true = 1)::INT) AS tp, sum((proba >= t AND y_true = 0)::INT) AS fp, "
                        "sum((proba < t AND y_true = 0)::INT) AS tn, sum((proba < t AND y_true = 1)::INT) AS fn FROM fr CROSS JOIN grid GROUP BY 1, 2, 3")
    f1 = "coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0)"
    n = "(tp + fp + tn + fn)::DOUBLE"
    pe = f"(((tp + fn) * (tp + fp) + (tn + fp) * (tn + fn)) / ({n} * {n}))"
    score = {
        "f1": f1, "precision_recall": f1, "f1_macro": f"({f1} + coalesce(2 * tn / nullif(2 * tn + fp + fn, 0), 0)) / 2",
        "youden": "coalesce(tp / nullif(tp + fn, 0), 0) + coalesce(tn / nullif(tn + fp, 0), 0) - 1",
        "kappa": f"CASE WHEN {pe} < 1 THEN 1 - (1 - (tp + tn) / {n}) / (1 - {pe}) END",
    }[metric]
    keep = "tp + fp > 0 AND tn + fn > 0" + (f" AND tp / nullif(tp + fp, 0) >= {min_precision}" if min_precision else "")
    q.cte(f"sc_{name}", f"SELECT *, CASE WHEN {keep} THEN {score} END AS score FROM counts")
    q.cte(f"best_{name}", f"SELECT symbol, fold_id, coalesce(first(t ORDER BY score DESC NULLS LAST, t) FILTER (score IS NOT NULL), 0.5) AS best_threshold, "
                          f"max(score) AS best_score FROM sc_{name} GROUP BY 1, 2")
    return f"best_{name}"


def equity(q: Layers) -> Layers:
    q.cte("v", "SELECT symbol, ts, y_pred AS pos, ret FROM s WHERE ret IS NOT NULL")
    q.add({"sr": f"pos * {lead('ret')} - abs({lead('pos')} - pos) * 0.001::DOUBLE"}).where("sr IS NOT NULL")
    q.add({"equity": f"product(1 + sr) OVER ({W} ROWS UNBOUNDED PRECEDING)"})
    q.add({"peak": f"max(equity) OVER ({W} ROWS UNBOUNDED PRECEDING)"})
    return q.add({"drawdown": "(equity - peak) / nullif(peak, 0)", "strategy_return": "sr"})


def pnl(q: Layers) -> Layers:
    equity(q)
    q.cte("p0", "SELECT symbol, arg_max(equity, ts) AS eq, count(*) AS n, avg(sr) AS m, stddev_pop(sr) AS sd, "
                "stddev_pop(sr) FILTER (sr < 0) AS dn, min(drawdown) AS max_drawdown, count(*) FILTER (sr > 0) AS num_wins, "
                "count(*) FILTER (sr < 0) AS num_losses, coalesce(sum(sr) FILTER (sr > 0), 0) AS sw, coalesce(sum(sr) FILTER (sr < 0), 0) AS sl, "
                f"coalesce(avg(sr) FILTER (sr > 0), 0) AS avg_win, coalesce(avg(sr) FILTER (sr < 0), 0) AS avg_loss FROM {q.last} GROUP BY 1")
    q.add({"total_return": "eq - 1", "cagr": "CASE WHEN eq >= 0 THEN pow(eq, 52.0 / n) - 1 END", "num_trades": "num_wins + num_losses"})
    return q.cte("pnl", "SELECT *, CASE WHEN sd > 0 THEN m / sd * sqrt(52.0) ELSE 0 END AS sharpe, CASE WHEN dn > 0 THEN m / dn * sqrt(52.0) ELSE 0 END AS sortino, "
                        "CASE WHEN max_drawdown <> 0 THEN cagr / abs(max_drawdown) ELSE 0 END AS calmar, "
                        "CASE WHEN num_trades > 0 THEN num_wins / num_trades ELSE 0 END AS win_rate, "
                        f"CASE WHEN sl <> 0 THEN abs(sw / sl) ELSE 0 END AS profit_factor FROM {q.last}")


PNL_D = ["total_return", "cagr", "sharpe", "sortino", "max_drawdown", "calmar", "win_rate", "profit_factor"]


def state(b, s):
    return f"CASE WHEN {b} AND NOT {s} THEN 'BULL' WHEN NOT {b} AND {s} THEN 'BEAR' WHEN NOT {b} AND NOT {s} THEN 'NEUTRAL' ELSE 'VOLATILE' END"


def matrix() -> Layers:
    q = fold_rows()
    return q.cte("mx", f"SELECT symbol, ts, fold_id, y_pred AS bull_pred, bear_pred, y_true, bear_true, {state('y_pred = 1', 'bear_pred = 1')} AS signal FROM fr")


def multiclass() -> Layers:
    q = directional(7, 0.5).add({"past": pct("close", 7)})
    return q.cte("mc", "SELECT symbol, label AS y_true, CASE WHEN past >= 0.5 THEN 0 WHEN past <= -0.5 THEN 2 ELSE 1 END AS y_pred "
                       f"FROM {q.last} WHERE label IS NOT NULL AND past IS NOT NULL")


def sql() -> dict[str, str]:
    lab = lambda q: q.out([*KEYS, "CAST(label AS INTEGER) AS label"], [])
    new = lambda: Layers("bars", [BARS])
    out = {
        "label_reversal": lab(reversal(14, 0.8)),
        "label_reversal_down_first": lab(reversal(14, 0.8, tie="down")),
        "label_directional": lab(directional(14, 0.5)),
        "label_return_sign": lab(new().add({"label": f"{lead('close', 7)} / nullif(close, 0) - 1 > 0"})),
        "label_return_rate": new().add({"label": f"({lead('close', 14)} / nullif(close, 0) - 1) * 100"}).out(KEYS, ["label"]),
        "label_triple_barrier": lab(triple(14, "0.7::DOUBLE", "1.0", new())),
    }
    out["label_triple_barrier_far"] = lab(triple(300, "3.0::DOUBLE", "0.3", new()))
    out["label_triple_barrier_far_blocked"] = out["label_triple_barrier_far"]
    q = new().add({"tr": TR}).add({"atr": mean("tr", 14)})
    out["label_triple_barrier_dynamic"] = lab(triple(14, "0.8::DOUBLE * atr / nullif(close, 0)", "0.5", q))

    parts, q = [], new()
    for name, make in (("reversal", reversal), ("directional", directional)):
        for T in (7, 14, 28):
            for X in (0.3, 0.8):
                one = make(T, X, Layers("bars", []))
                cte = f"g{len(parts)}"
                inner = "WITH " + ", ".join(f"{n} AS ({s})" for n, s in one.ctes)
                q.ctes.append((cte, f"{inner} SELECT '{name}' AS strategy, symbol, {T} AS T, {X}::DOUBLE AS X, label, count(*) AS n FROM {one.last} WHERE label IS NOT NULL GROUP BY ALL"))
                parts.append(cte)
    q.cte("u", " UNION ALL ".join(f"SELECT * FROM {p}" for p in parts))
    q.add({"pct": "n * 100.0::DOUBLE / sum(n) OVER (PARTITION BY strategy, symbol, T, X)"})
    out["label_balance_grid"] = q.out(["strategy", "symbol", "T", "label", "n"], ["X", "pct"])

    cols = ["symbol", "fold_id", "train_start", "train_end", "test_start", "test_end", "train_size"]
    out["walk_forward_folds"] = out["expanding_folds"] = folds(scored()).out(cols, [])
    out["fold_assignment"] = fold_rows().out([*KEYS, "fold_id", "row_idx"], [])
    q = scored().cte("z", "SELECT symbol, count(*) AS n FROM s GROUP BY 1")
    q.cte("sp", "SELECT symbol, k AS split_id, n - (3 - k) * (n // 4) AS valid_start, n - (2 - k) * (n // 4) AS valid_end FROM z CROSS JOIN (SELECT unnest([0, 1, 2]) AS k)")
    out["inner_time_splits"] = q.out(["symbol", "split_id", "valid_start", "valid_end"], [])
    q = folds(scored())
    q.cte("vt", "SELECT s.symbol, f.fold_id, count(*) AS n, min(row_idx) AS first_row, max(row_idx) AS last_row, CAST(sum(y_true) AS BIGINT) AS positives "
                "FROM s JOIN f ON s.symbol = f.symbol AND row_idx < train_size AND row_idx >= train_size - greatest(CAST(floor(train_size * 0.15::DOUBLE) AS BIGINT), 50) GROUP BY 1, 2")
    out["validation_tail"] = q.out(["symbol", "fold_id", "n", "first_row", "last_row", "positives"], [])
    q = folds(scored())
    q.cte("cw", "SELECT s.symbol, f.fold_id, CAST(sum((y_true = 0)::INT) AS BIGINT) AS n_neg, CAST(sum((y_true = 1)::INT) AS BIGINT) AS n_pos "
                "FROM s JOIN f ON s.symbol = f.symbol AND row_idx < train_size GROUP BY 1, 2")
    out["class_weight"] = q.add({"pos_weight": "CASE WHEN n_pos > 0 AND n_neg > 0 THEN n_neg / n_pos END"}).out(
        ["symbol", "fold_id", "n_neg", "n_pos"], ["pos_weight"])
    w = "CASE WHEN close > sma_200 THEN 1.5 WHEN close < sma_200 THEN 1.2 WHEN close = sma_200 THEN 0.5 ELSE 1.0 END"
    out["regime_sample_weight"] = scored().add({"weight": f"CAST({w} AS DOUBLE)"}).out(KEYS, ["weight"])

    out["metrics_by_fold"] = metrics(fold_rows(), "fr", "symbol, fold_id").out(["symbol", "fold_id", "n"], ALL_METRICS)
    out["metrics_pooled"] = metrics(fold_rows(), "fr", "symbol").out(["symbol", "n"], ALL_METRICS)
    q = fold_rows().cte("once", "SELECT * FROM fr QUALIFY row_number() OVER (PARTITION BY symbol, ts ORDER BY fold_id DESC) = 1")
    out["metrics_pooled_once"] = metrics(q, "once", "symbol").out(["symbol", "n"], ALL_METRICS)
    out["metrics_multiclass"] = metrics(multiclass(), "mc", "symbol").out(["symbol", "n"], ALL_METRICS)
    q = multiclass().cte("cm", "SELECT symbol, y_true, " + ", ".join(f"count(*) FILTER (y_pred = {k}) AS pred_{k}" for k in range(3)) + " FROM mc GROUP BY 1, 2")
    out["confusion_matrix"] = q.out(["symbol", "y_true", "pred_0", "pred_1", "pred_2"], [])
    q = metrics(multiclass(), "mc", "symbol")
    q.last = "pr"
    out["classification_report"] = q.out(["symbol", "cls", "CAST(support AS BIGINT) AS support"], ["precision", "recall", "f1"])

    q = fold_rows()
    names = {m: thresholds(q, m, m) for m in ("f1", "kappa", "youden", "precision_recall", "f1_macro")}
    names["precision_at_0.4"] = thresholds(q, "p4", "precision_recall", 0.4)
    q.cte("allbest", " UNION ALL ".join(f"SELECT *, '{m}' AS metric FROM {t}" for m, t in names.items()))
    out["threshold_search"] = q.out(["symbol", "fold_id", "metric"], ["best_threshold", "best_score"])
    q = fold_rows()
    q2 = folds(scored())
    q2.cte("fr", "SELECT s.symbol, f.fold_id, proba, y_true FROM s JOIN f ON s.symbol = f.symbol AND row_idx < train_size "
                 "AND row_idx >= train_size - greatest(CAST(floor(train_size * 0.15::DOUBLE) AS BIGINT), 50)")
    names = {m: thresholds(q2, m, m) for m in ("f1", "kappa", "youden")}
    q2.cte("best", " UNION ALL ".join(f"SELECT *, '{m}' AS metric FROM {n}" for m, n in names.items()))
    out["threshold_validation_tail"] = q2.out(["symbol", "fold_id", "metric"], ["best_threshold", "best_score"])
    best = thresholds(q, "y", "youden")
    q.cte("ap", f"SELECT symbol, fold_id, y_true, CAST(proba >= best_threshold AS INTEGER) AS y_pred FROM fr JOIN {best} USING (symbol, fold_id)")
    out["threshold_applied"] = metrics(q, "ap", "symbol").out(["symbol", "n"], ["accuracy", "f1_binary", "cohen_kappa"])
    q = fold_rows().cte("b", "SELECT symbol, fold_id, avg((proba - y_true) * (proba - y_true)) AS brier FROM fr GROUP BY 1, 2")
    out["brier_score"] = q.out(["symbol", "fold_id"], ["brier"])

    out["pnl_returns"] = equity(scored()).out(KEYS, ["strategy_return", "equity", "drawdown"])
    out["pnl_metrics"] = pnl(scored()).out(["symbol", "num_trades", "num_wins", "num_losses"], [*PNL_D, "avg_win", "avg_loss"])
    q = pnl(metrics(scored(), "s", "symbol").cte("mm", "SELECT symbol, n AS rows_n, accuracy, f1_macro FROM agg"))
    q.cte("att", "SELECT mm.symbol, rows_n AS n, accuracy, f1_macro, num_trades AS pnl_num_trades, " + ", ".join(f"{p} AS pnl_{p}" for p in PNL_D) + " FROM mm JOIN pnl USING (symbol)")
    out["pnl_attached"] = q.out(["symbol", "n", "pnl_num_trades"], ["accuracy", "f1_macro", *[f"pnl_{p}" for p in PNL_D]])

    q = fold_rows().cte("en", "SELECT symbol, y_true, CASE WHEN close > sma_200 THEN y_pred ELSE bear_pred END AS y_pred, CASE WHEN close > sma_200 THEN 1 ELSE 0 END AS rb FROM fr")
    q.cte("rc", "SELECT symbol, CAST(sum(rb) AS BIGINT) AS n_bull, CAST(sum(1 - rb) AS BIGINT) AS n_bear FROM en GROUP BY 1")
    metrics(q, "en", "symbol")
    q.cte("enj", f"SELECT * FROM {q.last} JOIN rc USING (symbol)")
    out["ensemble_combine"] = q.out(["symbol", "n", "n_bull", "n_bear"], ALL_METRICS)

    q = scored().add({
        "signal_code": state("proba >= 0.5", "bear_proba >= 0.52"),
        "bull_strength": "least(1.0::DOUBLE, greatest(0.0::DOUBLE, (proba - 0.40::DOUBLE) / 0.30::DOUBLE))",
        "bear_strength": "least(1.0::DOUBLE, greatest(0.0::DOUBLE, (bear_proba - 0.35::DOUBLE) / 0.30::DOUBLE))",
    })
    from tidebar.plans.signals import ACTIONS, NOTES, RISK_LEVELS

    texts = lambda t: "CASE signal_code " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in t.items()) + " END"
    q.add({
        "position_pct": "CASE signal_code WHEN 'BULL' THEN 50 + trunc(bull_strength * 20)::INT WHEN 'BEAR' THEN 50 - trunc(bear_strength * 30)::INT WHEN 'NEUTRAL' THEN 50 ELSE 35 END",
        "action": texts(ACTIONS), "risk_level": texts(RISK_LEVELS),
        "risk_notes": f"concat_ws('|', CASE WHEN bear_proba > 0.55 THEN '{NOTES['bear_high']}' END, CASE WHEN proba > 0.60 AND bear_proba > 0.40 THEN '{NOTES['both_high']}' END, "
                      f"CASE WHEN proba < 0.35 AND bear_proba < 0.35 THEN '{NOTES['both_low']}' END, '{NOTES['model']}')",
    })
    out["signal_decision"] = q.out([*KEYS, "signal_code", "position_pct", "action", "risk_level", "risk_notes"], ["bull_strength", "bear_strength"])
    out["signal_matrix"] = matrix().out([*KEYS, "fold_id", "bull_pred", "bear_pred", "signal"], [])
    dist = lambda by, over: matrix().cte("ds", f"SELECT {by}signal, count(*) AS n FROM mx GROUP BY ALL").add({"pct": f"n * 100.0::DOUBLE / sum(n) OVER ({over})"})
    out["signal_distribution"] = dist("symbol, ", "PARTITION BY symbol").out(["symbol", "signal", "n"], ["pct"])
    out["signal_distribution_all"] = dist("", "").out(["signal", "n"], ["pct"])
    q = matrix().cte("ef", "SELECT symbol, signal, count(*) AS n, avg(y_true::DOUBLE) AS actual_bull_rate, avg(bear_true::DOUBLE) AS actual_bear_rate FROM mx GROUP BY 1, 2")
    out["signal_efficacy"] = q.out(["symbol", "signal", "n"], ["actual_bull_rate", "actual_bear_rate"])
    q = scored().cte("mb", "SELECT symbol, avg(y_true::DOUBLE) AS pos_rate, avg((y_true = y_pred)::INT::DOUBLE) AS accuracy FROM s GROUP BY 1")
    q.add({"majority_acc": "greatest(pos_rate, 1 - pos_rate)"}).add({"acc_lift": "accuracy - majority_acc"})
    out["majority_baseline"] = q.out(["symbol"], ["pos_rate", "accuracy", "majority_acc", "acc_lift"])
    q = metrics(fold_rows(), "fr", "symbol, fold_id").add({
        "kappa_band": "CASE WHEN cohen_kappa < 0 THEN 'worse than chance' WHEN cohen_kappa < 0.2 THEN 'almost none' WHEN cohen_kappa < 0.4 THEN 'weak' "
                      "WHEN cohen_kappa < 0.6 THEN 'moderate' WHEN cohen_kappa < 0.8 THEN 'substantial' ELSE 'strong' END",
        "tier": "CASE WHEN f1_binary >= 0.5 AND precision_binary >= 0.5 THEN 'good' WHEN f1_binary >= 0.3 THEN 'fair' ELSE 'poor' END",
    })
    out["quality_bands"] = q.out(["symbol", "fold_id", "kappa_band", "tier"], [])
    q = new().add({"change": f"{pct('close')} * 100"}).cte("rb", "SELECT * FROM l1 QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) <= 7")
    out["recent_bars"] = q.out(KEYS, ["close", "change", "volume"])
    snap = ["rsi_14", "macd", "macd_hist", "bb_pctb_20", "atr_pct_14", "sma_cross_50_200", "price_vs_sma_20", "price_vs_sma_200",
            "return_7d", "return_14d", "volatility_20d"]
    q = Layers("x", [BARS, ("t", technical()), ("v", f"SELECT symbol, ts, {ratio('volume', mean('volume', 20))} AS vol_ratio_20 FROM bars"),
                     ("x", "SELECT t.*, vol_ratio_20 FROM t JOIN v USING (symbol, ts) QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) = 1")])
    out["indicator_snapshot"] = q.out(KEYS, [*snap, "vol_ratio_20"])
    q = Layers("fl", [(BARS[0], BARS[1]), *reversal(14, 0.8).ctes[1:], ("t", technical()), (
        "fl", "SELECT symbol, CAST(label AS INTEGER) AS label, count(*) AS n, avg(t.sma_20) AS sma_20, avg(t.rsi_14) AS rsi_14, avg(t.bb_pctb_20) AS bb_pctb_20, "
              "avg(t.ema_20) AS ema_20 FROM l2 JOIN t USING (symbol, ts) WHERE label IS NOT NULL GROUP BY 1, 2")])
    out["feature_label_summary"] = q.out(["symbol", "label", "n"], ["sma_20", "rsi_14", "bb_pctb_20", "ema_20"])
    return out
