import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tests.helpers import frame
from tidebar.operators.folds import FoldPlan, check_folds, series_sizes, validation_tail, walk_forward_folds
from tidebar.operators.metrics import compute_metrics, optimize_threshold, tail_threshold_table, threshold_table
from tidebar.operators.pnl import PNL_FIELDS, pnl_metrics
from tidebar.operators.prepare import dedupe_keep_last, require_columns
from tidebar.operators.asof import asof_join


def sizes(spark, **n):
    return spark.createDataFrame(list(n.items()), "symbol string, n_rows long")


def test_folds_exact_fit_and_short(spark):
    plan = FoldPlan(100, 20, 10)
    out = walk_forward_folds(sizes(spark, a=140, b=119, c=129), plan).toPandas().sort_values(["symbol", "fold_id"])
    assert out.groupby("symbol").size().to_dict() == {"a": 3, "c": 1}
    assert out.iloc[-2][["train_end", "test_end"]].tolist() == [120, 140]
    with pytest.raises(ValueError, match="too short"):
        check_folds(sizes(spark, a=140, b=119), plan)


def test_purge_removes_folds_without_training_rows(spark):
    out = walk_forward_folds(sizes(spark, a=60), FoldPlan(10, 20, 10, purge_gap=20)).toPandas()
    assert sorted(out["train_size"]) == [10, 20] and sorted(out["fold_id"]) == [2, 3]


def preds(spark, y, p):
    return spark.createDataFrame(pd.DataFrame({"y_true": y, "y_pred": p}))


def test_metrics_by_hand(spark):
    m = compute_metrics(preds(spark, [0, 0, 1, 1, 1, 0], [0, 1, 1, 1, 0, 0])).first()
    assert m["accuracy"] == pytest.approx(4 / 6) and m["f1_binary"] == pytest.approx(2 / 3)
    assert m["cohen_kappa"] == pytest.approx(1 / 3)
    three = compute_metrics(preds(spark, [0, 1, 2, 2], [0, 2, 2, 2])).first()
    assert three["f1_binary"] is None and three["f1_macro"] == pytest.approx((1 + 0 + 0.8) / 3)
    assert three["f1_weighted"] == pytest.approx(0.25 + 0.5 * 0.8)
    one = compute_metrics(preds(spark, [0, 0], [0, 0]), names=["cohen_kappa", "f1_binary", "made_up"]).first()
    assert one["cohen_kappa"] is None and one["f1_binary"] == 0.0 and "made_up" not in one.asDict()


def brute_threshold(y, p, metric, least=0.0):
    best, score = 0.5, -np.inf
    for t in [k / 100 for k in range(20, 81)]:
        q = (p >= t).astype(int)
        if q.sum() in (0, len(q)):
            continue
        tp, fp = ((q == 1) & (y == 1)).sum(), ((q == 1) & (y == 0)).sum()
        fn, tn = ((q == 0) & (y == 1)).sum(), ((q == 0) & (y == 0)).sum()
        if least and tp / (tp + fp) < least:
            continue
        f1 = 2 * tp / (2 * tp + fp + fn) if tp + fp + fn else 0
        s = {"f1": f1, "youden": (tp / (tp + fn) if tp + fn else 0) + (tn / (tn + fp) if tn + fp else 0) - 1}[metric]
        if s > score:
            best, score = t, s
    return best, score


@pytest.mark.parametrize("metric,least", [("f1", 0.0), ("youden", 0.0), ("f1", 0.55)])
def test_threshold_against_loop(spark, metric, least):
    rng = np.random.default_rng(3)
    p = rng.uniform(0.1, 0.9, 400).round(2)
    y = (rng.uniform(size=400) < p * 0.8).astype(int)
    df = spark.createDataFrame(pd.DataFrame({"proba": p, "y_true": y}))
    got = optimize_threshold(df, metric=metric, min_precision=least).first()
    want = brute_threshold(y, p, metric, least)
    assert got["best_threshold"] == want[0] and got["best_score"] == pytest.approx(want[1])


def test_threshold_fallback_and_ties(spark):
    df = lambda p, y: spark.createDataFrame(pd.DataFrame({"proba": p, "y_true": y}))
    none = optimize_threshold(df([0.9, 0.95], [1, 0])).first()
    assert none["best_threshold"] == 0.5 and none["best_score"] is None
    assert optimize_threshold(df([0.3, 0.7], [0, 1])).first()["best_threshold"] == 0.31
    with pytest.raises(ValueError, match="threshold metric"):
        optimize_threshold(df([0.3, 0.7], [0, 1]), metric="odd")


def numpy_pnl(y, ret, size=1.0, cost=0.001, per=52.0):
    pos = y * size
    step = np.diff(np.concatenate([[0], pos]))
    r = pos[:-1] * ret[1:] - np.abs(step)[1:] * cost
    eq = np.cumprod(1 + r)
    peak = np.maximum.accumulate(eq)
    neg, win, loss = r[r < 0], r[r > 0], r[r < 0]
    dd = ((eq - peak) / peak).min()
    cagr = eq[-1] ** (per / len(r)) - 1
    return {
        "total_return": eq[-1] - 1, "cagr": cagr, "sharpe": r.mean() / r.std() * np.sqrt(per) if r.std() > 0 else 0,
        "sortino": r.mean() / neg.std() * np.sqrt(per) if len(neg) and neg.std() > 0 else 0, "max_drawdown": dd,
        "calmar": cagr / abs(dd) if dd else 0, "win_rate": len(win) / max(len(win) + len(loss), 1),
        "profit_factor": abs(win.sum() / loss.sum()) if loss.sum() else 0,
        "avg_win": win.mean() if len(win) else 0, "avg_loss": loss.mean() if len(loss) else 0,
        "num_trades": len(win) + len(loss), "num_wins": len(win), "num_losses": len(loss),
    }


def test_pnl_against_numpy(spark):
    rng = np.random.default_rng(5)
    parts, want = [], {}
    for symbol, y in (("mixed", rng.integers(0, 2, 200)), ("long", np.ones(50, int)), ("flat", np.zeros(50, int))):
        ret = rng.normal(0.002, 0.03, len(y))
        ret = np.abs(ret) if symbol == "long" else ret  # no losses: profit factor 0
        parts.append(pd.DataFrame({"symbol": symbol, "ts": pd.date_range("2024-01-01", periods=len(y)), "y_true": y, "y_pred": y, "ret": ret}))
        want[symbol] = numpy_pnl(y, ret)
    parts.append(pd.DataFrame({"symbol": "single", "ts": [pd.Timestamp("2024-01-01")], "y_true": [1], "y_pred": [1], "ret": [0.1]}))
    want["single"] = dict.fromkeys(PNL_FIELDS, 0)
    got = pnl_metrics(spark.createDataFrame(pd.concat(parts))).toPandas().set_index("symbol")
    for symbol, fields in want.items():
        for name, value in fields.items():
            assert got.loc[symbol, name] == pytest.approx(value, rel=1e-9, abs=1e-12), (symbol, name)


def test_dedupe_and_required_columns(spark):
    df = spark.createDataFrame([("A", 1, 1, 1.0), ("A", 1, 2, None), ("A", 2, 1, 3.0)], "symbol string, ts int, seq int, x double")
    out = frame(dedupe_keep_last(df, ["symbol", "ts"], "seq"))
    assert out["seq"].tolist() == [2, 1] and np.isnan(out["x"][0])  # the last row wins even when null
    with pytest.raises(ValueError, match="close"):
        require_columns(df)


def test_asof_cases(spark):
    at = lambda n: F.timestamp_seconds(F.lit(n))
    bars = spark.createDataFrame([("A", n) for n in (1, 5, 6, 9, 20)] + [("B", 6)], "symbol string, n int")
    bars = bars.select("symbol", F.timestamp_seconds("n").alias("ts"), "n")
    src = spark.createDataFrame([("A", 5, 50.0), ("A", 8, None), ("B", 2, 7.0)], "symbol string, n int, level double")
    src = src.select("symbol", F.timestamp_seconds("n").alias("ts"), "level")
    out = frame(asof_join(bars, [src]))
    levels = out["level"].tolist()
    assert np.isnan(levels[0]) and levels[1:3] == [50.0, 50.0]  # before the first, exact hit, gap
    assert np.isnan(levels[3]) and np.isnan(levels[4])  # a null value of the last row stays null
    assert levels[5] == 7.0


@pytest.mark.parametrize("plan,ratio,least", [
    (FoldPlan(40, 10, 7, 3), 0.15, 5), (FoldPlan(30, 5, 1, 0), 0.9, 2), (FoldPlan(3, 2, 2, 8), 0.5, 1), (FoldPlan(60, 10, 30, 0), 0.0, 50),
])
def test_validation_tails_without_copies(spark, plan, ratio, least):
    """The counts of every fold's tail against rows copied per fold."""
    rng = np.random.default_rng(3)
    parts = []
    for name, n in (("A", 260), ("B", 130), ("C", 20)):
        parts.append(pd.DataFrame({
            "symbol": name, "row_idx": np.arange(n), "n_rows": n, "proba": rng.random(n).round(2), "y_true": rng.integers(0, 2, n), "fold": 0,
        }))
    rows = spark.createDataFrame(pd.concat(parts))
    rows = rows.withColumn("proba", F.when(F.col("row_idx") % 11 != 0, F.col("proba")))
    keys = ["symbol", "fold_id"]
    held = validation_tail(rows, plan, ratio, least).filter(F.lit(plan.init_train - plan.purge_gap) + F.col("fold_id") * plan.step > 0)
    want = threshold_table(held, keys)
    got = tail_threshold_table(rows, plan, ratio, least)
    pick = lambda df: sorted(map(tuple, df.select(*keys, "threshold", "tp", "fp", "tn", "fn").collect()))
    assert pick(got) == pick(want) and got.count() > 0
