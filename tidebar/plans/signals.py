"""Signal tables from bull and bear predictions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidebar.operators.frame import Frame
from tidebar.operators.prepare import tail

c = F.col

# fixed values: texts of the four states (action, risk level)
ACTIONS = {
    "BULL": "add slightly or hold the long position",
    "BEAR": "reduce the position or set a stop",
    "NEUTRAL": "keep the current position",
    "VOLATILE": "lower leverage, set stop and target",
}
RISK_LEVELS = {"BULL": "medium", "BEAR": "elevated", "NEUTRAL": "low", "VOLATILE": "high"}
NOTES = {
    "bear_high": "high probability of a large fall, set a stop",
    "both_high": "both directions likely, limit the position",
    "both_low": "both directions weak, low confidence",
    "model": "limited predictive power, use as one input only",
}
# fixed values: indicators shown in a snapshot
SNAPSHOT = [
    "rsi_14", "macd", "macd_hist", "bb_pctb_20", "atr_pct_14", "sma_cross_50_200",
    "price_vs_sma_20", "price_vs_sma_200", "vol_ratio_20", "return_7d", "return_14d", "volatility_20d",
]


def state(bull_on: Column, bear_on: Column) -> Column:
    return (
        F.when(bull_on & ~bear_on, "BULL")
        .when(~bull_on & bear_on, "BEAR")
        .when(~bull_on & ~bear_on, "NEUTRAL")
        .otherwise("VOLATILE")
    )


def _texts(table: dict[str, str]) -> Column:
    out = F.lit(None).cast("string")
    for key, text in table.items():
        out = F.when(c("signal_code") == key, text).otherwise(out)
    return out


def decide(
    probs: DataFrame, bull_threshold: float = 0.50, bear_threshold: float = 0.50,
    bull: str = "bull_prob", bear: str = "bear_prob", model_note: str | None = None,
) -> DataFrame:
    """State, strengths, position, action, risk level and notes per row."""
    p, q = c(bull), c(bear)
    strength = lambda v, base: F.least(F.greatest((v - F.lit(base)) / F.lit(0.30), F.lit(0.0)), F.lit(1.0))
    df = probs.select(
        "*",
        state(p >= bull_threshold, q >= bear_threshold).alias("signal_code"),
        strength(p, 0.40).alias("bull_strength"),
        strength(q, 0.35).alias("bear_strength"),
    )
    position = (
        F.when(c("signal_code") == "BULL", 50 + (c("bull_strength") * 20).cast("int"))
        .when(c("signal_code") == "BEAR", 50 - (c("bear_strength") * 30).cast("int"))
        .when(c("signal_code") == "NEUTRAL", 50)
        .otherwise(35)
    )
    notes = F.array(
        F.when(q > 0.55, NOTES["bear_high"]),
        F.when((p > 0.60) & (q > 0.40), NOTES["both_high"]),
        F.when((p < 0.35) & (q < 0.35), NOTES["both_low"]),
        F.lit(model_note or NOTES["model"]),
    )
    return df.select(
        "*",
        position.alias("position_pct"),
        _texts(ACTIONS).alias("action"),
        _texts(RISK_LEVELS).alias("risk_level"),
        F.filter(notes, lambda n: n.isNotNull()).alias("risk_notes"),
    )


def signal_matrix(bull: DataFrame, bear: DataFrame, keys: Sequence[str] = ("symbol", "ts", "fold_id")) -> DataFrame:
    """Bull and bear predictions of the same row combined into one of four states."""
    left = bull.select(*keys, c("y_pred").alias("bull_pred"), c("y_true").alias("bull_true"))
    right = bear.select(*keys, c("y_pred").alias("bear_pred"), c("y_true").alias("bear_true"))
    return left.join(right, list(keys)).withColumn("signal", state(c("bull_pred") == 1, c("bear_pred") == 1))


def signal_distribution(matrix: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    counts = matrix.groupBy(*by, "signal").agg(F.count(F.lit(1)).alias("n"))
    group = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))  # at most four states per group
    return counts.withColumn("pct", c("n") * 100.0 / F.sum("n").over(group))


def signal_efficacy(matrix: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """How often the bull and bear targets came true per state."""
    return matrix.groupBy(*by, "signal").agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(c("bull_true").cast("double")).alias("actual_bull_rate"),
        F.avg(c("bear_true").cast("double")).alias("actual_bear_rate"),
    )


def kappa_band(k: str | Column) -> Column:
    k = c(k) if isinstance(k, str) else k
    return (
        F.when(k < 0, "worse than chance").when(k < 0.2, "almost none").when(k < 0.4, "weak")
        .when(k < 0.6, "moderate").when(k < 0.8, "substantial").otherwise("strong")
    )


def quality_tier(f1: str | Column, precision: str | Column) -> Column:
    f1 = c(f1) if isinstance(f1, str) else f1
    precision = c(precision) if isinstance(precision, str) else precision
    return F.when((f1 >= 0.5) & (precision >= 0.5), "good").when(f1 >= 0.3, "fair").otherwise("poor")


def recent_bars(f: Frame, n: int = 7) -> DataFrame:
    """Last n rows per series with their percent change."""
    out = f.add({"change": f.change("close") * 100}).finish()
    return tail(out, n, f.by, f.ts).select(*f.by, f.ts, "close", "change", "volume")


def indicator_snapshot(features: DataFrame, by: Sequence[str] = ("symbol",), ts: str = "ts") -> DataFrame:
    """Named indicators of the latest row of every series."""
    names = [n for n in SNAPSHOT if n in features.columns]
    latest = features.groupBy(*by).agg(F.max_by(F.struct(ts, *names), ts).alias("r"))
    return latest.select(*by, f"r.{ts}", *[f"r.{n}" for n in names])
