"""Registry, builder properties, and the pandas restatement of core formulas."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import tidebar.features
from tests.helpers import assert_same, frame, walk_bars
from tidebar.features import get_feature_set, list_feature_sets, register_feature_set
from tidebar.features.builder import build_features, build_frame, feature_columns
from tidebar.functions.scalars import nan_to_null
from tidebar.operators.frame import lay_out

SETS = {
    "technical", "volume", "flow", "market_structure", "onchain", "sentiment", "lag_rolling", "regime",
    "bear_volatility", "external", "external_fgi", "external_fgi_enhanced", "external_macro", "external_fr",
}


@pytest.fixture(scope="module")
def bars(spark):
    return spark.createDataFrame(walk_bars(300, extra=False)).cache()


def test_registry():
    assert SETS <= set(list_feature_sets())
    with pytest.raises(KeyError, match="available"):
        get_feature_set("nope")


def test_custom_set(bars):
    @register_feature_set("spread_for_test", lookback=3)
    def spread(f):
        return f.add({"spread_mean": f.mean(F.col("high") - F.col("low"), 3)})

    out = frame(build_features(bars, ["spread_for_test"]))
    assert len(out) == 298 and (out["spread_mean"] > 0).all()


@pytest.mark.parametrize("sets", [["volume"], ["flow"], ["technical", "volume", "flow"]])
def test_builder_properties(bars, sets):
    out = build_features(bars, sets)
    pdf = out.toPandas()
    assert len(out.columns) > len(bars.columns) and 0 < len(pdf) <= 300
    assert pdf.isna().sum().sum() == 0
    names = feature_columns(out)
    assert not {"open", "high", "low", "close", "volume", "symbol", "ts"} & set(names)


def test_optional_columns_skip_groups(bars):
    cols = build_frame(bars, ["volume", "flow", "market_structure"]).columns
    assert not any(x.startswith(("qvol_", "trades_", "flow_change", "avg_trade")) for x in cols)
    assert "volume_density_sma_5" in cols and "volume_density_ma_5" in cols


def test_absent_sources_add_nothing(bars):
    f = build_frame(bars, ["external", "external_fgi_enhanced"], sources={})
    assert set(f.columns) == set(bars.columns)


def test_unknown_null_policy(bars):
    with pytest.raises(ValueError, match="null policy"):
        build_features(bars, ["volume"], "guess")


def test_against_pandas(bars):
    got = frame(build_frame(bars, ["technical", "volume", "sentiment", "bear_volatility"]).finish())
    p = walk_bars(300, extra=False)
    c, h, lo, v = p["close"], p["high"], p["low"], p["volume"]
    ret = c.pct_change()
    want = pd.DataFrame({f"ema_{w}": c.ewm(span=w, adjust=False).mean() for w in (5, 20, 200)})
    macd = c.ewm(span=12, adjust=False).mean() - c.ewm(span=26, adjust=False).mean()
    want["macd_signal"] = macd.ewm(span=9, adjust=False).mean()
    want["sma_50"] = c.rolling(50).mean()
    d = c.diff()
    rs = d.clip(lower=0).rolling(14).mean() / ((-d).clip(lower=0).rolling(14).mean() + 1e-10)
    want["rsi_14"] = 100 - 100 / (1 + rs)
    tr = pd.concat([h - lo, (h - c.shift()).abs(), (lo - c.shift()).abs()], axis=1).max(axis=1)
    want["atr_14"] = tr.rolling(14).mean()
    want["volatility_10d"] = ret.rolling(10).std()
    want["obv"] = (np.sign(c.diff()) * v).fillna(0).cumsum()
    want["vol_price_corr_20"] = v.rolling(20).corr(c)
    want["dist_from_high_90d"] = (c - c.rolling(90, min_periods=1).max()) / (c.rolling(90, min_periods=1).max() + 1e-10)
    up = (ret > 0).astype(int)
    want["consecutive_up_days"] = up.groupby((up == 0).cumsum()).cumsum()
    want["bear_max_drawdown"] = (c - c.cummax()) / (c.cummax() + 1e-10)
    rv = ret.rolling(21).std()
    want["bear_vol_high"] = (rv > rv.rolling(60).median() * 1.5).astype(int)
    for name in want:
        np.testing.assert_allclose(got[name].astype(float), want[name].astype(float), rtol=1e-9, atol=1e-9, err_msg=name)


def test_warm_up_and_interior_null(spark):
    rows = [("A", i, None if i == 4 else float(i)) for i in range(10)] + [("B", i, 1.0) for i in range(3)]
    df = spark.createDataFrame(rows, "symbol string, n int, x double").select(
        "symbol", F.timestamp_seconds(F.col("n") * 86400).alias("ts"), "x"
    )
    f = lay_out(df, lookback=3)
    out = frame(f.add({"m": f.mean("x", 3), "p": f.mean("x", 3, 1)}).ffill(["x"]).finish())
    a = out[out.symbol == "A"].reset_index(drop=True)
    assert a["m"].isna().tolist() == [True, True, False, False, True, True, True, False, False, False]
    assert a["x"][4] == 3.0 and a["p"][5] == 4.0
    b = out[out.symbol == "B"]["m"].tolist()
    assert np.isnan(b[0]) and np.isnan(b[1]) and b[2] == 1.0  # never reads the other symbol


def test_nan_and_zero_denominator(spark):
    df = spark.createDataFrame([("A", 0, 0.0), ("A", 1, float("nan")), ("A", 2, 5.0)], "symbol string, n int, x double")
    df = nan_to_null(df.select("symbol", F.timestamp_seconds(F.col("n")).alias("ts"), "x"))
    f = lay_out(df, lookback=2)
    out = frame(f.add({"r": f.change("x", 2)}).finish())
    assert out["x"].isna().tolist() == [False, True, False] and out["r"].isna().all()


def test_no_look_ahead(bars):
    """Changing later rows leaves every earlier feature alone."""
    sets = ["technical", "volume", "market_structure", "onchain", "sentiment", "regime", "lag_rolling"]
    cut = F.lit("2023-08-01").cast("timestamp")
    changed = bars.select(
        "symbol", "ts", *[F.when(F.col("ts") >= cut, F.col(c) * 1.7 + 3).otherwise(F.col(c)).alias(c) for c in ("open", "high", "low", "close", "volume")]
    )
    before = lambda df: df.filter(F.col("ts") < cut)
    assert_same(before(build_frame(bars, sets).finish()), before(build_frame(changed, sets).finish()))


def test_streak_breaks_on_tie(spark):
    rows = [("A", i, v) for i, v in enumerate([1.0, 2.0, 3.0, 3.0, 4.0, 3.0, 2.0])]
    df = spark.createDataFrame(rows, "symbol string, n int, close double").select(
        "symbol", F.timestamp_seconds("n").alias("ts"), "close"
    )
    f = lay_out(df, lookback=1)
    f = f.add({"r": f.change("close")}).streak({"up": F.col("r") > 0, "down": F.col("r") < 0})
    out = frame(f.finish())
    assert out["up"].tolist() == [0, 1, 2, 0, 1, 0, 0] and out["down"].tolist() == [0, 0, 0, 0, 0, 1, 2]


def test_long_windows_equal_sliding_frames(spark):
    pdf = walk_bars(500)
    pdf.loc[120, "close"] = None
    f = lay_out(spark.createDataFrame(pdf).withColumn("close", F.nanvl("close", F.lit(None))), lookback=400)
    sizes = (1, 2, 3, 50, 64, 90, 365)
    kinds = {"mean": f.mean, "sum": f.sum, "max": f.max, "min": f.min}
    specs = {f"{k}_{w}": (k, "close", w) for k in kinds for w in sizes}
    specs |= {f"std_{w}": ("std", "close", w) for w in (2, 30, 90)}
    specs |= {f"{k}_any_{w}": (f"{k}_any", "close", w) for k in ("max", "min") for w in (30, 365)}
    want = {f"{k}_{w}": fn("close", w) for k, fn in kinds.items() for w in sizes}
    want |= {f"std_{w}": f.std("close", w) for w in (2, 30, 90)}
    want |= {f"{k}_any_{w}": kinds[k]("close", w, 1) for k in ("max", "min") for w in (30, 365)}
    assert_same(f.long_windows(specs).finish(), f.add(want).finish())
