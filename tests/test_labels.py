import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tests.helpers import frame, walk_bars
from tidebar.operators.labels import add_labels, class_distribution, get_label_strategy, list_label_strategies


@pytest.fixture(scope="module")
def bars(spark):
    return spark.createDataFrame(walk_bars(300)).cache()


def test_registry():
    assert set(list_label_strategies()) >= {"reversal", "directional", "return_sign", "return_rate", "triple_barrier"}
    with pytest.raises(KeyError, match="available"):
        get_label_strategy("nope")


@pytest.mark.parametrize("strategy", ["reversal", "directional", "triple_barrier"])
def test_properties(bars, strategy):
    out = frame(add_labels(bars, strategy, T=14, X=0.01))["label"]
    assert len(out) == 300 and set(out.dropna()) <= {0, 1, 2}
    assert out.iloc[-14:].isna().all() and out.iloc[:-14].notna().all()
    other = frame(add_labels(bars, strategy, T=7, X=0.03))["label"]
    assert not out.equals(other)


def tiny(spark, rows):
    return spark.createDataFrame(
        [("A", i, *r) for i, r in enumerate(rows)], "symbol string, n int, close double, high double, low double"
    ).select("symbol", F.timestamp_seconds("n").alias("ts"), "close", "high", "low")


def test_reversal_both_sides(spark):
    df = tiny(spark, [(100.0, 100.0, 100.0), (80.0, 80.0, 80.0), (130.0, 130.0, 130.0)])
    assert frame(add_labels(df, "reversal", T=2, X=0.1))["label"][0] == 2
    assert frame(add_labels(df, "reversal", T=2, X=0.1, tie="down"))["label"][0] == 0


def test_triple_barrier_cases(spark):
    flat = (100.0, 101.0, 99.0)
    both = (100.0, 120.0, 80.0)
    label = lambda rows, **kw: frame(add_labels(tiny(spark, rows), "triple_barrier", **{"T": 3, "X": 0.1, **kw}))["label"]
    assert label([flat, both, flat, flat])[0] == 0  # stop counts first within a row
    assert label([flat, (100.0, 111.0, 99.0), both, flat])[0] == 2
    assert label([flat, flat, flat, flat])[0] == 1
    assert label([flat, flat, flat]).isna().all()  # short tail
    dynamic = label([flat] * 8, dynamic_threshold=True, atr_window=3)
    assert dynamic[:2].isna().all() and dynamic[2] == 1


def test_triple_barrier_loop(bars):
    """Equal to a plain loop over rows."""
    p = walk_bars(300)
    T, X = 10, 0.008
    want = []
    for i in range(len(p)):
        if i + T >= len(p):
            want.append(np.nan)
            continue
        hit = 1
        for j in range(i + 1, i + T + 1):
            if p.low[j] <= p.close[i] * (1 - X):
                hit = 0
                break
            if p.high[j] >= p.close[i] * (1 + X):
                hit = 2
                break
        want.append(hit)
    got = frame(add_labels(bars, "triple_barrier", T=T, X=X))["label"]
    pd.testing.assert_series_equal(got.astype(float), pd.Series(want, dtype=float), check_names=False)


def test_distribution_sums_to_100(bars):
    dist = class_distribution(add_labels(bars, "reversal", T=14, X=0.02), ["symbol"]).toPandas()
    assert dist["n"].sum() == 286 and abs(dist["pct"].sum() - 100) < 1e-9


@pytest.mark.parametrize("layout", [{}, {"block_rows": 128, "cell_rows": 32}])
def test_far_barriers_by_extremes(spark, monkeypatch, layout):
    """The search by extremes against one look-ahead per row, missing prices and flat stretches among them."""
    from tidebar.operators import labels

    pdf = walk_bars(700, 4, "A")
    pdf.loc[100:130, ["open", "high", "low", "close"]] = pdf.loc[100, ["open", "high", "low", "close"]].tolist()
    pdf.loc[::17, "low"] = np.nan
    pdf.loc[::23, "high"] = np.nan
    df = spark.createDataFrame(pd.concat([pdf, walk_bars(90, 5, "B"), walk_bars(20, 6, "C")]))
    df = df.withColumns({x: F.when(~F.isnan(x), F.col(x)) for x in ("low", "high")})
    for T, X, more in ((3, 0.01, {}), (37, 0.04, {"sl_ratio": 0.5}), (64, 0.06, {}), (37, 0.0, {"dynamic_threshold": True, "atr_multiplier": 3.0})):
        found = []
        for near in (0, 1000):
            monkeypatch.setattr(labels, "NEAR", near)
            out = add_labels(df, "triple_barrier", T=T, X=X, **more, **layout).select("symbol", "ts", "label")
            found.append(sorted((r.symbol, r.ts, -1 if r.label is None else r.label) for r in out.collect()))
        assert found[0] == found[1] and len({x[2] for x in found[0]}) >= 3
