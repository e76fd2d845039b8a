"""Seeded bar fixtures and comparison helpers."""

import numpy as np
import pandas as pd


def walk_bars(n=300, seed=42, symbol="A", start="2023-01-01", extra=True, freq="D"):
    rng = np.random.default_rng(seed)
    close = 30000 + np.cumsum(rng.normal(size=n) * 200)
    pdf = pd.DataFrame(
        {
            "symbol": symbol,
            "ts": pd.date_range(start, periods=n, freq=freq),
            "open": close + rng.normal(size=n) * 100,
            "high": close + np.abs(rng.normal(size=n) * 300),
            "low": close - np.abs(rng.normal(size=n) * 300),
            "close": close,
            "volume": rng.integers(1000, 9999, n).astype(float),
        }
    )
    if extra:
        pdf["quote_volume"] = pdf["volume"] * pdf["close"]
        pdf["trades"] = rng.integers(1, 500, n)
    return pdf


def frame(df, keys=("symbol", "ts")):
    pdf = df.toPandas()
    return pdf.sort_values(list(keys)).reset_index(drop=True)


def assert_same(a, b, keys=("symbol", "ts"), rtol=1e-9, atol=1e-9):
    a, b = frame(a, keys), frame(b, keys)
    assert sorted(a.columns) == sorted(b.columns)
    pd.testing.assert_frame_equal(a[sorted(a.columns)], b[sorted(a.columns)], check_dtype=False, rtol=rtol, atol=atol)
