"""One query per feature set, with every column of the set."""

from __future__ import annotations

from catalog.common import BLOCKED, order_bars
from tidebar.features.builder import build_frame
from tidebar.features.proxies import CORE_COLUMNS
from tidebar.features.registry import get_feature_set
from tidebar.sources.bars import outside_series

#: Sets whose blocked form is registered too: running values, exponential means, streaks, long windows, outside series.
BLOCKED_SETS = ("technical", "volume", "onchain", "sentiment", "market_structure", "external_fr")
RAW = ["open", "high", "low", "close", "volume", "quote_volume", "trades"]


def feature_query(sets: list[str], drop: list[str] | None = None, **layout):
    def run(spark, sf_dir):
        sources = outside_series(spark, sf_dir) if any(get_feature_set(s).sources for s in sets) else None
        df = build_frame(order_bars(spark, sf_dir), sets, sources, **layout).finish()
        return df.drop(*RAW, *(drop or []))

    return run


def lag_rolling(spark, sf_dir):
    """Columns derived from all core columns."""
    sets = ["technical", "market_structure", "onchain", "sentiment", "lag_rolling"]
    df = build_frame(order_bars(spark, sf_dir), sets).finish()
    cores = CORE_COLUMNS
    ends = [f"_lag{k}" for k in (1, 2, 3, 7, 14)] + [f"_{m}{w}" for m in ("ma", "std") for w in (3, 7, 14, 30)]
    ends += ["_dev_ma7"] + [f"_roc_{w}" for w in (1, 3, 7)]
    return df.select("symbol", "ts", *[c + e for c in cores for e in ends])


QUERIES = {
    f"features_{s}": feature_query([s])
    for s in (
        "technical", "volume", "flow", "market_structure", "onchain", "sentiment", "regime", "bear_volatility",
        "external", "external_fgi", "external_fgi_enhanced", "external_macro", "external_fr",
    )
} | {"features_lag_rolling": lag_rolling}

QUERIES |= {f"features_{s}_blocked": feature_query([s], **BLOCKED) for s in BLOCKED_SETS}
