"""Proxy and state sets: onchain, sentiment, regime, bear_volatility, lag_rolling."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidebar.features.price import true_range
from tidebar.features.registry import register_feature_set
from tidebar.functions.scalars import EPS, clip, div, flag, ratio, rel
from tidebar.operators.frame import Frame

c = F.col


def realized(f: Frame) -> tuple[Frame, dict]:
    return f, Frame.mean_specs({"__realized": "close"})


@register_feature_set("onchain", lookback=210, running=realized)
def onchain(f: Frame) -> Frame:
    f = f.expanding_mean({"__realized": "close"}).long_windows({"__mean_128": ("mean", "close", 128)})
    f = f.add(
        {
            "__ret": f.change("close"),
            "mvrv": div("close", "__realized"),
            "lth_sopr": div("close", f.lag("close", 180)),
            "sth_sopr": div("close", f.lag("close", 30)),
            "active_addr_proxy": f.mean("volume", 7),
            "difficulty_ribbon_proxy": rel(f.mean("close", 9), "__mean_128"),
            "nupl_proxy": ratio(c("close") - c("__realized"), "close"),
            "entity_adjusted_vol": c("volume") * ratio(F.abs(c("close") - c("open")), c("high") - c("low")),
        }
    )
    f = f.add(
        {f"mvrv_change_{w}": f.change("mvrv", w) for w in (7, 14)}
        | {f"active_addr_change_{w}": f.change("active_addr_proxy", w) for w in (7, 14)}
        | {f"{s}_sopr_ma_7": f.mean(f"{s}_sopr", 7) for s in ("lth", "sth")}
        | {f"{s}_sopr_change_7": f.change(f"{s}_sopr", 7) for s in ("lth", "sth")}
        | {
            "miner_outflow_proxy": f.std("__ret", 30) * c("volume"),
            "nupl_ma_14": f.mean("nupl_proxy", 14),
            "entity_adjusted_vol_ma_10": f.mean("entity_adjusted_vol", 10),
        }
    )
    f = f.add({"miner_outflow_ma_14": f.mean("miner_outflow_proxy", 14)})
    return f.drop("__realized", "__ret", "__mean_128")


def direction(f: Frame) -> tuple[Frame, dict]:
    f = f.add({"__move": f.change("close")})
    return f, Frame.streak_specs(_streaks())


def _streaks() -> dict:
    return {"consecutive_up_days": c("__move") > 0, "consecutive_down_days": c("__move") < 0}


@register_feature_set("sentiment", lookback=370, running=direction)
def sentiment(f: Frame) -> Frame:
    horizons = (30, 90, 180, 365)
    f = f.add({"__ret": f.change("close"), "__volret": f.change("volume", 7)})
    f = f.add({"__move": c("__ret")}).streak(_streaks())
    f = f.long_windows(
        {f"__high_{w}": ("max_any", "close", w) for w in horizons}
        | {f"__low_{w}": ("min_any", "close", w) for w in horizons}
        | {f"__std_{w}": ("std", "__ret", w) for w in (60, 90)}
    )
    sd = {14: f.std("__ret", 14), 30: f.std("__ret", 30), 60: c("__std_60")}
    f = f.add(
        {f"vix_proxy_{w}": s * 100 for w, s in sd.items()}
        | {f"volume_spike_{w}": ratio("volume", f.mean("volume", w)) for w in (10, 30)}
        | {f"dist_from_high_{w}d": rel("close", f"__high_{w}") for w in horizons}
        | {f"dist_from_low_{w}d": rel("close", f"__low_{w}") for w in horizons}
        | {
            "fgi": clip(
                50 + f.change("close", 30) * 100 - f.std("__ret", 30) * 200 + f.mean("__volret", 7) * 20, 0, 100
            ),
            "gtrend_proxy": ratio(f.mean("volume", 7), f.mean("volume", 30)) * 50,
            "liquidity_proxy": 100 - c("__std_90") * 1000,
        }
    )
    f = f.add(
        {f"fgi_ma_{w}": f.mean("fgi", w) for w in (7, 14)}
        | {
            "fgi_extreme_fear": flag(c("fgi") < 20),
            "fgi_extreme_greed": flag(c("fgi") > 80),
            "gtrend_proxy_ma_14": f.mean("gtrend_proxy", 14),
            "vix_proxy_change_7": f.change("vix_proxy_30", 7),
        }
    )
    return f.drop("__ret", "__volret", "__move", "__std_60", "__std_90", *[f"__{s}_{w}" for s in ("high", "low") for w in horizons])


@register_feature_set("regime", lookback=225)
def regime(f: Frame) -> Frame:
    means = {50: "__mean_50", 100: "__mean_100", 200: "sma_200"}
    f = f.long_windows({n: ("mean", "close", w) for w, n in means.items()}).add({"__ret": f.change("close")})
    f = f.add({"__base": f.lag("sma_200", 20), "__vol": f.std("__ret", 20)})
    close, ma = c("close"), c("sma_200")
    f = f.add(
        {f"regime_trend_{w}": rel("close", n) for w, n in means.items()}
        | {
            "regime_price_vs_ma200": rel("close", "sma_200"),
            "regime_bull": flag(close > ma),
            "regime_bear": flag(close < ma),
            "regime_sideways": flag((close > ma * 0.95) & (close < ma * 1.05)),
            "regime_ma200_rise": flag(ma > c("__base")),
            "regime_ma200_fall": flag(ma < c("__base")),
            "regime_vol_high": flag(c("__vol") > 0.03),
            "regime_vol_low": flag(c("__vol") < 0.015),
        }
    )
    return f.drop("__ret", "__base", "__vol", "__mean_50", "__mean_100")


def peak(f: Frame) -> tuple[Frame, dict]:
    return f, {"__peak": ("max", "close")}


@register_feature_set("bear_volatility", lookback=370, running=peak)
def bear_volatility(f: Frame) -> Frame:
    f = f.add({"__tr": true_range(f), "__step": f.diff("close"), "__ret": f.change("close")})
    f = f.cumulative(peak(f)[1]).long_windows({"__high_365": ("max", "close", 365)})
    f = f.add(
        {f"bear_atr_{w}": f.mean("__tr", w) for w in (7, 14, 28)}
        | {f"bear_rv_{w}": f.std("__ret", w) for w in (5, 10, 21)}
        | {
            "bear_dist_from_ath": rel("close", "__high_365"),
            "bear_max_drawdown": rel("close", "__peak"),
        }
        | (
            {f"__wr_{w}": c("__ret") * F.sqrt(div("volume", f.mean("volume", w))) for w in (7, 14)}
            if f.has("volume")
            else {}
        )
    )
    f = f.add(
        {f"bear_atr_norm_change_{w}": ratio("__step", f"bear_atr_{w}") for w in (7, 14, 28)}
        | {f"bear_rv_ratio_{w}_21": ratio(f"bear_rv_{w}", "bear_rv_21") for w in (5, 10)}
        | ({f"bear_vol_weighted_rv_{w}": f.std(f"__wr_{w}", w) for w in (7, 14)} if f.has("volume") else {})
        | {"__med": f.median("bear_rv_21", 60)}
    )
    f = f.add(
        {
            "bear_vol_high": flag(c("bear_rv_21") > c("__med") * 1.5),
            "bear_vol_low": flag(c("bear_rv_21") < c("__med") * 0.5),
        }
    )
    return f.drop("__tr", "__step", "__ret", "__peak", "__high_365", "__wr_7", "__wr_14", "__med")


# fixed values: columns this set derives from, lags, rolling windows
CORE_COLUMNS = [
    "rsi_14", "macd", "macd_hist", "atr_14", "buy_pressure",
    "mvrv", "lth_sopr", "sth_sopr", "fgi", "volume_density",
]
LAGS = [1, 2, 3, 7, 14]
WINDOWS = [3, 7, 14, 30]


@register_feature_set("lag_rolling", lookback=35, stacked=True)
def lag_rolling(f: Frame) -> Frame:
    """Lags, rolling moments and rates of the core columns that are present."""
    present = [name for name in CORE_COLUMNS if f.has(name)]
    first, second = {}, {}
    for name in present:
        first |= {f"{name}_lag{k}": f.lag(name, k) for k in LAGS}
        first |= {f"{name}_ma{w}": f.mean(name, w) for w in WINDOWS}
        first |= {f"{name}_std{w}": f.std(name, w) for w in WINDOWS}
        first |= {f"{name}_roc_{w}": f.change(name, w) for w in (1, 3, 7)}
        second[f"{name}_dev_ma7"] = div(c(name) - c(f"{name}_ma7"), F.abs(c(f"{name}_ma7")) + EPS)
    return f.add(first).add(second) if present else f
