"""Price and volume feature sets: technical, volume, flow, market_structure."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidebar.features.registry import register_feature_set
from tidebar.functions.scalars import EPS, at_least, div, ratio, rel
from tidebar.operators.frame import Frame

c = F.col


def true_range(f: Frame):
    """Largest of high-low and the gaps to the previous close (nulls skipped)."""
    prev = f.lag("close")
    return F.greatest(c("high") - c("low"), F.abs(c("high") - prev), F.abs(c("low") - prev))


@register_feature_set("technical", lookback=205)
def technical(f: Frame) -> Frame:
    windows = (5, 10, 20, 50, 100, 200)
    emas = {f"ema_{w}": ("close", w) for w in windows}
    f = f.ema(emas | {"__e12": ("close", 12), "__e26": ("close", 26)})
    f = f.long_windows(
        {f"sma_{w}": ("mean", "close", w) for w in windows if w >= 50}
        | {"__high_50": ("max", "high", 50), "__low_50": ("min", "low", 50)}
    )
    f = f.add(
        {f"sma_{w}": f.mean("close", w) for w in windows if w < 50}
        | {f"return_{w}d": f.change("close", w) for w in (1, 3, 5, 7, 14, 21)}
        | {f"__high_{w}": f.max("high", w) for w in (14, 21)}
        | {f"__low_{w}": f.min("low", w) for w in (14, 21)}
        | {
            "__tr": true_range(f),
            "__std": f.std("close", 20),
            "macd": c("__e12") - c("__e26"),
        }
    )
    f = f.add(
        {f"sma_cross_{a}_{b}": c(f"sma_{a}") - c(f"sma_{b}") for a, b in ((5, 20), (10, 50), (50, 200))}
        | {f"price_vs_sma_{w}": div(c("close") - c(f"sma_{w}"), f"sma_{w}") for w in (20, 50, 200)}
        | {f"atr_{w}": f.mean("__tr", w) for w in (14, 21)}
        | {f"high_{w}d_dist": div(c("close") - c(f"__high_{w}"), "close") for w in (14, 21, 50)}
        | {f"low_{w}d_dist": div(c("close") - c(f"__low_{w}"), "close") for w in (14, 21, 50)}
        | {f"volatility_{w}d": f.std("return_1d", w) for w in (5, 10, 20)}
        | {
            "bb_upper_20": c("sma_20") + 2 * c("__std"),
            "bb_lower_20": c("sma_20") - 2 * c("__std"),
            "stoch_k_14": div(100 * (c("close") - c("__low_14")), c("__high_14") - c("__low_14") + EPS),
        }
    )
    f = rsi(f, (6, 14, 28)).ema({"macd_signal": ("macd", 9)})
    f = f.add(
        {f"atr_pct_{w}": div(f"atr_{w}", "close") for w in (14, 21)}
        | {
            "macd_hist": c("macd") - c("macd_signal"),
            "bb_width_20": div(c("bb_upper_20") - c("bb_lower_20"), "sma_20"),
            "bb_pctb_20": ratio(c("close") - c("bb_lower_20"), c("bb_upper_20") - c("bb_lower_20")),
            "stoch_d_14": f.mean("stoch_k_14", 3),
        }
    )
    return f.drop("__tr", "__std", "__e12", "__e26", *[f"__{s}_{w}" for s in ("high", "low") for w in (14, 21, 50)])


def rsi(f: Frame, windows: tuple[int, ...]) -> Frame:
    """Relative strength from plain means of rises and falls."""
    step = f.diff("close")
    f = f.add({"__gain": at_least(step, 0.0), "__loss": at_least(-step, 0.0)})
    strength = {w: ratio(f.mean("__gain", w), f.mean("__loss", w)) for w in windows}
    return f.add({f"rsi_{w}": 100 - div(F.lit(100.0), 1 + s) for w, s in strength.items()}).drop("__gain", "__loss")


def signed_volume(f: Frame) -> tuple[Frame, dict]:
    signed = F.coalesce(F.signum(f.diff("close")) * c("volume"), F.lit(0.0))
    return f.add({"__signed": signed}), {"obv": ("sum", "__signed")}


@register_feature_set("volume", lookback=55, running=signed_volume)
def volume(f: Frame) -> Frame:
    typical = (c("high") + c("low") + c("close")) / 3
    f = f.add(
        {f"vol_sma_{w}": f.mean("volume", w) for w in (5, 10, 20, 50)}
        | {f"vol_change_{w}d": f.change("volume", w) for w in (1, 3, 5)}
        | {f"vol_price_corr_{w}": f.corr("volume", "close", w) for w in (10, 20)}
        | {f"vwap_{w}": ratio(f.sum(typical * c("volume"), w), f.sum("volume", w)) for w in (10, 20)}
    )
    f, specs = signed_volume(f)
    f = f.cumulative(specs).drop("__signed")
    f = f.add(
        {f"vol_ratio_{w}": ratio("volume", f"vol_sma_{w}") for w in (5, 10, 20, 50)}
        | {f"obv_sma_{w}": f.mean("obv", w) for w in (10, 20)}
        | {f"price_vs_vwap_{w}": rel("close", f"vwap_{w}") for w in (10, 20)}
        | {f"vol_volatility_{w}": f.std("vol_change_1d", w) for w in (10, 20)}
    )
    return quote_volume_ratios(f)


def quote_volume_ratios(f: Frame) -> Frame:
    if not f.has("quote_volume"):
        return f
    f = f.add({f"qvol_sma_{w}": f.mean("quote_volume", w) for w in (5, 10, 20)})
    return f.add({f"qvol_ratio_{w}": ratio("quote_volume", f"qvol_sma_{w}") for w in (5, 10, 20)})


def quote_volume_changes(f: Frame) -> Frame:
    if not f.has("quote_volume"):
        return f
    return f.add(
        {f"flow_change_{w}d": f.change("quote_volume", w) for w in (1, 3, 5, 10)}
        | {
            f"flow_price_divergence_{w}": f.change("quote_volume", w) - f.change("close", w)
            for w in (10, 20)
        }
    )


def trade_activity(f: Frame, mean_name: str) -> Frame:
    """Trade counts and size per trade; the two sets name the mean differently."""
    if not f.has("trades"):
        return f
    count = c("trades").cast("double")
    f = f.add(
        {f"trades_sma_{w}": f.mean("trades", w) for w in (5, 10, 20)}
        | {f"trades_change_{w}d": f.change(count, w) for w in (1, 5)}
        | {"avg_trade_size": ratio("volume", count)}
    )
    f = f.add(
        {f"trades_ratio_{w}": ratio(count, f"trades_sma_{w}") for w in (5, 10, 20)}
        | {f"avg_trade_size_{mean_name}_{w}": f.mean("avg_trade_size", w) for w in (5, 10, 20)}
    )
    return f.add(
        {f"avg_trade_size_ratio_{w}": ratio("avg_trade_size", f"avg_trade_size_{mean_name}_{w}") for w in (5, 10, 20)}
    )


def volume_density(f: Frame, mean_name: str) -> Frame:
    f = f.add({"volume_density": ratio("volume", c("high") - c("low"))})
    return f.add({f"volume_density_{mean_name}_{w}": f.mean("volume_density", w) for w in (5, 10)})


@register_feature_set("flow", lookback=45)
def flow(f: Frame) -> Frame:
    f = quote_volume_changes(trade_activity(f, "sma"))
    if f.has("quote_volume"):
        windows = (5, 10, 20)
        f = f.add({f"__qv_{w}": f.mean("quote_volume", w) for w in windows})
        f = f.add({f"flow_momentum_{w}": f.change(f"__qv_{w}", w) for w in windows})
        f = f.drop(*[f"__qv_{w}" for w in windows])
    return volume_density(f, "sma")


def volume_delta(f: Frame) -> tuple[Frame, dict]:
    return f, {"cvd": ("sum", F.signum(c("close") - c("open")) * c("volume"))}


@register_feature_set("market_structure", lookback=50, running=volume_delta)
def market_structure(f: Frame) -> Frame:
    f = f.cumulative(volume_delta(f)[1]).add({"__ret": f.change("close")})
    f = f.add(
        {f"funding_rate_{w}": f.mean("__ret", w) * 100 for w in (7, 14, 24)}
        | {f"open_interest_{w}": f.sum("volume", w) for w in (7, 14, 24)}
        | {f"cvd_ma_{w}": f.mean("cvd", w) for w in (7, 14, 21)}
        | {f"cvd_change_{w}": f.change("cvd", w) for w in (7, 14, 21)}
        | {
            "stablecoin_inflow_proxy": -f.change("close", 7) * f.mean("volume", 7),
            "buy_pressure": ratio(c("close") - c("low"), c("high") - c("low")),
        }
    ).drop("__ret")
    f = f.add({f"buy_pressure_ma_{w}": f.mean("buy_pressure", w) for w in (5, 10, 20)})
    f = quote_volume_changes(quote_volume_ratios(f))
    return volume_density(trade_activity(f, "ma"), "ma")
