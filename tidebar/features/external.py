"""Sets built on slower outside series, aligned backward to the bars.

The builder attaches the raw ``ext_*`` columns with as-of joins before the
rows are laid out; a set whose source is absent adds nothing.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tidebar.features.registry import register_feature_set
from tidebar.functions.scalars import EPS, div, flag, zscore
from tidebar.operators.frame import Frame

c = F.col

# fixed values: columns each source contributes (macro: every *_close column)
FUNDING_COLUMNS = ["funding_rate_mean", "funding_rate_sum", "funding_rate_max", "funding_rate_min"]
LONG_SHORT_COLUMNS = ["ls_ratio", "long_account", "short_account"]
MACRO_PREFIX = "ext_macro__"  # marks attached macro levels until a set renames them


def source_columns(name: str, available: list[str]) -> dict[str, str]:
    """Source column -> attached column for one outside series."""
    if name == "fgi":
        return {"fgi_value": "ext_fgi"} if "fgi_value" in available else {}
    if name == "macro":
        return {m: MACRO_PREFIX + m.removesuffix("_close") for m in available if m not in ("symbol", "ts")}
    wanted = FUNDING_COLUMNS if name == "funding" else LONG_SHORT_COLUMNS
    return {w: f"ext_{w}" for w in wanted if w in available}


def fgi_base(f: Frame) -> Frame:
    if not f.has("ext_fgi"):
        return f
    return f.add(
        {f"ext_fgi_ma{w}": f.mean("ext_fgi", w) for w in (7, 14, 30)}
        | {f"ext_fgi_change_{w}d": f.change("ext_fgi", w) for w in (7, 14)}
        | {
            "ext_fgi_std_14": f.std("ext_fgi", 14),
            "ext_fgi_extreme_fear": flag(c("ext_fgi") < 25),
            "ext_fgi_extreme_greed": flag(c("ext_fgi") > 75),
            "ext_fgi_price_divergence": f.change("ext_fgi", 7) - f.change("close", 7),
        }
    )


def macro(f: Frame) -> Frame:
    factors = [x.removeprefix(MACRO_PREFIX) for x in f.df.columns if x.startswith(MACRO_PREFIX)]
    if not factors:
        return f
    f = f.add({f"ext_{n}": c(MACRO_PREFIX + n) for n in factors} | {"__pret": f.change("close")})
    layer = {}
    for n in factors:
        level = f"ext_{n}"
        layer |= {f"{level}_ret_{w}d": f.change(level, w) for w in (1, 5, 10, 20)}
        for w in (10, 20, 50):
            ma = f.mean(level, w)
            layer[f"{level}_vs_ma{w}"] = div(c(level) - ma, F.abs(ma) + EPS)
    f = f.add(layer)
    layer = {}
    for n in factors:
        layer[f"ext_{n}_vol_20d"] = f.std(f"ext_{n}_ret_1d", 20)
        layer |= {f"ext_btc_{n}_corr_{w}d": f.corr("__pret", f"ext_{n}_ret_1d", w) for w in (20, 60)}
    return f.add(layer).drop("__pret", *[MACRO_PREFIX + n for n in factors])


def funding(f: Frame) -> Frame:
    if not f.has("ext_funding_rate_mean"):
        return f
    rate = "ext_funding_rate_mean"
    f = f.long_windows({"__mean_90": ("mean", rate, 90), "__std_90": ("std", rate, 90)})
    f = f.add(
        {f"ext_fr_ma_{w}": f.mean(rate, w) for w in (7, 14, 30)}
        | {f"ext_fr_std_{w}": f.std(rate, w) for w in (7, 14, 30)}
        | {f"ext_fr_cumsum_{w}": f.sum(rate, w) for w in (7, 14, 30)}
        | {"ext_fr_zscore": zscore(rate, "__mean_90", "__std_90")}
    )
    return f.add(
        {
            "ext_fr_extreme_high": flag(c("ext_fr_zscore") > 2),
            "ext_fr_extreme_low": flag(c("ext_fr_zscore") < -2),
        }
    ).drop("__mean_90", "__std_90")


def long_short(f: Frame) -> Frame:
    if not f.has("ext_ls_ratio"):
        return f
    f = f.long_windows({"__mean_60": ("mean", "ext_ls_ratio", 60), "__std_60": ("std", "ext_ls_ratio", 60)})
    return f.add(
        {f"ext_ls_ma_{w}": f.mean("ext_ls_ratio", w) for w in (7, 14, 30)}
        | {f"ext_ls_change_{w}d": f.change("ext_ls_ratio", w) for w in (1, 3, 7)}
        | {"ext_ls_zscore": zscore("ext_ls_ratio", "__mean_60", "__std_60")}
    ).drop("__mean_60", "__std_60")


@register_feature_set("external", lookback=95, sources=("fgi", "macro", "funding", "long_short"))
def external(f: Frame) -> Frame:
    return long_short(funding(macro(fgi_base(f))))


register_feature_set("external_fgi", lookback=35, sources=("fgi",))(fgi_base)
register_feature_set("external_macro", lookback=65, sources=("macro",))(macro)
register_feature_set("external_fr", lookback=95, sources=("funding",))(funding)


@register_feature_set("external_fgi_enhanced", lookback=40, sources=("fgi", "fgi_rank"))
def fgi_enhanced(f: Frame) -> Frame:
    """Denser view of the same series.

    The three ``pct_rank`` columns are one whole-series rank (it looks ahead);
    the builder attaches it as ``ext_fgi_rank``.
    """
    if not f.has("ext_fgi"):
        return f
    level = "ext_fgi"
    f = f.add(
        {f"ext_fgi_ma{w}": f.mean(level, w) for w in (3, 7, 14, 21, 30)}
        | {f"ext_fgi_std_{w}": f.std(level, w) for w in (3, 7, 14, 21, 30)}
        | {f"ext_fgi_change_{w}d": f.change(level, w) for w in (1, 3, 5, 7, 14, 21)}
        | {f"ext_fgi_price_div_{w}d": f.change(level, w) - f.change("close", w) for w in (7, 14)}
        | ({f"ext_fgi_pct_rank_{w}": c("ext_fgi_rank") - 0.5 for w in (30, 60, 90)} if f.has("ext_fgi_rank") else {})
        | {
            "ext_fgi_extreme_fear": flag(c(level) < 25),
            "ext_fgi_extreme_greed": flag(c(level) > 75),
            "ext_fgi_fear": flag(c(level) < 35),
            "ext_fgi_greed": flag(c(level) > 65),
            "ext_fgi_momentum": f.diff(level, 3),
        }
    )
    return f.add(
        {f"ext_fgi_vs_ma{w}": c(level) - c(f"ext_fgi_ma{w}") for w in (14, 30)}
        | {"ext_fgi_momentum_accel": f.diff("ext_fgi_momentum", 3)}
    ).drop("ext_fgi_rank")
