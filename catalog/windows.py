"""Window primitives on daily bars, one query per kind."""

from __future__ import annotations

from functools import partial

from pyspark.sql import functions as F

from catalog.common import BLOCKED, bar_frame, order_bars
from tidebar.functions.scalars import zscore
from tidebar.operators.ranks import pct_rank
from tidebar.sources.bars import event_bars
from tidebar.operators.frame import lay_out

c = F.col


def _pick(f, names):
    return f.finish().select("symbol", "ts", *names)


def shifts(s, d, **layout):
    f = bar_frame(s, d, **layout, lookback=14, lookahead=7)
    cols = {f"lag_{n}": f.lag("close", n) for n in (1, 14)} | {f"lead_{n}": f.lead("close", n) for n in (1, 7)}
    cols |= {"diff_1": f.diff("close"), "diff_3": f.diff("close", 3), "pct_1": f.change("close"), "pct_7": f.change("volume", 7)}
    return _pick(f.add(cols), cols)


def rolling(s, d, **layout):
    f = bar_frame(s, d, **layout, lookback=60)
    cols = {f"mean_{w}": f.mean("close", w) for w in (5, 50)} | {f"sum_{w}": f.sum("volume", w) for w in (7, 24)}
    cols |= {f"std_{w}": f.std("close", w) for w in (10, 30)}
    cols |= {"max_14": f.max("high", 14), "min_14": f.min("low", 14), "median_60": f.median("close", 60)}
    cols |= {"corr_10": f.corr("volume", "close", 10), "corr_20": f.corr("volume", "close", 20)}
    return _pick(f.add(cols), cols)


def min_periods(s, d, **layout):
    f = bar_frame(s, d, **layout, lookback=365)
    cols = {"max_365": f.max("close", 365, 1), "min_30": f.min("close", 30, 1), "mean_20_min5": f.mean("close", 20, 5)}
    return _pick(f.add(cols), cols)


def running(s, d, **layout):
    f = bar_frame(s, d, **layout, lookback=1)
    f = f.add({"ret": f.change("close")}).expanding_mean({"mean_all": "close"})
    f = f.cumulative({"sum_volume": ("sum", "volume"), "max_close": ("max", "close"), "min_close": ("min", "close")})
    f = f.cumulative({"growth": ("prod", 1 + F.signum(c("ret")) * 0.01)})
    return _pick(f, ["mean_all", "sum_volume", "max_close", "min_close", "growth"])


def ema(s, d, **layout):
    f = bar_frame(s, d, **layout, lookback=5)
    return _pick(f.ema({"ema_12": ("close", 12), "ema_26": ("close", 26)}), ["ema_12", "ema_26"])


def ema_gaps(s, d, **layout):
    """Means over values that are missing on some days, the first ones among them."""
    f = bar_frame(s, d, **layout, lookback=5)
    day = F.dayofmonth("ts")
    f = f.add({"held": F.when((day > 3) & (day % 7 != 0), c("close"))})
    return _pick(f.ema({"ema_12": ("held", 12), "ema_90": ("held", 90)}), ["ema_12", "ema_90"])


def hourly_ema(s, d, **layout):
    """Hourly event bars, with gaps between hours."""
    f = lay_out(event_bars(s, d), lookback=30, **layout).ema({"ema_9": ("close", 9)})
    f = f.add({"mean_24": f.mean("close", 24)})
    return _pick(f, ["ema_9", "mean_24"])


def streaks(s, d, **layout):
    f = bar_frame(s, d, **layout, lookback=1)
    f = f.add({"ret": f.change("close")})
    return _pick(f.streak({"up": c("ret") > 0, "down": c("ret") < 0}), ["up", "down"])


def ranks(s, d):
    df = order_bars(s, d).withColumn("level", F.floor(c("close") / 1000))
    return pct_rank(df, "level", "pct_rank").select("symbol", "ts", "pct_rank")


def forward(s, d, **layout):
    f = bar_frame(s, d, **layout, lookahead=14)
    return _pick(f.add({"max_ahead": f.ahead(F.max("close"), "close", 14), "min_ahead": f.ahead(F.min("close"), "close", 14)}),
                 ["max_ahead", "min_ahead"])


def zscores(s, d, **layout):
    f = bar_frame(s, d, **layout, lookback=90)
    cols = {f"z_{w}": zscore("close", f.mean("close", w), f.std("close", w)) for w in (60, 90)}
    return _pick(f.add(cols), cols)


QUERIES = {
    "window_shift_diff_change": shifts,
    "window_rolling": rolling,
    "window_min_periods": min_periods,
    "window_running": running,
    "window_ema": ema,
    "window_ema_gaps": ema_gaps,
    "window_hourly_ema": hourly_ema,
    "window_streak": streaks,
    "window_pct_rank": ranks,
    "window_forward": forward,
    "window_zscore": zscores,
}

QUERIES |= {
    f"{name}_blocked": partial(query, **BLOCKED) for name, query in QUERIES.items() if name != "window_pct_rank"
}
