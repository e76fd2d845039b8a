"""Forward-looking label strategies; each adds a ``label`` column."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidebar.features.price import true_range
from tidebar.functions.scalars import div
from tidebar.operators.frame import BLOCK_ROWS, CELL_ROWS, Frame, lay_out

_STRATEGIES: dict[str, Callable[..., Frame]] = {}
c = F.col


def register_label_strategy(name: str):
    """Decorator for ``fn(frame, **params) -> frame`` adding ``label``."""

    def wrap(fn):
        _STRATEGIES[name] = fn
        return fn

    return wrap


def get_label_strategy(name: str) -> Callable[..., Frame]:
    if name not in _STRATEGIES:
        raise KeyError(f"unknown label strategy '{name}', available: {sorted(_STRATEGIES)}")
    return _STRATEGIES[name]


def list_label_strategies() -> list[str]:
    return list(_STRATEGIES)


def three_way(down: Column, up: Column, known: Column, tie: str = "up") -> Column:
    """0 down, 2 up, 1 neither; ``tie`` decides when both hold."""
    first, second = ((up, 2), (down, 0)) if tie == "up" else ((down, 0), (up, 2))
    return F.when(known, F.when(first[0], first[1]).when(second[0], second[1]).otherwise(1))


def future_return(f: Frame, T: int) -> Column:
    return div(f.lead("close", T), "close") - 1


@register_label_strategy("reversal")
def reversal(f: Frame, T: int = 14, X: float = 0.08, tie: str = "up") -> Frame:
    """Extreme close of the next T rows; up wins when both barriers are hit."""
    if tie not in ("up", "down"):
        raise ValueError("tie is 'up' or 'down'")
    high = f.ahead(F.max("close"), "close", T)
    low = f.ahead(F.min("close"), "close", T)
    f = f.add({"__up": div(high - c("close"), "close"), "__down": div(low - c("close"), "close")})
    label = three_way(c("__down") <= -X, c("__up") >= X, c("__up").isNotNull(), tie)
    return f.add({"label": label}).drop("__up", "__down")


@register_label_strategy("directional")
def directional(f: Frame, T: int = 14, X: float = 0.05) -> Frame:
    f = f.add({"__ret": future_return(f, T)})
    return f.add({"label": three_way(c("__ret") <= -X, c("__ret") >= X, c("__ret").isNotNull())}).drop("__ret")


@register_label_strategy("return_sign")
def return_sign(f: Frame, T: int = 7, X: float = 0.0) -> Frame:
    return f.add({"label": (future_return(f, T) > 0).cast("int")})


@register_label_strategy("return_rate")
def return_rate(f: Frame, T: int = 14, X: float = 0.0) -> Frame:
    """Continuous target: percent return after T rows."""
    return f.add({"label": future_return(f, T) * 100})


@register_label_strategy("triple_barrier")
def triple_barrier(
    f: Frame,
    T: int = 14,
    X: float = 0.05,
    sl_ratio: float = 1.0,
    dynamic_threshold: bool = False,
    atr_window: int = 14,
    atr_multiplier: float = 2.0,
) -> Frame:
    """First barrier touched in the next T rows; the stop counts first within a row."""
    if dynamic_threshold:
        f = f.add({"__tr": true_range(f)})
        f = f.add({"__pt": div(atr_multiplier * f.mean("__tr", atr_window), "close")}).drop("__tr")
    else:
        f = f.add({"__pt": F.lit(float(X))})
    f = f.add(
        {
            "__hi": c("close") * (1 + c("__pt")),
            "__lo": c("close") * (1 - c("__pt") * sl_ratio),
        }
    )
    known = f.lead("close", T).isNotNull() & c("__pt").isNotNull()
    if T <= NEAR:
        hit = F.when(F.lit(False), 0)
        for j in range(1, T + 1):
            hit = hit.when(f.lead("low", j) <= c("__lo"), 0).when(f.lead("high", j) >= c("__hi"), 2)
        f = f.add({"label": F.when(known, hit.otherwise(1))})
    else:
        f = first_hit(f.add({"__known": known}), T)
        f = f.add({"label": F.when(c("__known"), F.coalesce("__hit", F.lit(1)))}).drop("__known", "__hit")
    return f.drop("__pt", "__hi", "__lo")


#: Rows that the first hit is looked for one by one; a longer horizon is searched by extremes.
NEAR = 32


def first_hit(f: Frame, T: int) -> Frame:
    """Add ``__hit``: 0 if the first of the next T rows beyond a barrier is at or below ``__lo``, 2 if it is at or above ``__hi`` alone.

    Lows and highs of the next 1, 2, 4, ... rows show whether a stretch stays between the barriers, so a row leaps over
    stretches of falling length to its first hit: about 2 log T looks a row in place of 2 T. One group is a block, or a short series.
    """
    narrow = f.df.select(*f.keys, "__rn", *[c(x).cast("double").alias(x) for x in ("low", "high", "__lo", "__hi")])
    kinds = dict(narrow.dtypes)

    def scan(table):
        import numpy as np
        import pyarrow as pa

        table = table.sort_by("__rn")
        column = lambda x, gap: np.nan_to_num(np.asarray(table[x].to_numpy(), dtype=float), nan=gap, posinf=np.inf, neginf=-np.inf)
        low, high = column("low", np.inf), column("high", -np.inf)  # what is missing hits nothing
        lower, upper = column("__lo", -np.inf), column("__hi", np.inf)
        n = len(low)
        lows, highs = [np.append(low, np.inf)], [np.append(high, -np.inf)]
        for k in range(T.bit_length() - 1):
            later = np.minimum(np.arange(n + 1) + (1 << k), n)
            lows.append(np.minimum(lows[-1], lows[-1][later]))
            highs.append(np.maximum(highs[-1], highs[-1][later]))
        at = np.minimum(np.arange(n) + 1, n)
        for k in range(len(lows) - 1, -1, -1):
            free = (lows[k][at] > lower) & (highs[k][at] < upper)
            at = np.where(free, np.minimum(at + (1 << k), n), at)
        found = (at < n) & (at - np.arange(n) <= T)
        hit = np.where(lows[0][at] <= lower, 0, 2)
        kept = table.select([*keys, "__rn"])
        return kept.append_column("__hit", pa.array(hit, pa.int32(), mask=~found))

    keys = f.keys
    schema = ", ".join(f"`{x}` {kinds[x]}" for x in (*keys, "__rn")) + ", `__hit` int"
    hits = narrow.groupBy(*keys).applyInArrow(scan, schema)
    return replace(f, df=f.df.join(hits, [*keys, "__rn"], "left"))


def label_lookback(params: dict) -> int:
    return params.get("atr_window", 14) + 1 if params.get("dynamic_threshold") else 1


def add_labels(
    bars: DataFrame, strategy: str, block_rows: int = BLOCK_ROWS, cell_rows: int = CELL_ROWS, **params
) -> DataFrame:
    """Bars with the label of one strategy."""
    fn = get_label_strategy(strategy)
    horizon = params.get("T", 14)
    frame = lay_out(
        bars, lookback=label_lookback(params), lookahead=horizon, block_rows=block_rows, cell_rows=cell_rows
    )
    return fn(frame, **params).finish()


def label_grid(frame: Frame, strategy: str, Ts: list[int], Xs: list[float]) -> DataFrame:
    """One row per bar and (T, X) pair: all combinations from one pass over the rows."""
    fn = get_label_strategy(strategy)
    names = {}
    for T in Ts:
        for X in Xs:
            name = f"__label_{len(names)}"
            frame = fn(frame, T=T, X=X).add({name: c("label")})
            names[name] = (T, X)
    combos = F.array(
        *[F.struct(F.lit(T).alias("T"), F.lit(float(X)).alias("X"), c(n).alias("label")) for n, (T, X) in names.items()]
    )
    df = frame.add({"combo": combos}).finish()
    return df.select(*frame.by, frame.ts, F.explode("combo").alias("combo")).select(
        *frame.by, frame.ts, "combo.T", "combo.X", "combo.label"
    )


def class_distribution(df: DataFrame, by: list[str], label: str = "label") -> DataFrame:
    """Rows and percent per class; a group has as many rows as classes after the count."""
    counts = df.filter(c(label).isNotNull()).groupBy(*by, label).agg(F.count(F.lit(1)).alias("n"))
    share = c("n") * 100.0 / F.sum("n").over(Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0)))
    return counts.withColumn("pct", share)


def label_summary(df: DataFrame, by: list[str], label: str = "label") -> DataFrame:
    return df.groupBy(*by).agg(
        F.avg(label).alias("mean"),
        F.stddev_samp(label).alias("std"),
        F.min(label).alias("min"),
        F.max(label).alias("max"),
    )
