"""Assemble feature sets over a bar table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidebar.features.external import source_columns
from tidebar.features.registry import attach_running, get_feature_set, total_lookback
from tidebar.operators.asof import asof_join
from tidebar.operators.frame import BLOCK_ROWS, CELL_ROWS, Frame, lay_out
from tidebar.operators.ranks import pct_rank
from tidebar.session import materialize

# fixed values: columns that are inputs or labels, not features
NON_FEATURES = {
    "symbol", "ts", "date", "open", "high", "low", "close", "volume",
    "quote_volume", "trades", "taker_buy_base", "taker_buy_quote", "label",
}
NULL_POLICIES = ("ffill_then_drop", "drop", "keep")


def feature_columns(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c.lower() not in NON_FEATURES]


def attach_sources(
    bars: DataFrame, wanted: list[str], sources: dict[str, DataFrame], block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """Backward as-of join of the wanted outside series that are available.

    Sources with a symbol column are aligned per symbol, the others to every
    series; each kind in one pass.
    """
    common, per_symbol = [], []
    for name in wanted:
        source = sources.get(name)
        names = source_columns(name, source.columns) if source is not None else {}
        if names:
            by = ["symbol"] if "symbol" in source.columns else []
            picked = source.select(*by, "ts", *[F.col(s).alias(t) for s, t in names.items()])
            (per_symbol if by else common).append(picked)
    if common or per_symbol:
        bars = materialize(bars)  # read by the alignment and again by the join back
    if common:
        bars = asof_join(bars, common, by=[], block_rows=block_rows)
    if per_symbol:
        bars = asof_join(bars, per_symbol, by=["symbol"], block_rows=block_rows)
    return bars


def build_frame(
    bars: DataFrame,
    sets: list[str],
    sources: dict[str, DataFrame] | None = None,
    lookahead: int = 0,
    extra_lookback: int = 0,
    block_rows: int = BLOCK_ROWS,
    cell_rows: int = CELL_ROWS,
) -> Frame:
    """Bars with the sets applied in order, still laid out in blocks."""
    wanted = list(dict.fromkeys(s for n in sets for s in get_feature_set(n).sources))
    bars = attach_sources(bars, wanted, sources or {}, block_rows)
    if "fgi_rank" in wanted and "ext_fgi" in bars.columns:
        bars = pct_rank(bars, "ext_fgi", "ext_fgi_rank", by=["symbol"])
    frame = lay_out(
        bars, lookback=total_lookback(sets) + extra_lookback, lookahead=lookahead,
        block_rows=block_rows, cell_rows=cell_rows,
    )
    frame = attach_running(frame, sets)
    for name in sets:
        frame = get_feature_set(name).build(frame)
    return frame


def apply_null_policy(frame: Frame, policy: str = "ffill_then_drop") -> Frame:
    """``ffill_then_drop`` | ``drop`` | ``keep`` over every non-key column."""
    if policy not in NULL_POLICIES:
        raise ValueError(f"unknown null policy '{policy}', use one of {NULL_POLICIES}")
    names = [c for c in frame.columns if c not in (*frame.by, frame.ts)]
    if policy == "ffill_then_drop":
        frame = frame.ffill(names)
    return frame


def build_features(
    bars: DataFrame,
    sets: list[str],
    null_policy: str = "ffill_then_drop",
    sources: dict[str, DataFrame] | None = None,
    block_rows: int = BLOCK_ROWS,
    cell_rows: int = CELL_ROWS,
) -> DataFrame:
    if null_policy not in NULL_POLICIES:
        raise ValueError(f"unknown null policy '{null_policy}', use one of {NULL_POLICIES}")
    frame = build_frame(bars, sets, sources, block_rows=block_rows, cell_rows=cell_rows)
    out = apply_null_policy(frame, null_policy).finish()
    return out if null_policy == "keep" else out.na.drop()
