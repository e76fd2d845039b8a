"""Profit-and-loss statistics of a 0/1 position series."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidebar.operators.frame import BLOCK_ROWS, CELL_ROWS, lay_out

c = F.col

PNL_FIELDS = [
    "total_return", "cagr", "sharpe", "sortino", "max_drawdown", "calmar", "win_rate",
    "profit_factor", "avg_win", "avg_loss", "num_trades", "num_wins", "num_losses",
]
# fixed values: fields attached to an evaluation
ATTACHED = [
    "total_return", "cagr", "sharpe", "sortino", "max_drawdown", "calmar", "win_rate", "profit_factor", "num_trades",
]


def strategy_returns(
    signals: DataFrame, by: Sequence[str] = ("symbol",), ts: str = "ts",
    position_size: float = 1.0, transaction_cost: float = 0.001,
    block_rows: int = BLOCK_ROWS, cell_rows: int = CELL_ROWS,
) -> DataFrame:
    """Per-row strategy return, equity and drawdown.

    Input rows carry y_true, y_pred and the asset return ``ret``; rows with
    any of them null are left out first.  A row earns the next row's return
    and pays for the position change into it; the last row earns nothing.
    """
    rows = signals.filter(c("y_true").isNotNull() & c("y_pred").isNotNull() & c("ret").isNotNull())
    f = lay_out(rows, by, ts, lookahead=1, block_rows=block_rows, cell_rows=cell_rows)
    f = f.add({"position": c("y_pred") * F.lit(float(position_size))})
    cost = F.abs(f.lead("position") - c("position")) * F.lit(float(transaction_cost))
    f = f.add({"strategy_return": c("position") * f.lead("ret") - cost})
    f = f.cumulative({"equity": ("prod", 1 + c("strategy_return"))})
    f = f.cumulative({"peak": ("max", "equity")})
    f = f.add({"drawdown": F.try_divide(c("equity") - c("peak"), c("peak"))})
    return f.finish(keep_row_number="row_idx").filter(c("strategy_return").isNotNull())


def pnl_metrics(
    signals: DataFrame, by: Sequence[str] = ("symbol",), ts: str = "ts",
    position_size: float = 1.0, transaction_cost: float = 0.001,
    risk_free_rate: float = 0.0, periods_per_year: float = 52.0,
    block_rows: int = BLOCK_ROWS, cell_rows: int = CELL_ROWS,
) -> DataFrame:
    """The 13 summary fields per series, ratios guarded to 0."""
    r = c("strategy_return")
    excess = r - F.lit(risk_free_rate / periods_per_year)
    win, loss = F.when(r > 0, r), F.when(r < 0, r)
    per = strategy_returns(signals, by, ts, position_size, transaction_cost, block_rows, cell_rows)
    agg = per.groupBy(*by).agg(
        F.max_by("equity", "row_idx").alias("equity"),
        F.count(r).alias("n"),
        F.avg(excess).alias("mean"),
        F.stddev_pop(excess).alias("std"),
        F.stddev_pop(F.when(excess < 0, excess)).alias("down"),
        F.min("drawdown").alias("max_drawdown"),
        F.count(win).alias("num_wins"), F.count(loss).alias("num_losses"),
        F.sum(win).alias("sum_win"), F.sum(loss).alias("sum_loss"),
        F.avg(win).alias("avg_win"), F.avg(loss).alias("avg_loss"),
    )
    root = F.lit(math.sqrt(periods_per_year))
    zero = F.lit(0.0)
    years = c("n") / F.lit(periods_per_year)
    agg = agg.withColumn("total_return", c("equity") - 1)
    agg = agg.withColumn("cagr", F.when(c("equity") >= 0, F.pow(c("equity"), 1 / years) - 1))
    trades = c("num_wins") + c("num_losses")
    result = agg.select(
        *by, "total_return", "cagr",
        F.when(c("std") > 0, c("mean") / c("std") * root).otherwise(zero).alias("sharpe"),
        F.when(c("down") > 0, c("mean") / c("down") * root).otherwise(zero).alias("sortino"),
        "max_drawdown",
        F.when(c("max_drawdown") != 0, c("cagr") / F.abs("max_drawdown")).otherwise(zero).alias("calmar"),
        F.when(trades > 0, c("num_wins") / trades).otherwise(zero).alias("win_rate"),
        F.when(c("sum_loss") != 0, F.abs(F.coalesce(c("sum_win"), zero) / c("sum_loss")))
        .otherwise(zero).alias("profit_factor"),
        F.coalesce("avg_win", zero).alias("avg_win"), F.coalesce("avg_loss", zero).alias("avg_loss"),
        trades.alias("num_trades"), "num_wins", "num_losses",
    )
    # a series without a single return reports zeros
    empty = signals.select(*by).distinct().join(result.select(*by), list(by), "left_anti")
    zeros = [F.lit(0).cast(t).alias(n) for n, t in result.dtypes if n not in by]
    return result.unionByName(empty.select(*by, *zeros))


def attach_pnl(metrics: DataFrame, pnl: DataFrame, by: Sequence[str] = ("symbol",)) -> DataFrame:
    """Metrics with the reported PnL fields under a ``pnl_`` prefix."""
    return metrics.join(pnl.select(*by, *[c(f).alias(f"pnl_{f}") for f in ATTACHED]), list(by), "left")
