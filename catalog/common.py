"""Shared inputs of the registered queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import tidebar.features  # noqa: F401  (registers the sets)
from tidebar.features.price import rsi
from tidebar.functions.scalars import map_values
from tidebar.operators.folds import FoldPlan, assign_test_folds, number_rows
from tidebar.operators.frame import Frame, lay_out
from tidebar.operators.labels import get_label_strategy
from tidebar.sources.bars import order_bars

#: Blocks so small that series of the test tables are cut into several, as long series are by default.
BLOCKED = {"block_rows": 512, "cell_rows": 64}
PLAN = FoldPlan(init_train=900, oos_window=63, step=21, purge_gap=7)


def canon(df: DataFrame) -> DataFrame:
    """Doubles at float precision, so engines with another summation order agree."""

    def one(name: str, kind: str):
        if kind != "double":
            return F.col(name)
        return (F.round(F.col(name), 8).cast("float").cast("double") + F.lit(0.0)).alias(name)

    return df.select(*[one(n, k) for n, k in df.dtypes])


def bar_frame(spark: SparkSession, sf_dir: str, lookback: int = 0, lookahead: int = 0, symbol="o_orderpriority", **layout) -> Frame:
    return lay_out(order_bars(spark, sf_dir, symbol), lookback=lookback, lookahead=lookahead, **layout)


def scored_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rule-based scores without a model: one row per usable bar.

    proba = rsi_14 / 100; y_true = did the close rise by half within 7 rows;
    bear columns mirror it.  ``ret`` is the return of the 20-row mean.
    """
    f = bar_frame(spark, sf_dir, lookback=210, lookahead=7)
    f = get_label_strategy("directional")(rsi(f, (14,)), T=7, X=0.5)
    f = f.add({"sma_20": f.mean("close", 20), "sma_200": f.mean("close", 200)})
    f = f.add({"ret": f.change("sma_20")})
    rows = f.finish().select(
        "symbol", "ts", "close", "sma_200", "ret",
        (F.col("rsi_14") / 100).alias("proba"),
        (1 - F.col("rsi_14") / 100).alias("bear_proba"),
        map_values("label", {0: 0, 1: 0, 2: 1}).alias("y_true"),
        map_values("label", {0: 1, 1: 0, 2: 0}).alias("bear_true"),
        F.col("label"),
    )
    rows = rows.filter(F.col("proba").isNotNull() & F.col("y_true").isNotNull())
    return rows.withColumn("y_pred", (F.col("proba") >= 0.5).cast("int")).withColumn(
        "bear_pred", (F.col("bear_proba") >= 0.48).cast("int")
    )


def fold_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scored rows, one per test fold they belong to."""
    return assign_test_folds(number_rows(scored_rows(spark, sf_dir)), PLAN)
