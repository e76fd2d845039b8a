"""Ranks over whole groups that stay bounded however large a group is."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidebar.operators.scan import FAN
from tidebar.session import materialize

GROUP_ROWS = FAN * 16
#: Most ranges that rows are cut into: their bounds meet on the driver. Beyond, ranges hold more rows.
MAX_RANGES = 20_000


def running_before(df: DataFrame, by: Sequence[str], order: Sequence[Column], amount: Column, out: str,
                   materialized: bool = False) -> DataFrame:
    """Sum of ``amount`` over the rows of the group ordered before each row.

    Groups up to ``GROUP_ROWS`` rows use one window.  Otherwise the rows are
    range-partitioned by (group, order), summed inside each range, and the
    totals of the earlier ranges of the group are added.
    """
    by, order = list(by), list(order)
    df = df if materialized else materialize(df)
    size = df.groupBy(*by).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n"), F.sum("n")).first()
    prior = lambda *keys: Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    if (size[0] or 0) <= GROUP_ROWS:
        return df.withColumn(out, F.coalesce(F.sum(amount).over(prior(*by)), F.lit(0)))
    ranges = min(max(2, -(-int(size[1]) // GROUP_ROWS)), MAX_RANGES)
    spread = df.repartitionByRange(ranges, *by, *order).withColumn("__part", F.spark_partition_id())
    spread = materialize(spread.withColumn("__amount", amount))
    tops = spread.groupBy(*by, "__part").agg(F.sum("__amount").alias("__t"))
    earlier = Window.partitionBy(*by).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    tops = tops.select(*by, "__part", F.sum("__t").over(earlier).alias("__pre"))
    inner = spread.withColumn("__in", F.sum("__amount").over(prior(*by, "__part")))
    total = F.coalesce(F.col("__pre"), F.lit(0)) + F.coalesce(F.col("__in"), F.lit(0))
    return inner.join(tops, [*by, "__part"]).select(*df.columns, total.alias(out))


def row_ranks(df: DataFrame, by: Sequence[str], order: Sequence[Column], out: str) -> DataFrame:
    """1-based position of every row in its group; the order must be unique."""
    ranked = running_before(df, by, order, F.lit(1).cast("long"), out)
    return ranked.withColumn(out, (F.col(out) + 1).cast("int"))


def pct_rank(df: DataFrame, value: str, out: str, by: Sequence[str] = ("symbol",)) -> DataFrame:
    """Average-rank percentile: (smaller + (equal + 1) / 2) / count, null for null.

    Works on counts per distinct value, so copies of one value collapse before
    the shuffle.
    """
    by = list(by)
    counts = df.filter(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("__n"))
    counts = materialize(counts)
    ranked = running_before(counts, by, [F.col(value).asc()], F.col("__n"), "__below", materialized=True)
    sizes = counts.groupBy(*by).agg(F.sum("__n").alias("__all"))
    rank = F.col("__below") + (F.col("__n") + 1) / 2
    table = ranked.join(sizes, by).select(*by, value, (rank / F.col("__all")).alias(out))
    return df.join(table, [*by, value], "left").select(*df.columns, out)
