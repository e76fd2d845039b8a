"""Backward as-of join: each row gets the last source row at or before its time."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidebar.operators.frame import BLOCK_ROWS
from tidebar.operators.scan import (
    bucket_column,
    choose_bucket_width,
    prefix_scan,
    series_extent,
)
from tidebar.session import materialize


def asof_join(
    left: DataFrame,
    sources: Sequence[DataFrame],
    by: Sequence[str] = ("symbol",),
    ts: str = "ts",
    block_rows: int = BLOCK_ROWS,
    distinct: bool = False,
) -> DataFrame:
    """Add the columns of each source's last row with time <= the row's time.

    All sources are aligned in one pass: union, one shuffle, one running
    ``last`` per source.  The last source row decides even where its values
    are null.  ``(by, ts)`` is unique in every source.  With an empty ``by``
    the sources hold one series for all rows; they are aligned to the
    distinct times of ``left`` and joined back on the time.  So they are where
    so many rows of a series have one time that no time bucket is small
    enough; hot times are split in the join.  ``distinct`` says that ``left``
    has each (by, ts) once.
    """
    by = list(by)
    values = [[c for c in s.columns if c not in (*by, ts)] for s in sources]
    names = [v for group in values for v in group]
    if not by:
        one = F.lit(0).alias("__all")
        times = left.select(ts).distinct().select(one, ts)
        aligned = asof_join(times, [s.select(one, "*") for s in sources], ["__all"], ts, block_rows)
        return split_join(left, aligned.drop("__all"), [ts], block_rows).select(*left.columns, *names)

    rest = [c for c in left.columns if c not in (*by, ts)]
    slots = [f"__s{i}" for i in range(len(sources))]
    both = left.select(*by, ts, F.lit(1).alias("__side"), F.struct(F.lit(1).alias("__one"), *rest).alias("__l"))
    for slot, source, cols in zip(slots, sources, values):
        rows = source.select(*by, ts, F.lit(0).alias("__side"), F.struct(*cols).alias(slot))
        both = both.unionByName(rows, allowMissingColumns=True)
    both = materialize(both)
    extent = series_extent(both, by, ts)
    order = [ts, "__side"]  # source rows of the same time come first
    if extent.longest <= block_rows:
        upto = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        filled = both.select(
            *by, ts, "__side", "__l", *[F.last(s, ignorenulls=True).over(upto).alias(s) for s in slots]
        )
    else:
        width = choose_bucket_width(both, by, ts, extent, block_rows)
        if width == 1 and not distinct:
            times = left.select(*by, ts).distinct()
            aligned = asof_join(times, sources, by, ts, block_rows, distinct=True)
            return split_join(left, aligned, [*by, ts], block_rows).select(*left.columns, *names)
        keyed = both.withColumn("__bkt", bucket_column(both, ts, extent.lo, width))
        latest = keyed.groupBy(*by, "__bkt").agg(
            *[F.max_by(s, F.when(F.col(s).isNotNull(), F.col(ts))).alias(f"{s}_end") for s in slots]
        )
        latest = materialize(latest)
        carry = prefix_scan(latest, by, "__bkt", {f"{s}_carry": ("last", F.col(f"{s}_end")) for s in slots})
        upto = Window.partitionBy(*by, "__bkt").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        filled = keyed.select(
            *by, ts, "__bkt", "__side", "__l", *[F.last(s, ignorenulls=True).over(upto).alias(s) for s in slots]
        )
        filled = filled.join(carry.select(*by, "__bkt", *[f"{s}_carry" for s in slots]), [*by, "__bkt"])
        for s in slots:
            filled = filled.withColumn(s, F.coalesce(s, f"{s}_carry"))
    out = filled.filter(F.col("__side") == 1)
    picked = {c: F.col(f"__l.{c}") for c in rest}
    picked |= {v: F.col(f"{s}.{v}") for s, group in zip(slots, values) for v in group}
    return out.select(*[picked[c].alias(c) if c in picked else F.col(c) for c in [*left.columns, *names]])


def split_join(left: DataFrame, table: DataFrame, keys: Sequence[str], task_rows: int) -> DataFrame:
    """left with the columns of table, which has one row a key.

    Keys with more than ``task_rows`` rows, and a thousandth of all, are at most a thousand: their row of the table is repeated once for
    each ``task_rows`` rows, and these are dealt to the copies, so no task gets all rows of a key.
    """
    keys = list(keys)
    total = left.count()
    counts = left.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")).filter(F.col("__n") > max(task_rows, total // 1000))
    hot = counts.select(*keys, F.ceil(F.col("__n") / F.lit(task_rows)).cast("int").alias("__parts"))
    parts = F.coalesce("__parts", F.lit(1))
    dealt = left.join(F.broadcast(hot), keys, "left").withColumn("__part", F.pmod(F.monotonically_increasing_id(), parts).cast("int"))
    copies = table.join(F.broadcast(hot), keys, "left").withColumn("__part", F.explode(F.sequence(F.lit(0), parts - 1)))
    return dealt.drop("__parts").join(copies.drop("__parts"), [*keys, "__part"], "left").drop("__part")
