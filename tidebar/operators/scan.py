"""Bounded-group building blocks: time buckets and two-level prefix scans.

No step here puts a whole series into one task.  A prefix over many small
groups is done in as many levels as keep each window group at ``FAN`` rows,
however unevenly the entries lie.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FAN = 4096


def running(kind: str, c: Column, spec) -> Column:
    """Aggregate of one prefix kind over a window spec."""
    if kind == "last":
        return F.last(c, ignorenulls=True).over(spec)
    return _AGG[kind](c).over(spec)


def total(kind: str, c: Column, order: str | Column) -> Column:
    """Group total of one prefix kind (partial aggregation on the map side)."""
    if kind == "last":
        order = F.col(order) if isinstance(order, str) else order
        return F.max_by(c, F.when(c.isNotNull(), order))
    return _AGG[kind](c)


def combine(kind: str, before: Column, here: Column) -> Column:
    """Join the prefix of everything before with the running value here."""
    if kind == "sum":
        return F.when(before.isNull(), here).when(here.isNull(), before).otherwise(before + here)
    if kind == "prod":
        return F.when(before.isNull(), here).when(here.isNull(), before).otherwise(before * here)
    if kind == "max":
        return F.greatest(before, here)
    if kind == "min":
        return F.least(before, here)
    if kind == "last":
        return F.coalesce(here, before)
    raise ValueError(f"unknown prefix kind: {kind}")


_AGG = {"sum": F.sum, "prod": F.product, "max": F.max, "min": F.min}


def prefix_scan(
    df: DataFrame,
    by: Sequence[str],
    idx: str,
    values: dict[str, tuple[str, Column]],
    fan: int = FAN,
) -> DataFrame:
    """Add the exclusive prefix of every value, ordered by the integer ``idx``.

    ``idx`` is a whole number from 0, unique within ``by``.  Level one runs
    inside groups of ``fan`` consecutive indexes, and the group totals are
    scanned in the same way, until their indexes all lie below ``fan``.  ``df``
    is read twice a level: pass a written one.
    """
    top = df.agg(F.max(idx)).first()[0]
    return _scan(df, list(by), idx, values, fan, int(top or 0) + 1, 0)


def _scan(df: DataFrame, by: list[str], idx: str, values: dict, fan: int, span: int, level: int) -> DataFrame:
    """One level of :func:`prefix_scan`; all indexes are below ``span``."""
    sup = f"__sup{level}"
    groups = [*by, sup] if span > fan else by
    keyed = df.withColumn(sup, F.floor(F.col(idx) / F.lit(fan)).cast("long")) if span > fan else df
    inner = Window.partitionBy(*groups).orderBy(idx).rowsBetween(Window.unboundedPreceding, -1)
    near = keyed.select("*", *[running(k, c, inner).alias(f"__n_{n}") for n, (k, c) in values.items()])
    if span <= fan:
        return near.select(*df.columns, *[F.col(f"__n_{n}").alias(n) for n in values])
    totals = keyed.groupBy(*groups).agg(*[total(k, c, idx).alias(f"__t_{n}") for n, (k, c) in values.items()])
    above = {f"__p_{n}": (k, F.col(f"__t_{n}")) for n, (k, _) in values.items()}
    tops = _scan(totals, by, sup, above, fan, -(-span // fan), level + 1).select(*groups, *above)
    joined = near.join(tops, groups)
    return joined.select(
        *df.columns,
        *[combine(k, F.col(f"__p_{n}"), F.col(f"__n_{n}")).alias(n) for n, (k, _) in values.items()],
    )


def micros(df: DataFrame, ts: str) -> Column:
    """Monotone microsecond clock of a time column.

    A time without zone is taken apart by its fields: reading it in the
    session's zone could run backwards where clocks change.
    """
    kind = dict(df.dtypes)[ts]
    if kind != "timestamp_ntz":
        return F.unix_micros(F.col(ts).cast("timestamp"))
    seconds = F.unix_date(F.to_date(ts)) * F.lit(86_400).cast("long") + F.hour(ts) * 3_600 + F.minute(ts) * 60
    return seconds * 1_000_000 + (F.date_part(F.lit("SECOND"), ts) * 1_000_000).cast("long")


@dataclass(frozen=True)
class Extent:
    """Size of a table of series: longest series, all rows, series, time range (micros)."""

    longest: int
    rows: int
    series: int
    lo: int
    hi: int


def series_extent(df: DataFrame, by: Sequence[str], ts: str) -> Extent:
    """One small job: per-series counts, reduced to a single row."""
    per = df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.min(micros(df, ts)).alias("lo"), F.max(micros(df, ts)).alias("hi")
    )
    row = per.agg(F.max("n"), F.sum("n"), F.count(F.lit(1)), F.min("lo"), F.max("hi")).first()
    return Extent(*[int(v or 0) for v in row])


def bucket_column(df: DataFrame, ts: str, lo: int, width: int) -> Column:
    offset = micros(df, ts) - F.lit(lo).cast("long")
    width = F.lit(width).cast("long")
    return ((offset - F.pmod(offset, width)) / width).cast("long")


def choose_bucket_width(
    df: DataFrame, by: Sequence[str], ts: str, extent: Extent, block_rows: int
) -> int:
    """Widest time bucket (micros) for which no (series, bucket) exceeds half a block.

    Uneven density is met by narrowing until the bound holds; with unique
    timestamps this ends at the latest at one microsecond.
    """
    lo = extent.lo
    width = max(1, (extent.hi - lo + 1) * max(block_rows // 8, 1) // max(extent.longest, 1))
    while width > 1:
        counts = df.groupBy(*by, bucket_column(df, ts, lo, width).alias("__bkt")).agg(F.count(F.lit(1)).alias("n"))
        worst = counts.agg(F.max("n")).first()[0] or 0
        if worst <= max(block_rows // 2, 1):
            break
        width = max(1, width // max(2, -(-worst * 4 // block_rows)))
    return width
