"""Scalar column helpers that carry the null / NaN / division contract."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EPS = 1e-10


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def div(a: str | Column, b: str | Column) -> Column:
    """a / b, null when b is zero (ANSI mode would raise)."""
    return F.try_divide(col(a), col(b))


def ratio(a: str | Column, b: str | Column) -> Column:
    """a / (b + 1e-10): the padded quotient used by most features."""
    return div(a, col(b) + F.lit(EPS))


def rel(a: str | Column, b: str | Column) -> Column:
    """(a - b) / (b + 1e-10)."""
    return ratio(col(a) - col(b), b)


def flag(cond: Column) -> Column:
    """Comparison to 0/1; an unknown comparison counts as 0."""
    return F.coalesce(cond, F.lit(False)).cast("int")


def at_least(c: str | Column, lo: float) -> Column:
    """Clip from below, keeping null (greatest() would skip it)."""
    c = col(c)
    return F.when(c.isNotNull(), F.greatest(c, F.lit(float(lo))))


def clip(c: str | Column, lo: float, hi: float) -> Column:
    c = col(c)
    return F.when(c.isNotNull(), F.least(F.greatest(c, F.lit(float(lo))), F.lit(float(hi))))


def zscore(c: str | Column, mean: str | Column, std: str | Column) -> Column:
    return ratio(col(c) - col(mean), std)


def map_values(c: str | Column, mapping: dict[int, int]) -> Column:
    """Value map; keys not listed become null."""
    c = col(c)
    out = F.lit(None).cast("int")
    for key, value in mapping.items():
        out = F.when(c == F.lit(key), F.lit(value).cast("int")).otherwise(out)
    return out


def nan_to_null(df: DataFrame) -> DataFrame:
    """NaN means missing; Spark would compare it as the largest number."""
    floats = {n for n, t in df.dtypes if t in ("double", "float")}
    return df.select(*[F.nanvl(F.col(c), F.lit(None)).alias(c) if c in floats else F.col(c) for c in df.columns])
