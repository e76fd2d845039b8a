"""Row and column preparation: names, checks, dedupe, filters, tails, profiles."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# fixed values: columns every bar table needs
REQUIRED_COLUMNS = ["open", "high", "low", "close", "volume"]


def normalise_columns(df: DataFrame, underscore: bool = False) -> DataFrame:
    """Lower-case, trimmed names; optionally blanks to underscores."""
    names = [c.lower().strip() for c in df.columns]
    return df.toDF(*[n.replace(" ", "_") if underscore else n for n in names])


def require_columns(df: DataFrame, required: Sequence[str] = REQUIRED_COLUMNS) -> DataFrame:
    missing = sorted(set(required) - set(df.columns))
    if missing:
        raise ValueError(f"missing required columns: {missing}")
    return df


def dedupe_keep_last(df: DataFrame, keys: Sequence[str], sequence: str) -> DataFrame:
    """Last row per key by ``sequence``; rows without one come before all others.

    Of equal sequences the largest row (column by column, nulls first) stays.
    An aggregate, not a row_number window: copies of one key collapse on the
    map side, so a key holding a third of the rows stays cheap.
    """
    rest = [c for c in df.columns if c not in keys]
    order = F.struct(F.col(sequence).isNotNull().alias("known"), F.col(sequence).alias("at"), F.struct(*rest).alias("row"))
    last = df.groupBy(*keys).agg(F.max(order)["row"].alias("__last"))
    return last.select(*[F.col(c) if c in keys else F.col(f"__last.{c}").alias(c) for c in df.columns])


def date_range(df: DataFrame, start: str | None = None, end: str | None = None, ts: str = "ts") -> DataFrame:
    """Inclusive range; the bound keeps the column type so the filter reaches the scan."""
    kind = dict(df.dtypes)[ts]
    if start:
        df = df.filter(F.col(ts) >= F.lit(start).cast(kind))
    if end:
        df = df.filter(F.col(ts) <= F.lit(end).cast(kind))
    return df


def tail(df: DataFrame, n: int, by: Sequence[str] = ("symbol",), ts: str = "ts") -> DataFrame:
    """Latest n rows per series.

    A row_number limit is pushed below the shuffle as a per-task group limit,
    so a long series sends n rows per task.
    """
    latest = Window.partitionBy(*by).orderBy(F.col(ts).desc())
    return df.withColumn("__rank", F.row_number().over(latest)).filter(F.col("__rank") <= n).drop("__rank")


def missing_profile(df: DataFrame, ts: str = "ts") -> DataFrame:
    """Null share of every other column with the covered time range, one pass."""
    names = [c for c in df.columns if c != ts]
    rates = [F.avg(F.col(c).isNull().cast("double")).alias(c) for c in names]
    one = df.agg(F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts"), F.count(F.lit(1)).alias("n_rows"), *rates)
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("missing_rate")) for c in names])
    return one.select("first_ts", "last_ts", "n_rows", F.explode(pairs).alias("p")).select(
        "p.column", "p.missing_rate", "n_rows", "first_ts", "last_ts"
    )


def align_rows(a: DataFrame, b: DataFrame, keys: Sequence[str] = ("symbol", "ts")) -> DataFrame:
    """Rows of ``a`` whose key also occurs in ``b``."""
    return a.join(b.select(*keys).distinct(), list(keys), "left_semi")


def merge_by_time(frames: Sequence[DataFrame], ts: str = "ts") -> DataFrame:
    """Full outer merge of tables with one row per time, in a single shuffle."""
    parts, names = [], [c for f in frames for c in f.columns if c != ts]
    for i, f in enumerate(frames):
        own = [c for c in f.columns if c != ts]
        parts.append(f.select(ts, *[F.col(c) for c in own]))
    merged = parts[0]
    for p in parts[1:]:
        merged = merged.unionByName(p, allowMissingColumns=True)
    return merged.groupBy(ts).agg(*[F.first(c, ignorenulls=True).alias(c) for c in names])
