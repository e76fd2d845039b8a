"""Landed raw files to typed tables (fetching them is not part of this package)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidebar.operators.prepare import dedupe_keep_last, normalise_columns

# fixed values: positions of the exchange's kline array
KLINE_FIELDS = [
    "open_time", "open", "high", "low", "close", "volume", "close_time",
    "quote_volume", "trades", "taker_buy_base", "taker_buy_quote", "ignore",
]
KLINE_DOUBLES = ["open", "high", "low", "close", "volume", "quote_volume"]


def klines(lines: DataFrame, value: str = "value", keep: tuple[str, ...] = ()) -> DataFrame:
    """One JSON array of 12 positional fields per row; 8 are kept and typed."""
    parts = F.from_json(F.col(value), "array<string>")
    at = {n: F.element_at("__k", i + 1) for i, n in enumerate(KLINE_FIELDS)}
    return lines.withColumn("__k", parts).select(
        *keep,
        F.timestamp_millis(at["open_time"].cast("long")).alias("ts"),
        *[at[n].cast("double").alias(n) for n in KLINE_DOUBLES],
        at["trades"].cast("long").alias("trades"),
    )


def read_klines(spark: SparkSession, path: str) -> DataFrame:
    """Files of newline-delimited kline arrays."""
    return klines(spark.read.text(path))


def price_history(raw: DataFrame) -> DataFrame:
    """Downloaded price history: lower-case, underscored names."""
    return normalise_columns(raw, underscore=True)


def fear_greed(raw: DataFrame) -> DataFrame:
    """Epoch-second records to daily values, last record of a time kept."""
    rows = raw.select(
        F.timestamp_seconds(F.col("timestamp").cast("long")).alias("ts"),
        F.col("value").cast("int").alias("fgi_value"),
        F.col("value_classification").alias("fgi_class"),
        F.col("seq"),
    )
    return dedupe_keep_last(rows, ["ts"], "seq").drop("seq")


def macro_wide(long: DataFrame, names: list[str]) -> DataFrame:
    """(factor, ts, close) rows to one row per time and a ``<factor>_close`` column each.

    Conditional aggregates over a given name list: one shuffle, no extra job
    to discover the columns.
    """
    return long.groupBy("ts").agg(
        *[F.max(F.when(F.col("factor") == n, F.col("close"))).alias(f"{n}_close") for n in names]
    )


def funding_daily(raw: DataFrame, when: Column, rate: Column) -> DataFrame:
    """Records several times a day to daily mean / sum / max / min."""
    rows = raw.select(F.date_trunc("day", when).alias("ts"), rate.cast("double").alias("r"))
    return rows.groupBy("ts").agg(
        F.avg("r").alias("funding_rate_mean"), F.sum("r").alias("funding_rate_sum"),
        F.max("r").alias("funding_rate_max"), F.min("r").alias("funding_rate_min"),
    )


def long_short_daily(raw: DataFrame, when: Column, order: list[Column]) -> DataFrame:
    """Last record of each day."""
    last = F.max_by(F.struct("ls_ratio", "long_account", "short_account"), F.struct(*order))
    days = raw.groupBy(F.date_trunc("day", when).alias("ts")).agg(last.alias("l"))
    return days.select("ts", "l.ls_ratio", "l.long_account", "l.short_account")
