"""Bar tables: reading them and building them from tick-like rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidebar.functions.scalars import nan_to_null
from tidebar.operators.prepare import dedupe_keep_last, normalise_columns, require_columns

BAR_SCHEMA = T.StructType(
    [T.StructField("symbol", T.StringType()), T.StructField("ts", T.TimestampType())]
    + [T.StructField(n, T.DoubleType()) for n in ("open", "high", "low", "close", "volume", "quote_volume")]
    + [T.StructField("trades", T.LongType())]
)


def read_bars(
    spark: SparkSession, path: str, fmt: str = "csv", schema: T.StructType | None = None,
    symbol: str | None = None, ts: str = "date", sequence: str | None = None,
) -> DataFrame:
    """Bar files to a checked, deduplicated table keyed by (symbol, ts).

    Names are lower-cased and trimmed, required columns checked, NaN made
    null.  Of rows with the same key the last by ``sequence`` stays; without
    one, the position in the input files decides.
    """
    reader = spark.read.format(fmt)
    if fmt == "csv":
        reader = reader.option("header", True).option("inferSchema", schema is None)
    df = (reader.schema(schema) if schema else reader).load(path)
    names = df.columns
    df = df.select(*names, F.struct(F.input_file_name(), F.monotonically_increasing_id()).alias("__pos"))
    df = df.toDF(*normalise_columns(df.select(*names)).columns, "__pos")
    require_columns(df)
    if "ts" not in df.columns:
        df = df.withColumnRenamed(ts if ts in df.columns else df.columns[0], "ts")
    df = df.withColumn("ts", F.col("ts").cast("timestamp"))
    if "symbol" not in df.columns:
        df = df.withColumn("symbol", F.lit(symbol or "default"))
    lead = ["symbol", "ts"]
    df = df.select(*lead, *[c for c in df.columns if c not in lead])
    out = dedupe_keep_last(nan_to_null(df.select(*[c for c in df.columns if c != "__pos"], "__pos")), lead,
                           sequence or "__pos")
    return out.drop("__pos")


def bars_from_ticks(
    ticks: DataFrame, by: Sequence[str], ts: Column, price: str, order: Sequence[str], quantity: str | None,
) -> DataFrame:
    """OHLCV bars: one row per (by, time bucket).

    A single aggregate with partial aggregation on the map side, so a bucket
    or symbol holding most ticks sends one partial row per task.
    """
    at = F.struct(*order) if len(order) > 1 else F.col(order[0])
    return ticks.groupBy(*by, ts.alias("ts")).agg(
        F.min_by(price, at).alias("open"),
        F.max(price).alias("high"),
        F.min(price).alias("low"),
        F.max_by(price, at).alias("close"),
        F.sum(quantity or price).alias("volume"),
        F.sum(price).alias("quote_volume"),
        F.count(F.lit(1)).alias("trades"),
    )


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def order_bars(spark: SparkSession, sf_dir: str, symbol: str = "o_orderpriority") -> DataFrame:
    """Daily bars of order prices; volume is the ordered quantity.

    ``symbol`` is an orders column, or ``ALL`` for one series over everything.
    """
    orders = read_table(spark, sf_dir, "orders")
    quantity = read_table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sum("l_quantity").alias("qty"))
    ticks = orders.join(quantity, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    name = F.lit("ALL") if symbol == "ALL" else F.col(symbol).cast("string")
    ticks = ticks.select(
        name.alias("symbol"), "o_orderdate", "o_orderkey", "o_totalprice", F.coalesce("qty", F.lit(0.0)).alias("qty")
    )
    return bars_from_ticks(ticks, ["symbol"], F.col("o_orderdate"), "o_totalprice", ["o_orderkey"], "qty")


def event_bars(spark: SparkSession, sf_dir: str, unit: str = "hour") -> DataFrame:
    """Bars of event values by event type and hour (or another date_trunc unit)."""
    events = read_table(spark, sf_dir, "events").withColumn("symbol", F.col("event_type"))
    return bars_from_ticks(events, ["symbol"], F.date_trunc(unit, "ts"), "value", ["ts", "event_id"], None)


def outside_series(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """Daily outside series on the order dates, from lineitem."""
    items = read_table(spark, sf_dir, "lineitem").withColumnRenamed("l_shipdate", "ts")
    fgi = items.groupBy("ts").agg(F.round(F.avg("l_discount") * 1000).alias("fgi_value"))
    weekday = items.filter(~F.dayofweek("ts").isin(1, 7))
    macro = weekday.groupBy("ts").agg(
        F.avg("l_extendedprice").alias("ndx_close"), F.avg("l_quantity").alias("vix_close")
    )
    funding = items.groupBy("ts").agg(
        F.avg("l_tax").alias("funding_rate_mean"), F.sum("l_tax").alias("funding_rate_sum"),
        F.max("l_tax").alias("funding_rate_max"), F.min("l_tax").alias("funding_rate_min"),
    )
    share = F.avg((F.col("l_returnflag") == "A").cast("double"))
    long_short = items.groupBy("ts").agg(
        F.try_divide(share, 1 - share).alias("ls_ratio"), share.alias("long_account"),
        (1 - share).alias("short_account"),
    )
    return {"fgi": fgi, "macro": macro, "funding": funding, "long_short": long_short}
