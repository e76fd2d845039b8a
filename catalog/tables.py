"""Scans, landing transforms, preparation, joins and plain aggregates."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from catalog.common import bar_frame, order_bars, scored_rows
from tidebar.features.builder import build_features
from tidebar.functions.scalars import map_values
from tidebar.operators.asof import asof_join
from tidebar.operators.labels import add_labels, class_distribution, label_summary
from tidebar.operators.prepare import (
    align_rows,
    date_range,
    dedupe_keep_last,
    merge_by_time,
    missing_profile,
    normalise_columns,
    tail,
)
from tidebar.session import ensure_checkpoint_dir
from tidebar.sources.bars import event_bars, outside_series, read_bars, read_table
from tidebar.sources.files import load_runs, write_csv, write_run
from tidebar.sources.landing import fear_greed, funding_daily, klines, long_short_daily, macro_wide, price_history

c = F.col
RAW = ["open", "high", "low", "close", "volume", "quote_volume", "trades"]


def bar_csv_scan(spark, sf_dir):
    """Bars written as CSV with untidy names, read back through the bar reader."""
    folder = f"{ensure_checkpoint_dir(spark)}/bars-{uuid.uuid4().hex}"
    untidy = order_bars(spark, sf_dir).withColumnRenamed("close", " Close").withColumnRenamed("ts", "Date")
    write_csv(untidy, folder)
    return read_bars(spark, folder)


def landing_klines(spark, sf_dir):
    """Orders as positional kline arrays, then typed."""
    o = read_table(spark, sf_dir, "orders")
    price = c("o_totalprice").cast("string")
    ms = F.unix_millis(c("o_orderdate").cast("timestamp")).cast("string")
    zero = F.lit("0")
    fields = [ms, price, price, price, price, c("o_custkey").cast("string"), ms, price, c("o_orderkey").cast("string"),
              zero, zero, zero]
    lines = o.select("o_orderkey", F.to_json(F.array(*fields)).alias("value"))
    return klines(lines, keep=("o_orderkey",))


def landing_price_history(spark, sf_dir):
    raw = order_bars(spark, sf_dir).select(
        "symbol", c("ts").alias("Date"), c("open").alias("Open"), c("close").alias(" Close"),
        c("close").alias("Adj Close"), c("volume").alias("Volume "),
    )
    return price_history(raw)


def landing_fear_greed(spark, sf_dir):
    """Line items as index records of their ship day, last one of a day kept."""
    raw = read_table(spark, sf_dir, "lineitem").select(
        F.unix_seconds(c("l_shipdate").cast("timestamp")).cast("string").alias("timestamp"),
        (c("l_discount") * 1000).cast("int").cast("string").alias("value"),
        c("l_returnflag").alias("value_classification"),
        (c("l_orderkey") * 10 + c("l_linenumber")).alias("seq"),
    )
    unique = raw.groupBy("timestamp", "seq").agg(
        F.max("value").alias("value"), F.max("value_classification").alias("value_classification")
    )
    return fear_greed(unique)


def landing_macro(spark, sf_dir):
    items = read_table(spark, sf_dir, "lineitem").filter(~F.dayofweek("l_shipdate").isin(1, 7))
    long = items.groupBy(c("l_shipdate").alias("ts"), c("l_returnflag").alias("factor")).agg(
        F.avg("l_extendedprice").alias("close")
    )
    return macro_wide(long, ["A", "N", "R"])


def landing_funding_daily(spark, sf_dir):
    """Event values in 8-hour steps, then per day."""
    eight = F.window("ts", "8 hours")["start"]
    raw = read_table(spark, sf_dir, "events").groupBy(eight.alias("at")).agg(F.avg("value").alias("rate"))
    return funding_daily(raw, c("at"), c("rate"))


def landing_long_short(spark, sf_dir):
    raw = read_table(spark, sf_dir, "events").select(
        "ts", "event_id", c("value").alias("ls_ratio"), (c("value") / (1 + c("value"))).alias("long_account"),
        (1 / (1 + c("value"))).alias("short_account"),
    )
    return long_short_daily(raw, c("ts"), [c("ts"), c("event_id")])


def dedupe(spark, sf_dir):
    """One order per (priority, day): the last by key."""
    o = read_table(spark, sf_dir, "orders").select(
        c("o_orderpriority").alias("symbol"), c("o_orderdate").alias("ts"), "o_orderkey", "o_totalprice", "o_orderstatus"
    )
    return dedupe_keep_last(o, ["symbol", "ts"], "o_orderkey")


def dedupe_null_sequence(spark, sf_dir):
    """As dedupe, with a sequence that is null for two customers in three: of rows without one the largest stays."""
    o = read_table(spark, sf_dir, "orders").filter(c("o_orderstatus").isNotNull()).select(
        c("o_orderpriority").alias("symbol"), c("o_orderdate").alias("ts"), "o_orderkey",
        F.when(c("o_custkey") % 3 == 0, c("o_orderkey")).alias("seq"),
    )
    return dedupe_keep_last(o, ["symbol", "ts"], "seq")


def ffill_frame(spark, sf_dir):
    f = bar_frame(spark, sf_dir)
    f = f.add({"sparse": F.when(c("trades") > 1, c("close")), "sparse_volume": F.when(c("volume") > 60, c("volume"))})
    return f.ffill(["sparse", "sparse_volume"]).finish().select("symbol", "ts", "sparse", "sparse_volume")


def drop_null_rows(spark, sf_dir):
    """Volume features, only complete rows."""
    return build_features(order_bars(spark, sf_dir), ["volume"], "drop").drop(*RAW)


def ffill_then_drop(spark, sf_dir):
    return build_features(order_bars(spark, sf_dir), ["volume"]).drop(*RAW)


def value_map(spark, sf_dir):
    labelled = add_labels(order_bars(spark, sf_dir), "directional", T=14, X=0.5)
    return labelled.select("symbol", "ts", "label", map_values("label", {0: 0, 1: 0, 2: 1}).alias("bull"),
                           map_values("label", {0: 1, 2: 0}).alias("bear"))


def row_intersection(spark, sf_dir):
    """Bars of single-order days whose priority also traded that day at a high price."""
    bars = order_bars(spark, sf_dir)
    high = bars.filter(c("high") > 400000)
    return align_rows(bars.filter(c("trades") == 1), high).select("symbol", "ts", "close")


def profile(spark, sf_dir):
    sources = outside_series(spark, sf_dir)
    return missing_profile(merge_by_time([sources["fgi"], sources["macro"], sources["long_short"]]))


def merged_sources(spark, sf_dir):
    sources = outside_series(spark, sf_dir)
    return merge_by_time([sources["fgi"], sources["macro"], sources["funding"]])


def asof_common(spark, sf_dir):
    """Weekday-only factors carried over weekends to every bar."""
    sources = outside_series(spark, sf_dir)
    bars = order_bars(spark, sf_dir).select("symbol", "ts", "close")
    return asof_join(bars, [sources["macro"], sources["fgi"]], by=[])


def asof_per_symbol(spark, sf_dir):
    """Last hourly bar of the same event type before each event; null values stay null."""
    events = read_table(spark, sf_dir, "events").select(
        c("event_type").alias("symbol"), "ts", "event_id", "value"
    )
    hourly = event_bars(spark, sf_dir).select(
        "symbol", "ts", F.when(c("trades") > 2, c("close")).alias("bar_close"), c("volume").alias("bar_volume")
    )
    unique = dedupe_keep_last(events, ["symbol", "ts"], "event_id")
    return asof_join(unique, [hourly])


def value_counts(spark, sf_dir):
    labelled = add_labels(order_bars(spark, sf_dir), "reversal", T=3, X=0.6)
    return class_distribution(labelled, ["symbol"])


def return_summary(spark, sf_dir):
    return label_summary(add_labels(order_bars(spark, sf_dir), "return_rate", T=14), ["symbol"])


def column_normalise(spark, sf_dir):
    raw = read_table(spark, sf_dir, "orders")
    return normalise_columns(raw.toDF(*[f" {n.upper()} " for n in raw.columns]))


def stored(table):
    """A table of two runs, written with all their artifacts to the shared folder and read back."""

    def run(spark, sf_dir):
        root = f"{ensure_checkpoint_dir(spark)}/runs-{uuid.uuid4().hex}"
        bars = order_bars(spark, sf_dir)
        for name, low in (("first", 0), ("second", 200_000)):
            preds = bars.filter(c("close") > low).select(
                "symbol", "ts", (c("trades") % 3).alias("fold_id"), (c("close") > c("open")).cast("int").alias("y_true"),
                (c("close") > 250_000).cast("int").alias("y_pred"),
            )
            folds = preds.groupBy("fold_id").agg(F.count(F.lit(1)).alias("n"), F.sum("y_true").alias("n_pos"))
            importance = preds.groupBy(c("symbol").alias("feature")).agg(F.count(F.lit(1)).alias("importance"))
            metrics = preds.agg(F.count(F.lit(1)).alias("n"), F.sum((c("y_true") == c("y_pred")).cast("long")).alias("n_right"))
            write_run(root, name, metrics, folds, importance, preds, metrics.select(F.lit(name).alias("name")))
        return load_runs(spark, root, table)

    return run


QUERIES = {
    "bars_daily": lambda s, d: order_bars(s, d),
    "bars_daily_all": lambda s, d: order_bars(s, d, "ALL"),
    "bars_hourly": lambda s, d: event_bars(s, d),
    "bar_csv_scan": bar_csv_scan,
    "landing_klines": landing_klines,
    "landing_price_history": landing_price_history,
    "landing_fear_greed": landing_fear_greed,
    "landing_macro": landing_macro,
    "landing_funding_daily": landing_funding_daily,
    "landing_long_short": landing_long_short,
    "column_normalise": column_normalise,
    "stored_predictions": stored("predictions"),
    "stored_metrics": stored("metrics"),
    "stored_fold_metrics": stored("fold_metrics"),
    "stored_importance": stored("feature_importance"),
    "dedupe_keep_last": dedupe,
    "dedupe_null_sequence": dedupe_null_sequence,
    "date_range": lambda s, d: date_range(order_bars(s, d), "1996-01-01", "1998-06-30"),
    "tail_rows": lambda s, d: tail(order_bars(s, d), 7),
    "latest_row": lambda s, d: tail(order_bars(s, d), 1),
    "forward_fill": ffill_frame,
    "null_policy_drop": drop_null_rows,
    "null_policy_ffill_then_drop": ffill_then_drop,
    "value_map": value_map,
    "row_intersection": row_intersection,
    "missing_profile": profile,
    "full_outer_merge": merged_sources,
    "asof_join": asof_common,
    "asof_join_per_symbol": asof_per_symbol,
    "class_distribution": value_counts,
    "label_summary": return_summary,
}
