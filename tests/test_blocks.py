"""The blocked layout gives the same values as one group per series."""

import pandas as pd
import pytest
from pyspark.sql import functions as F

import tidebar.features  # noqa: F401
from tests.helpers import assert_same, walk_bars
from tidebar.features.builder import build_features, build_frame
from tidebar.operators.asof import asof_join
from tidebar.operators.folds import FoldPlan, class_weights
from tidebar.operators.frame import lay_out
from tidebar.operators.labels import add_labels
from tidebar.operators.pnl import pnl_metrics
from tidebar.operators.ranks import pct_rank
from tidebar.operators.scan import prefix_scan


@pytest.fixture(scope="module")
def bars(spark):
    pdf = pd.concat([walk_bars(1900, 1, "A"), walk_bars(420, 2, "B"), walk_bars(30, 3, "C")])
    return spark.createDataFrame(pdf).cache()


SMALL = {"block_rows": 256, "cell_rows": 32}


@pytest.mark.parametrize("sets", [
    ["volume"], ["flow", "market_structure"], ["onchain"], ["sentiment"], ["regime", "bear_volatility"],
    ["market_structure", "onchain", "lag_rolling"],
])
def test_feature_sets(bars, sets):
    one = build_frame(bars, sets)
    many = build_frame(bars, sets, **SMALL)
    assert not one.blocked and many.blocked
    assert_same(one.finish(), many.finish(), rtol=1e-8)


def test_technical_with_long_ema(spark):
    bars = spark.createDataFrame(pd.concat([walk_bars(9000, 5, "A", freq="h"), walk_bars(700, 6, "B", freq="h")]))
    one = build_frame(bars, ["technical"]).finish()
    many = build_frame(bars, ["technical"], block_rows=2048, cell_rows=512)
    assert many.blocked
    assert_same(one, many.finish(), rtol=1e-8, atol=1e-7)


def test_uneven_density(spark):
    """Most rows of a series inside one short time span."""
    dense = walk_bars(1500, 7, "A", start="2024-01-01", freq="s")
    sparse = walk_bars(200, 8, "A", start="2010-01-01", freq="D")
    bars = spark.createDataFrame(pd.concat([sparse, dense]))
    assert_same(build_frame(bars, ["volume"]).finish(), build_frame(bars, ["volume"], **SMALL).finish(), rtol=1e-8)


def test_null_policy(bars):
    one = build_features(bars, ["volume"])
    many = build_features(bars, ["volume"], **SMALL)
    assert_same(one, many, rtol=1e-8)


@pytest.mark.parametrize("strategy,params", [
    ("reversal", {"T": 14, "X": 0.02}), ("directional", {"T": 7, "X": 0.01}), ("return_sign", {"T": 7}),
    ("return_rate", {"T": 14}), ("triple_barrier", {"T": 14, "X": 0.01}),
    ("triple_barrier", {"T": 10, "dynamic_threshold": True, "sl_ratio": 0.5}),
])
def test_labels(bars, strategy, params):
    assert_same(add_labels(bars, strategy, **params), add_labels(bars, strategy, **SMALL, **params))


def test_running_aggregates(bars):
    def run(**kw):
        f = lay_out(bars, **kw)
        f = f.add({"gap": F.when(F.col("__rn") % 5 == 0, F.col("close"))})
        f = f.ffill(["gap"]).streak({"up": F.col("close") > F.col("open")})
        f = f.cumulative({"lo": ("min", "low"), "p": ("prod", F.col("close") / F.col("open"))})
        return f.expanding_mean({"em": "close"}).finish()

    assert_same(run(), run(**SMALL), rtol=1e-8)


def test_asof(spark, bars):
    src = spark.createDataFrame(walk_bars(300, 11, "A", extra=False)).select(
        "symbol", (F.col("ts") + F.expr("INTERVAL 100 DAYS")).alias("ts"),
        F.when(F.col("close") > 30000, F.col("close")).alias("level"),
    )
    assert_same(asof_join(bars, [src]), asof_join(bars, [src], block_rows=64))
    common = src.select("ts", "level")
    other = common.select("ts", F.col("level").alias("second")).filter(F.dayofweek("ts") != 1)
    both = asof_join(bars, [common, other], by=[], block_rows=64)
    assert_same(asof_join(bars, [common, other], by=[]), both)


def test_pnl_and_weights(bars):
    signals = bars.select(
        "symbol", "ts", (F.col("close") > 30000).cast("int").alias("y_true"),
        (F.col("open") > F.col("close")).cast("int").alias("y_pred"), ((F.col("high") - F.col("close")) / 30000 - 0.004).alias("ret"),
    )
    assert_same(pnl_metrics(signals), pnl_metrics(signals, **SMALL), keys=["symbol"], rtol=1e-8)
    labelled = signals.withColumn("label", F.col("y_pred"))
    plan = FoldPlan(100, 20, 10, 5)
    assert_same(class_weights(labelled, plan), class_weights(labelled, plan, **SMALL), keys=["symbol", "fold_id"])


def test_prefix_scan_two_levels(spark):
    df = spark.range(1000).select(F.lit("a").alias("k"), (F.col("id") * 3).alias("i"), F.col("id").alias("v"))
    out = prefix_scan(df, ["k"], "i", {"s": ("sum", F.col("v")), "l": ("last", F.when(F.col("v") % 7 == 0, F.col("v")))}, fan=64)
    pdf = out.toPandas().sort_values("i")
    v = pdf["v"]
    assert (pdf["s"].iloc[1:].values == v.cumsum().shift(1).iloc[1:].values).all()
    assert pd.isna(pdf["s"].iloc[0])
    assert (pdf["l"].iloc[1:].values == (v.where(v % 7 == 0).ffill().shift(1)).iloc[1:].values).all()


def test_pct_rank_ranges(spark, bars, monkeypatch):
    import tidebar.operators.ranks as ranks

    rounded = bars.withColumn("close", F.round("close", -1))
    whole = pct_rank(rounded, "close", "r")
    monkeypatch.setattr(ranks, "GROUP_ROWS", 64)
    parted = pct_rank(rounded, "close", "r")
    assert_same(whole, parted)
    pdf = rounded.toPandas()
    pdf["r"] = pdf.groupby("symbol")["close"].rank(pct=True)
    got = whole.toPandas().sort_values(["symbol", "ts"])["r"].values
    assert abs(got - pdf.sort_values(["symbol", "ts"])["r"].values).max() < 1e-12


def test_prefix_scan_of_sparse_indexes(spark):
    """A burst among far-apart entries: every level has groups of at most `fan` entries, and the prefix is right."""
    from pyspark.sql import functions as F

    from tidebar.operators.scan import prefix_scan

    index = [10**9 * k for k in range(40)] + [10**6 + k for k in range(60)]
    rows = [(s, i, float(i % 7), None if i % 3 else i) for s in ("A", "B") for i in sorted(set(index))]
    df = spark.createDataFrame(rows, "symbol string, idx long, v double, w long")
    specs = {"before": ("sum", F.col("v")), "most": ("max", F.col("v")), "last": ("last", F.col("w"))}
    got = {(r.symbol, r.idx): (r.before, r.most, r["last"]) for r in prefix_scan(df, ["symbol"], "idx", specs, fan=8).collect()}
    assert len(got) == len(rows)
    for s in ("A", "B"):
        total, most, last = None, None, None
        for _, i, v, w in [r for r in rows if r[0] == s]:
            assert got[s, i] == (total, most, last)
            total, most, last = (total or 0) + v, v if most is None else max(most, v), w if w is not None else last


def test_blocked_carries_read_their_input_in_line(spark):
    """Running values on top of running values: scans grow with their number, not with its power."""
    from pyspark.sql import functions as F

    from tests.helpers import walk_bars
    from tidebar.operators.frame import lay_out

    f = lay_out(spark.createDataFrame(walk_bars(300)), block_rows=64, cell_rows=16)
    counts = []
    for k in range(4):
        f = f.cumulative({f"s{k}": ("sum", F.col("close"))}, own_rows=True)
        plan = f.df._jdf.queryExecution().executedPlan().toString()
        counts.append(plan.count("Scan ExistingRDD"))
    steps = [b - a for a, b in zip(counts, counts[1:])]
    assert max(steps) <= 4, counts


@pytest.mark.parametrize("layout", [{}, {"block_rows": 256, "cell_rows": 32}, {"block_rows": 64, "cell_rows": 64}])
def test_exponential_means_with_nulls(spark, layout):
    """pandas' values: leading and inner nulls, long gaps, a series without values, and inputs that span many orders of magnitude."""
    import numpy as np

    rng, frames = np.random.default_rng(11), []
    for name, n, share in (("A", 1500, 0.0), ("B", 900, 0.4), ("C", 700, 0.97), ("D", 40, 1.0), ("E", 600, 0.1)):
        x = rng.normal(100, 10, n)
        x[rng.random(n) < share] = np.nan
        if name == "B":
            x[:70] = np.nan
        if name == "E":
            x = x * 10.0 ** np.linspace(30, -30, n)
        frames.append(pd.DataFrame({"symbol": name, "ts": pd.date_range("2020-01-01", periods=n, freq="h"), "x": x}))
    pdf = pd.concat(frames)
    rows = spark.createDataFrame(pdf).withColumn("x", F.when(~F.isnan("x"), F.col("x")))
    spans = {"e1": 1, "e2": 2, "e3": 3, "e30": 30, "e400": 400}
    f = lay_out(rows, lookback=40, **layout).ema({k: ("x", v) for k, v in spans.items()}).ema({"again": ("e30", 9)})
    assert f.blocked == bool(layout)
    got = f.finish().toPandas().sort_values(["symbol", "ts"]).reset_index(drop=True)
    assert set(got.columns) == {"symbol", "ts", "x", "again", *spans}
    groups = pdf.groupby("symbol")
    for k, v in spans.items():
        want = groups["x"].transform(lambda s: s.ewm(span=v, adjust=False).mean())
        np.testing.assert_allclose(got[k].astype(float), want.to_numpy(), rtol=1e-9, err_msg=k)
    pdf["e30"] = groups["x"].transform(lambda s: s.ewm(span=30, adjust=False).mean())
    want = pdf.groupby("symbol")["e30"].transform(lambda s: s.ewm(span=9, adjust=False).mean())
    np.testing.assert_allclose(got["again"].astype(float), want.to_numpy(), rtol=1e-9)


def test_asof_with_a_hot_time(spark):
    """A third of all rows at one time: same values, and no task has twice the rows of the median one."""
    import numpy as np

    rng = np.random.default_rng(2)
    times = pd.to_datetime("2024-01-01") + pd.to_timedelta(np.where(np.arange(6000) % 3 == 0, 500, rng.integers(0, 1000, 6000)), unit="m")
    left = pd.DataFrame({"symbol": np.where(np.arange(6000) % 5 < 4, "A", "B"), "ts": times, "row": np.arange(6000)})
    source = pd.DataFrame({"ts": pd.date_range("2024-01-01 00:07", periods=90, freq="11min"), "v": np.arange(90.0)})
    sources = pd.concat([source.assign(symbol="A"), source.assign(symbol="B", v=source.v + 1000)])
    df, right = spark.createDataFrame(left), spark.createDataFrame(sources)
    whole = asof_join(df, [right])
    kept = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        split = asof_join(df, [right], block_rows=64)
        loads = sorted(r["count"] for r in split.groupBy(F.spark_partition_id().alias("p")).count().collect())
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", kept)
    pick = lambda x: sorted(map(tuple, x.select("symbol", "ts", "row", F.coalesce("v", F.lit(-1.0))).collect()))
    assert pick(whole) == pick(split) and len(pick(split)) == 6000
    assert len(loads) == 8 and loads[-1] <= 2 * loads[4]
    merged = pd.merge_asof(left[left.symbol == "A"].sort_values("ts"), source, on="ts")
    assert sorted(merged.v.fillna(-1.0)) == sorted(r[3] for r in pick(split) if r[0] == "A")
    market = spark.createDataFrame(source)
    assert pick(asof_join(df, [market], by=[], block_rows=64)) == pick(asof_join(df, [market], by=[]))
