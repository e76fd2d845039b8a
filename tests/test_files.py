import pandas as pd
import pytest
from pyspark.sql import functions as F

from tests.helpers import assert_same, walk_bars
from tidebar.operators.prepare import missing_profile
from tidebar.sources.bars import BAR_SCHEMA, read_bars
from tidebar.sources.files import (
    load_runs,
    read_csv,
    read_json,
    read_optional_series,
    write_csv,
    write_json,
    write_predictions,
    write_run,
    write_signals,
)
from tidebar.sources.landing import fear_greed, read_klines


def test_read_bars(spark, tmp_path):
    path = tmp_path / "bars.csv"
    path.write_text("date, Open ,HIGH,low,Close,volume\n2024-01-02,1,2,0.5,1.5,10\n2024-01-01,1,2,0.5,1.1,10\n2024-01-02,1,2,0.5,1.9,NaN\n")
    out = read_bars(spark, str(path), symbol="X").orderBy("ts").toPandas()
    assert out["close"].tolist() == [1.1, 1.9] and out["symbol"].unique().tolist() == ["X"]
    assert pd.isna(out["volume"][1])
    path.write_text("date,open,high,low,volume\n2024-01-02,1,2,0.5,10\n")
    with pytest.raises(ValueError, match="close"):
        read_bars(spark, str(path))


def test_bar_parquet_round_trip(spark, tmp_path):
    df = spark.createDataFrame(walk_bars(20)).select(*[F.col(f.name).cast(f.dataType) for f in BAR_SCHEMA])
    df.write.parquet(str(tmp_path / "b"))
    assert_same(read_bars(spark, str(tmp_path / "b"), "parquet", BAR_SCHEMA), df)


def test_klines(spark, tmp_path):
    path = tmp_path / "k.json"
    path.write_text('[1704067200000,"1.5","2","1","1.7","100",1704153599999,"170","12","0","0","0"]\n')
    row = read_klines(spark, str(path)).first()
    assert str(row["ts"]) == "2024-01-01 00:00:00" and row["close"] == 1.7 and row["trades"] == 12


def test_fear_greed_keeps_last(spark):
    raw = spark.createDataFrame([("86400", "10", "fear", 1), ("86400", "12", "fear", 2)], "timestamp string, value string, value_classification string, seq int")
    assert [r["fgi_value"] for r in fear_greed(raw).collect()] == [12]


def test_csv_json_and_optional(spark, tmp_path):
    df = spark.createDataFrame([("2024-01-01", 1.5)], "date string, v double")
    write_csv(df, str(tmp_path / "c"))
    write_json(df, str(tmp_path / "j"))
    assert read_csv(spark, str(tmp_path / "c")).first()["v"] == 1.5
    assert read_json(spark, str(tmp_path / "j")).first()["v"] == 1.5
    assert read_optional_series(spark, str(tmp_path / "none")) is None
    assert read_optional_series(spark, str(tmp_path / "c")).columns == ["v", "ts"]


def test_run_artifacts(spark, tmp_path):
    preds = spark.createDataFrame([("A", "2024-01-01", 0, 1, 0)], "symbol string, ts string, fold_id int, y_true int, y_pred int")
    for run in ("r1", "r2"):
        write_run(
            str(tmp_path / "runs"), run,
            spark.createDataFrame([(0.5,)], "accuracy double"), spark.createDataFrame([(0, 0.4), (1, 0.6)], "fold_id int, accuracy double"),
            spark.createDataFrame([("a", 1.0), ("b", 2.0)], "feature string, importance double"), preds,
            spark.createDataFrame([("completed",)], "status string"),
        )
    root = str(tmp_path / "runs")
    assert sorted(r["run_id"] for r in load_runs(spark, root, "metrics").collect()) == ["r1", "r2"]
    assert load_runs(spark, root, "fold_metrics").groupBy("run_id").count().count() == 2
    assert load_runs(spark, root, "feature_importance").columns == ["feature", "importance", "run_id"]
    assert load_runs(spark, root, "predictions").count() == 2
    write_predictions(preds, str(tmp_path / "p"), "r1")
    write_predictions(preds, str(tmp_path / "p"), "r2")
    assert spark.read.parquet(str(tmp_path / "p")).select("run_id").distinct().count() == 2
    signals = spark.createDataFrame([("A", "2024-01-01", "BULL", ["x", "y"])], "symbol string, ts string, signal_code string, risk_notes array<string>")
    write_signals(signals, str(tmp_path / "s"))
    assert spark.read.json(str(tmp_path / "s")).first()["risk_notes"] == ["x", "y"]


def test_missing_profile(spark):
    df = spark.createDataFrame([(1, 1.0, None), (2, None, None)], "ts int, a double, b string")
    got = {r["column"]: r["missing_rate"] for r in missing_profile(df).collect()}
    assert got == {"a": 0.5, "b": 1.0}
