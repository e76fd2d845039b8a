"""File helpers and sinks: CSV / JSON / parquet in and out, run artifacts by id."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    reader = spark.read.option("header", True)
    return (reader.schema(schema) if schema else reader.option("inferSchema", True)).csv(path)


def write_csv(df: DataFrame, path: str, mode: str = "error") -> None:
    df.write.mode(mode).option("header", True).csv(path)


def read_json(spark: SparkSession, path: str, schema: T.StructType | str | None = None, multiline=False) -> DataFrame:
    reader = spark.read.option("multiLine", multiline)
    return (reader.schema(schema) if schema else reader).json(path)


def write_json(df: DataFrame, path: str, mode: str = "error") -> None:
    df.write.mode(mode).json(path)


def read_optional_series(spark: SparkSession, path: str, ts: str = "date") -> DataFrame | None:
    """Outside series as CSV; None when the path does not exist, so its features are skipped."""
    try:
        rows = read_csv(spark, path)
    except AnalysisException as err:
        if err.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
    return rows.withColumn("ts", F.col(ts).cast("timestamp")).drop(*([ts] if ts != "ts" else []))


def write_predictions(preds: DataFrame, path: str, run_id: str) -> None:
    """Predictions with symbol, time and fold, one directory per run; a run that is written again replaces its own."""
    rows = preds.withColumn("run_id", F.lit(run_id)).write.option("partitionOverwriteMode", "dynamic")
    rows.mode("overwrite").partitionBy("run_id").parquet(path)


def write_run(root: str, run_id: str, metrics: DataFrame, folds: DataFrame, importance: DataFrame,
              preds: DataFrame, meta: DataFrame) -> None:
    """All tables of one run under ``root/run_id``."""
    base = f"{root}/{run_id}"
    write_json(metrics, f"{base}/metrics")
    write_json(meta, f"{base}/meta")
    write_csv(folds, f"{base}/fold_metrics")
    write_csv(importance.orderBy(F.col("importance").desc()), f"{base}/feature_importance")
    preds.write.parquet(f"{base}/predictions")


def load_runs(spark: SparkSession, root: str, table: str) -> DataFrame:
    """One table of all runs under ``root`` with the run id taken from the path."""
    path = f"{root}/*/{table}"
    if table in ("metrics", "meta"):
        df = spark.read.json(path)
    elif table == "predictions":
        df = spark.read.parquet(path)
    else:
        df = spark.read.option("header", True).option("inferSchema", True).csv(path)
    run = F.regexp_extract(F.input_file_name(), rf"([^/]+)/{table}/[^/]*$", 1)
    return df.withColumn("run_id", run)


def write_signals(signals: DataFrame, path: str, mode: str = "append") -> None:
    """Signal records as JSON, one directory per day."""
    signals.withColumn("day", F.to_date("ts")).write.mode(mode).partitionBy("day").json(path)
