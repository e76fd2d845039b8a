"""The run table survives failed writes and concurrent ones."""

from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tidebar.plans.run_store import RunStore


def runs(spark, *rows):
    return spark.createDataFrame(list(rows), "experiment_id string, status string, score double")


def content(store):
    return {r.experiment_id: (r.status, r.score) for r in store.read().collect()}


def test_upsert_delete_archive_and_compact(spark, tmp_path):
    store, old = RunStore(spark, f"{tmp_path}/runs"), RunStore(spark, f"{tmp_path}/archive")
    assert store.read() is None and store.compact() is None and store.leftovers() == []
    store.upsert(runs(spark, ("a", "running", 0.1), ("b", "done", 0.2)))
    store.upsert(runs(spark, ("a", "done", 0.5), ("c", "failed", None)))
    assert content(store) == {"a": ("done", 0.5), "b": ("done", 0.2), "c": ("failed", None)}
    store.delete(runs(spark, ("b", "", 0.0), ("nobody", "", 0.0)))
    assert set(content(store)) == {"a", "c"}
    store.upsert(runs(spark, ("b", "again", 0.9)).withColumn("tags", F.array(F.lit("new"))))
    before = sorted(map(tuple, store.read().collect()))
    assert store.compact() and len(store.leftovers()) == 4 and store.commits().count() == 1
    assert sorted(map(tuple, store.read().collect())) == before
    store.archive(runs(spark, ("c", "", 0.0)), old)
    assert set(content(store)) == {"a", "b"} and content(old) == {"c": ("failed", None)}
    store.compact()
    assert set(content(store)) == {"a", "b"}


def test_a_write_that_fails_half_way_leaves_the_table(spark, tmp_path):
    store = RunStore(spark, str(tmp_path))
    store.upsert(runs(spark, ("a", "done", 0.5)))
    bad = spark.range(0, 1000, 1, 4).select(
        F.concat(F.lit("x"), "id").alias("experiment_id"), F.lit("new").alias("status"),
        F.when(F.col("id") < 900, 1.0).otherwise(F.raise_error(F.lit("lost")).cast("double")).alias("score"),
    )
    with pytest.raises(PySparkException, match="lost"):
        store.upsert(bad)
    assert content(store) == {"a": ("done", 0.5)}
    # files without a commit, as after a crash between the two, and a commit folder without its file
    store._write(runs(spark, ("a", "ghost", 0.0)).withColumns({"__number": F.lit(9).cast("long"), "__gone": F.lit(False)}))
    (tmp_path / "commits" / "begun" / "_temporary").mkdir(parents=True)
    assert content(store) == {"a": ("done", 0.5)}
    store.upsert(runs(spark, ("b", "done", 0.1)))
    assert set(content(store)) == {"a", "b"}


def test_writers_at_the_same_time(spark, tmp_path):
    store = RunStore(spark, str(tmp_path))
    store.upsert(runs(spark, ("shared", "first", 0.0)))

    def write(k):
        RunStore(spark, str(tmp_path)).upsert(runs(spark, (f"own{k}", "done", float(k)), ("shared", f"by{k}", float(k))))

    with ThreadPoolExecutor(max_workers=5) as pool:
        jobs = [pool.submit(write, k) for k in range(4)] + [pool.submit(store.compact)]
        for job in jobs:
            job.result()
    found = content(store)
    assert set(found) == {"shared", "own0", "own1", "own2", "own3"}
    assert found["shared"][0] == f"by{int(found['shared'][1])}"
    store.compact()
    assert content(store) == found
