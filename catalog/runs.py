"""Tables of runs derived from orders and line items: one run per order."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tidebar.operators.metrics import importance_rank
from tidebar.plans.run_store import RunStore
from tidebar.plans.runs import (
    archive,
    best_per_metric,
    best_run,
    cleanup_failed,
    compare_metrics,
    config_diff,
    delete_runs,
    export_flat,
    filter_runs,
    fold_summary,
    importance_overlap,
    latest_per_prefix,
    long_metrics,
    parameter_grid,
    resolve_partial_id,
    top_features,
    upsert,
)
from tidebar.session import ensure_checkpoint_dir
from tidebar.sources.bars import read_table

c = F.col


def registry(s, d):
    """Orders as registry entries with tags and a metrics map (some metrics missing)."""
    o = read_table(s, d, "orders")
    status = F.when(c("o_orderstatus") == "F", "completed").when(c("o_orderstatus") == "O", "failed").otherwise("running")
    metrics = F.map_from_arrays(
        F.array(*[F.lit(m) for m in ("accuracy", "f1_macro", "cohen_kappa")]),
        F.array(
            c("o_totalprice") / 500000,
            F.when(c("o_custkey") % 7 != 0, (c("o_custkey") % 100) / 100.0),
            (c("o_totalprice") - 250000) / 1000000,
        ),
    )
    return o.select(
        F.concat(F.lit("weekly_v"), (c("o_custkey") % 9).cast("string"), F.lit("_"), F.lpad(c("o_orderkey").cast("string"), 8, "0")).alias("experiment_id"),
        F.concat(F.lit("Weekly_"), c("o_orderpriority")).alias("name"),
        F.when(c("o_custkey") % 2 == 0, "weekly").otherwise("baseline").alias("category"),
        F.array_compact(F.array(
            F.lit("daily"), F.when(c("o_custkey") % 3 == 0, "fgi"), F.when(c("o_custkey") % 5 == 0, "macro")
        )).alias("tags"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("created_at"),
        status.alias("status"),
        (c("o_totalprice") / 1000).alias("duration_seconds"),
        metrics.alias("aggregate_metrics"),
    )


def flat(df):
    """Registry rows with tags joined and the metrics as columns."""
    return export_flat(df, ["accuracy", "cohen_kappa", "f1_macro"])


def updates(s, d):
    """Reruns: orders of one day as completed runs, and new ids."""
    r = registry(s, d)
    again = r.filter(c("created_at") < "1995-06-01").withColumn("status", F.lit("completed")).withColumn("duration_seconds", F.lit(1.0))
    new = r.filter(c("created_at") > "2001-06-01").withColumn("experiment_id", F.concat(F.lit("new_"), "experiment_id"))
    return again.unionByName(new)


def store(s, d):
    """The registry, its updates and deletions as batches on storage, merged and compacted."""
    table = RunStore(s, f"{ensure_checkpoint_dir(s)}/store-{uuid.uuid4().hex}")
    table.upsert(registry(s, d))
    table.upsert(updates(s, d))
    table.delete(registry(s, d).filter(c("created_at") < "1993-01-01"))
    table.compact()
    return flat(table.read())


def fold_table(s, d):
    return read_table(s, d, "lineitem").select(
        c("l_orderkey").alias("run_id"), c("l_linenumber").alias("fold_id"),
        (c("l_quantity") / 50).alias("accuracy"), (1 - c("l_discount")).alias("f1_macro"), (c("l_tax") - c("l_discount")).alias("cohen_kappa"),
    )


def importances(s, d):
    """Supplier as run, part group as feature, quantity as importance."""
    li = read_table(s, d, "lineitem")
    feature = F.concat(F.lit("f"), F.lpad((c("l_partkey") % 97).cast("string"), 2, "0"))
    return li.groupBy(c("l_suppkey").alias("run_id"), feature.alias("feature")).agg(F.sum("l_quantity").alias("importance"))


def overlap(s, d):
    """Each supplier's top features against its neighbour's."""
    tops = top_features(importances(s, d))
    pairs = tops.select(c("run_id").alias("run_a"), (c("run_id") + 1).alias("run_b"))
    out = importance_overlap(pairs, tops)
    return out.select("run_a", "run_b", *[F.concat_ws(",", x).alias(x) for x in ("common", "only_a", "only_b")], "jaccard")


def top_set(s, d):
    return top_features(importances(s, d), 15).select("run_id", F.concat_ws(",", "features").alias("features"))


def config_rows(s, d):
    """Settings of every run as (run, key, value)."""
    o = read_table(s, d, "orders")
    pairs = F.array(
        F.struct(F.lit("label.T").alias("key"), (c("o_custkey") % 3 * 7).cast("string").alias("value")),
        F.struct(F.lit("label.strategy").alias("key"), F.lit("reversal").alias("value")),
        F.struct(F.lit("model.type").alias("key"), c("o_orderstatus").alias("value")),
        F.struct(F.lit("model.max_depth").alias("key"), F.lit(None).cast("string").alias("value")),
    )
    return o.select(c("o_orderkey").alias("run"), F.explode(pairs).alias("p")).select("run", "p.key", "p.value")


def versions(s, d):
    """Latest run per version prefix, then metric by metric with the best version."""
    r = registry(s, d)
    prefixes = [f"weekly_v{k}" for k in range(9)]
    latest = latest_per_prefix(r, prefixes)
    rows = r.join(latest, "experiment_id")
    long = rows.select(c("prefix").alias("experiment_id"), F.explode("aggregate_metrics").alias("metric", "value"))
    return compare_metrics(long, prefixes)


def two_runs(s, d):
    """Mean metrics of two versions with their difference."""
    r = registry(s, d).withColumn("experiment_id", F.substring("experiment_id", 1, 9))
    long = long_metrics(r).groupBy("experiment_id", "metric").agg(F.avg("value").alias("value"))
    return compare_metrics(long, ["weekly_v1", "weekly_v2"])


def grid(s, d):
    """All label horizons (line numbers) by thresholds (discounts)."""
    li = read_table(s, d, "lineitem")
    return parameter_grid(li.select((c("l_linenumber") * 7).alias("T"), c("l_discount").alias("X")))


QUERIES = {
    "runs_upsert": lambda s, d: flat(upsert(registry(s, d), updates(s, d))),
    "runs_filter": lambda s, d: flat(filter_runs(registry(s, d), status="completed", category="weekly", tags=["daily", "fgi"], name_contains="LOW")),
    "runs_sorted_by_metric": lambda s, d: flat(filter_runs(registry(s, d), status="completed", sort_by="f1_macro", ascending=True, top_n=50)),
    "runs_sorted_by_field": lambda s, d: flat(filter_runs(registry(s, d), sort_by="duration_seconds", ascending=False, top_n=20)),
    "runs_best": lambda s, d: flat(best_run(registry(s, d), "cohen_kappa")),
    "runs_delete": lambda s, d: flat(delete_runs(registry(s, d), registry(s, d).filter(c("category") == "baseline"))),
    "runs_cleanup_failed": lambda s, d: flat(cleanup_failed(registry(s, d))[0]),
    "runs_archived": lambda s, d: flat(archive(registry(s, d), ids=["weekly_v1_00000005"], before="1996-01-01", status="running")[1]),
    "runs_kept": lambda s, d: flat(archive(registry(s, d), before="1996-01-01", status="running")[0]),
    "runs_export": lambda s, d: export_flat(registry(s, d)),
    "runs_resolve_partial_id": lambda s, d: resolve_partial_id(registry(s, d), "00000042"),
    "runs_latest_per_prefix": lambda s, d: latest_per_prefix(registry(s, d), ["weekly_v1", "weekly_v3", "weekly_v8"]),
    "runs_long_metrics": lambda s, d: long_metrics(registry(s, d), ["accuracy", "f1_macro"]),
    "runs_best_per_metric": lambda s, d: best_per_metric(long_metrics(registry(s, d))),
    "runs_compare_two": two_runs,
    "runs_version_table": versions,
    "runs_best_with_gaps": lambda s, d: flat(best_run(registry(s, d), "f1_macro")),
    "runs_config_diff": lambda s, d: config_diff(config_rows(s, d)),
    "runs_config_diff_absent": lambda s, d: config_diff(config_rows(s, d).where("key <> 'label.strategy' or run % 10 > 0"), "run"),
    "runs_fold_summary": lambda s, d: fold_summary(fold_table(s, d), ["accuracy", "f1_macro", "cohen_kappa"]),
    "importance_rank": lambda s, d: importance_rank(importances(s, d), ["run_id"]),
    "importance_top_n": lambda s, d: importance_rank(importances(s, d), ["run_id"], 15),
    "importance_top_sets": top_set,
    "importance_overlap": overlap,
    "parameter_grid": grid,
    "runs_store": store,
}
