"""Tables of experiment runs: registry maintenance, filters and comparisons."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

c = F.col

# fixed values: metrics compared, all better when higher
COMPARED = ["accuracy", "f1_macro", "precision_macro", "recall_macro", "cohen_kappa"]


def upsert(registry: DataFrame, updates: DataFrame, key: str = "experiment_id") -> DataFrame:
    """Rows of ``updates`` replace or extend the registry."""
    return registry.join(updates.select(key), key, "left_anti").unionByName(updates, allowMissingColumns=True)


def metric(name: str) -> Column:
    return c("aggregate_metrics")[name]


def filter_runs(
    registry: DataFrame, status: str | None = None, category: str | None = None, tags: Sequence[str] | None = None,
    name_contains: str | None = None, sort_by: str | None = None, ascending: bool = True, top_n: int | None = None,
) -> DataFrame:
    """Runs matching every condition, optionally sorted by a field or metric.

    Runs without the sort value come last.
    """
    if status:
        registry = registry.filter(c("status") == status)
    if category:
        registry = registry.filter(c("category") == category)
    if tags:
        wanted = F.array(*[F.lit(t) for t in tags])
        registry = registry.filter(F.size(F.array_except(wanted, c("tags"))) == 0)
    if name_contains:
        text = name_contains.lower()
        registry = registry.filter(
            F.lower("name").contains(text) | F.lower("experiment_id").contains(text)
        )
    if sort_by:
        value = c(sort_by) if sort_by in registry.columns else metric(sort_by)
        order = value.asc_nulls_last() if ascending else value.desc_nulls_last()
        registry = registry.orderBy(order, "experiment_id")
    return registry.limit(top_n) if top_n else registry


def best_run(registry: DataFrame, metric_name: str = "accuracy", status: str = "completed", higher: bool = True):
    return filter_runs(registry, status=status, sort_by=metric_name, ascending=not higher, top_n=1)


def delete_runs(registry: DataFrame, ids: DataFrame, key: str = "experiment_id") -> DataFrame:
    return registry.join(ids.select(key), key, "left_anti")


def cleanup_failed(registry: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(kept, removed)."""
    failed = F.coalesce(c("status") == "failed", F.lit(False))
    return registry.filter(~failed), registry.filter(failed)


def archive(
    registry: DataFrame, ids: Sequence[str] | None = None, before: str | None = None, status: str | None = None
) -> tuple[DataFrame, DataFrame]:
    """(kept, archived): any condition that is given sends a run to the archive."""
    hit = F.lit(False)
    if ids:
        hit = hit | c("experiment_id").isin(list(ids))
    if before:
        hit = hit | (c("created_at") < F.lit(before))
    if status:
        hit = hit | (c("status") == status)
    hit = F.coalesce(hit, F.lit(False))
    return registry.filter(~hit), registry.filter(hit)


def export_flat(registry: DataFrame, metrics: Sequence[str] | None = None, most: int = 1000) -> DataFrame:
    """Metrics as columns, tags joined by commas.

    Without a list, the metric names are read from the data (a distinct over
    map keys, merged on the map side); more than ``most`` of them are an error,
    for a table of that many columns should be asked for by name.
    """
    if metrics is None:
        keys = registry.select(F.explode(F.map_keys("aggregate_metrics")).alias("k")).distinct()
        metrics = sorted(r[0] for r in keys.limit(most + 1).collect())
        if len(metrics) > most:
            raise ValueError(f"more than {most} metric names; pass the list to export")
    plain = [x for x in registry.columns if x not in ("aggregate_metrics", "tags")]
    return registry.select(*plain, F.concat_ws(",", "tags").alias("tags"), *[metric(m).alias(m) for m in metrics])


def resolve_partial_id(registry: DataFrame, part: str) -> DataFrame:
    """The single run whose id contains ``part``; empty when none or several do."""
    hits = registry.filter(c("experiment_id").contains(part)).select("experiment_id")
    one = hits.agg(F.min("experiment_id").alias("experiment_id"), F.count(F.lit(1)).alias("n"))
    return one.filter(c("n") == 1).select("experiment_id")


def latest_per_prefix(registry: DataFrame, prefixes: Sequence[str]) -> DataFrame:
    """Run with the largest id for every name prefix."""
    pairs = F.array(*[F.lit(p) for p in prefixes])
    hits = F.filter(pairs, lambda p: c("experiment_id").startswith(p))
    return (
        registry.withColumn("prefix", F.explode(hits))
        .groupBy("prefix")
        .agg(F.max("experiment_id").alias("experiment_id"))
    )


def long_metrics(registry: DataFrame, names: Sequence[str] | None = None) -> DataFrame:
    """(experiment_id, metric, value) rows."""
    rows = registry.select("experiment_id", F.explode("aggregate_metrics").alias("metric", "value"))
    return rows.filter(c("metric").isin(list(names))) if names else rows


def compare_metrics(long: DataFrame, runs: Sequence[str]) -> DataFrame:
    """Metric x run table with the best run; for two runs also the difference."""
    wide = long.filter(c("experiment_id").isin(list(runs))).groupBy("metric").pivot(
        "experiment_id", list(runs)
    ).agg(F.first("value"))
    ranked = F.array_max(
        F.array(*[
            F.when(c(r).isNotNull(), F.struct(c(r).alias("v"), F.lit(-i).alias("i"), F.lit(r).alias("r")))
            for i, r in enumerate(runs)
        ])
    )
    out = wide.withColumn("best_run", ranked["r"])
    if len(runs) == 2:
        first, second = (F.coalesce(c(r), F.lit(0.0)) for r in runs)
        out = out.withColumn("delta", second - first)
    return out


def best_per_metric(long: DataFrame) -> DataFrame:
    """Best run of every metric over all runs (lowest id on ties)."""
    present = long.filter(c("value").isNotNull())
    top = present.groupBy("metric").agg(F.max("value").alias("best_value"))
    return (
        present.join(top, "metric").filter(c("value") == c("best_value"))
        .groupBy("metric", "best_value").agg(F.min("experiment_id").alias("best_run"))
    )


def config_diff(long_config: DataFrame, run: str | None = None) -> DataFrame:
    """(run, key, value) rows to one row per key with a same/different flag.

    With the run column's name, a key that some run lacks counts as different, as a value of N/A would.
    """
    value = F.coalesce("value", F.lit("N/A"))
    keys = long_config.groupBy("key").agg(
        (F.min(value) == F.max(value)).alias("same"),
        F.count(F.lit(1)).alias("n_runs"),
        *([F.count_distinct(run).alias("__runs")] if run else []),
    )
    if not run:
        return keys
    total = long_config.agg(F.count_distinct(run)).first()[0]
    return keys.select("key", (c("same") & (c("__runs") == F.lit(total))).alias("same"), "n_runs")


def fold_summary(folds: DataFrame, metrics: Sequence[str], by: Sequence[str] = ("run_id",)) -> DataFrame:
    """mean / std / min / max of every metric per run."""
    aggs = [F.count(F.lit(1)).alias("n_folds")]
    for m in metrics:
        aggs += [
            F.avg(m).alias(f"{m}_mean"), F.stddev_samp(m).alias(f"{m}_std"),
            F.min(m).alias(f"{m}_min"), F.max(m).alias(f"{m}_max"),
        ]
    return folds.groupBy(*by).agg(*aggs)


def top_features(importance: DataFrame, n: int = 20) -> DataFrame:
    """(run_id, features): names of the n most important features."""
    order = Window.partitionBy("run_id").orderBy(c("importance").desc(), "feature")
    top = importance.withColumn("__r", F.row_number().over(order)).filter(c("__r") <= n)
    return top.groupBy("run_id").agg(F.sort_array(F.collect_list("feature")).alias("features"))


def importance_overlap(pairs: DataFrame, tops: DataFrame) -> DataFrame:
    """Shared and exclusive top features and Jaccard similarity for pairs of runs."""
    left = tops.select(c("run_id").alias("run_a"), c("features").alias("__a"))
    right = tops.select(c("run_id").alias("run_b"), c("features").alias("__b"))
    both = pairs.join(left, "run_a").join(right, "run_b")
    union = F.size(F.array_union("__a", "__b"))
    return both.select(
        "run_a", "run_b",
        F.sort_array(F.array_intersect("__a", "__b")).alias("common"),
        F.sort_array(F.array_except("__a", "__b")).alias("only_a"),
        F.sort_array(F.array_except("__b", "__a")).alias("only_b"),
        F.when(union > 0, F.size(F.array_intersect("__a", "__b")) / union).alias("jaccard"),
    )


def parameter_grid(params: DataFrame, first: str = "T", second: str = "X", most: int = 10_000) -> DataFrame:
    """All combinations of the distinct values of two parameter columns.

    Each list is a search space that one driver works through, so more than ``most`` values are an error.
    """
    lists = []
    for name in (first, second):
        values = [r[0] for r in params.select(name).where(c(name).isNotNull()).distinct().limit(most + 1).collect()]
        if len(values) > most:
            raise ValueError(f"'{name}' has more than {most} values; that is no search space")
        lists.append(values)
    kinds = dict(params.dtypes)
    rows = params.sparkSession.createDataFrame([(v,) for v in lists[0]], f"{first} {kinds[first]}")
    return rows.withColumn(second, F.explode(F.array(*[F.lit(v) for v in lists[1]]).cast(f"array<{kinds[second]}>")))
