"""Classification metrics from confusion counts.

Predictions are reduced to (group, y_true, y_pred, n) with partial
aggregation; everything after that works on those few rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidebar.operators.folds import FoldPlan, tail_range, walk_forward_folds
from tidebar.operators.scan import prefix_scan
from tidebar.session import materialize

from tidebar.operators.ranks import row_ranks

c = F.col

METRICS = [
    "accuracy", "f1_macro", "f1_weighted", "f1_binary", "precision_macro",
    "precision_binary", "recall_macro", "recall_binary", "cohen_kappa",
]


def confusion_counts(preds: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    rows = preds.filter(c("y_true").isNotNull() & c("y_pred").isNotNull())
    return rows.groupBy(*by, "y_true", "y_pred").agg(F.count(F.lit(1)).alias("n"))


def confusion_matrix(preds: DataFrame, by: Sequence[str], classes: Sequence[int]) -> DataFrame:
    counts = confusion_counts(preds, by)
    wide = counts.groupBy(*by, "y_true").pivot("y_pred", list(classes)).agg(F.sum("n"))
    return wide.select(
        *by, "y_true", *[F.coalesce(c(str(k)), F.lit(0)).cast("long").alias(f"pred_{k}") for k in classes]
    )


def _safe(num: Column, den: Column) -> Column:
    return F.when(den == 0, F.lit(0.0)).otherwise(num / den)


def per_class(counts: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """precision, recall, f1, support of every class seen as truth or prediction."""
    sides = F.array(
        F.struct(
            c("y_true").alias("cls"), c("n").alias("support"), F.lit(0).cast("long").alias("predicted"),
            F.when(c("y_true") == c("y_pred"), c("n")).otherwise(F.lit(0)).alias("hit"),
        ),
        F.struct(
            c("y_pred").alias("cls"), F.lit(0).cast("long").alias("support"), c("n").alias("predicted"),
            F.lit(0).cast("long").alias("hit"),
        ),
    )
    flat = counts.select(*by, F.explode(sides).alias("s")).select(*by, "s.*")
    agg = flat.groupBy(*by, "cls").agg(*[F.sum(x).alias(x) for x in ("support", "predicted", "hit")])
    return agg.select(
        *by, "cls",
        _safe(c("hit"), c("predicted")).alias("precision"),
        _safe(c("hit"), c("support")).alias("recall"),
        _safe(2 * c("hit"), c("support") + c("predicted")).alias("f1"),
        "support", "predicted", "hit",
    )


def classification_report(preds: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return per_class(confusion_counts(preds, by), by).drop("predicted", "hit")


def metrics_from_counts(counts: DataFrame, by: Sequence[str] = (), names: Sequence[str] | None = None) -> DataFrame:
    """One row per group; binary metrics are null when the classes are not 0/1."""
    stats = per_class(counts, by)
    pos = lambda m: F.when(
        F.max(~c("cls").isin(0, 1)), F.lit(None)
    ).otherwise(F.coalesce(F.max(F.when(c("cls") == 1, c(m))), F.lit(0.0)))
    total = F.sum("support")
    agreed = F.sum("hit") / total
    chance = F.sum(c("support") * c("predicted").cast("double")) / (total.cast("double") * total)
    exprs = {
        "accuracy": agreed,
        "f1_macro": F.avg("f1"),
        "f1_weighted": F.sum(c("f1") * c("support")) / total,
        "f1_binary": pos("f1"),
        "precision_macro": F.avg("precision"),
        "precision_binary": pos("precision"),
        "recall_macro": F.avg("recall"),
        "recall_binary": pos("recall"),
        "cohen_kappa": F.when(chance < 1, 1 - (1 - agreed) / (1 - chance)),
    }
    chosen = [n for n in (names or METRICS) if n in exprs]  # unknown names are skipped
    return stats.groupBy(*by).agg(total.alias("n"), *[exprs[n].alias(n) for n in chosen])


def compute_metrics(preds: DataFrame, by: Sequence[str] = (), names: Sequence[str] | None = None) -> DataFrame:
    return metrics_from_counts(confusion_counts(preds, by), by, names)


def brier_score(proba: str, y: str) -> Column:
    """Aggregate: mean squared distance of probability and outcome."""
    return F.avg((c(proba) - c(y)) * (c(proba) - c(y)))


def brier(preds: DataFrame, by: Sequence[str], proba: str = "proba", y: str = "y_true") -> DataFrame:
    return preds.groupBy(*by).agg(brier_score(proba, y).alias("brier"))


def brier_improvement(before: Column, after: Column) -> Column:
    return (before - after) / (before + F.lit(1e-10))


# fixed values: candidate thresholds 0.20 .. 0.80 in steps of 0.01
THRESHOLDS = [k / 100 for k in range(20, 81)]
THRESHOLD_METRICS = ("f1", "kappa", "youden", "precision_recall", "f1_macro")


def threshold_table(
    scored: DataFrame, by: Sequence[str] = (), thresholds: Sequence[float] = THRESHOLDS,
    proba: str = "proba", y: str = "y_true",
) -> DataFrame:
    """tp, fp, tn, fn of every threshold per group.

    Each row is counted once under the number of thresholds it reaches; the
    counts at a threshold are sums over the higher bins (at most
    len(thresholds)+1 rows per group).  Rows are not repeated per threshold.
    """
    return table_of_bins(threshold_bins(scored, by, thresholds, proba, y), by, thresholds)


def threshold_bins(scored: DataFrame, by: Sequence[str], thresholds: Sequence[float], proba: str, y: str) -> DataFrame:
    """pos and neg rows of each group by the number of thresholds that they reach."""
    reached = sum(((c(proba) >= F.lit(t)).cast("int") for t in sorted(thresholds)), F.lit(0))
    rows = scored.filter(c(proba).isNotNull() & c(y).isNotNull())
    return rows.groupBy(*by, reached.alias("bin")).agg(
        F.sum((c(y) == 1).cast("long")).alias("pos"), F.sum((c(y) == 0).cast("long")).alias("neg")
    )


def table_of_bins(bins: DataFrame, by: Sequence[str], thresholds: Sequence[float]) -> DataFrame:
    """tp, fp, tn, fn of every threshold per group, from threshold_bins."""
    grid = sorted(thresholds)
    per_group = bins.groupBy(*by).agg(
        F.map_from_entries(F.collect_list(F.struct("bin", F.struct("pos", "neg")))).alias("bins"),
        F.sum("pos").alias("all_pos"), F.sum("neg").alias("all_neg"),
    )
    levels = F.array(*[F.struct(F.lit(i + 1).alias("i"), F.lit(t).alias("threshold")) for i, t in enumerate(grid)])
    above = lambda side: F.aggregate(
        F.filter(F.map_entries("bins"), lambda e: e["key"] >= c("level.i")),
        F.lit(0).cast("long"),
        lambda acc, e: acc + e["value"][side],
    )
    table = per_group.withColumn("level", F.explode(levels)).select(
        *by, c("level.threshold").alias("threshold"), above("pos").alias("tp"), above("neg").alias("fp"),
        "all_pos", "all_neg",
    )
    return table.select(
        *by, "threshold", "tp", "fp", (c("all_neg") - c("fp")).alias("tn"), (c("all_pos") - c("tp")).alias("fn")
    )


def tail_threshold_table(
    numbered: DataFrame, plan: FoldPlan, ratio: float = 0.15, least: int = 50, by: Sequence[str] = ("symbol",),
    thresholds: Sequence[float] = THRESHOLDS, proba: str = "proba", y: str = "y_true",
) -> DataFrame:
    """threshold_table of every fold's validation tail, for scores that do not depend on the fold; no row is copied.

    A row lies in the tails of the folds from ``lo`` to ``hi`` - 1. Rows are counted once by (lo, hi, bin); a count enters at lo and leaves
    at hi, and the running sum over the folds of a series is the count of each fold. Output grows with the folds alone.
    Tails without a usable row are left out.
    """
    rows = numbered.withColumns(dict(zip(("__lo", "__hi"), tail_range(plan, ratio, least)))).filter(c("__lo") < c("__hi"))
    counts = threshold_bins(rows, [*by, "__lo", "__hi"], thresholds, proba, y)
    enters = F.struct(c("__lo").alias("fold_id"), c("pos"), c("neg"))
    leaves = F.struct(c("__hi").alias("fold_id"), (-c("pos")).alias("pos"), (-c("neg")).alias("neg"))
    changes = counts.select(*by, "bin", F.inline(F.array(enters, leaves)))
    sizes = numbered.groupBy(*by).agg(F.max("n_rows").alias("n_rows"))
    folds = walk_forward_folds(sizes, plan).select(*by, "fold_id")
    every = counts.select(*by, "bin").distinct().join(folds, list(by))
    zero = F.lit(0).cast("long")
    keys = [*by, "bin", "fold_id"]
    summed = changes.unionByName(every.select(*by, "bin", "fold_id", zero.alias("pos"), zero.alias("neg"))).groupBy(*keys).agg(
        F.sum("pos").alias("pos"), F.sum("neg").alias("neg")
    )
    summed = materialize(summed)
    before = prefix_scan(summed, [*by, "bin"], "fold_id", {"__pos": ("sum", c("pos")), "__neg": ("sum", c("neg"))})
    upto = before.select(*keys, (c("pos") + F.coalesce("__pos", zero)).alias("pos"), (c("neg") + F.coalesce("__neg", zero)).alias("neg"))
    held = upto.join(folds, [*by, "fold_id"]).filter(c("pos") + c("neg") > 0)
    return table_of_bins(held, [*by, "fold_id"], thresholds)


def threshold_score(metric: str) -> Column:
    """Score of one confusion row (tp, fp, tn, fn)."""
    tp, fp, tn, fn = c("tp"), c("fp"), c("tn"), c("fn")
    f1 = _safe(2 * tp, 2 * tp + fp + fn)
    if metric in ("f1", "precision_recall"):
        return f1
    if metric == "f1_macro":
        return (f1 + _safe(2 * tn, 2 * tn + fp + fn)) / 2
    if metric == "youden":
        return _safe(tp, tp + fn) + _safe(tn, tn + fp) - 1
    if metric == "kappa":
        n = (tp + fp + tn + fn).cast("double")
        agreed = (tp + tn) / n
        chance = ((tp + fn) * (tp + fp).cast("double") + (tn + fp) * (tn + fn).cast("double")) / (n * n)
        return F.when(chance < 1, 1 - (1 - agreed) / (1 - chance))
    raise ValueError(f"unknown threshold metric '{metric}', use one of {THRESHOLD_METRICS}")


def best_thresholds(table: DataFrame, by: Sequence[str], goals: dict[str, tuple[str, float]]) -> DataFrame:
    """Best threshold per group for several goals, name -> (metric, least precision), in one pass."""
    best = []
    for name, (metric, least) in goals.items():
        usable = (c("tp") + c("fp") > 0) & (c("tn") + c("fn") > 0)
        if least > 0:
            usable = usable & (_safe(c("tp"), c("tp") + c("fp")) >= least)
        score = F.when(usable, threshold_score(metric))
        # largest score first, then the lowest threshold
        pair = F.when(score.isNotNull(), F.struct(score.alias("score"), (-c("threshold")).alias("t")))
        best.append(F.max(pair).alias(name))
    out = table.groupBy(*by).agg(*best)
    rows = F.array(*[F.struct(F.lit(n).alias("goal"), c(f"`{n}`").alias("b")) for n in goals])
    return out.select(*by, F.explode(rows).alias("r")).select(
        *by, "r.goal", F.coalesce(-c("r.b.t"), F.lit(0.5)).alias("best_threshold"), c("r.b.score").alias("best_score")
    )


def optimize_threshold(
    scored: DataFrame, by: Sequence[str] = (), metric: str = "f1", thresholds: Sequence[float] = THRESHOLDS,
    min_precision: float = 0.0, proba: str = "proba", y: str = "y_true",
) -> DataFrame:
    """Best threshold per group; the lowest wins ties, 0.5 when none is usable."""
    table = threshold_table(scored, by, thresholds, proba, y)
    return best_thresholds(table, by, {"best": (metric, min_precision)}).drop("goal")


def apply_threshold(proba: str | Column, threshold: str | float | Column) -> Column:
    p = c(proba) if isinstance(proba, str) else proba
    t = c(threshold) if isinstance(threshold, str) else threshold
    return (p >= t).cast("int")


def majority_baseline(preds: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Positive rate, accuracy of always guessing the larger class, and the lift over it."""
    out = preds.groupBy(*by).agg(
        F.avg(c("y_true").cast("double")).alias("pos_rate"),
        F.avg((c("y_true") == c("y_pred")).cast("double")).alias("accuracy"),
    )
    base = F.greatest(c("pos_rate"), 1 - c("pos_rate"))
    return out.select(*by, "pos_rate", "accuracy", base.alias("majority_acc"), (c("accuracy") - base).alias("acc_lift"))


def importance_rank(df: DataFrame, by: Sequence[str], top_n: int | None = None) -> DataFrame:
    """Rank features by importance with their share of the group's total."""
    totals = df.groupBy(*by).agg(F.sum("importance").alias("__total"))
    order = [c("importance").desc(), c("feature").asc()]
    if top_n:  # the limit is applied per task before the shuffle
        ranked = df.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
        ranked = ranked.filter(c("rank") <= top_n)
    else:
        ranked = row_ranks(df, by, order, "rank")
    return ranked.join(totals, list(by)).withColumn("share", c("importance") / c("__total")).drop("__total")
