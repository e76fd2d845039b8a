"""Walk-forward folds over row numbers.

Folds are arithmetic on (row number, series length): the test folds of a row
are a short range of ids, the training rows of a fold are a prefix.  Nothing
joins rows with folds, and training rows are never copied per fold.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidebar.operators.frame import BLOCK_ROWS, CELL_ROWS, lay_out
from tidebar.operators.scan import FAN

c = F.col


@dataclass(frozen=True)
class FoldPlan:
    """First training size, test window, step, and rows purged before each test."""

    init_train: int = 1500
    oos_window: int = 63
    step: int = 21
    purge_gap: int = 0

    def count(self, n: Column) -> Column:
        """Folds whose whole test window fits into n rows."""
        room = n - F.lit(self.init_train + self.oos_window)
        return F.when(room >= 0, F.floor(room / F.lit(self.step)) + 1).otherwise(F.lit(0)).cast("long")


def series_sizes(df: DataFrame, by: Sequence[str] = ("symbol",)) -> DataFrame:
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n_rows"))


def walk_forward_folds(sizes: DataFrame, plan: FoldPlan) -> DataFrame:
    """Fold table per series: half-open row ranges and the effective training size."""
    # two short explodes, so that no array grows with the series
    n, fan = plan.count(c("n_rows")), F.lit(FAN).cast("long")
    upper = F.when(n > 0, F.sequence(F.lit(0).cast("long"), F.floor((n - 1) / fan)))
    folds = sizes.withColumn("__upper", F.explode(upper))
    first = c("__upper") * fan
    folds = folds.withColumn("fold_id", F.explode(F.sequence(first, F.least(first + fan - 1, n - 1))))
    end = F.lit(plan.init_train) + c("fold_id") * F.lit(plan.step)
    return folds.select(
        *[x for x in sizes.columns if x != "n_rows"],
        "fold_id",
        F.lit(0).cast("long").alias("train_start"),
        end.alias("train_end"),
        end.alias("test_start"),
        (end + F.lit(plan.oos_window)).alias("test_end"),
        (end - F.lit(plan.purge_gap)).alias("train_size"),
    ).filter(c("train_size") > 0)


expanding_folds = walk_forward_folds


def check_folds(sizes: DataFrame, plan: FoldPlan) -> None:
    """Raise for series too short for the plan, as a single-series run would."""
    short = sizes.filter(plan.count(c("n_rows")) == 0).limit(5).collect()
    if short:
        raise ValueError(f"series too short for init_train={plan.init_train}, oos={plan.oos_window}: {short}")


def number_rows(
    df: DataFrame, by: Sequence[str] = ("symbol",), ts: str = "ts",
    block_rows: int = BLOCK_ROWS, cell_rows: int = CELL_ROWS,
) -> DataFrame:
    """Add ``row_idx`` (0-based position in the series) and ``n_rows``."""
    numbered = lay_out(df, by, ts, block_rows=block_rows, cell_rows=cell_rows).finish(keep_row_number="row_idx")
    return numbered.join(series_sizes(numbered, by), list(by))


def number_times(
    df: DataFrame, ts: str = "ts", block_rows: int = BLOCK_ROWS, cell_rows: int = CELL_ROWS
) -> DataFrame:
    """Add ``row_idx`` (position of the row's time among all distinct times of df) and ``n_rows`` (their number).

    Folds cut on these positions are cut on the calendar, so a model trained on many series never sees rows after the
    first test time, whatever dates the series have. For one series they are its row numbers.
    """
    times = df.select(ts).distinct().withColumn("everything", F.lit(0))
    numbered = number_rows(times, ["everything"], ts, block_rows, cell_rows).drop("everything")
    return df.drop("row_idx", "n_rows").join(numbered, ts)


def assign_test_folds(numbered: DataFrame, plan: FoldPlan) -> DataFrame:
    """One row per (row, fold that tests it); overlapping folds repeat a row."""
    behind = c("row_idx") - F.lit(plan.init_train)
    lo = F.greatest(F.floor((behind - F.lit(plan.oos_window)) / F.lit(plan.step)) + 1, F.lit(0))
    hi = F.least(F.floor(behind / F.lit(plan.step)), plan.count(c("n_rows")) - 1)
    train = F.lit(plan.init_train - plan.purge_gap) + c("fold_id") * F.lit(plan.step)
    ids = F.when(hi >= lo, F.sequence(lo.cast("long"), hi.cast("long")))
    return numbered.withColumn("fold_id", F.explode(ids)).filter(train > 0)


def train_end(plan: FoldPlan, fold_id: int) -> int:
    """First row index not used for training (after the purge)."""
    return plan.init_train + fold_id * plan.step - plan.purge_gap


def in_validation_tail(plan: FoldPlan, ratio: float = 0.15, least: int = 50) -> Column:
    """Is the row in the last max(ratio, least) training rows of its ``fold_id``."""
    size = F.lit(plan.init_train - plan.purge_gap) + c("fold_id") * F.lit(plan.step)
    start = size - F.greatest(F.floor(size * F.lit(ratio)), F.lit(least))
    return (c("row_idx") >= start) & (c("row_idx") < size)


def tail_range(plan: FoldPlan, ratio: float = 0.15, least: int = 50) -> tuple[Column, Column]:
    """First fold, and first fold no more, whose validation tail holds the row (``row_idx`` of ``n_rows``).

    Tails begin and end later from fold to fold, so the folds of a row are a range. Its end follows from the largest training size
    whose tail still reaches back to the row, put right by a step where rounding went astray.
    """
    base, step = plan.init_train - plan.purge_gap, F.lit(plan.step)
    row = c("row_idx")

    def reached(fold: Column) -> Column:
        size = F.lit(base) + fold * step
        return size - F.greatest(F.floor(size * F.lit(ratio)), F.lit(least)) <= row

    first = F.greatest(F.floor((row - F.lit(base)) / step) + 1, F.lit(-base // plan.step + 1 if base <= 0 else 0))
    size = F.greatest(F.floor(row / F.lit(1.0 - ratio)), row + F.lit(least))
    near = F.floor((size - F.lit(base)) / step)
    last = F.when(reached(near + 1), near + 1).when(reached(near), near).otherwise(near - 1)
    return first.cast("long"), (F.least(last, plan.count(c("n_rows")) - 1) + 1).cast("long")


def validation_tail(numbered: DataFrame, plan: FoldPlan, ratio: float = 0.15, least: int = 50) -> DataFrame:
    """Rows of every fold's validation tail.

    The tail starts are increasing in the fold id, so the folds of a row are a
    range: a bounded over-estimate is exploded and then filtered exactly.
    """
    last = plan.count(c("n_rows")) - 1
    base = F.lit(plan.init_train - plan.purge_gap)
    lo = F.greatest(F.floor((c("row_idx") - base) / F.lit(plan.step)), F.lit(0))
    # row >= size * (1 - ratio) or row >= size - least  =>  size <= max(row + 1)/(1 - ratio), row + least
    reach = F.greatest((c("row_idx") + 1) / F.lit(1.0 - ratio), (c("row_idx") + F.lit(least)).cast("double"))
    hi = F.least(F.floor((reach - base) / F.lit(plan.step)) + 1, last)
    ids = F.when(hi >= lo, F.sequence(lo.cast("long"), hi.cast("long")))
    return numbered.withColumn("fold_id", F.explode(ids)).filter(in_validation_tail(plan, ratio, least))


def inner_time_splits(sizes: DataFrame, k: int) -> DataFrame:
    """k expanding inner splits; the last k of k+1 equal parts are validated in turn."""
    part = F.floor(c("n_rows") / F.lit(k + 1))
    start = c("n_rows") - (F.lit(k) - c("split_id")) * part
    return sizes.withColumn("split_id", F.explode(F.sequence(F.lit(0), F.lit(k - 1)))).select(
        *[x for x in sizes.columns if x != "n_rows"],
        "split_id",
        start.cast("long").alias("valid_start"),
        (start + part).cast("long").alias("valid_end"),
    )


def class_weights(labelled: DataFrame, plan: FoldPlan, label: str = "label", by: Sequence[str] = ("symbol",),
                  ts: str = "ts", block_rows: int = BLOCK_ROWS, cell_rows: int = CELL_ROWS) -> DataFrame:
    """Negatives, positives and their quotient in the training rows of each fold.

    Running class counts are read at the row before each training end.
    """
    f = lay_out(labelled, by, ts, block_rows=block_rows, cell_rows=cell_rows)
    f = f.cumulative(
        {
            "n_pos": ("sum", (c(label) == 1).cast("long")),
            "n_neg": ("sum", (c(label) == 0).cast("long")),
        }
    )
    at = f.finish(keep_row_number="row_idx").join(series_sizes(labelled, by), list(by))
    offset = c("row_idx") + 1 - F.lit(plan.init_train - plan.purge_gap)
    fold = (offset / F.lit(plan.step)).cast("long")
    at = at.filter((offset >= 0) & (offset % F.lit(plan.step) == 0)).withColumn("fold_id", fold)
    at = at.filter(c("fold_id") < plan.count(c("n_rows")))
    weight = F.when((c("n_pos") > 0) & (c("n_neg") > 0), c("n_neg") / c("n_pos"))
    return at.select(*by, "fold_id", "n_neg", "n_pos", weight.alias("pos_weight"))


def regime_weight(value: str | Column, weights: dict[str, float]) -> Column:
    """Sample weight by the sign of a regime column."""
    v = c(value) if isinstance(value, str) else value
    return (
        F.when(v > 0, F.lit(float(weights.get("bull", 1.0))))
        .when(v < 0, F.lit(float(weights.get("bear", 1.0))))
        .when(v == 0, F.lit(float(weights.get("sideways", 1.0))))
        .otherwise(F.lit(1.0))
    )
