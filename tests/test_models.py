import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tests.helpers import walk_bars
from tidebar.models import create_model, list_models
from tidebar.models.boosting import Task, cut_points, train
from tidebar.models.calibration import calibrated
from tidebar.models.store import load_model, save_model
from tidebar.operators.folds import FoldPlan
from tidebar.plans.walk_forward import (
    Experiment, fold_bounds, latest_rows, parameter_search, prepare, run_experiment, score_latest, walk_forward,
)

FAST = {"n_estimators": 3, "max_depth": 2, "learning_rate": 0.3, "min_child_samples": 5}


def matrix(spark, n=400, classes=2, seed=0):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 4))
    y = (x[:, 0] + rng.normal(size=n) * 0.3 > 0).astype(int) if classes == 2 else rng.integers(0, classes, n)
    pdf = pd.DataFrame(x, columns=list("abcd"))
    pdf["label"], pdf["row_idx"], pdf["symbol"] = y, np.arange(n), "A"
    return spark.createDataFrame(pdf)


def test_registry():
    assert {"boosted_trees", "boosted_trees_regressor", "stacking"} <= set(list_models())
    with pytest.raises(KeyError, match="available"):
        create_model("nope")


@pytest.mark.parametrize("classes", [2, 3])
def test_tree_classifier(spark, classes):
    df = matrix(spark, classes=classes)
    fitted = create_model("boosted_trees", FAST).fit(df, list("abcd"))
    out = fitted.score(df).toPandas()
    assert len(out) == 400 and set(out["y_pred"]) <= set(range(classes))
    assert all(len(p) == classes and abs(sum(p) - 1) < 1e-6 for p in out["probs"])
    assert len(fitted.importance()) == 4
    if classes == 2:
        assert (out["y_pred"] == out["label"]).mean() > 0.8


def test_weight_is_optional_everywhere(spark):
    df = matrix(spark).withColumn("w", F.when(F.col("label") == 1, 2.0).otherwise(1.0))
    stack = {"base_models": [{"name": "x", "params": FAST}], "n_cv_folds": 2}
    for name, params in (("boosted_trees", FAST), ("boosted_trees_regressor", FAST), ("stacking", stack)):
        for weight in (None, "w"):
            out = create_model(name, params).fit(df, list("abcd"), weight).score(df)
            assert out.filter(F.col("proba").between(0, 1)).count() == 400


def test_saved_models_score_the_same(spark, tmp_path):
    df = matrix(spark)
    stack = {"base_models": [{"name": "x", "params": FAST}], "n_cv_folds": 2, "passthrough": True}
    for name, params in (("boosted_trees", FAST), ("boosted_trees_regressor", FAST), ("stacking", stack)):
        fitted = create_model(name, params).fit(df, list("abcd"))
        save_model(spark, fitted, str(tmp_path / name))
        again = load_model(spark, str(tmp_path / name))
        pick = lambda m: [round(r["proba"], 9) for r in m.score(df).orderBy("row_idx").collect()]
        assert again.features == list("abcd") and pick(fitted) == pick(again)


def test_regressor_threshold(spark):
    fitted = create_model("boosted_trees_regressor", {**FAST, "auto_threshold": True}).fit(matrix(spark), list("abcd"))
    out = fitted.score(matrix(spark)).toPandas()
    assert 0.2 <= fitted.threshold <= 0.8
    assert (out["y_pred"] == (out["proba"] >= fitted.threshold).astype(int)).all()


def test_calibration(spark):
    model, df = create_model("boosted_trees", FAST), matrix(spark, 600)
    for method in ("platt", "isotonic"):
        out = calibrated(model, df, list("abcd"), method).score(df).toPandas()
        assert out["proba"].between(0, 1).all() and (out["y_pred"] == out["label"]).mean() > 0.8
    with pytest.raises(ValueError, match="calibration"):
        calibrated(model, df, list("abcd"), "sigmoid-ish")


def test_walk_forward_run(spark):
    bars = spark.createDataFrame(pd.concat([walk_bars(330, 1, "A"), walk_bars(290, 2, "B")]))
    exp = Experiment(
        ["volume"], label_params={"T": 5, "X": 0.01}, label_map={0: 0, 1: 0, 2: 1}, plan=FoldPlan(150, 40, 30, 5),
        model_params=FAST, top_n=6, threshold_optimize=True,
    )
    rows = prepare(bars, exp)
    assert rows.filter("label is null").count() == 0
    result = run_experiment(bars, exp)
    assert len(result.features) == 6
    preds = result.predictions.toPandas()
    folds = (rows.select("ts").distinct().count() - 150 - 40) // 30 + 1
    # the longer series fills each window, the other gives what rows it has there
    sizes = preds.groupby(["symbol", "fold_id"]).size()
    assert sizes["A"].eq(40).all() and sizes["B"].le(40).all() and len(sizes["A"]) == folds
    known = rows.select("symbol", "ts", "row_idx").toPandas()
    tested = known[(known.row_idx >= 150) & (known.row_idx < 150 + 30 * (folds - 1) + 40)]
    assert preds[["symbol", "ts"]].drop_duplicates().shape[0] == len(tested)
    assert result.fold_metrics().count() == folds
    assert result.pooled_metrics(once=True).first()["n"] == preds.groupby(["symbol", "ts"]).ngroups
    search = parameter_search(bars, exp, [5, 400], [0.01]).toPandas()
    assert search["status"][0] == "ok" and search["status"][1] != "ok" and len(search) == 2
    with pytest.raises(ValueError, match="no fold fits"):
        walk_forward(rows, result.features, Experiment(["volume"], plan=FoldPlan(5000)))


def test_folds_of_series_with_other_dates(spark):
    """No fold trains on the future, short and late series keep their history, and sizes are those of the rows."""
    bars = pd.concat([walk_bars(260, 1, "OLD", "2020-01-01"), walk_bars(260, 2, "NEW", "2020-09-01"), walk_bars(60, 3, "SHORT", "2020-10-01")])
    plan = FoldPlan(200, 30, 30, 7)
    exp = Experiment(["volume"], label_params={"T": 5, "X": 0.01}, label_map={0: 0, 1: 0, 2: 1}, plan=plan, model_params=FAST)
    rows = prepare(spark.createDataFrame(bars), exp)
    known = rows.select("symbol", "ts", "row_idx", "n_rows").toPandas()
    assert set(known.symbol) == {"OLD", "NEW", "SHORT"}
    assert (known.sort_values("ts").row_idx.diff().dropna() >= 0).all() and known.n_rows.nunique() == 1
    bounds = {r.fold_id: r for r in fold_bounds(rows, plan).collect()}
    assert len(bounds) == (known.n_rows.max() - 230) // 30 + 1
    for k, r in bounds.items():
        train = known[known.row_idx < 200 + 30 * k - 7]
        test = known[(known.row_idx >= 200 + 30 * k) & (known.row_idx < 230 + 30 * k)]
        assert r.last_train_ts == train.ts.max() < test.ts.min() == r.first_test_ts
        assert (r.train_size, r.test_size) == (len(train), len(test))
    result = walk_forward(rows, ["vol_sma_50", "obv"], exp)
    assert [(i["train_size"], i["test_size"]) for i in result.folds] == [(b.train_size, b.test_size) for _, b in sorted(bounds.items())]


def test_newest_bars_are_scored_without_labels(spark):
    bars = spark.createDataFrame(pd.concat([walk_bars(120, 1, "A"), walk_bars(90, 2, "B"), walk_bars(10, 3, "C")]))
    exp = Experiment(["volume"], label_params={"T": 5, "X": 0.01}, label_map={0: 0, 1: 0, 2: 1})
    fitted = create_model("boosted_trees", FAST).fit(prepare(bars, exp), ["vol_sma_50", "obv"])
    got = {r.symbol: r for r in score_latest(latest_rows(bars, exp), {"p": fitted}).collect()}
    newest = {r.symbol: r.ts for r in bars.groupBy("symbol").agg(F.max("ts").alias("ts")).collect()}
    assert {s: r.ts for s, r in got.items()} == newest
    assert 0 <= got["A"].p <= 1 and got["C"].p is None


def test_early_stopping_and_unknown_parameters(spark):
    df = matrix(spark, 300)
    stop = {**FAST, "early_stopping_rounds": 5}
    assert create_model("boosted_trees", stop).fit(df, list("abcd")).score(df).count() == 300
    with pytest.raises(ValueError, match="holds out"):
        create_model("boosted_trees", {**stop, "validation_least": 400}).fit(df, list("abcd"))
    with pytest.raises(ValueError, match="counterpart"):
        create_model("boosted_trees", {**FAST, "linear_tree": True}).fit(df, list("abcd"))


def test_three_classes_learn(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(600, 4))
    pdf = pd.DataFrame(x, columns=list("abcd"))
    pdf["label"], pdf["row_idx"] = np.digitize(x[:, 0] + 0.3 * x[:, 1], [-0.5, 0.5]), np.arange(600)
    df = spark.createDataFrame(pdf)
    outs = []
    for rate in (0.01, 0.3):
        fitted = create_model("boosted_trees", {**FAST, "n_estimators": 12, "max_depth": 3, "learning_rate": rate}).fit(df.filter("row_idx < 450"), list("abcd"))
        out = fitted.score(df.filter("row_idx >= 450")).toPandas()
        assert all(abs(sum(p) - 1) < 1e-9 and len(p) == 3 for p in out["probs"])
        assert (out["y_pred"] == [int(np.argmax(p)) for p in out["probs"]]).all()
        assert len(fitted.stages["booster"].trees) == 3
        outs.append(out)
    assert (outs[1]["y_pred"] == outs[1]["label"]).mean() > 0.8
    sure = [np.mean([max(p) for p in out["probs"]]) for out in outs]
    assert sure[1] > sure[0] + 0.2


def test_rounds_of_early_stopping(spark):
    df = matrix(spark, 500)
    kept = []
    for rounds in (1, 15):
        params = {"n_estimators": 40, "max_depth": 3, "learning_rate": 0.7, "min_child_samples": 5, "early_stopping_rounds": rounds}
        booster = create_model("boosted_trees", params).fit(df, list("abcd")).stages["booster"]
        best = int(np.argmin(booster.losses))
        assert booster.rounds == best + 1 and len(booster.losses) in (best + 1 + rounds, 40)
        kept.append(len(booster.losses))
    assert kept[0] < kept[1]


def test_tasks_see_their_own_times_alone(spark):
    """What comes after a task's end, or lies in its gap, changes neither its trees nor its cut points."""
    df = matrix(spark, 400)
    tasks = [Task(end=200, params=FAST), Task(end=300, params=FAST), Task(end=400, skip=(100, 220), params=FAST)]
    later = F.col("row_idx") >= 200
    other = df.withColumn("label", F.when(later, 1 - F.col("label")).otherwise(F.col("label"))).withColumn("a", F.when(later, F.col("b") * 9).otherwise(F.col("a")))
    one, two = train(df, list("abcd"), tasks), train(other, list("abcd"), tasks)
    assert one[0].trees == two[0].trees and one[0].base == two[0].base and one[1].trees != two[1].trees
    gap = (F.col("row_idx") >= 100) & (F.col("row_idx") < 220)
    third = train(df.withColumn("label", F.when(gap, 1 - F.col("label")).otherwise(F.col("label"))), list("abcd"), tasks)
    assert third[2].trees == one[2].trees and third[0].trees != one[0].trees


def test_limits_of_trees(spark):
    df = matrix(spark, 400)
    base = {"n_estimators": 2, "max_depth": 5, "min_child_samples": 5}
    leaves = lambda b: [sum(1 for i, f in enumerate(feature) if f < 0 and (i == 0 or feature[(i - 1) // 2] >= 0)) for feature, _, _ in b.trees[0]]
    small, large = train(df, list("abcd"), [Task(params={**base, "num_leaves": 4}), Task(params={**base, "num_leaves": 31})])
    assert max(leaves(small)) <= 4 < max(leaves(large)) <= 31
    plain, strict = train(df, list("abcd"), [Task(params={**base, "reg_alpha": 0.0, "reg_lambda": 0.0}), Task(params={**base, "reg_alpha": 5.0, "reg_lambda": 50.0})])
    size = lambda b: max(abs(v) for _, _, value in b.trees[0] for v in value)
    assert size(strict) < 0.6 * size(plain)
    with pytest.raises(ValueError, match="levels"):
        train(df, list("abcd"), [Task(params={"max_depth": 20})])


def test_histograms_give_the_best_split(spark):
    """The first split of a value tree against every cut tried by hand."""
    df = matrix(spark, 300)
    pdf = df.orderBy("row_idx").toPandas()
    params = {"n_estimators": 1, "max_depth": 1, "min_child_samples": 20, "subsample": 1.0, "colsample_bytree": 1.0, "reg_alpha": 0.0, "reg_lambda": 0.0, "learning_rate": 1.0}
    df = df.repartition(5)
    found = train(df, list("abcd"), [Task(params=params)], "value")[0]
    feature, cut, value = found.trees[0][0]
    cuts, _ = cut_points(df, list("abcd"), "row_idx", [Task()])
    y, best = pdf["label"].to_numpy(float), None
    for name, values in zip("abcd", cuts):
        assert len(values) > 20
        for v in values:
            left = pdf[name].to_numpy() <= v
            if 20 <= left.sum() <= 280:
                cost = ((y[left] - y[left].mean()) ** 2).sum() + ((y[~left] - y[~left].mean()) ** 2).sum()
                best = min(best, (cost, name, v)) if best else (cost, name, v)
    assert ("abcd"[feature[0]], cut[0]) == best[1:]
    left = pdf[best[1]].to_numpy() <= best[2]
    assert abs(found.base[0] + value[1] - y[left].mean()) < 1e-4 and abs(found.base[0] + value[2] - y[~left].mean()) < 1e-4
