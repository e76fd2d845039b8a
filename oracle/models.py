"""Comparison SQL of what is certain about trained models: rows, times and folds."""

from oracle.build import BARS, Layers

# technical features are complete from row WARM_UP on; labels look 14 rows ahead
WARM_UP, AHEAD = 200, 14
MODELS = ("classes", "regression", "stacking", "calibrated", "three_classes")

NUMBERED = ("numbered", "SELECT symbol, ts, row_number() OVER (PARTITION BY symbol ORDER BY ts) AS rn, count(*) OVER (PARTITION BY symbol) AS n FROM bars")
COMPLETE = ("complete", f"SELECT symbol, ts, dense_rank() OVER (ORDER BY ts) - 1 AS row_idx FROM numbered WHERE rn >= {WARM_UP} AND rn <= n - {AHEAD}")


def sql() -> dict[str, str]:
    out = {}
    q = Layers("k", [BARS, ("k", "SELECT symbol, max(ts) AS ts, 1 AS well_formed FROM bars GROUP BY 1")])
    out["latest_signal_keys"] = q.out(["symbol", "ts", "well_formed"], [])
    names = ", ".join(f"('{m}')" for m in MODELS)
    tested = (
        "tested", "SELECT symbol, count(*) AS n_test FROM complete WHERE row_idx >= 0.8 * (SELECT count(DISTINCT ts) FROM complete) GROUP BY 1"
    )
    q = Layers("k", [BARS, NUMBERED, COMPLETE, tested, ("k", f"SELECT symbol, n_test, 1 AS well_formed, model FROM tested, (VALUES {names}) AS m(model)")])
    out["model_checks"] = q.out(["symbol", "n_test", "well_formed", "model"], [])
    folds = (
        "folds", "SELECT unnest(range((count(DISTINCT ts) - 1000 - 63) // 21 + 1)) AS fold_id FROM complete"
    )
    cut = (
        "cut", "SELECT fold_id, max(ts) FILTER (row_idx < 986 + 21 * fold_id) AS last_train_ts, min(ts) FILTER (row_idx >= 1000 + 21 * fold_id) AS first_test_ts, "
        "count(*) FILTER (row_idx < 986 + 21 * fold_id) AS train_size, "
        "count(*) FILTER (row_idx >= 1000 + 21 * fold_id AND row_idx < 1063 + 21 * fold_id) AS test_size FROM complete, folds GROUP BY 1"
    )
    q = Layers("cut", [BARS, NUMBERED, COMPLETE, folds, cut])
    out["walk_forward_no_future"] = q.out(["fold_id", "last_train_ts", "first_test_ts", "train_size", "test_size"], [])
    fits = "CASE WHEN (SELECT count(DISTINCT ts) FROM bars) - T >= 1000 + 250 + 60 THEN 1 ELSE 0 END"
    q = Layers("p", [BARS, ("p", f"SELECT T, X, {fits} AS ran, {fits} AS scored FROM (VALUES (7), (14), (4000)) AS t(T), (VALUES (0.5::DOUBLE), (0.8::DOUBLE)) AS x(X)")])
    out["parameter_search"] = q.out(["T", "ran", "scored"], ["X"])
    return out
