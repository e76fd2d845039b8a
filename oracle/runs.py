"""Comparison SQL of the run tables."""

from oracle.build import Layers

FLAT = ["experiment_id", "name", "category", "tags", "created_at", "status"]
D = ["duration_seconds", "accuracy", "cohen_kappa", "f1_macro"]

REG = ("reg", (
    "SELECT concat('weekly_v', o_custkey % 9, '_', lpad(o_orderkey::VARCHAR, 8, '0')) AS experiment_id, concat('Weekly_', o_orderpriority) AS name, "
    "CASE WHEN o_custkey % 2 = 0 THEN 'weekly' ELSE 'baseline' END AS category, "
    "concat_ws(',', 'daily', CASE WHEN o_custkey % 3 = 0 THEN 'fgi' END, CASE WHEN o_custkey % 5 = 0 THEN 'macro' END) AS tags, "
    "strftime(o_orderdate, '%Y-%m-%d') AS created_at, CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'failed' ELSE 'running' END AS status, "
    "o_totalprice / 1000 AS duration_seconds, o_totalprice / 500000 AS accuracy, "
    "CASE WHEN o_custkey % 7 <> 0 THEN (o_custkey % 100) / 100.0::DOUBLE END AS f1_macro, (o_totalprice - 250000) / 1000000 AS cohen_kappa, "
    "o_custkey % 9 AS v FROM orders"
))
LONG = ("long", " UNION ALL ".join(f"SELECT experiment_id, v, '{m}' AS metric, {m} AS value FROM reg" for m in ("accuracy", "f1_macro", "cohen_kappa")))
IMP = ("imp", (
    "SELECT l_suppkey AS run_id, concat('f', lpad((l_partkey % 97)::VARCHAR, 2, '0')) AS feature, sum(l_quantity) AS importance FROM lineitem GROUP BY 1, 2"
))
RANKED = ("ranked", (
    "SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY importance DESC, feature) AS rank, importance / sum(importance) OVER (PARTITION BY run_id) AS share FROM imp"
))


def picked(where: str, tail: str = "") -> str:
    return Layers("reg", [REG]).where(where).out(FLAT, D, tail)


def sql() -> dict[str, str]:
    out = {
        "runs_filter": picked("status = 'completed' AND category = 'weekly' AND contains(tags, 'fgi') AND contains(lower(name), 'low')"),
        "runs_delete": picked("category <> 'baseline'"),
        "runs_cleanup_failed": picked("status <> 'failed'"),
        "runs_archived": picked("experiment_id = 'weekly_v1_00000005' OR created_at < '1996-01-01' OR status = 'running'"),
        "runs_kept": picked("NOT (created_at < '1996-01-01' OR status = 'running')"),
        "runs_export": picked("TRUE"),
    }
    top = lambda where, order, n: Layers("reg", [REG, ("t", f"SELECT * FROM reg WHERE {where} ORDER BY {order} LIMIT {n}")])
    for name, where, order, n in (
        ("runs_sorted_by_metric", "status = 'completed'", "f1_macro ASC NULLS LAST, experiment_id", 50),
        ("runs_sorted_by_field", "TRUE", "duration_seconds DESC, experiment_id", 20),
        ("runs_best", "status = 'completed'", "cohen_kappa DESC NULLS LAST, experiment_id", 1),
        ("runs_best_with_gaps", "status = 'completed'", "f1_macro DESC NULLS LAST, experiment_id", 1),
    ):
        q = top(where, order, n)
        q.last = "t"
        out[name] = q.out(FLAT, D)
    up = ("upd", "SELECT * REPLACE ('completed' AS status, 1.0::DOUBLE AS duration_seconds) FROM reg WHERE created_at < '1995-06-01' "
                 "UNION ALL SELECT * REPLACE (concat('new_', experiment_id) AS experiment_id) FROM reg WHERE created_at > '2001-06-01'")
    q = Layers("u", [REG, up, ("u", "SELECT * FROM reg WHERE experiment_id NOT IN (SELECT experiment_id FROM upd) UNION ALL SELECT * FROM upd")])
    out["runs_upsert"] = q.out(FLAT, D)
    q = Layers("u", [REG, up, ("u", "SELECT * FROM (SELECT * FROM reg WHERE experiment_id NOT IN (SELECT experiment_id FROM upd) UNION ALL SELECT * FROM upd) "
                                    "WHERE experiment_id NOT IN (SELECT experiment_id FROM reg WHERE created_at < '1993-01-01')")])
    out["runs_store"] = q.out(FLAT, D)
    q = Layers("p", [REG, ("p", "SELECT min(experiment_id) AS experiment_id FROM reg WHERE contains(experiment_id, '00000042') HAVING count(*) = 1")])
    out["runs_resolve_partial_id"] = q.out(["experiment_id"], [])
    q = Layers("p", [REG, ("p", "SELECT concat('weekly_v', v) AS prefix, max(experiment_id) AS experiment_id FROM reg WHERE v IN (1, 3, 8) GROUP BY 1")])
    out["runs_latest_per_prefix"] = q.out(["prefix", "experiment_id"], [])
    q = Layers("long", [REG, LONG]).where("metric IN ('accuracy', 'f1_macro')")
    out["runs_long_metrics"] = q.out(["experiment_id", "metric"], ["value"])
    q = Layers("b", [REG, LONG, ("b", "SELECT metric, max(value) AS best_value, first(experiment_id ORDER BY value DESC NULLS LAST, experiment_id) AS best_run FROM long GROUP BY 1")])
    out["runs_best_per_metric"] = q.out(["metric", "best_run"], ["best_value"])
    q = Layers("c2", [REG, LONG, ("c2", "SELECT metric, avg(value) FILTER (v = 1) AS weekly_v1, avg(value) FILTER (v = 2) AS weekly_v2 FROM long GROUP BY 1")])
    q.add({"best_run": "CASE WHEN weekly_v2 > weekly_v1 THEN 'weekly_v2' ELSE 'weekly_v1' END", "delta": "weekly_v2 - weekly_v1"})
    out["runs_compare_two"] = q.out(["metric", "best_run"], ["weekly_v1", "weekly_v2", "delta"])
    cols = [f"weekly_v{k}" for k in range(9)]
    q = Layers("vt", [REG, LONG, ("last", "SELECT v AS lv, max(experiment_id) AS id FROM reg GROUP BY 1"), (
        "vt", "SELECT metric, " + ", ".join(f"max(value) FILTER (v = {k}) AS weekly_v{k}" for k in range(9))
              + ", concat('weekly_v', first(v ORDER BY value DESC NULLS LAST, v)) AS best_run FROM long JOIN last ON experiment_id = id GROUP BY 1")])
    out["runs_version_table"] = q.out(["metric", "best_run"], cols)
    conf = ("conf", "SELECT 'label.T' AS key, (o_custkey % 3 * 7)::VARCHAR AS value FROM orders UNION ALL SELECT 'label.strategy', 'reversal' FROM orders "
                    "UNION ALL SELECT 'model.type', o_orderstatus FROM orders UNION ALL SELECT 'model.max_depth', 'N/A' FROM orders")
    q = Layers("cd", [conf, ("cd", "SELECT key, count(DISTINCT value) = 1 AS same, count(*) AS n_runs FROM conf GROUP BY 1")])
    out["runs_config_diff"] = q.out(["key", "same", "n_runs"], [])
    absent = ("conf", "SELECT o_orderkey AS run, 'label.T' AS key, (o_custkey % 3 * 7)::VARCHAR AS value FROM orders UNION ALL SELECT o_orderkey, 'label.strategy', 'reversal' FROM orders "
                      "WHERE o_orderkey % 10 > 0 UNION ALL SELECT o_orderkey, 'model.type', o_orderstatus FROM orders UNION ALL SELECT o_orderkey, 'model.max_depth', 'N/A' FROM orders")
    q = Layers("cd", [absent, ("cd", "SELECT key, count(DISTINCT value) = 1 AND count(DISTINCT run) = (SELECT count(DISTINCT run) FROM conf) AS same, count(*) AS n_runs FROM conf GROUP BY 1")])
    out["runs_config_diff_absent"] = q.out(["key", "same", "n_runs"], [])
    folds = ("folds", "SELECT l_orderkey AS run_id, l_quantity / 50 AS accuracy, 1 - l_discount AS f1_macro, l_tax - l_discount AS cohen_kappa FROM lineitem")
    ms = ("accuracy", "f1_macro", "cohen_kappa")
    aggs = ", ".join(f"avg({m}) AS {m}_mean, stddev_samp({m}) AS {m}_std, min({m}) AS {m}_min, max({m}) AS {m}_max" for m in ms)
    q = Layers("fs", [folds, ("fs", f"SELECT run_id, count(*) AS n_folds, {aggs} FROM folds GROUP BY 1")])
    out["runs_fold_summary"] = q.out(["run_id", "n_folds"], [f"{m}_{k}" for m in ms for k in ("mean", "std", "min", "max")])
    q = Layers("ranked", [IMP, RANKED])
    out["importance_rank"] = q.out(["run_id", "feature", "rank"], ["importance", "share"])
    out["importance_top_n"] = Layers("ranked", [IMP, RANKED]).where("rank <= 15").out(["run_id", "feature", "rank"], ["importance", "share"])
    tops = lambda n: ("tops", f"SELECT run_id, list(feature ORDER BY feature) AS fs FROM ranked WHERE rank <= {n} GROUP BY 1")
    out["importance_top_sets"] = Layers("tops", [IMP, RANKED, tops(15)]).out(["run_id", "array_to_string(fs, ',') AS features"], [])
    only = lambda x, y: f"array_to_string(list_sort([z FOR z IN {x}.fs IF NOT list_contains({y}.fs, z)]), ',')"
    inter = "[z FOR z IN a.fs IF list_contains(b.fs, z)]"
    q = Layers("ov", [IMP, RANKED, tops(20), (
        "ov", f"SELECT a.run_id AS run_a, b.run_id AS run_b, array_to_string(list_sort({inter}), ',') AS common, {only('a', 'b')} AS only_a, {only('b', 'a')} AS only_b, "
              f"len({inter}) / (len(a.fs) + len(b.fs) - len({inter})) AS jaccard FROM tops a JOIN tops b ON b.run_id = a.run_id + 1")])
    out["importance_overlap"] = q.out(["run_a", "run_b", "common", "only_a", "only_b"], ["jaccard"])
    q = Layers("g", [("g", "SELECT * FROM (SELECT DISTINCT l_linenumber * 7 AS T FROM lineitem), (SELECT DISTINCT l_discount AS X FROM lineitem)")])
    out["parameter_grid"] = q.out(["T"], ["X"])
    return out
