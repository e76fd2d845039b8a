"""Comparison SQL of scans, landing, preparation, joins and aggregates."""

from oracle.build import (
    BAR_DOUBLES, BARS, FGI, FUNDING, LONG_SHORT, MACRO, W, Layers, ahead, bars, canon, event_bars, lag, lead, mean, pct, run,
)

KEYS = ["symbol", "ts"]
ALL_BAR = [*KEYS, "trades"]


def simple(sql: str, plain: list[str], doubles: list[str]) -> str:
    return Layers("q", [("q", sql)]).out(plain, doubles)


def three_way(down, up, known):
    return f"CASE WHEN {known} THEN CASE WHEN {up} THEN 2 WHEN {down} THEN 0 ELSE 1 END END"


def directional(T, X, q=None):
    q = q or Layers("bars", [BARS])
    q.add({"fr": f"{lead('close', T)} / nullif(close, 0) - 1"})
    return q.add({"label": three_way(f"fr <= -{X}", f"fr >= {X}", "fr IS NOT NULL")})


def reversal(T, X, q=None, tie="up"):
    q = q or Layers("bars", [BARS])
    q.add({"up": f"({ahead('max', 'close', T)} - close) / nullif(close, 0)", "down": f"({ahead('min', 'close', T)} - close) / nullif(close, 0)"})
    order = f"WHEN up >= {X} THEN 2 WHEN down <= -{X} THEN 0" if tie == "up" else f"WHEN down <= -{X} THEN 0 WHEN up >= {X} THEN 2"
    return q.add({"label": f"CASE WHEN up IS NOT NULL THEN CASE {order} ELSE 1 END END"})


def _macro_long():
    return (
        "SELECT l_shipdate AS ts, max(CASE WHEN f = 'A' THEN v END) AS A_close, max(CASE WHEN f = 'N' THEN v END) AS N_close, "
        "max(CASE WHEN f = 'R' THEN v END) AS R_close FROM (SELECT l_shipdate, l_returnflag AS f, avg(l_extendedprice) AS v "
        "FROM lineitem WHERE isodow(l_shipdate) <= 5 GROUP BY 1, 2) GROUP BY 1"
    )


def _merge(*names):
    return " FULL OUTER JOIN ".join([names[0]] + [f"{n} USING (ts)" for n in names[1:]])


def _profile():
    cols = ["fgi_value", "ndx_close", "vix_close", "ls_ratio", "long_account", "short_account"]
    parts = " UNION ALL ".join(
        f"SELECT '{x}' AS \"column\", avg(CASE WHEN {x} IS NULL THEN 1.0 ELSE 0.0 END) AS missing_rate, count(*) AS n_rows, "
        "min(ts) AS first_ts, max(ts) AS last_ts FROM merged" for x in cols
    )
    q = Layers("m", [FGI, MACRO, LONG_SHORT, ("merged", f"SELECT * FROM {_merge('fgi', 'macro', 'longshort')}"), ("m", parts)])
    return q.out(['"column"', "n_rows", "first_ts", "last_ts"], ["missing_rate"])


def _features_volume():
    q = Layers("bars", [BARS])
    q.add({"vol_sma_50": mean("volume", 50), "vol_change_5d": pct("volume", 5), "sv": f"coalesce(sign(close - {lag('close')}) * volume, 0)"})
    return q.add({"obv": run("sum", "sv")})


def _volume_all():
    """All columns of the volume set, for the row-completeness policies."""
    from oracle.features import volume

    sql = volume()
    return sql


def sql() -> dict[str, str]:
    out = {
        "bars_daily": simple("SELECT * FROM (" + bars()[1] + ")", ALL_BAR, BAR_DOUBLES),
        "bars_daily_all": simple(bars("ALL")[1], ALL_BAR, BAR_DOUBLES),
        "bars_hourly": simple(event_bars()[1], ALL_BAR, BAR_DOUBLES),
        "bar_csv_scan": simple(bars()[1], [*KEYS, "CAST(trades AS INTEGER) AS trades"], BAR_DOUBLES),
    }
    d = ["open", "high", "low", "close", "volume", "quote_volume"]
    out["landing_klines"] = simple(
        "SELECT o_orderkey, o_orderdate AS ts, o_totalprice AS open, o_totalprice AS high, o_totalprice AS low, "
        "o_totalprice AS close, CAST(o_custkey AS DOUBLE) AS volume, o_totalprice AS quote_volume, o_orderkey AS trades FROM orders",
        ["o_orderkey", "ts", "trades"], d,
    )
    out["landing_price_history"] = Layers("bars", [BARS]).add({"date": "ts", "adj_close": "close"}).out(
        ["symbol", "date"], ["open", "close", "adj_close", "volume"]
    )
    out["landing_fear_greed"] = (
        "SELECT ts, arg_max(v, seq) AS fgi_value, arg_max(k, seq) AS fgi_class FROM (SELECT l_shipdate AS ts, "
        "l_orderkey * 10 + l_linenumber AS seq, max(CAST(trunc(l_discount * 1000) AS INTEGER)::VARCHAR)::INTEGER AS v, "
        "max(l_returnflag) AS k FROM lineitem GROUP BY 1, 2) GROUP BY 1"
    )
    out["landing_macro"] = simple(_macro_long(), ["ts"], ["A_close", "N_close", "R_close"])
    out["landing_funding_daily"] = simple(
        "SELECT date_trunc('day', slot)::TIMESTAMP AS ts, avg(r) AS funding_rate_mean, sum(r) AS funding_rate_sum, max(r) AS funding_rate_max, "
        "min(r) AS funding_rate_min FROM (SELECT time_bucket(INTERVAL '8 hours', ts, TIMESTAMP '1970-01-01') AS slot, avg(value) AS r "
        "FROM events GROUP BY 1) GROUP BY 1",
        ["ts"], [f"funding_rate_{k}" for k in ("mean", "sum", "max", "min")],
    )
    at = "{'t': ts, 'e': event_id}"
    out["landing_long_short"] = simple(
        f"SELECT date_trunc('day', ts)::TIMESTAMP AS ts, arg_max(value, {at}) AS ls_ratio, arg_max(value / (1 + value), {at}) AS long_account, "
        f"arg_max(1 / (1 + value), {at}) AS short_account FROM events GROUP BY date_trunc('day', ts)",
        ["ts"], ["ls_ratio", "long_account", "short_account"],
    )
    out["column_normalise"] = simple(
        "SELECT * FROM orders", ["o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate", "o_orderpriority"], ["o_totalprice"],
    )
    out["dedupe_keep_last"] = simple(
        "SELECT o_orderpriority AS symbol, o_orderdate AS ts, o_orderkey, o_totalprice, o_orderstatus FROM orders "
        "QUALIFY row_number() OVER (PARTITION BY o_orderpriority, o_orderdate ORDER BY o_orderkey DESC) = 1",
        [*KEYS, "o_orderkey", "o_orderstatus"], ["o_totalprice"],
    )
    preds = (
        "preds", "SELECT run_id, symbol, ts, trades % 3 AS fold_id, (close > open)::INT AS y_true, (close > 250000)::INT AS y_pred "
                 "FROM bars, (VALUES ('first', 0), ('second', 200000)) AS r(run_id, least_close) WHERE close > least_close"
    )
    stored = lambda sql, names: Layers("t", [BARS, preds, ("t", sql)]).out(names, [])
    out["stored_predictions"] = stored("SELECT * FROM preds", ["run_id", "symbol", "ts", "fold_id", "y_true", "y_pred"])
    out["stored_metrics"] = stored("SELECT run_id, count(*) AS n, sum((y_true = y_pred)::INT)::BIGINT AS n_right FROM preds GROUP BY 1", ["run_id", "n", "n_right"])
    out["stored_fold_metrics"] = stored(
        "SELECT run_id, fold_id::INT AS fold_id, count(*)::INT AS n, sum(y_true)::INT AS n_pos FROM preds GROUP BY 1, 2", ["run_id", "fold_id", "n", "n_pos"]
    )
    out["stored_importance"] = stored(
        "SELECT run_id, symbol AS feature, count(*)::INT AS importance FROM preds GROUP BY 1, 2", ["run_id", "feature", "importance"]
    )
    out["dedupe_null_sequence"] = simple(
        "SELECT o_orderpriority AS symbol, o_orderdate AS ts, o_orderkey, CASE WHEN o_custkey % 3 = 0 THEN o_orderkey END AS seq FROM orders "
        "QUALIFY row_number() OVER (PARTITION BY o_orderpriority, o_orderdate ORDER BY seq DESC NULLS LAST, o_orderkey DESC) = 1",
        [*KEYS, "o_orderkey", "seq"], [],
    )
    out["date_range"] = Layers("bars", [BARS]).where(
        "ts BETWEEN TIMESTAMP '1996-01-01' AND TIMESTAMP '1998-06-30'"
    ).out(ALL_BAR, BAR_DOUBLES)
    for name, n in (("tail_rows", 7), ("latest_row", 1)):
        q = Layers("bars", [BARS]).cte(
            "t", "SELECT * FROM bars QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) <= " + str(n)
        )
        out[name] = q.out(ALL_BAR, BAR_DOUBLES)
    q = Layers("bars", [BARS]).add({"s": "CASE WHEN trades > 1 THEN close END", "v": "CASE WHEN volume > 60 THEN volume END"})
    fill = lambda x: f"last_value({x} IGNORE NULLS) OVER ({W} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    q.add({"sparse": fill("s"), "sparse_volume": fill("v")})
    out["forward_fill"] = q.out(KEYS, ["sparse", "sparse_volume"])

    from oracle.features import volume as volume_sql

    base = volume_sql()
    complete = "COLUMNS(*) IS NOT NULL"
    out["null_policy_drop"] = f"SELECT * FROM ({base}) WHERE {complete}"
    filled = f"SELECT symbol, ts, last_value(COLUMNS(* EXCLUDE (symbol, ts)) IGNORE NULLS) OVER ({W} ROWS UNBOUNDED PRECEDING) FROM ({base})"
    out["null_policy_ffill_then_drop"] = f"SELECT * FROM ({filled}) WHERE {complete}"

    q = directional(14, 0.5).add({
        "bull": "CASE label WHEN 0 THEN 0 WHEN 1 THEN 0 WHEN 2 THEN 1 END", "bear": "CASE label WHEN 0 THEN 1 WHEN 2 THEN 0 END",
    })
    out["value_map"] = q.out([*KEYS, "label", "bull", "bear"], [])
    out["row_intersection"] = Layers("bars", [BARS]).where("trades = 1 AND high > 400000").out(KEYS, ["close"])
    out["missing_profile"] = _profile()
    q = Layers("m", [FGI, MACRO, FUNDING, ("m", f"SELECT * FROM {_merge('fgi', 'macro', 'funding')}")])
    out["full_outer_merge"] = q.out(
        ["ts"], ["fgi_value", "ndx_close", "vix_close", *[f"funding_rate_{k}" for k in ("mean", "sum", "max", "min")]]
    )
    q = Layers("a", [BARS, MACRO, FGI, (
        "a", "SELECT b.symbol, b.ts, b.close, m.ndx_close, m.vix_close, f.fgi_value FROM bars b "
             "ASOF LEFT JOIN macro m ON b.ts >= m.ts ASOF LEFT JOIN fgi f ON b.ts >= f.ts")])
    out["asof_join"] = q.out(KEYS, ["close", "ndx_close", "vix_close", "fgi_value"])
    q = Layers("a", [event_bars("hours"), (
        "e", "SELECT event_type AS symbol, ts, event_id, value FROM events "
             "QUALIFY row_number() OVER (PARTITION BY event_type, ts ORDER BY event_id DESC) = 1"), (
        "a", "SELECT e.*, CASE WHEN h.trades > 2 THEN h.close END AS bar_close, h.volume AS bar_volume FROM e "
             "ASOF LEFT JOIN hours h ON e.symbol = h.symbol AND e.ts >= h.ts")])
    out["asof_join_per_symbol"] = q.out([*KEYS, "event_id"], ["value", "bar_close", "bar_volume"])
    q = reversal(3, 0.6).cte("d", "SELECT symbol, label, count(*) AS n FROM l2 WHERE label IS NOT NULL GROUP BY 1, 2")
    out["class_distribution"] = q.add({"pct": "n * 100.0::DOUBLE / sum(n) OVER (PARTITION BY symbol)"}).out(["symbol", "label", "n"], ["pct"])
    q = Layers("bars", [BARS]).add({"label": f"({lead('close', 14)} / nullif(close, 0) - 1) * 100"})
    q.cte("s", f"SELECT symbol, avg(label) AS mean, stddev_samp(label) AS std, min(label) AS min, max(label) AS max FROM {q.last} GROUP BY 1")
    out["label_summary"] = q.out(["symbol"], ["mean", "std", "min", "max"])
    return out
