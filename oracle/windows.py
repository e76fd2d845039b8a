"""Comparison SQL of the window primitives."""

from oracle.build import BARS, W, Layers, ahead, corr, diff, event_bars, lag, lead, mean, pct, ratio, roll, run, std
from oracle.features import streak

KEYS = ["symbol", "ts"]


def _ema(base: tuple[str, str], spans: dict[str, int], extra: dict[str, str] | None = None) -> str:
    step = ", ".join(f"n.close * {2 / (s + 1)!r} + e.{k} * {1 - 2 / (s + 1)!r} AS {k}" for k, s in spans.items())
    seed = ", ".join(f"close AS {k}" for k in spans)
    q = Layers("bars", [base], recursive=True)
    q.cte("num", f"SELECT *, row_number() OVER ({W}) AS rn FROM bars")
    q.cte("e", f"SELECT symbol, rn, {seed} FROM num WHERE rn = 1 UNION ALL SELECT n.symbol, n.rn, {step} "
               "FROM e JOIN num n ON n.symbol = e.symbol AND n.rn = e.rn + 1")
    q.cte("r", "SELECT num.*, e.* EXCLUDE (symbol, rn) FROM num JOIN e USING (symbol, rn)")
    if extra:
        q.add(extra)
    return q.out(KEYS, [*spans, *(extra or {})])


def _ema_gaps(spans: dict[str, int]) -> str:
    """m counts the missing values since the last one."""
    def step(k, s):
        a, kept = f"{2 / (s + 1)!r}", f"pow({1 - 2 / (s + 1)!r}, e.m + 1)"
        return f"CASE WHEN e.{k} IS NULL THEN n.held WHEN n.held IS NULL THEN e.{k} ELSE ({kept} * e.{k} + {a} * n.held) / ({kept} + {a}) END AS {k}"

    q = Layers("bars", [BARS], recursive=True)
    q.cte("num", f"SELECT *, CASE WHEN day(ts) > 3 AND day(ts) % 7 <> 0 THEN close END AS held, row_number() OVER ({W}) AS rn FROM bars")
    seed, steps = ", ".join(f"held AS {k}" for k in spans), ", ".join(step(k, s) for k, s in spans.items())
    first = next(iter(spans))
    q.cte("e", f"SELECT symbol, rn, 0 AS m, {seed} FROM num WHERE rn = 1 UNION ALL SELECT n.symbol, n.rn, "
               f"CASE WHEN n.held IS NULL AND e.{first} IS NOT NULL THEN e.m + 1 ELSE 0 END, {steps} "
               "FROM e JOIN num n ON n.symbol = e.symbol AND n.rn = e.rn + 1")
    q.cte("r", "SELECT num.*, e.* EXCLUDE (symbol, rn, m) FROM num JOIN e USING (symbol, rn)")
    return q.out(KEYS, list(spans))


def sql() -> dict[str, str]:
    new = lambda: Layers("bars", [BARS])
    plain = lambda cols: new().add(cols).out(KEYS, list(cols))
    out = {
        "window_shift_diff_change": plain(
            {f"lag_{n}": lag("close", n) for n in (1, 14)} | {f"lead_{n}": lead("close", n) for n in (1, 7)}
            | {"diff_1": diff("close"), "diff_3": diff("close", 3), "pct_1": pct("close"), "pct_7": pct("volume", 7)}
        ),
        "window_rolling": plain(
            {f"mean_{w}": mean("close", w) for w in (5, 50)} | {f"sum_{w}": roll("sum", "volume", w) for w in (7, 24)}
            | {f"std_{w}": std("close", w) for w in (10, 30)}
            | {"max_14": roll("max", "high", 14), "min_14": roll("min", "low", 14), "median_60": roll("median", "close", 60)}
            | {"corr_10": corr("volume", "close", 10), "corr_20": corr("volume", "close", 20)}
        ),
        "window_min_periods": plain({
            "max_365": roll("max", "close", 365, 1), "min_30": roll("min", "close", 30, 1), "mean_20_min5": mean("close", 20, 5),
        }),
        "window_ema": _ema(BARS, {"ema_12": 12, "ema_26": 26}),
        "window_ema_gaps": _ema_gaps({"ema_12": 12, "ema_90": 90}),
        "window_hourly_ema": _ema(event_bars(), {"ema_9": 9}, {"mean_24": mean("close", 24)}),
        "window_forward": plain({"max_ahead": ahead("max", "close", 14), "min_ahead": ahead("min", "close", 14)}),
        "window_zscore": plain({f"z_{w}": ratio(f"close - {mean('close', w)}", std("close", w)) for w in (60, 90)}),
    }
    q = new().add({"ret": pct("close")}).add({
        "mean_all": run("avg", "close"), "sum_volume": run("sum", "volume"), "max_close": run("max", "close"),
        "min_close": run("min", "close"), "growth": run("product", "(1 + sign(ret) * 0.01::DOUBLE)"),
    })
    out["window_running"] = q.out(KEYS, ["mean_all", "sum_volume", "max_close", "min_close", "growth"])
    gu, lu = streak("up", "ret > 0")
    gd, ld = streak("down", "ret < 0")
    out["window_streak"] = new().add({"ret": pct("close")}).add(gu | gd).add(lu | ld).out([*KEYS, "up", "down"], [])
    rank = "(rank() OVER (PARTITION BY symbol ORDER BY level) + (count(*) OVER (PARTITION BY symbol, level) - 1) / 2.0::DOUBLE)"
    out["window_pct_rank"] = new().add({"level": "floor(close / 1000)"}).add(
        {"pct_rank": f"{rank} / count(*) OVER (PARTITION BY symbol)"}
    ).out(KEYS, ["pct_rank"])
    # the same results from series cut into blocks
    return out | {f"{name}_blocked": text for name, text in out.items() if name != "window_pct_rank"}
