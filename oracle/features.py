"""Comparison SQL of the feature sets."""

from oracle.build import (
    BARS, FGI, FUNDING, LONG_SHORT, MACRO, W, Layers, corr, diff, flag, lag, mean, pct, ratio, rel, roll, run, std,
)

KEYS = ["symbol", "ts"]
TR = f"greatest(high - low, abs(high - {lag('close')}), abs(low - {lag('close')}))"


def _ema_layers() -> Layers:
    spans = {"ema_5": 5, "ema_10": 10, "ema_20": 20, "ema_50": 50, "ema_100": 100, "ema_200": 200, "e12": 12, "e26": 26}
    step = {n: f"(n.close * {2 / (s + 1)!r} + e.{n} * {1 - 2 / (s + 1)!r})" for n, s in spans.items()}
    seed = ", ".join(f"close AS {n}" for n in spans)
    macd = f"({step['e12']} - {step['e26']})"
    nxt = ", ".join(f"{v} AS {n}" for n, v in step.items())
    rec = (
        f"SELECT symbol, rn, {seed}, CAST(0 AS DOUBLE) AS macd_signal FROM num WHERE rn = 1 UNION ALL "
        f"SELECT n.symbol, n.rn, {nxt}, {macd} * 0.2::DOUBLE + e.macd_signal * 0.8::DOUBLE "
        "FROM e JOIN num n ON n.symbol = e.symbol AND n.rn = e.rn + 1"
    )
    q = Layers("bars", [BARS], recursive=True)
    q.cte("num", f"SELECT *, row_number() OVER ({W}) AS rn FROM bars")
    q.cte("e", rec)
    return q.cte("withema", "SELECT num.*, e.* EXCLUDE (symbol, rn) FROM num JOIN e USING (symbol, rn)")


def _technical_layers() -> Layers:
    ws = (5, 10, 20, 50, 100, 200)
    q = _ema_layers()
    q.add(
        {f"sma_{w}": mean("close", w) for w in ws}
        | {f"return_{w}d": pct("close", w) for w in (1, 3, 5, 7, 14, 21)}
        | {f"high_{w}d_dist": f"(close - {roll('max', 'high', w)}) / nullif(close, 0)" for w in (14, 21, 50)}
        | {f"low_{w}d_dist": f"(close - {roll('min', 'low', w)}) / nullif(close, 0)" for w in (14, 21, 50)}
        | {
            "d": diff("close"), "tr": TR, "sd": std("close", 20),
            "lo14": roll("min", "low", 14), "hi14": roll("max", "high", 14), "macd": "e12 - e26",
        }
    )
    q.add({"gain": "CASE WHEN d > 0 THEN d WHEN d <= 0 THEN 0 END", "loss": "CASE WHEN d < 0 THEN -d WHEN d >= 0 THEN 0 END"})
    q.add(
        {f"sma_cross_{a}_{b}": f"sma_{a} - sma_{b}" for a, b in ((5, 20), (10, 50), (50, 200))}
        | {f"price_vs_sma_{w}": f"(close - sma_{w}) / nullif(sma_{w}, 0)" for w in (20, 50, 200)}
        | {f"rsi_{w}": f"100 - 100 / (1 + {ratio(mean('gain', w), mean('loss', w))})" for w in (6, 14, 28)}
        | {f"atr_{w}": mean("tr", w) for w in (14, 21)}
        | {f"volatility_{w}d": std("return_1d", w) for w in (5, 10, 20)}
        | {
            "bb_upper_20": "sma_20 + 2 * sd", "bb_lower_20": "sma_20 - 2 * sd",
            "stoch_k_14": "100 * (close - lo14) / nullif(hi14 - lo14 + 1e-10::DOUBLE, 0)",
            "macd_hist": "macd - macd_signal",
        }
    )
    q.add(
        {f"atr_pct_{w}": f"atr_{w} / nullif(close, 0)" for w in (14, 21)}
        | {
            "bb_width_20": "(bb_upper_20 - bb_lower_20) / nullif(sma_20, 0)",
            "bb_pctb_20": ratio("close - bb_lower_20", "bb_upper_20 - bb_lower_20"),
            "stoch_d_14": mean("stoch_k_14", 3),
        }
    )
    return q


def technical() -> str:
    ws = (5, 10, 20, 50, 100, 200)
    q = _technical_layers()
    cols = [f"{p}_{w}" for p in ("sma", "ema") for w in ws]
    cols += ["sma_cross_5_20", "sma_cross_10_50", "sma_cross_50_200"]
    cols += [f"price_vs_sma_{w}" for w in (20, 50, 200)] + [f"rsi_{w}" for w in (6, 14, 28)]
    cols += ["macd", "macd_signal", "macd_hist", "bb_upper_20", "bb_lower_20", "bb_width_20", "bb_pctb_20"]
    cols += ["atr_14", "atr_21", "atr_pct_14", "atr_pct_21"] + [f"return_{w}d" for w in (1, 3, 5, 7, 14, 21)]
    cols += [f"volatility_{w}d" for w in (5, 10, 20)]
    cols += [f"{s}_{w}d_dist" for s in ("high", "low") for w in (14, 21, 50)] + ["stoch_k_14", "stoch_d_14"]
    return q.out(KEYS, cols)


QVOL = [f"qvol_{k}_{w}" for k in ("sma", "ratio") for w in (5, 10, 20)]


def _qvol(q: Layers) -> Layers:
    q.add({f"qvol_sma_{w}": mean("quote_volume", w) for w in (5, 10, 20)})
    return q.add({f"qvol_ratio_{w}": ratio("quote_volume", f"qvol_sma_{w}") for w in (5, 10, 20)})


def volume() -> str:
    q = Layers("bars", [BARS])
    q.add(
        {f"vol_sma_{w}": mean("volume", w) for w in (5, 10, 20, 50)}
        | {f"vol_change_{w}d": pct("volume", w) for w in (1, 3, 5)}
        | {f"vol_price_corr_{w}": corr("volume", "close", w) for w in (10, 20)}
        | {
            f"vwap_{w}": ratio(roll("sum", "((high + low + close) / 3 * volume)", w), roll("sum", "volume", w))
            for w in (10, 20)
        }
        | {"sv": f"coalesce(sign(close - {lag('close')}) * volume, 0)"}
    )
    q.add({"obv": run("sum", "sv")})
    q.add(
        {f"vol_ratio_{w}": ratio("volume", f"vol_sma_{w}") for w in (5, 10, 20, 50)}
        | {f"obv_sma_{w}": mean("obv", w) for w in (10, 20)}
        | {f"price_vs_vwap_{w}": rel("close", f"vwap_{w}") for w in (10, 20)}
        | {f"vol_volatility_{w}": std("vol_change_1d", w) for w in (10, 20)}
    )
    _qvol(q)
    cols = [f"vol_{k}_{w}" for k in ("sma", "ratio") for w in (5, 10, 20, 50)] + [f"vol_change_{w}d" for w in (1, 3, 5)]
    cols += [f"{p}_{w}" for p in ("vol_price_corr", "obv_sma", "vwap", "price_vs_vwap", "vol_volatility") for w in (10, 20)]
    return q.out(KEYS, [*cols, "obv", *QVOL])


def _flow_change(q: Layers) -> Layers:
    return q.add(
        {f"flow_change_{w}d": pct("quote_volume", w) for w in (1, 3, 5, 10)}
        | {f"flow_price_divergence_{w}": f"{pct('quote_volume', w)} - {pct('close', w)}" for w in (10, 20)}
    )


def _trades(q: Layers, m: str) -> Layers:
    t = "CAST(trades AS DOUBLE)"
    q.add(
        {f"trades_sma_{w}": mean("trades", w) for w in (5, 10, 20)}
        | {f"trades_change_{w}d": pct(t, w) for w in (1, 5)}
        | {"avg_trade_size": ratio("volume", t)}
    )
    q.add(
        {f"trades_ratio_{w}": ratio("trades", f"trades_sma_{w}") for w in (5, 10, 20)}
        | {f"avg_trade_size_{m}_{w}": mean("avg_trade_size", w) for w in (5, 10, 20)}
    )
    return q.add({f"avg_trade_size_ratio_{w}": ratio("avg_trade_size", f"avg_trade_size_{m}_{w}") for w in (5, 10, 20)})


def _density(q: Layers, m: str) -> Layers:
    q.add({"volume_density": ratio("volume", "high - low")})
    return q.add({f"volume_density_{m}_{w}": mean("volume_density", w) for w in (5, 10)})


def _activity_cols(m: str) -> list[str]:
    cols = [f"{p}_{w}" for p in ("trades_sma", "trades_ratio", f"avg_trade_size_{m}", "avg_trade_size_ratio") for w in (5, 10, 20)]
    cols += ["trades_change_1d", "trades_change_5d", "avg_trade_size", "volume_density"]
    cols += [f"volume_density_{m}_{w}" for w in (5, 10)] + [f"flow_change_{w}d" for w in (1, 3, 5, 10)]
    return cols + ["flow_price_divergence_10", "flow_price_divergence_20"]


def flow() -> str:
    q = _flow_change(_trades(Layers("bars", [BARS]), "sma"))
    q.add({f"qm_{w}": mean("quote_volume", w) for w in (5, 10, 20)})
    q.add({f"flow_momentum_{w}": pct(f"qm_{w}", w) for w in (5, 10, 20)})
    return _density(q, "sma").out(KEYS, [*_activity_cols("sma"), *[f"flow_momentum_{w}" for w in (5, 10, 20)]])


def market_structure() -> str:
    q = Layers("bars", [BARS])
    q.add({"ret": pct("close"), "delta": "sign(close - open) * volume"})
    q.add({"cvd": run("sum", "delta"), "buy_pressure": ratio("close - low", "high - low")})
    q.add(
        {f"funding_rate_{w}": f"{mean('ret', w)} * 100" for w in (7, 14, 24)}
        | {f"open_interest_{w}": roll("sum", "volume", w) for w in (7, 14, 24)}
        | {f"cvd_ma_{w}": mean("cvd", w) for w in (7, 14, 21)}
        | {f"cvd_change_{w}": pct("cvd", w) for w in (7, 14, 21)}
        | {f"buy_pressure_ma_{w}": mean("buy_pressure", w) for w in (5, 10, 20)}
        | {"stablecoin_inflow_proxy": f"-{pct('close', 7)} * {mean('volume', 7)}"}
    )
    _density(_trades(_flow_change(_qvol(q)), "ma"), "ma")
    cols = [f"{p}_{w}" for p in ("funding_rate", "open_interest") for w in (7, 14, 24)]
    cols += [f"{p}_{w}" for p in ("cvd_ma", "cvd_change") for w in (7, 14, 21)]
    cols += ["cvd", "stablecoin_inflow_proxy", "buy_pressure"] + [f"buy_pressure_ma_{w}" for w in (5, 10, 20)]
    return q.out(KEYS, [*cols, *QVOL, *_activity_cols("ma")])


def onchain() -> str:
    q = Layers("bars", [BARS])
    q.add({"realized": run("avg", "close"), "ret": pct("close")})
    q.add(
        {
            "mvrv": "close / nullif(realized, 0)", "lth_sopr": f"close / nullif({lag('close', 180)}, 0)",
            "sth_sopr": f"close / nullif({lag('close', 30)}, 0)", "active_addr_proxy": mean("volume", 7),
            "difficulty_ribbon_proxy": rel(mean("close", 9), mean("close", 128)),
            "nupl_proxy": ratio("close - realized", "close"),
            "entity_adjusted_vol": f"volume * {ratio('abs(close - open)', 'high - low')}",
            "miner_outflow_proxy": f"{std('ret', 30)} * volume",
        }
    )
    q.add(
        {f"mvrv_change_{w}": pct("mvrv", w) for w in (7, 14)}
        | {f"active_addr_change_{w}": pct("active_addr_proxy", w) for w in (7, 14)}
        | {f"{s}_sopr_ma_7": mean(f"{s}_sopr", 7) for s in ("lth", "sth")}
        | {f"{s}_sopr_change_7": pct(f"{s}_sopr", 7) for s in ("lth", "sth")}
        | {
            "nupl_ma_14": mean("nupl_proxy", 14), "entity_adjusted_vol_ma_10": mean("entity_adjusted_vol", 10),
            "miner_outflow_ma_14": mean("miner_outflow_proxy", 14),
        }
    )
    return q.out(KEYS, [
        "mvrv", "mvrv_change_7", "mvrv_change_14", "lth_sopr", "lth_sopr_ma_7", "sth_sopr", "sth_sopr_ma_7",
        "lth_sopr_change_7", "sth_sopr_change_7", "active_addr_proxy", "active_addr_change_7",
        "active_addr_change_14", "miner_outflow_proxy", "miner_outflow_ma_14", "difficulty_ribbon_proxy",
        "nupl_proxy", "nupl_ma_14", "entity_adjusted_vol", "entity_adjusted_vol_ma_10",
    ])


def streak(name: str, cond: str) -> tuple[dict[str, str], dict[str, str]]:
    """Run length by islands: rows of the flag within the group opened by the last failure."""
    miss = f"CASE WHEN coalesce({cond}, FALSE) THEN 0 ELSE 1 END"
    group = {f"g_{name}": f"sum({miss}) OVER ({W} ROWS UNBOUNDED PRECEDING)"}
    length = {
        name: f"CAST(sum(1 - ({miss})) OVER (PARTITION BY symbol, g_{name} ORDER BY ts ROWS UNBOUNDED PRECEDING) AS INTEGER)"
    }
    return group, length


def sentiment() -> str:
    q = Layers("bars", [BARS])
    q.add({"ret": pct("close"), "vr": pct("volume", 7)})
    gu, lu = streak("consecutive_up_days", "ret > 0")
    gd, ld = streak("consecutive_down_days", "ret < 0")
    raw = f"50 + {pct('close', 30)} * 100 - {std('ret', 30)} * 200 + {mean('vr', 7)} * 20"
    q.add(
        {"raw": raw}
        | gu | gd
        | {f"vix_proxy_{w}": f"{std('ret', w)} * 100" for w in (14, 30, 60)}
        | {f"volume_spike_{w}": ratio("volume", mean("volume", w)) for w in (10, 30)}
        | {f"dist_from_high_{w}d": rel("close", roll("max", "close", w, 1)) for w in (30, 90, 180, 365)}
        | {f"dist_from_low_{w}d": rel("close", roll("min", "close", w, 1)) for w in (30, 90, 180, 365)}
        | {
            "gtrend_proxy": f"{ratio(mean('volume', 7), mean('volume', 30))} * 50",
            "liquidity_proxy": f"100 - {std('ret', 90)} * 1000",
        }
    )
    q.add(lu | ld | {"fgi": "CASE WHEN raw IS NOT NULL THEN least(greatest(raw, 0), 100) END"})
    q.add(
        {f"fgi_ma_{w}": mean("fgi", w) for w in (7, 14)}
        | {
            "fgi_extreme_fear": flag("fgi < 20"), "fgi_extreme_greed": flag("fgi > 80"),
            "gtrend_proxy_ma_14": mean("gtrend_proxy", 14), "vix_proxy_change_7": pct("vix_proxy_30", 7),
        }
    )
    ints = ["fgi_extreme_fear", "fgi_extreme_greed", "consecutive_up_days", "consecutive_down_days"]
    cols = ["fgi", "fgi_ma_7", "fgi_ma_14", "gtrend_proxy", "gtrend_proxy_ma_14", "vix_proxy_14", "vix_proxy_30"]
    cols += ["vix_proxy_60", "vix_proxy_change_7", "liquidity_proxy", "volume_spike_10", "volume_spike_30"]
    cols += [f"dist_from_{s}_{w}d" for s in ("high", "low") for w in (30, 90, 180, 365)]
    return q.out([*KEYS, *ints], cols)


def regime() -> str:
    q = Layers("bars", [BARS])
    q.add({"sma_200": mean("close", 200), "ret": pct("close")})
    q.add({"base": lag("sma_200", 20), "vol": std("ret", 20)})
    flags = {
        "regime_bull": "close > sma_200", "regime_bear": "close < sma_200",
        "regime_sideways": "close > sma_200 * 0.95::DOUBLE AND close < sma_200 * 1.05::DOUBLE",
        "regime_ma200_rise": "sma_200 > base", "regime_ma200_fall": "sma_200 < base",
        "regime_vol_high": "vol > 0.03", "regime_vol_low": "vol < 0.015",
    }
    q.add(
        {f"regime_trend_{w}": rel("close", mean("close", w)) for w in (50, 100, 200)}
        | {"regime_price_vs_ma200": rel("close", "sma_200")}
        | {n: flag(cond) for n, cond in flags.items()}
    )
    return q.out([*KEYS, *flags], ["sma_200", "regime_price_vs_ma200", *[f"regime_trend_{w}" for w in (50, 100, 200)]])


def bear_volatility() -> str:
    q = Layers("bars", [BARS])
    q.add({"tr": TR, "d": diff("close"), "ret": pct("close"), "peak": run("max", "close")})
    q.add(
        {f"bear_atr_{w}": mean("tr", w) for w in (7, 14, 28)}
        | {f"bear_rv_{w}": std("ret", w) for w in (5, 10, 21)}
        | {
            "bear_dist_from_ath": rel("close", roll("max", "close", 365)),
            "bear_max_drawdown": rel("close", "peak"),
        }
        | {f"wr_{w}": f"ret * sqrt(volume / nullif({mean('volume', w)}, 0))" for w in (7, 14)}
    )
    q.add(
        {f"bear_atr_norm_change_{w}": ratio("d", f"bear_atr_{w}") for w in (7, 14, 28)}
        | {f"bear_rv_ratio_{w}_21": ratio(f"bear_rv_{w}", "bear_rv_21") for w in (5, 10)}
        | {f"bear_vol_weighted_rv_{w}": std(f"wr_{w}", w) for w in (7, 14)}
        | {"med": roll("median", "bear_rv_21", 60)}
    )
    q.add({"bear_vol_high": flag("bear_rv_21 > med * 1.5"), "bear_vol_low": flag("bear_rv_21 < med * 0.5")})
    cols = [f"{p}_{w}" for p in ("bear_atr", "bear_atr_norm_change") for w in (7, 14, 28)]
    cols += [f"bear_rv_{w}" for w in (5, 10, 21)] + ["bear_rv_ratio_5_21", "bear_rv_ratio_10_21"]
    cols += ["bear_dist_from_ath", "bear_max_drawdown", "bear_vol_weighted_rv_7", "bear_vol_weighted_rv_14"]
    return q.out([*KEYS, "bear_vol_high", "bear_vol_low"], cols)


def lag_rolling() -> str:
    """On all ten core columns."""
    q = _technical_layers()
    q.add({"realized": run("avg", "close"), "ret": pct("close"), "vr": pct("volume", 7)})
    q.add({"raw": f"50 + {pct('close', 30)} * 100 - {std('ret', 30)} * 200 + {mean('vr', 7)} * 20"})
    base = {
        "buy_pressure": ratio("close - low", "high - low"), "volume_density": ratio("volume", "high - low"),
        "mvrv": "close / nullif(realized, 0)", "lth_sopr": f"close / nullif({lag('close', 180)}, 0)",
        "sth_sopr": f"close / nullif({lag('close', 30)}, 0)",
        "fgi": "CASE WHEN raw IS NOT NULL THEN least(greatest(raw, 0), 100) END",
    }
    q.add(base)
    layer, cores = {}, [*base, "rsi_14", "macd", "macd_hist", "atr_14"]
    for f in cores:
        layer |= {f"{f}_lag{k}": lag(f, k) for k in (1, 2, 3, 7, 14)}
        layer |= {f"{f}_ma{w}": mean(f, w) for w in (3, 7, 14, 30)}
        layer |= {f"{f}_std{w}": std(f, w) for w in (3, 7, 14, 30)}
        layer |= {f"{f}_roc_{w}": pct(f, w) for w in (1, 3, 7)}
    q.add(layer)
    dev = {f"{f}_dev_ma7": f"({f} - {f}_ma7) / nullif(abs({f}_ma7) + 1e-10::DOUBLE, 0)" for f in cores}
    q.add(dev)
    return q.out(KEYS, [*layer, *dev])


# -- outside series --------------------------------------------------------
def _asof(q: Layers, source: tuple[str, str], cols: dict[str, str]) -> Layers:
    q.ctes.append(source)
    picked = ", ".join(f"s.{a} AS {b}" for a, b in cols.items())
    return q.cte(f"with_{source[0]}", f"SELECT b.*, {picked} FROM {q.last} b ASOF LEFT JOIN {source[0]} s ON b.ts >= s.ts")


def _fgi(q: Layers) -> tuple[list[str], list[str]]:
    q.add(
        {f"ext_fgi_ma{w}": mean("ext_fgi", w) for w in (7, 14, 30)}
        | {f"ext_fgi_change_{w}d": pct("ext_fgi", w) for w in (7, 14)}
        | {
            "ext_fgi_std_14": std("ext_fgi", 14), "ext_fgi_extreme_fear": flag("ext_fgi < 25"),
            "ext_fgi_extreme_greed": flag("ext_fgi > 75"),
            "ext_fgi_price_divergence": f"{pct('ext_fgi', 7)} - {pct('close', 7)}",
        }
    )
    cols = ["ext_fgi", "ext_fgi_ma7", "ext_fgi_ma14", "ext_fgi_ma30", "ext_fgi_change_7d", "ext_fgi_change_14d"]
    return ["ext_fgi_extreme_fear", "ext_fgi_extreme_greed"], [*cols, "ext_fgi_std_14", "ext_fgi_price_divergence"]


def _macro(q: Layers) -> list[str]:
    names, cols, layer = ("ndx", "vix"), [], {"pret": pct("close")}
    for n in names:
        x = f"ext_{n}"
        layer |= {f"{x}_ret_{w}d": pct(x, w) for w in (1, 5, 10, 20)}
        layer |= {f"{x}_vs_ma{w}": f"({x} - {mean(x, w)}) / (abs({mean(x, w)}) + 1e-10::DOUBLE)" for w in (10, 20, 50)}
        cols.append(x)
    q.add(layer)
    second = {}
    for n in names:
        second[f"ext_{n}_vol_20d"] = std(f"ext_{n}_ret_1d", 20)
        second |= {f"ext_btc_{n}_corr_{w}d": corr("pret", f"ext_{n}_ret_1d", w) for w in (20, 60)}
    q.add(second)
    return [*cols, *[k for k in layer if k != "pret"], *second]


def _funding(q: Layers) -> tuple[list[str], list[str]]:
    r = "ext_funding_rate_mean"
    q.add(
        {f"ext_fr_ma_{w}": mean(r, w) for w in (7, 14, 30)}
        | {f"ext_fr_std_{w}": std(r, w) for w in (7, 14, 30)}
        | {f"ext_fr_cumsum_{w}": roll("sum", r, w) for w in (7, 14, 30)}
        | {"ext_fr_zscore": ratio(f"{r} - {mean(r, 90)}", std(r, 90))}
    )
    q.add({"ext_fr_extreme_high": flag("ext_fr_zscore > 2"), "ext_fr_extreme_low": flag("ext_fr_zscore < -2")})
    cols = [f"ext_funding_rate_{k}" for k in ("mean", "sum", "max", "min")]
    cols += [f"ext_fr_{k}_{w}" for k in ("ma", "std", "cumsum") for w in (7, 14, 30)]
    return ["ext_fr_extreme_high", "ext_fr_extreme_low"], [*cols, "ext_fr_zscore"]


def _long_short(q: Layers) -> list[str]:
    x = "ext_ls_ratio"
    q.add(
        {f"ext_ls_ma_{w}": mean(x, w) for w in (7, 14, 30)}
        | {f"ext_ls_change_{w}d": pct(x, w) for w in (1, 3, 7)}
        | {"ext_ls_zscore": ratio(f"{x} - {mean(x, 60)}", std(x, 60))}
    )
    cols = [x, "ext_long_account", "ext_short_account", *[f"ext_ls_ma_{w}" for w in (7, 14, 30)]]
    return [*cols, *[f"ext_ls_change_{w}d" for w in (1, 3, 7)], "ext_ls_zscore"]


F_COLS = {"fgi_value": "ext_fgi"}
M_COLS = {"ndx_close": "ext_ndx", "vix_close": "ext_vix"}
R_COLS = {f"funding_rate_{k}": f"ext_funding_rate_{k}" for k in ("mean", "sum", "max", "min")}
L_COLS = {"ls_ratio": "ext_ls_ratio", "long_account": "ext_long_account", "short_account": "ext_short_account"}


def external() -> str:
    q = Layers("bars", [BARS])
    for source, cols in ((FGI, F_COLS), (MACRO, M_COLS), (FUNDING, R_COLS), (LONG_SHORT, L_COLS)):
        _asof(q, source, cols)
    fi, fd = _fgi(q)
    md = _macro(q)
    ri, rd = _funding(q)
    return q.out([*KEYS, *fi, *ri], [*fd, *md, *rd, *_long_short(q)])


def external_fgi() -> str:
    q = _asof(Layers("bars", [BARS]), FGI, F_COLS)
    ints, cols = _fgi(q)
    return q.out([*KEYS, *ints], cols)


def external_macro() -> str:
    q = _asof(Layers("bars", [BARS]), MACRO, M_COLS)
    return q.out(KEYS, _macro(q))


def external_fr() -> str:
    q = _asof(Layers("bars", [BARS]), FUNDING, R_COLS)
    ints, cols = _funding(q)
    return q.out([*KEYS, *ints], cols)


def external_fgi_enhanced() -> str:
    q = _asof(Layers("bars", [BARS]), FGI, F_COLS)
    x = "ext_fgi"
    rank = (
        f"(rank() OVER (PARTITION BY symbol, {x} IS NULL ORDER BY {x}) + (count(*) OVER (PARTITION BY symbol, {x}) - 1) / 2.0::DOUBLE)"
        f" / count({x}) OVER (PARTITION BY symbol)"
    )
    q.add(
        {f"{x}_ma{w}": mean(x, w) for w in (3, 7, 14, 21, 30)}
        | {f"{x}_std_{w}": std(x, w) for w in (3, 7, 14, 21, 30)}
        | {f"{x}_change_{w}d": pct(x, w) for w in (1, 3, 5, 7, 14, 21)}
        | {f"{x}_price_div_{w}d": f"{pct(x, w)} - {pct('close', w)}" for w in (7, 14)}
        | {f"{x}_pct_rank_{w}": f"CASE WHEN {x} IS NOT NULL THEN {rank} - 0.5 END" for w in (30, 60, 90)}
        | {f"{x}_momentum": diff(x, 3)}
        | {f"{x}_extreme_fear": flag(f"{x} < 25"), f"{x}_extreme_greed": flag(f"{x} > 75")}
        | {f"{x}_fear": flag(f"{x} < 35"), f"{x}_greed": flag(f"{x} > 65")}
    )
    q.add({f"{x}_vs_ma{w}": f"{x} - {x}_ma{w}" for w in (14, 30)} | {f"{x}_momentum_accel": diff(f"{x}_momentum", 3)})
    cols = [x, *[f"{x}_{k}{w}" for k in ("ma", "std_") for w in (3, 7, 14, 21, 30)]]
    cols += [f"{x}_change_{w}d" for w in (1, 3, 5, 7, 14, 21)] + [f"{x}_pct_rank_{w}" for w in (30, 60, 90)]
    cols += [f"{x}_price_div_7d", f"{x}_price_div_14d", f"{x}_momentum", f"{x}_momentum_accel", f"{x}_vs_ma14", f"{x}_vs_ma30"]
    return q.out([*KEYS, *[f"{x}_{k}" for k in ("extreme_fear", "extreme_greed", "fear", "greed")]], cols)


def sql() -> dict[str, str]:
    sets = (
        technical, volume, flow, market_structure, onchain, sentiment, regime, bear_volatility, lag_rolling,
        external, external_fgi, external_fgi_enhanced, external_macro, external_fr,
    )
    out = {f"features_{s.__name__}": s() for s in sets}
    blocked = (technical, volume, onchain, sentiment, market_structure, external_fr)
    return out | {f"features_{s.__name__}_blocked": out[f"features_{s.__name__}"] for s in blocked}
