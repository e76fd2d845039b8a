"""Text helpers for the comparison SQL."""

W = "PARTITION BY symbol ORDER BY ts"


def canon(x: str) -> str:
    """Doubles to float precision, tiny values to zero (summation order differs between engines)."""
    r = f"round({x}, 8)"
    return f"CASE WHEN {r} = 0 THEN CAST(0 AS DOUBLE) ELSE CAST(CAST({r} AS FLOAT) AS DOUBLE) END"


def lag(x, n=1):
    return f"lag({x}, {n}) OVER ({W})"


def lead(x, n=1):
    return f"lead({x}, {n}) OVER ({W})"


def diff(x, n=1):
    return f"({x} - {lag(x, n)})"


def pct(x, n=1):
    return f"({x} / nullif({lag(x, n)}, 0) - 1)"


def roll(fn, x, w, mp=None):
    frame = f"OVER ({W} ROWS BETWEEN {w - 1} PRECEDING AND CURRENT ROW)"
    mp = w if mp is None else mp
    value = f"{fn}({x}) {frame}"
    return value if mp <= 1 else f"(CASE WHEN count({x}) {frame} >= {mp} THEN {value} END)"


def mean(x, w, mp=None):
    return roll("avg", x, w, mp)


def std(x, w):
    return roll("stddev_samp", x, w)


def corr(a, b, w):
    frame = f"OVER ({W} ROWS BETWEEN {w - 1} PRECEDING AND CURRENT ROW)"
    both = f"count(CASE WHEN {a} IS NOT NULL AND {b} IS NOT NULL THEN 1 END) {frame}"
    return f"(CASE WHEN {both} >= {w} AND NOT isnan(corr({a}, {b}) {frame}) THEN corr({a}, {b}) {frame} END)"


def run(fn, x):
    return f"{fn}({x}) OVER ({W} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"


def ahead(fn, x, t):
    frame = f"OVER ({W} ROWS BETWEEN 1 FOLLOWING AND {t} FOLLOWING)"
    return f"(CASE WHEN count({x}) {frame} = {t} THEN {fn}({x}) {frame} END)"


def ratio(a, b):
    return f"(({a}) / nullif(({b}) + 1e-10::DOUBLE, 0))"


def rel(a, b):
    return ratio(f"({a}) - ({b})", b)


def flag(cond):
    return f"CAST(coalesce({cond}, FALSE) AS INTEGER)"


class Layers:
    """Chain of CTEs, each adding columns to the one before."""

    def __init__(self, base: str, ctes: list[tuple[str, str]] | None = None, recursive: bool = False):
        self.ctes = list(ctes or [])
        self.last = base
        self.recursive = recursive

    def cte(self, name: str, sql: str):
        self.ctes.append((name, sql))
        self.last = name
        return self

    def add(self, cols: dict[str, str]):
        name = f"l{len(self.ctes)}"
        exprs = ", ".join(f"{e} AS {n}" for n, e in cols.items())
        self.ctes.append((name, f"SELECT *, {exprs} FROM {self.last}"))
        self.last = name
        return self

    def where(self, cond: str):
        name = f"l{len(self.ctes)}"
        self.ctes.append((name, f"SELECT * FROM {self.last} WHERE {cond}"))
        self.last = name
        return self

    def out(self, plain: list[str], doubles: list[str], tail: str = "") -> str:
        head = "WITH RECURSIVE " if self.recursive else "WITH "
        ctes = ",\n".join(f"{n} AS ({q})" for n, q in self.ctes)
        cols = ", ".join([*plain, *[f"{canon(d)} AS {d}" for d in doubles]])
        return f"{head}{ctes}\nSELECT {cols} FROM {self.last} {tail}"


def bars(symbol: str = "o_orderpriority", name: str = "bars") -> tuple[str, str]:
    s = "'ALL'" if symbol == "ALL" else symbol
    return name, (
        f"SELECT {s} AS symbol, o_orderdate AS ts, arg_min(o_totalprice, o_orderkey) AS open, "
        "max(o_totalprice) AS high, min(o_totalprice) AS low, arg_max(o_totalprice, o_orderkey) AS close, "
        "sum(coalesce(qty, 0)) AS volume, sum(o_totalprice) AS quote_volume, count(*) AS trades "
        "FROM orders LEFT JOIN (SELECT l_orderkey, sum(l_quantity) AS qty FROM lineitem GROUP BY 1) q "
        "ON o_orderkey = l_orderkey GROUP BY 1, 2"
    )


def event_bars(name: str = "bars", unit: str = "hour") -> tuple[str, str]:
    at = "{'t': ts, 'e': event_id}"
    return name, (
        f"SELECT event_type AS symbol, date_trunc('{unit}', ts) AS ts, arg_min(value, {at}) AS open, "
        f"max(value) AS high, min(value) AS low, arg_max(value, {at}) AS close, sum(value) AS volume, "
        "sum(value) AS quote_volume, count(*) AS trades FROM events GROUP BY 1, 2"
    )


BARS = bars()
BAR_DOUBLES = ["open", "high", "low", "close", "volume", "quote_volume"]

FGI = ("fgi", "SELECT l_shipdate AS ts, round(avg(l_discount) * 1000) AS fgi_value FROM lineitem GROUP BY 1")
MACRO = (
    "macro",
    "SELECT l_shipdate AS ts, avg(l_extendedprice) AS ndx_close, avg(l_quantity) AS vix_close FROM lineitem "
    "WHERE isodow(l_shipdate) <= 5 GROUP BY 1",
)
FUNDING = (
    "funding",
    "SELECT l_shipdate AS ts, avg(l_tax) AS funding_rate_mean, sum(l_tax) AS funding_rate_sum, "
    "max(l_tax) AS funding_rate_max, min(l_tax) AS funding_rate_min FROM lineitem GROUP BY 1",
)
LONG_SHORT = (
    "longshort",
    "SELECT ts, s / nullif(1 - s, 0) AS ls_ratio, s AS long_account, 1 - s AS short_account FROM "
    "(SELECT l_shipdate AS ts, avg(CAST(l_returnflag = 'A' AS DOUBLE)) AS s FROM lineitem GROUP BY 1)",
)
