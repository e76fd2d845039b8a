"""Series laid out in bounded, overlapping row blocks.

A window partitioned by symbol alone puts a whole series into one task, and
one symbol may hold a third of all rows.  ``lay_out`` therefore numbers the
rows of each series, cuts them into blocks of ``block_rows`` and ships every
row to the blocks that need it: its own, and the neighbours whose look-back or
look-ahead reaches it.  All row-based windows then run inside
``(symbol, block)`` with one shuffle; running aggregates add a carry taken
from a two-level prefix over cell totals.  When the longest series fits into
one block, the layout is simply ``partitionBy(symbol)``.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from tidebar.functions.scalars import col, div
from tidebar.operators.scan import (
    Extent,
    bucket_column,
    choose_bucket_width,
    combine,
    prefix_scan,
    running,
    series_extent,
    total,
)
from tidebar.session import materialize

BLOCK_ROWS = 65_536
CELL_ROWS = 2_048
# Most tasks of one window stage; beyond it a task handles several blocks in turn.
MAX_TASKS = 20_000

# Nats by which an exponential mean forgets within one segment of its sums; two segments on, a value is below the least double.
_EMA_NATS = 400.0


_FAMILY = {
    "mean": "sum", "sum": "sum", "std": "std", "max": "max", "min": "min", "max_any": "maxany", "min_any": "minany",
}


def _pair(family: str, a: Column, b: Column) -> Column:
    """Value of two adjacent (or, for max and min, overlapping) windows together."""
    if family == "sum":
        return a + b
    if family == "std":  # the mean of two windows of equal size
        return (a + b) / 2
    best = F.greatest(a, b) if family in ("max", "maxany") else F.least(a, b)
    return best if family.endswith("any") else F.when(a.isNotNull() & b.isNotNull(), best)


def fading_sums(df: DataFrame, keys: Sequence[str], ts: str, names: Sequence[str]) -> DataFrame:
    """For each name the running y = A * y before + B of the maps in ``<name>l`` (log of A, null for 1) and ``<name>b`` (B, null
    for 0), as ``<name>y``, and the running log of all A as ``<name>s``.

    A map is composed with all before it: y = sum of B * exp(s - s at B). The sums run within segments of ``_EMA_NATS`` nats, where
    no factor overflows; the sum at the end of a segment, with that of the one before it, counts in the next. What lies further back
    is multiplied by less than the least double.
    """
    order = Window.partitionBy(*keys).orderBy(ts)
    upto, before = order.rowsBetween(Window.unboundedPreceding, 0), order.rowsBetween(Window.unboundedPreceding, -1)
    c = F.col
    df = df.withColumns({f"{n}s": F.coalesce(F.sum(f"{n}l").over(upto), F.lit(0.0)) for n in names})
    df = df.withColumns({f"{n}g": F.floor(-c(f"{n}s") / F.lit(_EMA_NATS)) for n in names})
    sums = {}
    for n in names:
        inside = Window.partitionBy(*keys, f"{n}g").orderBy(ts).rowsBetween(Window.unboundedPreceding, 0)
        shift = c(f"{n}s") + F.lit(_EMA_NATS) * c(f"{n}g")
        sums[f"{n}z"] = F.coalesce(F.sum(c(f"{n}b") * F.exp(-shift)).over(inside), F.lit(0.0)) * F.exp(shift)
    df = df.withColumns(sums)
    final = {n: F.lead(f"{n}g").over(order) != c(f"{n}g") for n in names}
    ended = lambda n, z: F.last(F.when(c(f"{n}f"), F.struct(c(z).alias("z"), c(f"{n}s").alias("s"))), ignorenulls=True).over(before)
    faded = lambda n, e: F.coalesce(c(e)["z"] * F.exp(c(f"{n}s") - c(e)["s"]), F.lit(0.0))
    df = df.withColumns({f"{n}f": final[n] for n in names})
    df = df.withColumns({f"{n}e": ended(n, f"{n}z") for n in names})
    df = df.withColumns({f"{n}w": c(f"{n}z") + faded(n, f"{n}e") for n in names})
    df = df.withColumns({f"{n}e": ended(n, f"{n}w") for n in names})
    df = df.withColumns({f"{n}y": c(f"{n}z") + faded(n, f"{n}e") for n in names})
    return df.drop(*[f"{n}{x}" for n in names for x in "gzfew"])


def affine(x: Column, gap: Column, a: float) -> tuple[Column, Column]:
    """Log of A, and B, of the map that a value x makes of the exponential mean before it, ``gap`` rows after the last value."""
    kept = F.pow(F.lit(1.0 - a), gap.cast("double"))
    return F.log(kept) - F.log(kept + F.lit(a)), F.lit(a) * x / (kept + F.lit(a))


@dataclass(frozen=True)
class Frame:
    """Rows of many series with window access; immutable like a DataFrame.

    Columns ``__rn`` (row number in the series, from 0), and in blocked mode
    ``__blk``, are helpers removed by :meth:`finish`.
    """

    df: DataFrame
    by: tuple[str, ...]
    ts: str
    blocked: bool = False
    block_rows: int = BLOCK_ROWS
    cell_rows: int = CELL_ROWS
    halo_cells: int = 0

    # -- shape -----------------------------------------------------------
    @property
    def columns(self) -> list[str]:
        return [c for c in self.df.columns if not c.startswith("__")]

    def has(self, *names: str) -> bool:
        return all(n in self.df.columns for n in names)

    def add(self, cols: dict[str, Column]) -> Frame:
        """One layer of new (or replaced) columns in a single projection."""
        return replace(self, df=self.df.withColumns(cols)) if cols else self

    def drop(self, *names: str) -> Frame:
        return replace(self, df=self.df.drop(*names))

    def finish(self, keep_row_number: str | None = None) -> DataFrame:
        """Own rows only (neighbour copies removed), helper columns dropped."""
        df = self.df
        if self.blocked:
            df = df.filter(self._own())
        if keep_row_number:
            df = df.withColumn(keep_row_number, F.col("__rn"))
        return df.drop(*[c for c in df.columns if c.startswith("__") and c != keep_row_number])

    # -- windows ---------------------------------------------------------
    @property
    def keys(self) -> list[str]:
        return [*self.by, "__blk"] if self.blocked else list(self.by)

    @property
    def order(self) -> WindowSpec:
        return Window.partitionBy(*self.keys).orderBy(self.ts)

    def trailing(self, w: int) -> WindowSpec:
        return self.order.rowsBetween(-(w - 1), 0)

    def _own(self) -> Column:
        size = F.lit(self.block_rows)
        return (F.col("__rn") >= F.col("__blk") * size) & (F.col("__rn") < (F.col("__blk") + 1) * size)

    def lag(self, c: str | Column, n: int = 1) -> Column:
        return F.lag(col(c), n).over(self.order)

    def lead(self, c: str | Column, n: int = 1) -> Column:
        return F.lead(col(c), n).over(self.order)

    def diff(self, c: str | Column, n: int = 1) -> Column:
        return col(c) - self.lag(c, n)

    def change(self, c: str | Column, n: int = 1) -> Column:
        """Relative change over n rows, null at zero or missing base."""
        return div(c, self.lag(c, n)) - 1

    def rolling(self, agg: Column, present: Column, w: int, min_periods: int | None = None) -> Column:
        """Trailing aggregate, null until ``min_periods`` (default w) inputs are present."""
        win = self.trailing(w)
        need = w if min_periods is None else min_periods
        value = agg.over(win)
        return value if need <= 1 else F.when(F.count(present).over(win) >= need, value)

    def mean(self, c, w: int, min_periods: int | None = None) -> Column:
        return self.rolling(F.avg(col(c)), col(c), w, min_periods)

    def sum(self, c, w: int, min_periods: int | None = None) -> Column:
        return self.rolling(F.sum(col(c)), col(c), w, min_periods)

    def max(self, c, w: int, min_periods: int | None = None) -> Column:
        return self.rolling(F.max(col(c)), col(c), w, min_periods)

    def min(self, c, w: int, min_periods: int | None = None) -> Column:
        return self.rolling(F.min(col(c)), col(c), w, min_periods)

    def std(self, c, w: int, min_periods: int | None = None) -> Column:
        return self.rolling(F.stddev_samp(col(c)), col(c), w, min_periods)

    def median(self, c, w: int, min_periods: int | None = None) -> Column:
        return self.rolling(F.percentile(col(c), F.lit(0.5)), col(c), w, min_periods)

    def corr(self, a, b, w: int) -> Column:
        both = F.when(col(a).isNotNull() & col(b).isNotNull(), F.lit(1))
        return self.rolling(F.corr(col(a), col(b)), both, w)

    def ahead(self, agg: Column, present: str | Column, t: int) -> Column:
        """Aggregate over the next t rows, null when fewer than t exist."""
        win = self.order.rowsBetween(1, t)
        return F.when(F.count(col(present)).over(win) == t, agg.over(win))

    # -- long windows -----------------------------------------------------
    def long_windows(self, specs: dict[str, tuple[str, str, int]]) -> Frame:
        """Trailing mean / sum / max / min / std over many rows: name -> (kind, column, w).

        A sliding frame visits w rows per row.  Here windows of 2, 4, 8, ...
        rows are built from two halves with lag(), and a window of any length
        is put together from them: about log2(w) lags per row, shared by all
        lengths.  A missing input makes the result null, as a full window
        requires; ``max_any`` / ``min_any`` accept partial windows.
        """
        deepest: dict[tuple[str, str], int] = {}
        for kind, src, w in specs.values():
            key = (_FAMILY[kind], src)
            deepest[key] = max(deepest.get(key, 1), 1 << (w.bit_length() - 1))
        part = lambda fam, src, size, what="v": f"__{fam}_{src.strip('_')}_{size}_{what}"
        f = self.add(
            {part(fam, src, 1): col(src).cast("double") for fam, src in deepest}
            | {part("std", src, 1, "q"): F.when(col(src).isNotNull(), F.lit(0.0)) for fam, src in deepest if fam == "std"}
        )
        size = 1
        while any(size < d for d in deepest.values()):
            layer = {}
            for (fam, src), d in deepest.items():
                if size < d:
                    here, back = F.col(part(fam, src, size)), f.lag(part(fam, src, size), size)
                    layer[part(fam, src, 2 * size)] = _pair(fam, here, back)
                    if fam == "std":
                        q = part(fam, src, size, "q")
                        spread = (here - back) * (here - back) * F.lit(size / 2.0)
                        layer[part(fam, src, 2 * size, "q")] = F.col(q) + f.lag(q, size) + spread
            f, size = f.add(layer), 2 * size
        out, moments = {}, {}
        for name, (kind, src, w) in specs.items():
            fam, top = _FAMILY[kind], 1 << (w.bit_length() - 1)
            shifted = lambda size, off, what="v": f.lag(part(fam, src, size, what), off) if off else F.col(part(fam, src, size, what))
            if fam in ("sum", "std"):
                pieces, off = [], 0
                for bit in reversed(range(w.bit_length())):
                    if w >> bit & 1:
                        pieces.append((1 << bit, off))
                        off += 1 << bit
            if fam == "sum":
                whole = reduce(add, [shifted(n, off) for n, off in pieces])
                out[name] = whole / w if kind == "mean" else whole
            elif fam == "std":
                for i, (n, off) in enumerate(pieces):
                    out[f"__{name}_m{i}"], out[f"__{name}_q{i}"] = shifted(n, off), shifted(n, off, "q")
                moments[name] = (w, [n for n, _ in pieces])
            else:
                out[name] = _pair(fam, shifted(top, 0), shifted(top, w - top)) if w > top else shifted(top, 0)
        made = [c for c in f.df.columns if c not in self.df.columns]
        f = f.add(out)
        means = {
            f"__{n}_m": reduce(add, [F.col(f"__{n}_m{i}") * F.lit(float(k)) for i, k in enumerate(ks)]) / w
            for n, (w, ks) in moments.items()
        }
        f = f.add(means)
        stds = {}
        for n, (w, ks) in moments.items():
            gap = lambda i: F.col(f"__{n}_m{i}") - F.col(f"__{n}_m")
            total_sq = reduce(add, [F.col(f"__{n}_q{i}") + gap(i) * gap(i) * F.lit(float(k)) for i, k in enumerate(ks)])
            stds[n] = F.sqrt(total_sq / (w - 1))
        temps = [f"__{n}_{x}{i}" for n, (_, ks) in moments.items() for i in range(len(ks)) for x in ("m", "q")]
        return f.add(stds).drop(*made, *temps, *means)

    # -- running aggregates -----------------------------------------------
    def cumulative(self, specs: dict[str, tuple[str, str | Column]], own_rows: bool = False) -> Frame:
        """Running sum / max / min / prod / last from the start of each series.

        In blocked mode the first halo cell is warm-up, so inputs may look back
        ``cell_rows`` rows and the result is valid in the rest of the halo.
        ``own_rows`` starts at the block itself instead: any look-back is fine
        for the inputs, and only own rows get a result.
        """
        exprs = {n: (k, col(c)) for n, (k, c) in specs.items()}
        upto = self.order.rowsBetween(Window.unboundedPreceding, 0)
        if not self.blocked:
            return self.add({n: running(k, c, upto) for n, (k, c) in exprs.items()})
        missing = {n: e for n, e in exprs.items() if f"__c_{n}" not in self.df.columns}
        f = self.attach_carries(missing, own_rows=own_rows) if missing else self
        counted = F.col("__rn") >= F.col("__blk") * self.block_rows - self._lead_in(own_rows) * self.cell_rows
        f = f.add({f"__h_{n}": running(k, F.when(counted, c), upto) for n, (k, c) in exprs.items()})
        f = f.add({n: combine(k, F.col(f"__c_{n}"), F.col(f"__h_{n}")) for n, (k, _) in exprs.items()})
        return f.drop(*[f"__c_{n}" for n in exprs], *[f"__h_{n}" for n in exprs])

    def _lead_in(self, own_rows: bool) -> int:
        """Halo cells that running aggregates cover (the first one is warm-up)."""
        return 0 if own_rows else max(self.halo_cells - 1, 0)

    def attach_carries(
        self, specs: dict[str, tuple[str, str | Column]], source: Frame | None = None, own_rows: bool = False
    ) -> Frame:
        """Join the value each running aggregate has before the block, as ``__c_<name>``.

        ``source`` holds the input columns when this frame does not.  Totals
        per cell come from own rows without a shuffle; their prefix is a
        scan over few rows.  Asking for the carries of many
        aggregates at once costs one pass.
        """
        exprs = {n: (k, col(c)) for n, (k, c) in specs.items()}
        rows = (source or self).df.filter(self._own())
        per_block = self.block_rows // self.cell_rows
        cell = F.floor(F.col("__rn") / F.lit(self.cell_rows)).cast("long")
        totals = rows.groupBy(*self.keys, cell.alias("__cell")).agg(
            *[total(k, c, "__rn").alias(n) for n, (k, c) in exprs.items()]
        )
        # a few rows a block, written once: each later aggregate reads this frame one time for its totals and one time for its rows
        totals = materialize(totals)
        carries = prefix_scan(
            totals.drop("__blk"), self.by, "__cell", {f"__c_{n}": (k, F.col(n)) for n, (k, _) in exprs.items()}
        )
        shifted = F.col("__cell") + F.lit(self._lead_in(own_rows))
        carries = carries.filter(shifted % per_block == 0).select(
            *self.by, (shifted / per_block).cast("long").alias("__blk"), *[f"__c_{n}" for n in exprs]
        )
        return replace(self, df=self.df.join(carries, self.keys, "left"))

    @staticmethod
    def mean_specs(specs: dict[str, str | Column]) -> dict[str, tuple[str, Column]]:
        """Running aggregates behind :meth:`expanding_mean`."""
        sums = {f"__s_{n}": ("sum", col(c)) for n, c in specs.items()}
        present = lambda c: F.when(col(c).isNotNull(), F.lit(1)).otherwise(F.lit(0))
        return sums | {f"__k_{n}": ("sum", present(c)) for n, c in specs.items()}

    def expanding_mean(self, specs: dict[str, str | Column]) -> Frame:
        out = self.cumulative(self.mean_specs(specs))
        out = out.add({n: div(f"__s_{n}", F.col(f"__k_{n}").cast("double")) for n in specs})
        return out.drop(*[f"__s_{n}" for n in specs], *[f"__k_{n}" for n in specs])

    @staticmethod
    def streak_specs(specs: dict[str, Column]) -> dict[str, tuple[str, Column]]:
        """Running aggregates behind :meth:`streak`: the last row where the flag failed."""
        failed = lambda c: ~F.coalesce(c, F.lit(False))
        return {f"__z_{n}": ("max", F.when(failed(c), F.col("__rn"))) for n, c in specs.items()}

    def streak(self, specs: dict[str, Column]) -> Frame:
        """Rows since the flag last failed: run length ending here (0 while false)."""
        out = self.cumulative(self.streak_specs(specs))
        out = out.add(
            {n: (F.col("__rn") - F.coalesce(F.col(f"__z_{n}"), F.lit(-1))).cast("int") for n in specs}
        )
        return out.drop(*[f"__z_{n}" for n in specs])

    def keep_numbered(self, kept: Column, name: str = "row_idx") -> DataFrame:
        """Finished rows where ``kept`` holds, numbered from 0 within their series."""
        one = F.when(kept, F.lit(1).cast("long"))
        out = self.add({"__kept": one}).cumulative({"__pos": ("sum", "__kept")}, own_rows=True)
        out = out.add({name: F.when(F.col("__kept").isNotNull(), F.col("__pos") - 1)})
        return out.finish().filter(F.col(name).isNotNull())

    def ffill(self, names: Sequence[str]) -> Frame:
        return self.cumulative({n: ("last", F.col(n)) for n in names}, own_rows=True)

    # -- exponential mean -------------------------------------------------
    def ema(self, specs: dict[str, tuple[str, int]]) -> Frame:
        """y0 = x0, yt = a*xt + (1-a)*y(t-1), a = 2/(span+1), from the first value that is not null.

        A null keeps the mean and fades it: after m nulls the mean before weighs (1-a)^(m+1) against a, so a value is an affine map of
        the mean, and a null is the identity. Maps are composed by :func:`fading_sums`. In blocked mode the cells' composed
        maps give the exact mean before each block; nothing is cut off. Valid where :meth:`cumulative` is.
        """
        plain = {n: s for n, s in specs.items() if s[1] > 1}
        direct = {n: src for n, (src, span) in specs.items() if span <= 1}  # the last value itself
        out = self.cumulative({n: ("last", F.col(src)) for n, src in direct.items()}) if direct else self
        if not plain:
            return out
        sources = sorted({src for src, _ in plain.values()})
        seen = {src: f"__o{i}_" for i, src in enumerate(sources)}
        number = {n: f"__m{i}_" for i, n in enumerate(plain)}
        if self.blocked:
            out = out._attach_means(plain, seen, number)
            counted = F.col("__rn") >= F.col("__blk") * self.block_rows - self._lead_in(False) * self.cell_rows
        else:
            counted = F.lit(True)
        before = self.order.rowsBetween(Window.unboundedPreceding, -1)
        last = {}
        for src, o in seen.items():
            here = F.last(F.when(counted & F.col(src).isNotNull(), F.col("__rn")), ignorenulls=True).over(before)
            last[f"{o}p"] = F.coalesce(here, F.col(f"{o}c")) if self.blocked else here
        out = out.add(last)
        maps = {}
        for n, (src, span) in plain.items():
            p, x, here = F.col(f"{seen[src]}p"), F.col(src).cast("double"), counted & F.col(src).isNotNull()
            fade, add_ = affine(x, F.col("__rn") - p, 2.0 / (span + 1.0))
            maps[f"{number[n]}l"] = F.when(here & p.isNotNull(), fade)
            maps[f"{number[n]}b"] = F.when(here, F.when(p.isNull(), x).otherwise(add_))
        out = out.add(maps)
        out = replace(out, df=fading_sums(out.df, self.keys, self.ts, list(number.values())))
        ys = {}
        for n, (src, _) in plain.items():
            m, begun = number[n], F.col(f"{seen[src]}p").isNotNull() | (counted & F.col(src).isNotNull())
            early = F.coalesce(F.col(f"{m}c") * F.exp(F.col(f"{m}s")), F.lit(0.0)) if self.blocked else F.lit(0.0)
            ys[n] = F.when(begun, F.col(f"{m}y") + early)
        out = out.add(ys)
        return out.drop(*[c for c in out.df.columns if c.startswith(("__o", "__m")) and c[:-1] in (*seen.values(), *number.values())])

    def _attach_means(self, specs: dict[str, tuple[str, int]], seen: dict[str, str], number: dict[str, str]) -> Frame:
        """Join the last row with a value (``<seen>c``) and the means (``<number>c``) as they are before each block's first counted row.

        Own rows of a cell are composed to one map; cells of a series are one narrow row each.
        """
        cell = F.floor(F.col("__rn") / F.lit(self.cell_rows)).cast("long")
        rows = self.df.filter(self._own()).withColumn("__cell", cell)
        inside = Window.partitionBy(*self.keys, "__cell")
        before = inside.orderBy(self.ts).rowsBetween(Window.unboundedPreceding, -1)
        upto = inside.orderBy(self.ts).rowsBetween(Window.unboundedPreceding, 0)
        value = {src: F.col(src).isNotNull() for src in seen}
        rows = rows.withColumns({f"{o}p": F.last(F.when(value[s], F.col("__rn")), ignorenulls=True).over(before) for s, o in seen.items()})
        maps = {}
        for n, (src, span) in specs.items():
            p = F.col(f"{seen[src]}p")
            fade, add_ = affine(F.col(src).cast("double"), F.col("__rn") - p, 2.0 / (span + 1.0))
            maps |= {f"{number[n]}l": F.when(value[src] & p.isNotNull(), fade), f"{number[n]}b": F.when(value[src] & p.isNotNull(), add_)}
        rows = rows.withColumns(maps)
        logs = {f"{m}s": F.coalesce(F.sum(f"{m}l").over(upto), F.lit(0.0)) for m in number.values()}
        logs |= {f"{m}t": F.coalesce(F.sum(f"{m}l").over(inside), F.lit(0.0)) for m in number.values()}
        rows = rows.withColumns(logs)
        ends = []
        for src, o in seen.items():
            at = F.when(value[src], F.col("__rn"))
            ends += [F.min(at).alias(f"{o}f"), F.max(at).alias(f"{o}l"), F.min_by(F.col(src).cast("double"), at).alias(f"{o}x")]
        for m in number.values():
            whole = F.sum(F.col(f"{m}b") * F.exp(F.col(f"{m}t") - F.col(f"{m}s")))
            ends += [F.max(f"{m}t").alias(f"{m}t"), F.coalesce(whole, F.lit(0.0)).alias(f"{m}r")]
        cells = materialize(rows.groupBy(*self.by, "__cell").agg(*ends))
        cells = prefix_scan(cells, self.by, "__cell", {f"{o}c": ("last", F.col(f"{o}l")) for o in seen.values()})
        maps = {}
        for n, (src, span) in specs.items():
            o, m = seen[src], number[n]
            f_, p, x = (F.col(f"{o}{k}") for k in "fcx")
            fade, add_ = affine(x, f_ - p, 2.0 / (span + 1.0))
            maps[f"{m}l"] = F.when(f_.isNotNull() & p.isNotNull(), fade + F.col(f"{m}t"))
            maps[f"{m}b"] = F.when(f_.isNotNull(), F.when(p.isNull(), x).otherwise(add_) * F.exp(F.col(f"{m}t")) + F.col(f"{m}r"))
        cells = fading_sums(cells.withColumns(maps), self.by, "__cell", list(number.values()))
        ordered = Window.partitionBy(*self.by).orderBy("__cell")
        cells = cells.withColumns({f"{m}c": F.when(F.col(f"{seen[specs[n][0]]}c").isNotNull(), F.lag(f"{m}y").over(ordered)) for n, m in number.items()})
        per_block = self.block_rows // self.cell_rows
        shifted = F.col("__cell") + F.lit(self._lead_in(False))
        carries = cells.filter(shifted % per_block == 0).select(
            *self.by, (shifted / per_block).cast("long").alias("__blk"), *[f"{o}c" for o in seen.values()], *[f"{m}c" for m in number.values()]
        )
        return replace(self, df=self.df.join(carries, self.keys, "left"))


def task_count(df: DataFrame, extent: Extent, block_rows: int) -> int:
    """Partitions for the window stage: about one block of rows each.

    Windows are compute-bound and widen rows a lot, so the count follows the
    rows, not the bytes; few small series are spread over the local cores.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return max(1, min(-(-extent.rows // block_rows), MAX_TASKS), min(2 * extent.series, cores))


def lay_out(
    rows: DataFrame,
    by: Sequence[str] = ("symbol",),
    ts: str = "ts",
    lookback: int = 0,
    lookahead: int = 0,
    block_rows: int = BLOCK_ROWS,
    cell_rows: int = CELL_ROWS,
    materialized: bool = False,
) -> Frame:
    """Number the rows of every series and distribute them in bounded blocks.

    ``lookback`` / ``lookahead`` are the rows a feature may read before and
    after its own.  ``(by, ts)`` must be unique.  Rows are read more than
    once, so they are checkpointed first unless already ``materialized``.
    """
    if block_rows % cell_rows:
        raise ValueError("block_rows must be a multiple of cell_rows")
    by = tuple(by)
    if not materialized:
        rows = materialize(rows)
    extent = series_extent(rows, by, ts)
    if extent.longest <= block_rows:
        rows = rows.repartition(task_count(rows, extent, block_rows), *by)
        frame = Frame(rows, by, ts, False, block_rows, cell_rows)
        return frame.add({"__rn": (F.row_number().over(frame.order) - 1).cast("long")})

    width = choose_bucket_width(rows, by, ts, extent, block_rows)
    keyed = rows.withColumn("__bkt", bucket_column(rows, ts, extent.lo, width))
    counts = keyed.groupBy(*by, "__bkt").agg(F.count(F.lit(1)).alias("__cnt"))
    counts = materialize(counts)
    starts = prefix_scan(counts, by, "__bkt", {"__start": ("sum", F.col("__cnt"))})
    halo_cells = -(-lookback // cell_rows) + 1 if lookback else 0  # one more cell to warm up running inputs
    size, back = F.lit(block_rows), F.lit(halo_cells * cell_rows)
    start = F.coalesce(F.col("__start"), F.lit(0)).cast("long")
    first = F.greatest(F.floor((start - F.lit(lookahead)) / size), F.lit(0)).cast("long")
    final = (F.ceil((start + F.col("__cnt") + back) / size) - 1).cast("long")
    targets = starts.select(*by, "__bkt", start.alias("__start"), F.sequence(first, final).alias("__to"))
    shipped = (
        keyed.join(targets, [*by, "__bkt"]).withColumn("__blk", F.explode("__to")).drop("__bkt", "__to")
    )
    shipped = shipped.repartition(task_count(rows, extent, block_rows), *by, "__blk")
    frame = Frame(shipped, by, ts, True, block_rows, cell_rows, halo_cells)
    upto = frame.order.rowsBetween(Window.unboundedPreceding, 0)
    frame = frame.add(
        {"__rn": (F.first("__start").over(upto) + F.row_number().over(frame.order) - 1).cast("long")}
    ).drop("__start")
    lo, hi = F.col("__blk") * size - back, (F.col("__blk") + 1) * size + F.lit(lookahead)
    return replace(frame, df=frame.df.filter((F.col("__rn") >= lo) & (F.col("__rn") < hi)))
