"""Periodic runs of words, found with a grammar made by recompression."""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidebar.llm.common import distinct_words, joined_bytes, split_words, text_blocks, whole_text

#: Shortest run, its least exponent, words after a grid point that must repeat (any such run has 8 there), grid points at a time.
LEAST, EXPONENT, PROBE, GRID = 24, 3, 8, 1 << 20
#: A grammar is tall enough once no document has more symbols than this; the rest is walked.
TOP = 8


class Grammar:
    """Levels of symbols over documents that lie one after the other.

    Block compression turns a stretch of one symbol into one symbol of that symbol and its length; pair compression then
    parts the symbols in two classes by a hash and turns each neighbouring pair from the first and the second class into one symbol.
    Equal stretches get equal symbols but for a few at their ends, so two places are compared in a few steps a level.
    Negative symbols are ends of documents: each stands once and is left alone.
    """

    def __init__(self, symbols: np.ndarray):
        self.levels = []  # (kind, symbols, first child of each parent, parent of each symbol, children of each parent)
        current, number = symbols.astype(np.int64), 0
        while longest_stretch(current) > TOP:
            first = block_starts(current)
            current = self.climb("block", current, first)
            first = pair_starts(current, number)
            current = self.climb("pair", current, first)
            number += 1
        self.top = current

    def climb(self, kind: str, current: np.ndarray, first: np.ndarray) -> np.ndarray:
        starts = np.flatnonzero(first)
        sizes = np.diff(np.append(starts, len(current)))
        parent = np.cumsum(first) - 1
        self.levels.append((kind, current, starts, parent, sizes))
        head = current[starts]
        tail = sizes if kind == "block" else np.where(sizes == 2, current[np.minimum(starts + 1, len(current) - 1)], -1)
        free = head < 0
        out = np.empty(len(starts), np.int64)
        out[free] = head[free]
        rows = np.stack((head[~free], tail[~free]), axis=1)
        order = np.lexsort((rows[:, 1], rows[:, 0]))
        new = np.ones(len(rows), bool)
        new[1:] = (rows[order[1:]] != rows[order[:-1]]).any(axis=1)
        named = np.empty(len(rows), np.int64)
        named[order] = np.cumsum(new) - 1
        out[~free] = named
        return out

    def common(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Words that the texts from place x[k] and from place y[k] on have in common (x < y)."""
        begin, x, y = x, x.copy(), y.copy()
        height = np.full(len(x), len(self.levels), np.int64)  # level at which symbols first differ
        going = np.arange(len(x))
        for level, (kind, symbols, starts, parent, sizes) in enumerate(self.levels):
            a, b = x[going], y[going]
            above_a, above_b = parent[a], parent[b]
            inside_a, inside_b = a - starts[above_a], b - starts[above_b]
            # both to a start of a parent: past what is left of the two parents, if both begin with the same symbol. The second
            # of a pair equals another second or a single symbol; of two blocks the shorter rest counts
            step = ((inside_a > 0) | (inside_b > 0)) & (symbols[a] == symbols[b])
            far = 1 if kind == "pair" else np.minimum(sizes[above_a] - inside_a, sizes[above_b] - inside_b)
            a, b = a + step * far, b + step * far
            differ = symbols[a] != symbols[b]
            x[going], y[going] = a, b
            height[going[differ]] = level
            going, a, b = going[~differ], a[~differ], b[~differ]
            x[going], y[going] = parent[a], parent[b]
        while len(going):  # the top, of a few symbols a document
            going = going[self.top[x[going]] == self.top[y[going]]]
            x[going] += 1
            y[going] += 1
        for level in range(len(self.levels) - 1, -1, -1):
            kind, symbols, starts, _, sizes = self.levels[level]
            down = np.flatnonzero(height > level)
            above_a, above_b = x[down], y[down]
            a, b = starts[above_a], starts[above_b]
            # unlike parents share at most their first child, or the shorter block
            far = 1 if kind == "pair" else np.minimum(sizes[above_a], sizes[above_b])
            same = symbols[a] == symbols[b]
            x[down], y[down] = a + same * far, b + same * far
        return x - begin


def longest_stretch(symbols: np.ndarray) -> int:
    ends = np.flatnonzero(symbols < 0)
    return int(np.diff(ends).max(initial=1)) - 1


def block_starts(symbols: np.ndarray) -> np.ndarray:
    first = np.ones(len(symbols), bool)
    first[1:] = symbols[1:] != symbols[:-1]
    return first


def pair_starts(symbols: np.ndarray, number: int) -> np.ndarray:
    """False for the second of each pair. Classes come from a hash, the way round that makes more pairs."""
    mixed = (symbols + 1).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(number * 0xBF58476D1CE4E5B9 % (1 << 64))
    mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    side = (mixed >> np.uint64(63)).astype(bool)
    inner = (symbols[1:] >= 0) & (symbols[:-1] >= 0)
    up, down = inner & ~side[:-1] & side[1:], inner & side[:-1] & ~side[1:]
    first = np.ones(len(symbols), bool)
    first[1:] = ~(up if up.sum() >= down.sum() else down)
    return first


def grid_candidates(words: np.ndarray, begin: np.ndarray, size: np.ndarray):
    """Arrays (document, period q, place i): i is a multiple of q, counted from the document's first word, and the PROBE words
    from i on equal those q later. A run of period q has such a point among its first q words."""
    order = np.argsort(-size, kind="stable")
    fits = size[order]
    q = 1
    while len(fits) and fits[0] >= max(LEAST, EXPONENT * q):
        parts, total = [], 0
        while total < GRID and len(fits) and fits[0] >= max(LEAST, EXPONENT * q):
            docs = order[: int(np.searchsorted(-fits, -max(LEAST, EXPONENT * q), side="right"))]
            points = (size[docs] - PROBE - q) // q + 1
            many = np.repeat(np.arange(len(docs)), points)
            at = np.arange(len(many)) - np.repeat(np.cumsum(points) - points, points)
            place = begin[docs][many] + at * q
            ok = words[place] == words[place + q]
            parts.append((docs[many][ok], np.full(int(ok.sum()), q), place[ok]))
            total += len(many)
            q += 1
        found = [np.concatenate(x) for x in zip(*parts)]
        for k in range(1, PROBE):
            ok = words[found[2] + k] == words[found[2] + found[1] + k]
            found = [x[ok] for x in found]
        if len(found[0]):
            yield found


def periodic_runs(words: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, ...]:
    """document, start, length, period of all runs, in this order; words of documents lie one after the other."""
    begin = np.cumsum(size) - size
    nothing = (np.zeros(0, np.int64),) * 4
    found = [np.concatenate(x) for x in zip(*grid_candidates(words, begin, size))]
    if not found:
        return nothing
    # the grammars hold the documents with a candidate alone, one by one between ends of their own
    held = np.unique(found[0])
    length = size[held]
    shift = np.zeros(len(size), np.int64)
    shift[held] = np.cumsum(length + 1) - length  # place of the first word
    total = int((length + 1).sum()) + 1
    symbols = np.empty(total, np.int64)
    ends = np.append(shift[held] - 1, total - 1)
    inside = np.ones(total, bool)
    inside[ends] = False
    source = np.arange(int(length.sum())) + np.repeat(begin[held] - (np.cumsum(length) - length), length)
    symbols[inside] = words[source]
    symbols[ends] = -1 - np.arange(len(ends))
    forward, backward = Grammar(symbols), Grammar(symbols[::-1])
    doc, q, i = found
    i = i - begin[doc] + shift[doc]
    out = []
    while len(doc):
        # grid points that follow each other at distance q are asked by the first of them; those beyond its run come again
        lead = np.ones(len(doc), bool)
        lead[1:] = (q[1:] != q[:-1]) | (i[1:] - i[:-1] != q[1:]) | (doc[1:] != doc[:-1])
        group = np.cumsum(lead) - 1
        a, p = i[lead], q[lead]
        high = a + p + forward.common(a, a + p)
        low = a - backward.common(total - (a + p), total - a)
        out.append((doc[lead], low, high, p))
        rest = i + q >= high[group]
        doc, q, i = doc[rest], q[rest], i[rest]
    doc, low, high, p = (np.concatenate(x) for x in zip(*out))
    long_enough = high - low >= np.maximum(LEAST, EXPONENT * p)
    doc, low, high, p = (x[long_enough] for x in (doc, low, high, p))
    # a stretch is found under multiples of its period too; the smallest counts
    order = np.lexsort((p, high, low, doc))
    doc, low, high, p = (x[order] for x in (doc, low, high, p))
    first = np.ones(len(doc), bool)
    first[1:] = (doc[1:] != doc[:-1]) | (low[1:] != low[:-1]) | (high[1:] != high[:-1])
    doc, low, high, p = (x[first] for x in (doc, low, high, p))
    order = np.lexsort((p, low, doc))
    return tuple(x[order] for x in (doc, low - shift[doc], high - low, p))


def repeated_part(count: int, doc_id) -> tuple[int, int] | None:
    """(a, p) for the documents that are rewritten: word i >= a is original word a + (i - a) % p."""
    h = zlib.crc32(("" if doc_id is None else str(doc_id)).encode())
    if h % 10 or not count:
        return None
    g = h // 10
    a = g % count
    return a, 1 + (count - a) // (3 + g % 8)


def rewritten(sizes: np.ndarray, ids: list) -> np.ndarray:
    """The original place of every word of the rewritten documents."""
    places = np.arange(int(sizes.sum()))
    begin = (np.cumsum(sizes) - sizes).tolist()
    for first, count, doc_id in zip(begin, sizes.tolist(), ids):
        part = repeated_part(count, doc_id)
        if part:
            a, p = part
            places[first + a : first + count] = first + a + np.arange(count - a) % p
    return places


def best_run(starts: list, lengths: list, periods: list) -> int:
    """Greatest exact length / period, then smallest start, then period."""
    best = 0
    for k in range(1, len(starts)):
        more = lengths[k] * periods[best] - lengths[best] * periods[k]
        if more > 0 or more == 0 and (starts[k], periods[k]) < (starts[best], periods[best]):
            best = k
    return best


SCHEMA = (
    "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, "
    "collapsed_sha256 string, n_words long, n_kept long"
)


def block_rows(ids: list, block: pa.Array) -> list[tuple]:
    """The rows of SCHEMA for some whole documents."""
    data, offsets = joined_bytes(block)
    starts, ends, rows = split_words(data, offsets)
    sizes = np.bincount(rows, minlength=len(block)).astype(np.int64)
    places = rewritten(sizes, ids)
    codes, words = distinct_words(data, starts, ends)
    codes = codes[places]
    doc, first, length, period = periodic_runs(codes, sizes)
    begin = np.cumsum(sizes) - sizes
    # words under a run after its first q, by where such parts begin and end
    change = np.zeros(len(codes) + 1, np.int64)
    np.add.at(change, begin[doc] + first + period, 1)
    np.add.at(change, begin[doc] + first + length, -1)
    kept = np.cumsum(change)[:-1] == 0
    bounds = np.searchsorted(doc, np.arange(len(block) + 1))
    names = words.to_pylist()
    out = []
    for k, doc_id in enumerate(ids):
        low, high = int(begin[k]), int(begin[k] + sizes[k])
        stay = codes[low:high][kept[low:high]]
        collapsed = hashlib.sha256(b" ".join(map(names.__getitem__, stay.tolist()))).hexdigest()
        s, n, p = (x[bounds[k] : bounds[k + 1]].tolist() for x in (first, length, period))
        listing = hashlib.sha256("".join(f"{a},{b},{c}\n" for a, b, c in zip(s, n, p)).encode()).hexdigest()
        top = (None,) * 4
        if s:
            b = best_run(s, n, p)
            top = (s[b], n[b], p[b], 1000 * n[b] // p[b])
        out.append((doc_id, len(s), *top, listing, collapsed, high - low, len(stay)))
    return out


def periodic_digest(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_runs, start, length, period, exponent_milli, runs_sha256, collapsed_sha256, n_words,
    n_kept.

    The words of a document whose crc32(doc_id) is divisible by 10 are first rewritten by the rule of repeated_part. All grid
    points of all periods are tried; the candidates' exact extensions come from a grammar of the text and one of its reverse.

    Null and empty texts have no words and no run; a null id counts as empty text in the rule. Repeated rows and ids stand each for
    themselves. Ties for the best run go to the smallest start, then period. An empty table gives no rows; other columns play no
    part. A document is one unit of work of n log n grid points, held some 2**20 at a time, and the shorter ones share blocks of
    4 MB. One pass without a shuffle.
    """

    def measured(batches):
        for batch in batches:
            ids, texts = batch.column("doc_id").to_pylist(), batch.column("text")
            for first, block in text_blocks(texts):
                columns = zip(*block_rows(ids[first : first + len(block)], block))
                types = [pa.string() if "sha256" in name else pa.int64() for name in NAMES]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=NAMES)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text")).mapInArrow(measured, SCHEMA)


NAMES = [x.split()[0] for x in SCHEMA.split(", ")]
