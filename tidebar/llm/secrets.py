"""Secrets by an inverted index over trigrams, whose candidates the patterns verify."""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidebar.llm.common import give_back, joined_bytes, lower_ascii, text_blocks, whole_text


#: Bytes of text that redaction, whose workers share an executor with full shuffles, indexes at once.
REDACTED_BYTES = 1 << 20


@dataclass(frozen=True)
class Rule:
    """A kind of secret: ASCII pattern over UTF-8 bytes; matches are leftmost and do not overlap, those whose `group`
    is shorter than `least` are dropped."""

    kind: str
    pattern: str
    least: int = 0
    group: int = 0

    def compiled(self):
        return re.compile(self.pattern.encode())


# fixed values: the three kinds every scan has, then public token formats
BASE = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 6, 2),
    Rule("access", r"AKIA[A-Z0-9]+", 20),
    Rule("hex", r"[0-9a-f]+", 24),
)
RULES = BASE + (
    # with its body: to the END line of the same kind, or to the end of the text
    Rule("private_key", r"-----BEGIN ((?:[A-Z]+ )*)PRIVATE KEY-----(?s:.*?)(?:-----END \1PRIVATE KEY-----|\Z)"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[0-9A-Za-z_-]{35}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
)

# Boolean trigram queries -------------------------------------------------------------------------------------------
# A query is None (every text is a candidate), ("and", [queries]), ("or", [queries]) or a trigram (3 bytes, A-Z in lower case).

#: Spellings that one stretch of a pattern may have before it is cut in two.
SPELLINGS = 64


def every(parts: list):
    parts = [p for p in parts if p is not None]
    return None if not parts else parts[0] if len(parts) == 1 else ("and", parts)


def some(parts: list):
    return None if any(p is None for p in parts) else parts[0] if len(parts) == 1 else ("or", parts)


def of_string(text: bytes):
    return every([text[i : i + 3] for i in range(len(text) - 2)])


def of_spellings(texts: set[bytes]):
    return some([of_string(t) for t in sorted(texts)])


def trigram_query(pattern: str):
    """What each match must hold, from the parsed pattern; case is ignored, so queries never miss a match."""
    from re import _parser

    query, spellings = walk(list(_parser.parse(pattern)))
    return every([query, of_spellings(spellings) if spellings is not None else None])


def walk(items: list):
    """(query, spellings): all spellings of the items if they are few, else None, with what is mandatory in the query."""
    from re import _constants as K

    queries, run, whole = [], {b""}, True

    def cut():
        nonlocal run, whole
        queries.append(of_spellings(run))
        run, whole = {b""}, False

    for op, value in items:
        choices, inner = None, None
        if op is K.LITERAL:
            choices = {chr(value).lower().encode()}
        elif op is K.IN and all(o is K.LITERAL for o, _ in value) and len(value) <= 8:
            choices = {chr(v).lower().encode() for _, v in value}
        elif op is K.SUBPATTERN:
            inner, choices = walk(list(value[-1]))
        elif op is K.BRANCH:
            found = [walk(list(branch)) for branch in value[1]]
            if all(c is not None for _, c in found):
                choices = set().union(*(c for _, c in found))
            else:
                inner = some([every([q, of_spellings(c) if c is not None else None]) for q, c in found])
        elif op is K.MAX_REPEAT or op is K.MIN_REPEAT:
            low, high, body = value
            query, few = walk(list(body))
            if few is not None and high == 1:
                choices = few | {b""} if low == 0 else few
            elif few is not None and low == high and len(few) ** low <= SPELLINGS:
                choices = {b""}
                for _ in range(low):
                    choices = {a + b for a in choices for b in few}
            elif low:
                inner = every([query, of_spellings(few) if few is not None else None])
        elif op is K.AT:
            continue
        queries.append(inner)
        if choices is None:
            cut()
            continue
        if len(run) * len(choices) > SPELLINGS:
            cut()
        run = {a + b for a in run for b in choices}
    if whole:
        return every(queries), run
    queries.append(of_spellings(run))
    return every(queries), None


def terms(query) -> set[bytes]:
    if query is None:
        return set()
    return {query} if isinstance(query, bytes) else set().union(*map(terms, query[1]))


class Index:
    """Postings (sorted row numbers) of chosen trigrams over one block of texts."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, wanted: list[bytes]):
        self.rows = np.arange(len(offsets) - 1)
        self.postings = {t: np.zeros(0, np.int64) for t in wanted}
        if len(data) < 3 or not wanted:
            return
        low = lower_ascii(data)
        number = np.zeros(1 << 24, dtype=np.uint16)
        for i, t in enumerate(wanted):
            number[int.from_bytes(t, "big")] = i + 1
        codes = low[:-2].astype(np.uint32) << 16 | low[1:-1].astype(np.uint32) << 8 | low[2:]
        term = number[codes]
        at = np.flatnonzero(term)
        row = np.searchsorted(offsets, at, side="right") - 1
        inside = at + 3 <= offsets[row + 1]
        pairs = np.unique(term[at[inside]].astype(np.int64) * len(offsets) + row[inside])
        which, row = pairs // len(offsets) - 1, pairs % len(offsets)
        cuts = np.searchsorted(which, np.arange(len(wanted) + 1))
        self.postings = {t: row[a:b] for t, a, b in zip(wanted, cuts[:-1], cuts[1:])}

    def candidates(self, query) -> np.ndarray:
        if query is None:
            return self.rows
        if isinstance(query, bytes):
            return self.postings[query]
        found = [self.candidates(q) for q in query[1]]
        out = found[0]
        for more in found[1:]:
            out = np.intersect1d(out, more, assume_unique=True) if query[0] == "and" else np.union1d(out, more)
        return out


def find(block: pa.Array, rules: tuple[Rule, ...] = RULES) -> dict[int, list[tuple[int, int, int]]]:
    """Row -> (rule number, start, end) in code points, sorted by start then rule; rows without a match are left out."""
    queries = [trigram_query(r.pattern) for r in rules]
    data, offsets = joined_bytes(block)
    index = Index(data, offsets, sorted(set().union(*map(terms, queries))))
    raw = data.tobytes()
    found: dict[int, list] = {}
    for number, (rule, query) in enumerate(zip(rules, queries)):
        pattern = rule.compiled()
        for row in index.candidates(query):
            a, b = int(offsets[row]), int(offsets[row + 1])
            for match in pattern.finditer(raw[a:b]):
                if match.end(rule.group) - match.start(rule.group) >= rule.least:
                    found.setdefault(int(row), []).append((number, match.start(), match.end()))
    for row, spans in found.items():
        a, b = offsets[row], offsets[row + 1]
        points = np.concatenate(([0], np.cumsum((data[a:b] & 0xC0) != 0x80)))
        found[row] = sorted(((n, int(points[s]), int(points[e])) for n, s, e in spans), key=lambda x: (x[1], x[0], x[2]))
    return found


def as_text(spans: list[tuple[int, int, int]], rules: tuple[Rule, ...]) -> str:
    return ",".join(f"{rules[n].kind}:{s}:{e}" for n, s, e in spans)


def secret_spans(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """One row per document: doc_id, spans (array of kind, start, end in code points, by start then rule order).

    Each task builds the index of its own block of texts, intersects postings and verifies candidates in the whole texts;
    nothing is shuffled. Null and empty texts have no spans; repeated rows are each scanned.
    """
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), spans_of(rules).alias("spans"))


def spans_of(rules: tuple[Rule, ...] = RULES) -> Column:
    @F.arrow_udf("array<struct<kind:string,start:long,end:long>>")
    def scan(texts: pa.Array) -> pa.Array:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        rows: list[list] = [[] for _ in range(len(texts))]
        for first, block in text_blocks(texts):
            for row, spans in find(block, rules).items():
                rows[first + row] = [{"kind": rules[n].kind, "start": s, "end": e} for n, s, e in spans]
        return pa.array(rows, kind)

    return scan(whole_text())


def secret_digest(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """secret_spans as counts of the base kinds, the digest of their spans, and all spans as text."""
    found = secret_spans(docs, rules)
    base = F.filter("spans", lambda x: x["kind"].isin([r.kind for r in BASE]))

    def count(kind):
        return F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")

    def text(spans):
        return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")

    return found.select(
        "doc_id", *[count(r.kind) for r in BASE], F.sha2(text(base).cast("binary"), 256).alias("base_sha256"),
        text(F.col("spans")).alias("spans"),
    )


def changed_texts(texts: pa.Array, rules: tuple[Rule, ...], mark: str) -> pa.Array:
    """The texts that redaction changes, null for all others: most have no secret and need not travel back."""
    out: list[str | None] = [None] * len(texts)
    for first, block in text_blocks(texts, REDACTED_BYTES):
        for row, spans in find(block, rules).items():
            text, parts, done = block[row].as_py(), [], 0
            merged: list[list[int]] = []
            for _, s, e in spans:
                if merged and s < merged[-1][1]:
                    merged[-1][1] = max(merged[-1][1], e)
                else:
                    merged.append([s, e])
            for s, e in merged:
                parts += [text[done:s], mark]
                done = e
            out[first + row] = "".join(parts) + text[done:]
    return pa.array(out, pa.string())


def redacted(rules: tuple[Rule, ...] = RULES, mark: str = "[secret]") -> Column:
    """The text with every span, overlapping ones as one, replaced by mark; null stays null."""

    @F.arrow_udf("string")
    def replace(texts: pa.Array) -> pa.Array:
        changed = changed_texts(texts, rules, mark)
        give_back()
        return changed

    text = F.col("text").cast("string")
    return F.coalesce(replace(text), text)


def redact_secrets(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """docs with secrets replaced in text, and n_chars counted anew where it is a column; all rows and columns stay."""
    cleaned = docs.withColumn("text", redacted(rules))
    if "n_chars" in docs.columns:
        cleaned = cleaned.withColumn("n_chars", F.when(F.col("n_chars").isNotNull(), F.length("text")).cast(docs.schema["n_chars"].dataType))
    return cleaned.select(*docs.columns)


def span_digest(spans: list[tuple[int, int, int]], rules: tuple[Rule, ...] = RULES) -> str:
    """base_sha256 of one text's spans, for tests."""
    return hashlib.sha256(as_text([x for x in spans if x[0] < len(BASE)], rules).encode()).hexdigest()
