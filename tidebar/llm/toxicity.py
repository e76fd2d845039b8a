"""Toxicity by FTRL-proximal logistic regression over hashed word features."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidebar.llm.common import fold_of, give_back, joined_bytes, lower_ascii, text_blocks, whole_text, worker_cache

BASE, MASK = 0x100000001B3, (1 << 64) - 1
#: Bytes of text whose features are made at once; a task needs some 60 bytes of memory for each.
BLOCK_BYTES = 1 << 18


@dataclass(frozen=True)
class FtrlPlan:
    """Parameters of features and training. `sample`: labelled rows that are fitted on at most, those of the smallest
    hash of their id and text; every row is scored."""

    bits: int = 22
    sample: int = 12_000
    epochs: int = 3
    alpha: float = 0.15
    beta: float = 1.0
    l1: float = 4.0
    l2: float = 1.0
    prefixes: tuple[int, ...] = (4, 5, 6, 7)
    skips: tuple[int, ...] = (1, 2, 3)


def powers(count: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**k and its inverse modulo 2**64, k < count."""
    inverse = pow(BASE, -1, 1 << 64)
    out = []
    for base in (BASE, inverse):
        steps = np.full(count, base, dtype=np.uint64)
        steps[0] = 1
        out.append(np.multiply.accumulate(steps))
    return out[0], out[1]


def mixed(x: np.ndarray, salt: int) -> np.ndarray:
    x = x + np.uint64(0x9E3779B97F4A7C15 * (salt + 1) & MASK)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def features(texts: pa.Array, plan: FtrlPlan, wanted: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (row, feature number) pairs of the texts, sorted by row.

    Words are runs of letters, digits and bytes above 127, A-Z in lower case. Features: words, their prefixes, and pairs
    of words `skips` apart (1: bigrams, beyond: skip-grams), each present or not. wanted: a mask of features to keep.
    """
    data, offsets = joined_bytes(texts)
    data = lower_ascii(data)
    part = ((data >= 97) & (data <= 122)) | ((data >= 48) & (data <= 57)) | (data >= 128)
    plain = np.where(part, data, 32).astype(np.uint8)
    edge = np.zeros(len(plain) + 1, dtype=bool)
    edge[offsets] = True
    word = plain != 32
    if not word.any():
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    starts = np.flatnonzero(word & (np.concatenate(([True], ~word[:-1])) | edge[:-1]))
    ends = np.flatnonzero(word & (np.concatenate((~word[1:], [True])) | edge[1:])) + 1
    rows = np.searchsorted(offsets, starts, side="right") - 1
    ups, downs = worker_powers(len(plain) + 1)
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum((plain.astype(np.uint64) + np.uint64(1)) * ups[: len(plain)], dtype=np.uint64)))
    words = (sums[ends] - sums[starts]) * downs[starts]
    found = []

    def keep(hashes, at, salt):
        index = (mixed(hashes, salt) >> np.uint64(64 - plan.bits)).astype(np.int64)
        if wanted is not None:
            some = wanted[index]
            index, at = index[some], at[some]
        found.append(at << plan.bits | index)

    keep(words, rows, 0)
    first_of_char = (plain & 0xC0) != 0x80
    chars = np.flatnonzero(first_of_char)
    begins = np.cumsum(first_of_char)[starts] - 1
    for k in plan.prefixes:
        stop = begins + k
        fits = np.flatnonzero(stop < len(chars))
        at = chars[stop[fits]]
        inside = at < ends[fits]
        fits, at = fits[inside], at[inside]
        keep((sums[at] - sums[starts[fits]]) * downs[starts[fits]], rows[fits], 100)
    for k in plan.skips:
        same = np.flatnonzero(rows[k:] == rows[:-k]) if len(rows) > k else np.zeros(0, np.int64)
        keep(words[same] * np.uint64(0xD6E8FEB86659FD93) + mixed(words[same + k], k), rows[same], 200 + k)
    pairs = np.unique(np.concatenate(found))
    return pairs >> plan.bits, pairs & ((1 << plan.bits) - 1)


def worker_powers(count: int):
    held = worker_cache("powers", dict)
    if held.get("count", 0) < count:
        held["count"] = max(count, BLOCK_BYTES * 2)
        held["tables"] = powers(held["count"])
    return held["tables"]


def train(texts: list[str] | pa.ChunkedArray, labels: list[int], plan: FtrlPlan) -> tuple[np.ndarray, np.ndarray, float]:
    """FTRL-proximal with one learning rate a coordinate; feature numbers, weights other than zero, and the bias."""
    if not isinstance(texts, pa.ChunkedArray):
        texts = pa.chunked_array([pa.array(texts, pa.large_string())])
    size = 1 << plan.bits
    z, n = np.zeros(size + 1), np.zeros(size + 1)

    def weights(at):
        zi = z[at]
        w = -(zi - np.sign(zi) * plan.l1) / ((plan.beta + np.sqrt(n[at])) / plan.alpha + plan.l2)
        return np.where(np.abs(zi) <= plan.l1, 0.0, w)

    rows = []  # views of one array a block
    for chunk in texts.chunks:
        for _, block in text_blocks(chunk, BLOCK_BYTES):
            at, index = features(block, plan)
            counts = np.bincount(at, minlength=len(block))
            # every row also has the bias, whose number is the largest
            flat = np.insert(index, np.cumsum(counts), size).astype(np.int32)
            rows += np.split(flat, np.cumsum(counts + 1)[:-1])
    order = np.random.default_rng(7)
    for _ in range(plan.epochs):
        for i in order.permutation(len(rows)):
            at = rows[i]
            w = weights(at)
            p = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35)))
            g = p - labels[i]
            ni = n[at]
            sigma = (np.sqrt(ni + g * g) - np.sqrt(ni)) / plan.alpha
            z[at] += g - sigma * w
            n[at] = ni + g * g
    kept, found = [], []
    for first in range(0, size, 1 << 16):  # a few MB at a time
        at = np.arange(first, min(first + (1 << 16), size))
        w = weights(at)
        some = np.flatnonzero(w)
        kept.append(at[some])
        found.append(w[some])
    return np.concatenate(kept), np.concatenate(found), float(weights(np.array([size]))[0])


def fit(docs: DataFrame, labels: DataFrame, plan: FtrlPlan = FtrlPlan()) -> tuple[np.ndarray, np.ndarray, float]:
    """The model, learnt from at most plan.sample labelled rows in one task; only weights reach the driver, 12 bytes
    for each of at most 2**plan.bits features.

    labels: doc_id and toxic (0 or 1; others and null ids are left out; where an id repeats, its largest label
    counts). Without labelled rows of both kinds every score is the share of toxic rows, 0.5 without any.
    """
    known = labels.where("doc_id is not null and toxic in (0, 1)").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("__toxic"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(plan.sample)
    # at most plan.sample ids of 12 bytes
    rows = docs.join(F.broadcast(chosen), "doc_id").select("doc_id", whole_text().alias("text"), "__toxic")
    rows = rows.orderBy(F.xxhash64("doc_id", "text"), "doc_id", "text").limit(plan.sample)

    def learn(batches):
        texts, marks = [], []
        for batch in batches:
            texts.append(batch.column("text"))
            marks += batch.column("__toxic").to_pylist()
        if len(set(marks)) < 2:
            share = min(max((sum(marks) + 0.5) / (len(marks) + 1), 1e-6), 1 - 1e-6)
            index, w, bias = np.zeros(0, np.int64), np.zeros(0), float(np.log(share / (1 - share)))
        else:
            index, w, bias = train(pa.chunked_array(texts), marks, plan)
        del texts
        give_back()
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.append(index, -1).astype(np.int64)), pa.array(np.append(w, bias))], names=["feature", "weight"]
        )

    model = rows.select("text", "__toxic").coalesce(1).mapInArrow(learn, "feature long, weight double").toArrow()
    index, w = np.asarray(model.column("feature")), np.asarray(model.column("weight"))
    if not len(index):
        return np.zeros(0, np.int64), np.zeros(0), 0.0
    return index[:-1], w[:-1], float(w[-1])


def toxicity(model, plan: FtrlPlan = FtrlPlan(), spark=None) -> Column:
    """Column of scores from 0 to 1 of the whole texts; null and empty texts get the model's bias alone."""
    index, w, bias = model
    shared = spark.sparkContext.broadcast((index.astype(np.int32), w.astype(np.float32)))

    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        index, w = shared.value
        dense = np.zeros(1 << plan.bits, dtype=np.float32)
        dense[index] = w
        wanted = dense != 0
        out = np.full(len(texts), float(bias))
        for first, block in text_blocks(texts, BLOCK_BYTES):
            at, which = features(block, plan, wanted)
            out[first : first + len(block)] += np.bincount(at, weights=dense[which].astype(float), minlength=len(block))
            del at, which
        give_back()
        return pa.array(1 / (1 + np.exp(-np.clip(out, -35, 35))))

    return score(whole_text())


def held_out(folds: int = 5) -> Column:
    return fold_of("doc_id", folds) == 0


def toxicity_scores(docs: DataFrame, labels: DataFrame, plan: FtrlPlan = FtrlPlan()) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted. Labels of held-out rows are not learnt from."""
    model = fit(docs, labels.where(~held_out()), plan)
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"),
        toxicity(model, plan, docs.sparkSession).alias("score"),
    ).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def drop_toxic(docs: DataFrame, labels: DataFrame, plan: FtrlPlan = FtrlPlan()) -> DataFrame:
    """docs without those predicted toxic; all columns stay."""
    model = fit(docs, labels.where(~held_out()), plan)
    return docs.withColumn("__score", toxicity(model, plan, docs.sparkSession)).where("__score < 0.5").drop("__score")
