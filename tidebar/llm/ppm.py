"""Scores of a language model: prediction by partial matching over bytes, learnt from the training fold."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidebar.llm.common import checkpointed, distinct_words, fold_of, joined_bytes, lower_ascii, split_words, whole_text

#: Bytes of text that share one lookup of the model; bytes of context; groups of contexts (by their last two bytes).
CHUNK_BYTES, ORDER, GROUPS = 8 << 20, 5, 1024
#: Chunks whose counts are added up in one task.
FAN = 64
#: Bytes that UTF-8 never holds: the start (never predicted) and the end of a text.
START, STOP = 0xFE, 0xFF

PACKED = "chunk long, blob binary"


def squeezed(values: np.ndarray, steps: bool = False) -> bytes:
    """An array as compressed bytes; steps: sorted numbers, kept as differences."""
    raw = (np.diff(values, prepend=values.dtype.type(0)) if steps else values).tobytes()
    return len(raw).to_bytes(8, "little") + pa.Codec("zstd").compress(raw, asbytes=True)


def spread_out(blob: bytes, kind, steps: bool = False) -> np.ndarray:
    raw = pa.Codec("zstd").decompress(blob[8:], int.from_bytes(blob[:8], "little"), asbytes=True)
    values = np.frombuffer(raw, kind)
    return np.cumsum(values, dtype=kind) if steps else values


def chunked(docs: DataFrame, chunks: int, folds: int, held: int) -> DataFrame:
    """The documents as compressed tables, a few for each chunk. A document's chunk follows from its id and text."""
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), (fold_of("doc_id", folds) == held).alias("held_out"),
        whole_text().cast("binary").alias("text"), F.pmod(F.xxhash64("doc_id", whole_text()), F.lit(chunks)).alias("chunk"),
    )

    def pack(batches):
        for batch in batches:
            chunk = np.asarray(batch.column("chunk"))
            order = np.argsort(chunk, kind="stable")
            cuts = np.flatnonzero(np.diff(chunk[order], prepend=-1))
            for a, b in zip(cuts, np.append(cuts[1:], len(order))):
                part = pa.Table.from_batches([batch.select(["doc_id", "held_out", "text"]).take(pa.array(order[a:b]))])
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, part.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                    out.write_table(part)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([int(chunk[order[a]])]), pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["chunk", "blob"]
                )

    return rows.mapInArrow(pack, PACKED)


class Chunk:
    """The documents of a chunk in an order that does not depend on how they arrived."""

    def __init__(self, blobs: list[bytes], order: int, buckets: int):
        table = pa.concat_tables([pa.ipc.open_stream(b).read_all() for b in blobs]).combine_chunks()
        ids, texts = table["doc_id"].to_pylist(), table["text"].to_pylist()
        by = sorted(range(len(ids)), key=lambda i: (ids[i] is not None, ids[i] or 0, texts[i]))
        table = table.take(pa.array(by))
        self.ids, held = table["doc_id"].combine_chunks(), table["held_out"].combine_chunks()
        self.held = np.asarray(held.to_pylist(), dtype=bool)
        data, self.offsets = joined_bytes(table["text"].combine_chunks())
        self.data, self.order, self.buckets = lower_ascii(data), order, buckets

    def words(self):
        """Code of each token, its row, training counts and buckets of the distinct words, and the words."""
        starts, ends, rows = split_words(self.data, self.offsets)
        codes, words = distinct_words(self.data, starts, ends)
        words = words.to_pylist()
        counts = np.bincount(codes[~self.held[rows]], minlength=len(words)) if len(words) else np.zeros(0, np.int64)
        bucket = np.fromiter(map(zlib.crc32, words), np.int64, len(words)) % self.buckets
        return codes, rows, counts, bucket, words

    def grams(self):
        """The gram (context and symbol) at each byte and each end of text, text by text, and where texts begin."""
        k, sizes = self.order, np.diff(self.offsets)
        pad = np.full(len(self.data) + len(sizes) * (k + 1), START, dtype=np.uint8)
        pad[np.arange(len(self.data)) + np.repeat((np.arange(len(sizes)) + 1) * (k + 1) - 1, sizes)] = self.data
        stops = self.offsets[1:] + (np.arange(len(sizes)) + 1) * (k + 1) - 1
        pad[stops] = STOP
        code = np.zeros(len(pad), dtype=np.uint64)
        for d in range(k + 1):
            code[k:] |= pad[d : len(pad) - k + d].astype(np.uint64) << np.uint64(8 * (k - d))
        return code[pad != START], self.offsets[:-1] + np.arange(len(sizes))


def group_of(grams: np.ndarray) -> np.ndarray:
    """Grams whose contexts share their last two bytes share a group."""
    return ((grams >> np.uint64(8)) & np.uint64(0xFFFF)).astype(np.int64) * 40503 % GROUPS


def by_group(keys: np.ndarray):
    """Order that sorts by key and keeps what is equal in place, and (key, from, to) of each."""
    order = np.argsort(keys, kind="stable")
    cuts = np.flatnonzero(np.diff(keys[order], prepend=-1))
    return order, [(int(keys[order[a]]), a, b) for a, b in zip(cuts, np.append(cuts[1:], len(order)))]


def train_counts(chunk: Chunk):
    """Distinct grams of a chunk and how often they stand in training texts."""
    codes, firsts = chunk.grams()
    every = np.unique(codes)
    sizes = np.diff(np.append(firsts, len(codes)))
    seen, n = np.unique(codes[np.repeat(~chunk.held, sizes)], return_counts=True)
    counts = np.zeros(len(every), np.int64)
    counts[np.searchsorted(every, seen)] = n
    return every, counts


def summed(keys: np.ndarray, values: np.ndarray):
    """Distinct sorted keys, sums of values, and where each key went."""
    found, at = np.unique(keys, return_inverse=True)
    return found, np.bincount(at, weights=values, minlength=len(found)), at


def log_probabilities(grams: np.ndarray, counts: np.ndarray, order: int, pairs: np.ndarray) -> np.ndarray:
    """log10 probability of each distinct gram's symbol after its context, all grams of one or more groups given.

    Escape method D: a context seen t times with q different symbols escapes with q / (2 t), and a symbol seen n times
    has (2 n - 1) / (2 t). On escape the symbols
    of the longer context are excluded; those seen after a context were seen after its suffix, so what
    is excluded follows from the longer context alone. pairs: counts of (byte before, symbol) in all of the training texts.
    """
    cost = np.zeros(len(grams))
    open_ = np.ones(len(grams), dtype=bool)
    # what the contexts one longer took out: total and distinct, by gram
    lost_t, lost_q = np.zeros(len(grams)), np.zeros(len(grams))
    for j in range(order, -1, -1):
        mask = np.uint64((1 << 8 * (j + 1)) - 1)
        if j >= 2:
            codes, n, at = summed(grams & mask, counts)
            _, t, ctx = summed(codes >> np.uint64(8), n)
            q = np.bincount(ctx, weights=n > 0)
            n, t, q = n[at], t[ctx][at], q[ctx][at]
        elif j == 1:
            at = (grams & mask).astype(np.int64)
            n, t, q = pairs[at], pairs.reshape(256, 256).sum(1)[at >> 8], (pairs.reshape(256, 256) > 0).sum(1)[at >> 8]
        else:
            single = pairs.reshape(256, 256).sum(0)
            n = single[(grams & mask).astype(np.int64)]
            t, q = np.full(len(grams), single.sum()), np.full(len(grams), (single > 0).sum())
        left_t, left_q = t - lost_t, q - lost_q
        known = open_ & (left_q > 0)
        hit = known & (n > 0)
        cost[hit] += np.log10((2 * n[hit] - 1) / (2 * left_t[hit]))
        miss = known & (n == 0)
        cost[miss] += np.log10(left_q[miss] / (2 * left_t[miss]))
        open_ &= ~hit
        if j:
            lost_t, lost_q = excluded(grams, counts, j, pairs), q
    cost[open_] -= np.log10(max(1, 255 - int((pairs.reshape(256, 256).sum(0) > 0).sum())))
    return cost


def excluded(grams: np.ndarray, counts: np.ndarray, j: int, pairs: np.ndarray) -> np.ndarray:
    """For each gram, the counts after its context of j - 1 bytes of all symbols that were seen after that of j bytes."""
    if j == 1:
        seen = pairs.reshape(256, 256) > 0
        lost = (seen * pairs.reshape(256, 256).sum(0)).sum(1)
        return lost[((grams >> np.uint64(8)) & np.uint64(0xFF)).astype(np.int64)]
    codes, n, at = summed(grams & np.uint64((1 << 8 * (j + 1)) - 1), counts)
    low = codes & np.uint64((1 << 8 * j) - 1)
    if j == 2:
        shorter = pairs[low.astype(np.int64)]
    else:
        known, total, where = summed(grams & np.uint64((1 << 8 * j) - 1), counts)
        shorter = total[np.searchsorted(known, low)]
    _, lost, ctx = summed(codes >> np.uint64(8), np.where(n > 0, shorter, 0))
    return lost[ctx][at]


def lm_scores(
    docs: DataFrame, order: int = ORDER, folds: int = 7, held: int = 2, chunk_bytes: int = CHUNK_BYTES,
) -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    score: log10 probability of the lower-cased bytes of the text and its end under a byte trie with contexts of
    `order` bytes, learnt from all documents but those whose crc32(doc_id) mod folds is held. base_score: unigrams of words with
    one added. Null text is empty; repeated rows count and are scored each; an empty table gives no rows.

    The model is as large as the corpus makes it and is never whole in one place. Documents are dealt into chunks.
    Each chunk asks for the words and grams that it holds: counts are added by word bucket and by context group, and
    what comes back to a chunk is one number for each of its own distinct words and grams.
    """
    if not 2 <= order <= 7:
        raise ValueError("order must be from 2 to 7")
    spark = docs.sparkSession
    total = docs.agg(F.sum(F.octet_length(whole_text()).cast("long"))).first()[0] or 0
    chunks = max(1, -(-total // chunk_bytes))
    buckets, salts = max(32, chunks), max(1, -(-chunks // FAN))
    packed = chunked(docs, chunks, folds, held)

    def ask(key, table):
        chunk = Chunk(table["blob"].to_pylist(), order, buckets)
        number, rows = key[0].as_py(), []
        _, _, counts, bucket, words = chunk.words()
        by, parts = by_group(bucket)
        for k, a, b in parts:
            rows.append((number, k, 0, b" ".join([words[i] for i in by[a:b]]), squeezed(counts[by[a:b]])))
        grams, counts = train_counts(chunk)
        by, parts = by_group(group_of(grams))
        for k, a, b in parts:
            rows.append((number, k, 1 + number % salts, squeezed(grams[by[a:b]], True), squeezed(counts[by[a:b]])))
        return table_of(rows)

    # key: bucket or group; salt: 0 for words, from 1 for grams
    schema = "chunk long, key long, salt long, what binary, n binary"
    names = [("chunk", pa.int64()), ("key", pa.int64()), ("salt", pa.int64()), ("what", pa.binary()), ("n", pa.binary())]

    def table_of(rows) -> pa.Table:
        columns = list(zip(*rows)) if rows else [[]] * 5
        return pa.Table.from_arrays([pa.array(c, k) for c, (_, k) in zip(columns, names)], names=[n for n, _ in names])

    asked = checkpointed(packed.groupBy("chunk").applyInArrow(ask, schema))

    def word_totals(table: pa.Table) -> pa.Table:
        parts, counts = table["what"].to_pylist(), [spread_out(x, np.int64) for x in table["n"].to_pylist()]
        data, offsets = joined_bytes(pa.array(parts, pa.binary()))
        codes, _ = distinct_words(data, *split_words(data, offsets)[:2])
        totals = np.bincount(codes, weights=np.concatenate(counts)).astype(np.int64)
        owner = np.zeros(len(codes), dtype=bool)
        owner[np.unique(codes, return_index=True)[1]] = True
        rows, at = [], 0
        for chunk, key, n in zip(table["chunk"].to_pylist(), table["key"].to_pylist(), map(len, counts)):
            part = codes[at : at + n]
            rows.append((chunk, key, 0, squeezed(owner[at : at + n]), squeezed(totals[part])))
            at += n
        return table_of(rows)

    def gram_totals(table: pa.Table) -> pa.Table:
        grams = np.concatenate([spread_out(x, np.uint64, True) for x in table["what"].to_pylist()])
        counts = np.concatenate([spread_out(x, np.int64) for x in table["n"].to_pylist()])
        found, n, _ = summed(grams, counts)
        return table_of([(None, table["key"][0].as_py(), table["salt"][0].as_py(), squeezed(found, True), squeezed(n.astype(np.int64)))])

    words_back = asked.where("salt = 0").groupBy("key").applyInArrow(word_totals, schema)
    gram_rows = asked.where("salt > 0")
    partial = gram_rows.groupBy("key", "salt").applyInArrow(gram_totals, schema)
    # distinct grams of a group: no more than its contexts and symbols, whatever the corpus
    model = checkpointed(partial.groupBy("key").applyInArrow(gram_totals, schema))

    def pair_counts(batches):
        sums = np.zeros(1 << 16, np.int64)
        for batch in batches:
            for what, n in zip(batch.column("what").to_pylist(), batch.column("n").to_pylist()):
                at = (spread_out(what, np.uint64, True) & np.uint64(0xFFFF)).astype(np.int64)
                sums += np.bincount(at, weights=spread_out(n, np.int64), minlength=1 << 16).astype(np.int64)
        at = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(sums[at])], names=["pair", "n"])

    found = model.select("what", "n").mapInArrow(pair_counts, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).toArrow()
    pairs = np.zeros(1 << 16, np.int64)  # 65,536 numbers at most
    pairs[np.asarray(found["pair"], dtype=np.int64)] = np.asarray(found["n"])

    def price(table: pa.Table) -> pa.Table:
        rows = []
        for key, what, n in zip(table["key"].to_pylist(), table["what"].to_pylist(), table["n"].to_pylist()):
            grams = spread_out(what, np.uint64, True)
            costs = log_probabilities(grams, spread_out(n, np.int64), order, pairs)
            rows.append((None, key, None, what, squeezed(costs.astype(np.float32))))
        return table_of(rows)

    priced = model.groupBy("key").applyInArrow(price, schema)
    spread = priced.withColumn("salt", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(salts).cast("long"))))

    def answer(left: pa.Table, right: pa.Table) -> pa.Table:
        if not len(left):
            return table_of([])
        grams, costs = spread_out(right["what"][0].as_py(), np.uint64, True), spread_out(right["n"][0].as_py(), np.float32)
        rows = []
        for chunk, key, what in zip(left["chunk"].to_pylist(), left["key"].to_pylist(), left["what"].to_pylist()):
            rows.append((chunk, key, 1, b"", squeezed(costs[np.searchsorted(grams, spread_out(what, np.uint64, True))])))
        return table_of(rows)

    grams_back = (
        gram_rows.select("chunk", "key", "salt", "what", "n").groupBy("key", "salt")
        .cogroup(spread.select("chunk", "key", "salt", "what", "n").groupBy("key", "salt")).applyInArrow(answer, schema)
    )

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        import pandas as pd

        chunk = Chunk(left["blob"].to_pylist(), order, buckets)
        docs_here = len(chunk.ids)
        back = {(s, k): (w, n) for k, s, w, n in zip(*(right[c].to_pylist() for c in ("key", "salt", "what", "n")))}
        codes, rows, counts, bucket, words = chunk.words()
        totals, owner = np.zeros(len(words), np.int64), np.zeros(len(words), dtype=bool)
        by, parts = by_group(bucket)
        for k, a, b in parts:
            own, n = back[0, k]
            totals[by[a:b]], owner[by[a:b]] = spread_out(n, np.int64), spread_out(own, np.bool_)
        known = np.bincount(rows, weights=totals[codes] > 0, minlength=docs_here) if len(rows) else np.zeros(docs_here)
        logs = np.bincount(rows, weights=np.log10(totals[codes] + 1.0), minlength=docs_here) if len(rows) else np.zeros(docs_here)
        tokens = np.bincount(rows, minlength=docs_here) if len(rows) else np.zeros(docs_here, np.int64)
        grams, firsts = chunk.grams()
        place, every = pd.factorize(grams)
        order_of = np.argsort(every)
        cost = np.zeros(len(every))
        by, parts = by_group(group_of(every[order_of]))
        for k, a, b in parts:
            cost[order_of[by[a:b]]] = spread_out(back[1, k][1], np.float32)
        scores = np.add.reduceat(cost[place], firsts)
        head = np.zeros((3, docs_here), np.int64)
        head[:, 0] = counts.sum(), (owner & (totals > 0)).sum(), (~chunk.held).sum()
        return pa.Table.from_arrays(
            [chunk.ids, pa.array(chunk.held), pa.array(tokens.astype(np.int64)), pa.array(known.astype(np.int64)), pa.array(logs), pa.array(scores)]
            + [pa.array(x) for x in head],
            names=["doc_id", "held_out", "words", "known", "logs", "score", "train", "distinct", "train_docs"],
        )

    back = words_back.unionByName(grams_back)
    scored = checkpointed(
        packed.groupBy("chunk").cogroup(back.groupBy("chunk")).applyInArrow(
            score, "doc_id long, held_out boolean, words long, known long, logs double, score double, train long, distinct long, train_docs long",
        )
    )
    row = scored.agg(*[F.coalesce(F.sum(c), F.lit(0)) for c in ("train", "distinct", "train_docs")]).first()
    ends, train_tokens, kinds = row[2], row[0] + row[2], row[1] + (row[2] > 0)
    tokens = F.col("words") + 1
    return scored.select(
        "doc_id", "held_out", tokens.alias("n_tokens"), (F.col("known") + int(ends > 0)).alias("n_known"),
        F.lit(int(train_tokens)).cast("long").alias("train_tokens"),
        (F.col("logs") + F.lit(float(np.log10(ends + 1))) - tokens * F.lit(float(np.log10(train_tokens + kinds + 1)))).alias("base_score"),
        "score",
    )
