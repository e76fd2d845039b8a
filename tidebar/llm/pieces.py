"""SentencePiece encoding and decoding: an Aho-Corasick automaton over pieces drives one Viterbi pass."""

from __future__ import annotations

import hashlib
import zlib
from collections import deque

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidebar.llm.common import distinct_words, joined_bytes, text_blocks, whole_text, worker_cache

#: Bytes of text that share one list of distinct stretches.
BLOCK = 4 << 20
#: What a byte scores below the worst piece, as SentencePiece has it for unknown characters.
FALLBACK = 10.0


def read_pieces(name: str = "piece_bpe_32k.model") -> list[tuple[bytes, float, bool]]:
    """(bytes, score, stands for one byte) of each id of a public model; a space stands for its mark of white space, and
    ids that text cannot give are empty.

    The file gives bytes score 0, above all pieces. Here they score less than any piece, so that no best path has the
    bytes of a character that is a piece."""
    import public_tokenizers
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(name))
    out = []
    for i in range(model.get_piece_size()):
        piece, score = model.id_to_piece(i), model.get_score(i)
        if model.is_byte(i):
            out.append((bytes([int(piece[3:5], 16)]), score, True))
        elif model.is_control(i) or model.is_unknown(i) or model.is_unused(i):
            out.append((b"", 0.0, False))
        else:
            out.append((piece.replace("▁", " ").encode(), score, False))
    least = min(score for piece, score, single in out if piece and not single)
    return [(piece, least - FALLBACK if single else score, single) for piece, score, single in out]


class Automaton:
    """States of all prefixes of pieces. go: next state by byte; piece, length and score of what ends in a state; link:
    the longest proper suffix state in which a piece ends, 0 for none."""

    def __init__(self, pieces: list[tuple[bytes, float, bool]]):
        self.bytes_of = [p for p, _, _ in pieces]
        self.byte_ids, self.byte_scores = np.full(256, -1, np.int64), np.zeros(256)
        children: list[dict[int, int]] = [{}]
        ends: dict[int, int] = {}
        for i, (piece, score, single) in enumerate(pieces):
            if single:
                self.byte_ids[piece[0]], self.byte_scores[piece[0]] = i, score
            elif piece:
                if b" " in piece.lstrip(b" "):
                    raise ValueError("a piece crosses white space")
                state = 0
                for b in piece:
                    state = children[state].setdefault(b, len(children))
                    if state == len(children):
                        children.append({})
                # of pieces that are written alike the first with the best score counts
                if state not in ends or score > pieces[ends[state]][1]:
                    ends[state] = i
        if (self.byte_ids < 0).any():
            raise ValueError("the model has no pieces for single bytes")
        count = len(children)
        self.go = np.zeros((count, 256), dtype=np.int32)
        fail, self.link = np.zeros(count, np.int32), np.zeros(count, np.int32)
        self.piece = np.full(count, -1, np.int32)
        for state, i in ends.items():
            self.piece[state] = i
        queue = deque()
        for b, child in children[0].items():
            self.go[0, b] = child
            queue.append(child)
        while queue:
            state = queue.popleft()
            back = fail[state]
            self.link[state] = back if self.piece[back] >= 0 else self.link[back]
            self.go[state] = self.go[back]
            for b, child in children[state].items():
                fail[child] = self.go[back, b]
                self.go[state, b] = child
                queue.append(child)
        self.first = np.where(self.piece >= 0, np.arange(count), self.link).astype(np.int32)
        at = np.maximum(self.piece, 0)
        self.length = np.array([len(p) for p in self.bytes_of], np.int64)[at]
        self.score = np.array([s for _, s, _ in pieces])[at]
        held = {b for p, _, single in pieces if not single for b in p}
        #: bytes that are in no piece: nothing spans them
        self.never = np.array([b not in held for b in range(256)])
        sizes = np.array([len(p) for p in self.bytes_of])
        self.piece_starts, self.piece_sizes = np.cumsum(sizes) - sizes, sizes
        self.piece_data = np.frombuffer(b"".join(self.bytes_of), np.uint8)

    def best_paths(self, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray):
        """ids of the best pieces of many stretches of data, their number and their score, all stretches in step.

        At each byte the output links are followed from the longest piece that ends there; a piece must beat what was
        found so far, so of equal scores the longest last piece stays.
        """
        order = np.argsort(-lengths, kind="stable")
        sizes = lengths[order]
        base = np.cumsum(sizes + 1) - sizes - 1  # place of position 0 of each stretch
        total = int((sizes + 1).sum())
        best, taken = np.full(total, -np.inf), np.zeros(total, np.int32)
        best[base] = 0.0
        state, begin = np.zeros(len(order), np.int32), starts[order]
        active = np.searchsorted(-sizes, -np.arange(int(sizes[0]) if len(sizes) else 0), side="left")
        for step, n in enumerate(active):
            byte = data[begin[:n] + step]
            state[:n] = self.go[state[:n], byte]
            here = base[:n] + step + 1
            score = best[here - 1] + self.byte_scores[byte]
            piece = self.byte_ids[byte].astype(np.int32)
            rows = np.flatnonzero(self.first[state[:n]])
            out = self.first[state[:n]][rows]
            while len(rows):
                found = best[here[rows] - self.length[out]] + self.score[out]
                better = found > score[rows]
                # pieces come before single bytes of equal score
                score[rows[better]] = found[better]
                piece[rows[better]] = self.piece[out[better]]
                out = self.link[out]
                rows, out = rows[out > 0], out[out > 0]
            best[here], taken[here] = score, piece
        # back from the ends, one piece of every stretch at a time
        at, found = base + sizes, []
        rows = np.arange(len(order))
        counts = np.zeros(len(order), np.int64)
        while len(rows):
            more = at[rows] > base[rows]
            rows = rows[more]
            if not len(rows):
                break
            piece = taken[at[rows]]
            found.append((rows, counts[rows].copy(), piece))
            counts[rows] += 1
            at[rows] -= self.piece_sizes[piece]
        first = np.cumsum(counts) - counts
        ids = np.zeros(int(counts.sum()), np.int32)
        for rows, back, piece in found:
            ids[first[rows] + counts[rows] - 1 - back] = piece
        score = best[base + sizes]
        where = np.empty(len(order), np.int64)
        where[order] = np.arange(len(order))
        return ids, first[where], counts[where], score[where]

    def encode(self, block: pa.Array):
        """ids of all texts, the offsets of the texts among them, and the texts' scores. A text gets a leading space, an empty one
        no piece."""
        texts, offsets = joined_bytes(block)
        sizes = np.diff(offsets)
        filled = sizes > 0
        data = np.full(len(texts) + int(filled.sum()), 32, np.uint8)
        shift = np.cumsum(filled)
        data[np.arange(len(texts)) + np.repeat(shift, sizes)] = texts
        offsets = offsets + np.concatenate(([0], shift))
        if not len(data):
            return np.zeros(0, np.int32), np.zeros(len(block) + 1, np.int64), np.zeros(len(block))
        # a piece is spaces alone or begins with its only space: stretches begin where spaces do
        begins = np.zeros(len(data) + 1, dtype=bool)
        space, never = data == 32, self.never[data]
        begins[:-1] = space & np.concatenate(([True], ~space[:-1]))
        begins[:-1] |= never
        begins[1:] |= never
        begins[offsets] = True
        starts = np.flatnonzero(begins[:-1])
        ends = np.append(starts[1:], len(data))
        rows = np.searchsorted(offsets, starts, side="right") - 1
        codes, words = distinct_words(data, starts, ends)
        raw, bounds = joined_bytes(words)
        ids, first, counts, score = self.best_paths(raw, bounds[:-1], np.diff(bounds))
        lengths = counts[codes]
        stops = np.cumsum(lengths)
        flat = ids[np.repeat(first[codes] - (stops - lengths), lengths) + np.arange(int(stops[-1]))]
        per_row = np.bincount(rows, weights=lengths, minlength=len(block)).astype(np.int64)
        return flat, np.concatenate(([0], np.cumsum(per_row))), np.bincount(rows, weights=score[codes], minlength=len(block))

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes and offsets of the texts that ids stand for; the leading space of each goes."""
        sizes = self.piece_sizes[ids]
        stops = np.cumsum(sizes)
        data = self.piece_data[np.repeat(self.piece_starts[ids] - (stops - sizes), sizes) + np.arange(int(stops[-1]) if len(stops) else 0)]
        bounds = np.concatenate(([0], stops))[offsets]
        filled = np.diff(bounds) > 0
        keep = np.ones(len(data), dtype=bool)
        keep[bounds[:-1][filled]] = False
        return data[keep], bounds - np.concatenate(([0], np.cumsum(filled)))


def automaton(shared) -> Automaton:
    pieces = shared.value
    return worker_cache(f"automaton {zlib.crc32(repr(pieces).encode())}", lambda: Automaton(pieces))


def encode_pieces(docs: DataFrame, pieces: list[tuple[bytes, float, bool]]) -> DataFrame:
    """One row per document: doc_id, ids (array<int>), score: the segmentation with the largest sum of piece scores, the bytes
    of a character where no piece fits. Null and empty texts have no ids and score 0; repeated rows are encoded each."""
    shared = docs.sparkSession.sparkContext.broadcast(pieces)  # the size of the model file bounds it

    def run(batches):
        for batch in batches:
            for first, block in text_blocks(batch.column("text"), BLOCK):
                ids, offsets, scores = automaton(shared).encode(block)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(first, len(block)), pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids)), pa.array(scores)],
                    names=["doc_id", "ids", "score"],
                )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"))
    return rows.mapInArrow(run, "doc_id long, ids array<int>, score double")


def decode_pieces(encoded: DataFrame, pieces: list[tuple[bytes, float, bool]]) -> DataFrame:
    """encoded with `ids` replaced by `text`; null ids give null."""
    shared = encoded.sparkSession.sparkContext.broadcast(pieces)

    @F.arrow_udf("binary")
    def run(ids: pa.Array) -> pa.Array:
        out = []
        for row in ids:
            flat = np.asarray(row.values if row.is_valid else [], dtype=np.int64)
            data, _ = automaton(shared).decode(flat, np.array([0, len(flat)]))
            out.append(data.tobytes() if row.is_valid else None)
        return pa.array(out, pa.binary())

    return encoded.withColumn("text", run(F.col("ids")).cast("string")).drop("ids")


def pieces_digest(docs: DataFrame, pieces: list[tuple[bytes, float, bool]]) -> DataFrame:
    """One row per document: doc_id, n_pieces, ids_crc32 (little-endian unsigned 32-bit ids), score, decoded_sha256 (of the text
    decoded from the ids)."""
    shared = docs.sparkSession.sparkContext.broadcast(pieces)

    def run(batches):
        for batch in batches:
            for first, block in text_blocks(batch.column("text"), BLOCK):
                machine = automaton(shared)
                ids, offsets, scores = machine.encode(block)
                data, bounds = machine.decode(ids.astype(np.int64), offsets)
                raw, text = memoryview(ids.astype("<u4").tobytes()), memoryview(data.tobytes())
                crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
                sha = [hashlib.sha256(text[a:b]).hexdigest() for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(first, len(block)), pa.array(np.diff(offsets)), pa.array(crc, pa.int64()), pa.array(scores), pa.array(sha)],
                    names=["doc_id", "n_pieces", "ids_crc32", "score", "decoded_sha256"],
                )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_pieces long, ids_crc32 long, score double, decoded_sha256 string")
