"""Packing without padding: documents cut into pieces of power-of-two length, equal lengths in one bucket."""

from __future__ import annotations

import json
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidebar.llm.common import distinct_words, give_back, joined_bytes, lower_ascii, split_words, text_blocks, whole_text, worker_cache

#: Longest sequence, the id after each document, and words that a worker keeps encoded.
LONGEST, END, KEPT_WORDS = 4096, 2, 300_000
#: Bytes of text that share one list of distinct words, and plain words that are encoded as one text.
WORD_BLOCK, TOGETHER = 4 << 20, 256
#: Words of small Latin letters alone, or of marks alone: one run for the tokenizer, which leaves them as they are.
PLAIN = r"^(?:(?:[a-z]|\xc3[\x9f-\xb6\xb8-\xbf])+|[!-&(-/:;=?@]+)$"
#: ASCII marks before which a letter ends a word; < | > [ ] are left out, as special tokens are written with them.
MARKS = np.zeros(256, dtype=bool)
MARKS[list(b"!\"#$%&'()*+,-./:;=?@^`{}~")] = True
#: What a tokenizer takes as one run, for plain words letters and marks alone.
RUNS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


class WordEncoder:
    """ids of whole texts by way of their distinct words; the tokenizer must drop white space and part letters from marks.

    Texts are cut at ASCII white space and after each ASCII letter that a mark follows; there the tokenizer starts anew
    anyway, so the ids are those of the whole text. Known words are kept from block to block; where they get too many,
    those met just once go.
    """

    def __init__(self, vocabulary: str, end: int):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(vocabulary)
        self.plain = plain_tokenizer(vocabulary) or self.tokenizer
        self.end = end
        last = np.zeros(max(self.tokenizer.get_vocab().values()) + 1, dtype=bool)
        for token, number in self.tokenizer.get_vocab().items():
            last[number] = token.endswith("</w>")
        self.last = last
        self.clear()

    def clear(self) -> None:
        self.numbers: dict[bytes, int] = {}
        self.ids = np.array([self.end], dtype=np.uint32)
        self.starts, self.lengths = np.zeros(1, np.int64), np.ones(1, np.int64)
        self.used = np.zeros(1, np.int64)

    def forget(self, room: int) -> None:
        """Only words met more than once stay, if that leaves room for so many words more, else none."""
        kept = np.flatnonzero(self.used > 1)
        kept = kept[kept > 0]
        if len(kept) + room > KEPT_WORDS:
            self.clear()
            return
        place = np.zeros(len(self.used), np.int64)
        place[kept] = np.arange(1, len(kept) + 1)
        self.numbers = {w: p for w, p in zip(self.numbers, place[1:].tolist()) if p}
        kept = np.insert(kept, 0, 0)
        lengths = self.lengths[kept]
        starts = np.cumsum(lengths) - lengths
        self.ids = self.ids[np.repeat(self.starts[kept] - starts, lengths) + np.arange(int(lengths.sum()))]
        # half the count: words of long ago go in the end
        self.starts, self.lengths, self.used = starts, lengths, self.used[kept] >> 1

    def encoded(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Lengths and ids of words. Plain ones (letters alone, or one run of marks) end at the only id that closes a
        word, so many of them are encoded as one text; the others are encoded one by one."""
        simple = pc.match_substring_regex(pa.array(words, pa.binary()), PLAIN).to_pylist()
        easy = [w.decode() for w, ok in zip(words, simple) if ok]
        lines = [" ".join(easy[i : i + TOGETHER]) for i in range(0, len(easy), TOGETHER)]
        flat = [np.array(x.ids, np.uint32) for x in self.plain.encode_batch_fast(lines, add_special_tokens=False)]
        flat = np.concatenate(flat) if flat else np.zeros(0, np.uint32)
        easy_ends = np.flatnonzero(self.last[flat]) + 1
        if len(easy_ends) != len(easy):
            raise ValueError("the tokenizer does not close each word once")
        hard = self.tokenizer.encode_batch_fast([w.decode() for w, ok in zip(words, simple) if not ok], add_special_tokens=False)
        hard = [np.array(x.ids, np.uint32) for x in hard]
        mask = np.array(simple, dtype=bool)
        lengths = np.zeros(len(words), np.int64)
        lengths[mask] = np.diff(easy_ends, prepend=0)
        lengths[~mask] = [len(x) for x in hard]
        out = np.zeros(int(lengths.sum()), np.uint32)
        is_easy = np.repeat(mask, lengths)
        out[is_easy] = flat
        if hard:
            out[~is_easy] = np.concatenate(hard)
        return lengths, out

    def known(self, words: list[bytes]) -> np.ndarray:
        """The number of each word, from 1; number 0 stands for the end of a document."""
        numbers = self.numbers
        new = [w for w in words if w not in numbers]
        if len(numbers) + len(new) > KEPT_WORDS:
            self.forget(len(words))
            numbers = self.numbers
            new = [w for w in words if w not in numbers]
        if new:
            lengths, flat = self.encoded(new)
            begin = len(self.lengths)
            numbers.update(zip(new, range(begin, begin + len(new))))
            self.starts = np.concatenate((self.starts, len(self.ids) + np.cumsum(lengths) - lengths))
            self.lengths = np.concatenate((self.lengths, lengths))
            self.ids = np.concatenate((self.ids, flat))
            self.used = np.concatenate((self.used, np.zeros(len(new), np.int64)))
        return np.fromiter(map(numbers.__getitem__, words), np.int64, len(words))

    def encode(self, block: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, each text closed by the end id, and the offsets of the texts."""
        data, offsets = joined_bytes(block)
        if b"<|" not in data.tobytes():  # the names of special tokens alone depend on case
            data = lower_ascii(data)
        letter = ((data | 32) >= 97) & ((data | 32) <= 122)
        mark = MARKS[data]
        cuts = np.flatnonzero(letter[:-1] & mark[1:]) + 1 if len(data) else np.zeros(0, np.int64)
        starts, ends, rows = split_words(data, offsets, cuts)
        codes, words = distinct_words(data, starts, ends)
        number = self.known(words.to_pylist())
        self.used[number] += np.bincount(codes, minlength=len(number))
        sequence = np.insert(number[codes], np.searchsorted(rows, np.arange(len(block)), side="right"), 0)
        lengths = self.lengths[sequence]
        stops = np.cumsum(lengths)
        shift = (self.starts[sequence] - (stops - lengths)).astype(np.int32)  # a block has far fewer ids than 2**31
        ids = self.ids[np.repeat(shift, lengths) + np.arange(int(stops[-1]), dtype=np.int32)]
        return ids, np.concatenate(([0], stops[np.flatnonzero(sequence == 0)]))


def plain_tokenizer(vocabulary: str):
    """A tokenizer for plain words with a space between, without the steps that leave these as they are; None where the
    file has other steps."""
    from tokenizers import Tokenizer, pre_tokenizers

    def steps(name, inner):
        part = json.loads(vocabulary).get(name) or {}
        return part.get(inner) or [part]

    blanks = {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}
    runs = {"type": "Split", "pattern": {"Regex": RUNS}, "behavior": "Removed", "invert": True}
    bytes_of = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}
    if any(x != blanks and x.get("type") not in ("NFC", "Lowercase") for x in steps("normalizer", "normalizers")):
        return None
    if steps("pre_tokenizer", "pretokenizers") != [runs, bytes_of]:
        return None
    found = Tokenizer.from_str(vocabulary)
    found.normalizer = None
    found.pre_tokenizer = pre_tokenizers.Sequence(
        [pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)]
    )
    return found


def power_pieces(tokens: np.ndarray, longest: int = LONGEST) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """row, start, length of the pieces: as many of the longest as fit, then the binary digits of the rest, long first."""
    top = longest.bit_length() - 1
    rows = [np.repeat(np.arange(len(tokens)), tokens >> top)]
    lengths = [np.full(len(rows[0]), longest)]
    for k in range(top - 1, -1, -1):
        has = np.flatnonzero(tokens >> k & 1)
        rows.append(has)
        lengths.append(np.full(len(has), 1 << k))
    rows, lengths = np.concatenate(rows), np.concatenate(lengths)
    order = np.argsort(rows, kind="stable")
    rows, lengths = rows[order], lengths[order]
    before = np.cumsum(lengths) - lengths
    first = np.concatenate(([0], np.cumsum(tokens)))[rows]
    return rows, before - first, lengths


def pack(docs: DataFrame, vocabulary: str, longest: int = LONGEST, end: int = END, with_ids: bool = True, word_block: int = WORD_BLOCK) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, bucket, sequence_id, offset and, if asked
    for, ids (array<int>).

    vocabulary: the text of a tokenizers file that drops white space. Every document becomes its ids and the end id,
    so null and empty texts are one piece of one id. The pieces are power-of-two long and each is a sequence of its own: bucket (its
    length) tells with which others it makes a batch, no sequence crosses documents and none has padding.
    One pass without a shuffle; repeated rows and ids are packed each. word_block: bytes of text that share one list of
    distinct words; fewer take less memory and a little more time.
    """
    if longest & (longest - 1):
        raise ValueError("longest must be a power of two")
    # the size of the vocabulary file bounds what is sent
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)
    key = f"word encoder {zlib.crc32(vocabulary.encode())} {end}"

    def cut(batches):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        encoder = worker_cache(key, lambda: WordEncoder(shared.value, end))
        for batch in batches:
            ids_of, texts = batch.column("doc_id"), batch.column("text")
            for first, block in text_blocks(texts, word_block):
                ids, offsets = encoder.encode(block)
                tokens = np.diff(offsets)
                rows, starts, lengths = power_pieces(tokens, longest)
                raw = memoryview(ids.astype("<u4").tobytes())
                at = (offsets[rows] + starts) * 4
                crc = np.fromiter((zlib.crc32(raw[a:b]) for a, b in zip(at.tolist(), (at + lengths * 4).tolist())), np.int64, len(at))
                columns = [
                    ids_of.take(pa.array(first + rows)), pa.array(starts), pa.array(lengths), pa.array(crc), pa.array(tokens[rows]),
                ]
                names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
                if with_ids:
                    # pieces follow each other, so the ids are their values as they stand
                    columns.append(pa.ListArray.from_arrays(pa.array(np.append(at // 4, len(ids)).astype(np.int32)), pa.array(ids.astype(np.int32))))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names=names)
                del ids, raw, columns
            give_back()

    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long" + ", ids array<int>" * with_ids
    pieces = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text")).mapInArrow(cut, schema)
    return pieces.withColumns({
        "bucket": F.col("length"), "sequence_id": F.monotonically_increasing_id(), "offset": F.lit(0).cast("long"),
    })


def read_vocabulary(name: str = "word_bpe_49k.json") -> str:
    """A public tokenizer's file, read on the driver."""
    import public_tokenizers

    with open(public_tokenizers.path(name), encoding="utf-8") as file:
        return file.read()
