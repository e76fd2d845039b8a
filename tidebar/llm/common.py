"""Helpers shared by the operators of this package."""

from __future__ import annotations

import tempfile

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one step inside a task handles at once.
BLOCK_BYTES = 4 << 20
#: Small rows, such as pairs of numbers, that one partition holds.
FEW = 200_000


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def whole_text() -> Column:
    """The text, null as empty."""
    return F.coalesce(F.col("text").cast("string"), F.lit(""))


def fold_of(name: str, folds: int) -> Column:
    """crc32 of the id as text, modulo the number of folds; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(name).cast("string"), F.lit("")).cast("binary")) % folds


def checkpointed(df: DataFrame) -> DataFrame:
    """df written once to the folder that spark.checkpoint.dir names, and read from there.

    Only where that setting is missing on a local master, as in tests, a temporary folder takes its place.
    """
    context = df.sparkSession.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        folder = context.getConf().get("spark.checkpoint.dir")
        if folder is None:
            if not context.master.startswith("local[") and context.master != "local":
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="llm-checkpoint-")
        context.setCheckpointDir(folder)
    return df.checkpoint()


def few(df: DataFrame, rows: int) -> DataFrame:
    """df of about so many small rows in a partition for each FEW of them, where it has more: a shuffle writes files for each."""
    return df.coalesce(rows // FEW + 1)


def shuffle_partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def worker_cache(key, make):
    """make()'s value, kept for later tasks in the same Python worker until another key is asked for."""
    import sys
    import types

    held = sys.modules.setdefault("llm_worker_cache", types.ModuleType("llm_worker_cache")).__dict__.setdefault("slot", {})
    if key not in held:
        held.clear()
        held[key] = make()
    return held[key]


def give_back() -> None:
    """Hand memory that a batch no longer needs back to the system; workers live on from stage to stage."""
    import ctypes

    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def text_blocks(texts: pa.Array, block_bytes: int = BLOCK_BYTES):
    """(first row, slice) pairs that cover texts, each of about block_bytes, one row at least."""
    sizes = np.asarray(pc.binary_length(texts).fill_null(0), dtype=np.int64)
    ends = np.cumsum(sizes)
    start = 0
    while start < len(texts):
        done = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, done + block_bytes, side="right")))
        yield start, texts.slice(start, stop - start)
        start = stop


def joined_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All UTF-8 bytes in a row, and the offsets of the rows. Null counts as empty."""
    sizes = np.asarray(pc.binary_length(texts).fill_null(0), dtype=np.int64)
    offsets = np.concatenate(([0], np.cumsum(sizes)))
    raw = b"".join(x or b"" for x in texts.cast(pa.binary()).to_pylist())
    return np.frombuffer(raw, dtype=np.uint8), offsets


def lower_ascii(data: np.ndarray) -> np.ndarray:
    return np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint8)


def split_words(data: np.ndarray, offsets: np.ndarray, cuts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and rows of the words of joined texts; white space is space and the bytes 9 to 13, and a word also
    ends where cuts say."""
    if not len(data):
        return (np.zeros(0, np.int64),) * 3
    word = ~((data == 32) | ((data >= 9) & (data <= 13)))
    edge = np.zeros(len(data) + 1, dtype=bool)
    edge[offsets] = True
    if cuts is not None:
        edge[cuts] = True
    before, after = edge[:-1].copy(), edge[1:].copy()
    before[1:] |= ~word[:-1]
    after[:-1] |= ~word[1:]
    before[0] = after[-1] = True
    starts, ends = np.flatnonzero(word & before), np.flatnonzero(word & after) + 1
    return starts, ends, np.searchsorted(offsets, starts, side="right") - 1


def distinct_words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """A number for each word, and the distinct words (binary) that the numbers point to."""
    if not len(starts):
        return np.zeros(0, np.int64), pa.array([], pa.binary())
    bounds = np.concatenate(([0], np.cumsum(ends - starts)))
    # the words are all bytes that lie in one
    depth = np.zeros(len(data) + 1, dtype=np.int8)
    depth[starts] = 1
    depth[ends] -= 1
    packed = data[np.cumsum(depth[:-1], dtype=np.int8) > 0]
    words = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(bounds.astype(np.int64)), pa.py_buffer(packed)])
    coded = words.dictionary_encode()
    return np.asarray(coded.indices, dtype=np.int64), coded.dictionary
