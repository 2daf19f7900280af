"""Byte-level helpers for text columns inside Arrow tasks."""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, functions as F

#: Bytes handled at once; a longer text is a block of its own.
BLOCK_BYTES = 500_000
#: Stands for a null doc_id inside operators: larger than every id.
NO_ID = 2**63 - 1

WHITE = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)
IN_WORD = np.ones(256, bool)
IN_WORD[list(WHITE)] = False

ODD_A, ODD_B = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F
MASK = 2**64 - 1


def narrow(docs: DataFrame) -> DataFrame:
    """``doc_id`` (long, a null id last) and ``text`` only, so clashing columns stay out."""
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_id"), F.col("text").cast("string").alias("text"))


def public_id(c: str = "doc_id") -> Column:
    """The id as given: the stand-in becomes null again."""
    return F.when(F.col(c) != NO_ID, F.col(c)).alias(c)


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and row offsets of a string column; null reads as empty."""
    binary = pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type)
    column = column.fill_null(b"" if binary else "").cast(pa.large_binary() if binary else pa.large_string())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64, len(column) + 1, column.offset * 8) if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw, at


def packed(docs: DataFrame) -> DataFrame:
    """``narrow`` with the text as compressed bytes ``z``, for a shuffle that carries whole texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=3).compress
        for batch in batches:
            raw, at = buffers(batch.column("text"))
            data = memoryview(raw)
            z = [pack(data[a:b]) for a, b in itertools.pairwise(at.tolist())]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(z, pa.binary())], names=["doc_id", "z"])

    return narrow(docs).mapInArrow(run, "doc_id long, z binary")


def unpacked(column: pa.Array) -> pa.Array:
    """UTF-8 texts of a column of compressed bytes."""
    unpack = zstandard.ZstdDecompressor().decompress
    return pa.array([unpack(z) for z in column.to_pylist()], pa.large_binary())


def blocks(column: pa.Array, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets in them) over runs of whole texts."""
    raw, at = buffers(column)
    lo = 0
    while lo < len(column):
        hi = max(lo + 1, int(np.searchsorted(at, at[lo] + limit, "right")) - 1)
        yield lo, hi, raw[at[lo] : at[hi]], at[lo : hi + 1] - at[lo]
        lo = hi


def word_spans(raw: np.ndarray, at: np.ndarray, in_word: np.ndarray = IN_WORD) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words, and per text the index of its first word (one more at the end)."""
    w = in_word[raw]
    before, after = np.zeros_like(w), np.zeros_like(w)
    before[1:], after[:-1] = w[:-1], w[1:]
    edge = at[(at > 0) & (at < len(raw))]
    before[edge] = False
    after[edge - 1] = False
    starts, ends = np.flatnonzero(w & ~before), np.flatnonzero(w & ~after) + 1
    return starts, ends, np.searchsorted(starts, at)


def powers(base: int, n: int) -> np.ndarray:
    """1, base, base^2 ... modulo 2^64."""
    out = np.full(max(1, n), np.uint64(base), np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def mixed(h: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every bit over the word."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class Rolling:
    """Hashes of runs of a sequence from prefix sums; equal runs hash alike wherever they stand."""

    def __init__(self, base: int):
        self.base, self.inverse = base & MASK, pow(base, -1, 2**64)
        self.up = self.down = np.ones(1, np.uint64)

    def __call__(self, values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        if len(values) + 1 > len(self.up):
            n = max(len(values) + 1, 2 * len(self.up))
            self.up, self.down = powers(self.base, n), powers(self.inverse, n)
        total = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(values.astype(np.uint64) * self.up[: len(values)], out=total[1:])
        return mixed((total[ends] - total[starts]) * self.down[starts] + (ends - starts).astype(np.uint64))


def long_hash(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)
