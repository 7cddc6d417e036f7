"""Vectorised word splitting and hashing over the byte buffers of Arrow string columns.

A chunk is some consecutive rows of a batch, cut by bytes, so that memory is bounded by the longest single text.
Words are maximal runs of bytes of a class; hashes are prefix-sum polynomials mod 2**64 of per-byte random values with
A-Z folded, so nothing is lower-cased or sliced row by row. Null text has no words.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_BYTES = 1 << 20
U64 = np.uint64
_BASE = 0x9E3779B97F4A7C15


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit words."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def byte_class(separators: str) -> np.ndarray:
    """True for the bytes that are in words: all but those of ``separators``."""
    table = np.ones(256, dtype=bool)
    table[[ord(c) for c in separators]] = False
    return table


#: Words of ``[^\x20\x09-\x0D]+``.
BLANKS = byte_class(" \t\n\x0b\x0c\r")
#: Words of ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` after A-Z is lower-cased: digits, letters and all beyond ASCII.
ALNUM = np.array([b >= 128 or chr(b).isalnum() for b in range(256)])

_VALUES = mix(np.arange(1, 257, dtype=U64) * U64(_BASE))
_VALUES[65:91] = _VALUES[97:123]

_powers: dict[str, np.ndarray] = {}


def _power(base: int, n: int, key: str) -> np.ndarray:
    if key not in _powers or len(_powers[key]) < n:
        p = np.full(max(n, CHUNK_BYTES), base & (2**64 - 1), dtype=U64)
        p[0] = 1
        _powers[key] = np.multiply.accumulate(p)
    return _powers[key][:n]


@dataclass
class Chunk:
    """Words of some rows: ``hashes`` and ``doc`` (index within the chunk) per word, ``first`` word per row (and one more)."""

    rows: pa.RecordBatch
    hashes: np.ndarray
    doc: np.ndarray
    first: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)


def chunks(batch: pa.RecordBatch, text: str = "text", limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch of about ``limit`` bytes of text, of one row at least."""
    column = batch.column(text)
    ends = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    start = 0
    while start < len(column):
        done = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, done + limit, "right")))
        yield batch.slice(start, stop - start)
        start = stop


def buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of a string column; null rows are empty."""
    column = pc.fill_null(column, "")
    column = pa.concat_arrays([column]) if column.offset == 0 else pa.concat_arrays([column.slice(0, 0), column])
    width = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, width)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def words(rows: pa.RecordBatch, letters: np.ndarray, text: str = "text") -> Chunk:
    """Split and hash the words of a chunk."""
    data, offsets = buffer(rows.column(text))
    n = len(data)
    inside = letters[data]
    begins = np.zeros(n + 1, dtype=bool)
    begins[offsets[:-1]] = True  # a word never runs on into the next row
    begins[n] = True
    starts = inside.copy()
    starts[1:] &= ~inside[:-1] | begins[1:n]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:] | begins[1:n]
    starts, ends = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    sums = np.zeros(n + 1, dtype=U64)
    np.cumsum(_VALUES[data] * _power(_BASE, n, "up"), out=sums[1:])
    inverse = _power(pow(_BASE, -1, 2**64), n, "down")
    hashes = mix((sums[ends] - sums[starts]) * inverse[starts])
    first = np.searchsorted(starts, offsets)
    return Chunk(rows, hashes, np.repeat(np.arange(len(first) - 1), np.diff(first)), first)


def pack(a: np.ndarray) -> bytes:
    return a.tobytes()


def unpack(b: bytes, kind) -> np.ndarray:
    return np.frombuffer(b, kind)
