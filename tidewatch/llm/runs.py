"""Counts of 64-bit keys in sorted arrays, and such arrays compressed."""

from __future__ import annotations

import numpy as np
import zstandard

from .text_blocks import U64

#: Keys that a ``Tally`` holds before it merges them.
TALLY = 1 << 22


def squeeze(a: np.ndarray) -> bytes:
    """Bytes by place (all lowest first), compressed: the high ones of small numbers vanish."""
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(a.view(np.uint8).reshape(len(a), -1).T).tobytes()) if len(a) else b""


def expand(b: bytes, kind) -> np.ndarray:
    if not b:
        return np.zeros(0, kind)
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(b), np.uint8)
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(raw.reshape(size, -1).T).view(kind).ravel()


class Tally:
    """Counts of keys, merged when many have come."""

    def __init__(self) -> None:
        self.keys, self.counts, self.size = [], [], 0

    def add(self, keys: np.ndarray) -> None:
        k, n = np.unique(keys, return_counts=True)
        self.keys.append(k), self.counts.append(n)
        self.size += len(k)
        if self.size > TALLY:
            k, n = self.merged()
            self.keys, self.counts, self.size = [k], [n], len(k)

    def full(self) -> bool:
        return self.size > TALLY // 2 and len(self.keys) == 1

    def merged(self) -> tuple[np.ndarray, np.ndarray]:
        return merge(self.keys, self.counts)

    def taken(self) -> tuple[np.ndarray, np.ndarray]:
        out = self.merged()
        self.keys, self.counts, self.size = [], [], 0
        return out


def merge(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    if not keys:
        return np.zeros(0, U64), np.zeros(0, np.int64)
    k, n = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(k, kind="stable")
    k, n = k[order], n[order]
    first = np.flatnonzero(np.concatenate(([True], k[1:] != k[:-1]))) if len(k) else np.zeros(0, np.int64)
    return k[first], np.add.reduceat(n, first) if len(k) else n
