"""Vectorised words of a batch of texts: 64-bit hashes by prefix sums, no loop over words."""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_BASE, _INV = 0x9E3779B97F4A7C15, pow(0x9E3779B97F4A7C15, -1, 1 << 64)
_POW: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> list[np.ndarray]:
    if len(_POW[0]) < n:
        size = 1 << (n - 1).bit_length()
        for i, b in enumerate((_BASE, _INV)):
            p = np.full(size, b, np.uint64)
            p[0] = 1
            _POW[i] = np.cumprod(p, dtype=np.uint64)
    return _POW


def lean(run: Callable) -> Callable:
    """run, a generator function, that gives freed memory back to the system at its end: idle workers stay small."""

    @functools.wraps(run)
    def leaner(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
            if trim:
                trim(0)

    return leaner


def slices(batches: Iterator, rows: int = 1000) -> Iterator:
    """The batches in pieces of so many rows, so that few texts are Python objects at once."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


def mix(h: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def blocks(texts: list[bytes], limit: int = 1 << 18) -> Iterator[tuple[int, list[bytes]]]:
    """(index of the first text, texts) in blocks of about limit bytes; a longer text is a block of its own."""
    start, size = 0, 0
    for i, t in enumerate(texts):
        if size and size + len(t) > limit:
            yield start, texts[start:i]
            start, size = i, 0
        size += len(t) + 1
    if start < len(texts):
        yield start, texts[start:]


def words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words [^\\x20\\x09-\\x0D]+ of A-Z lower-cased UTF-8 texts.

    Returns (hash, bounds, start, end, bytes): hashes of all words in order, for text
    i the slice bounds[i]:bounds[i + 1], and each word's bytes as bytes[start:end].
    """
    joined = b" ".join(texts).lower() + b" "
    buf = np.frombuffer(joined, np.uint8)
    sp = _SPACE[buf]
    edge = np.flatnonzero(np.diff(sp, prepend=True))
    start, end = edge[0::2], edge[1::2]
    p, inv = _powers(len(buf) + 1)
    sums = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum(_BYTE[buf] * p[: len(buf)], out=sums[1:])
    h = mix((sums[end] - sums[start]) * inv[start] + (end - start).astype(np.uint64))
    at = np.cumsum([0] + [len(t) + 1 for t in texts])
    return h, np.searchsorted(start, at), start, end, buf
