"""Array kernels over UTF-8 text: words, hashes and windows of many documents at once.

A slice is about a quarter of a megabyte of whole documents laid end to end, so the arrays
stay small however many rows an Arrow batch has. A single longer document is a
slice of its own.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from xxhash import xxh3_64_intdigest

SLICE_BYTES = 1 << 18
#: Bytes from which a span is hashed by itself.
LONG_SPAN = 64

#: Separators of `[^\x20\x09-\x0D]+` words.
BLANK = np.zeros(256, bool)
BLANK[[0x20, *range(0x09, 0x0E)]] = True
#: Separators of `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` words.
NOT_ALNUM = np.zeros(256, bool)
NOT_ALNUM[[*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]] = True

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_P = np.uint64(0x9E3779B97F4A7C15 | 1)
_P_INV = np.uint64(pow(int(_P), -1, 1 << 64))
_BYTES = np.random.default_rng(20240607).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers = {}
#: Large caches of other operators in this worker process; a scan frees them.
CACHES: list[dict] = []


def give_back() -> None:
    """Returns memory that is free but held by the allocators of this process to the system."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # not glibc
        pass


def tidy(task: Callable) -> Callable:
    """A task over batches after which its worker, which Spark keeps for others, is as small as it can be."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from task(batches)
        finally:
            give_back()

    return run


def _power(base: np.uint64, n: int) -> np.ndarray:
    """base**0 .. base**n modulo 2**64."""
    have = _powers.get(base)
    if have is None or len(have) <= n:
        size = max(n + 1, SLICE_BYTES + 1)
        steps = np.full(size, base, np.uint64)
        steps[0] = 1
        have = _powers[base] = np.cumprod(steps)
    return have


def mix(h: np.ndarray) -> np.ndarray:
    """Spreads the bits of 64-bit hashes."""
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(29)
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(32))


def text_slices(texts: pa.Array, target: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets of the rows in them); a null text is empty."""
    for cache in CACHES:
        cache.clear()
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    n = len(texts)
    if not n:
        return
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + n + 1]
    data = np.frombuffer(data, np.uint8) if data else np.empty(0, np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(at, at[lo] + target, "right")) - 1)
        yield lo, hi, data[at[lo] : at[hi]], at[lo : hi + 1] - at[lo]
        lo = hi


def spans(data: np.ndarray, at: np.ndarray, separators: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of each maximal run without separators; runs end with their row."""
    if not len(data):
        return (np.empty(0, np.int64),) * 3
    apart = separators[data]
    before, after = np.empty_like(apart), np.empty_like(apart)
    before[0], before[1:] = True, apart[:-1]
    after[-1], after[:-1] = True, apart[1:]
    edges = at[1:-1]
    before[edges[edges < len(data)]] = True
    after[edges[edges > 0] - 1] = True
    inside = ~apart
    starts = np.flatnonzero(inside & before)
    ends = np.flatnonzero(inside & after) + 1
    return starts, ends, np.searchsorted(at, starts, "right") - 1


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte span, the same wherever the span stands.

    Short spans: a polynomial modulo 2**64, all at once. Modulo a power of two it fails on long
    strings of the Thue-Morse kind, so spans of LONG_SPAN bytes and up are hashed one by one by XXH3.
    """
    n = len(data)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTES[data] * _power(_P, n)[:n], out=sums[1:])
    h = mix((sums[ends] - sums[starts]) * _power(_P_INV, n)[starts] + (ends - starts).astype(np.uint64))
    long = np.flatnonzero(ends - starts >= LONG_SPAN)
    if len(long):
        raw = memoryview(np.ascontiguousarray(data))
        h[long] = np.fromiter((xxh3_64_intdigest(raw[a:b]) for a, b in zip(starts[long].tolist(), ends[long].tolist(), strict=True)), np.uint64, len(long))
    return h


def windows(h: np.ndarray, rows: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every run of ``width`` words within a row, and the index of its first word."""
    n = len(h) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    first = np.flatnonzero(rows[:n] == rows[width - 1 :])
    total = np.zeros(len(first), np.uint64)
    for k in range(width):
        total = total * np.uint64(0x9DDFEA08EB382D69 | 1) + h[first + k]
    return mix(total), first


def row_counts(rows: np.ndarray, n: int, weights: np.ndarray | None = None) -> np.ndarray:
    return np.bincount(rows, weights, n).astype(np.int64)


def sort_rows(values: np.ndarray, bounds: np.ndarray) -> None:
    """Sorts values[bounds[k]:bounds[k + 1]] in place."""
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        if b - a > 1:
            values[a:b].sort()


def repeated(rows: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For items (row, hash): whether an equal item stands earlier, and whether one stands anywhere else."""
    key = mix(h ^ mix(rows.astype(np.uint64) + np.uint64(1)))
    order = np.argsort(key, kind="stable")
    k = key[order]
    same = np.zeros(len(k) + 1, bool)
    same[1:-1] = k[1:] == k[:-1]
    later, twice = np.empty(len(k), bool), np.empty(len(k), bool)
    later[order] = same[:-1]
    twice[order] = same[:-1] | same[1:]
    return later, twice


def bytes_per_row(flags: np.ndarray, at: np.ndarray) -> np.ndarray:
    sums = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=sums[1:])
    return np.diff(sums[at])
