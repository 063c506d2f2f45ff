"""Vectorised text helpers for the tasks of the corpus operators.

A batch of texts is one run of UTF-8 bytes with row offsets, as Arrow stores it. Words, hashes and sliding
minima are computed for the whole run at once; nothing crosses a row. Batches are cut by bytes of text, so a
task holds a few megabytes whatever the number of rows in an Arrow batch; one row larger than that is a
batch of its own.
"""

from __future__ import annotations

import contextlib
import ctypes
import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

BATCH_BYTES = 1 << 20
_U = np.uint64
_BASE = 0x9E3779B97F4A7C15  # odd, so that it has an inverse modulo 2**64
_INVERSE = pow(_BASE, -1, 1 << 64)


def pieces(batches: Iterator[pa.RecordBatch], column: str, limit: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches cut so that ``column`` holds about ``limit`` bytes in each."""
    for batch in batches:
        if not batch.num_rows:
            continue
        ends = row_bounds(batch.column(column))[1].astype(np.int64)
        start = 0
        while start < batch.num_rows:
            stop = max(int(np.searchsorted(ends, ends[start] + limit, "right")) - 1, start + 1)
            stop = min(stop, batch.num_rows)
            yield batch.slice(start, stop - start)
            start = stop
    release()


def release() -> None:
    """Free memory goes back to the system: a worker outlives its task, and the next one should find room."""
    _powers.clear()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # another C library keeps what it has
        ctypes.CDLL(None).malloc_trim(0)


def row_bounds(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column and its n + 1 row offsets; a null row is empty."""
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    _, offsets, data = texts.buffers()
    bounds = np.frombuffer(offsets, np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw, bounds


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of these rows alone, with offsets from 0."""
    raw, bounds = row_bounds(texts)
    bounds = bounds.astype(np.int64)
    return raw[bounds[0] : bounds[-1]], bounds - bounds[0]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values in which every input bit reaches every output bit."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


@lru_cache(maxsize=8)
def byte_table(seed: int) -> np.ndarray:
    """A random 64-bit value for each byte."""
    return mix(np.arange(1, 257, dtype=_U) * _U(0xD1B54A32D192ED03) + _U(seed))


_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(n, BATCH_BYTES + (1 << 18))
        out = np.full(size, _U(base))
        out[0] = _U(1)
        have = _powers[base] = np.multiply.accumulate(out)
    return have[:n]


def prefix_hash(values: np.ndarray) -> np.ndarray:
    """P with P[j] - P[i] the polynomial hash of values[i:j], times base ** i."""
    out = np.zeros(len(values) + 1, _U)
    np.cumsum(values * powers(_BASE, len(values)), out=out[1:])
    return out


def range_hash(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of the bytes in each [start, end), the same wherever they stand."""
    inverse = powers(_INVERSE, len(prefix))
    return mix((prefix[ends] - prefix[starts]) * inverse[starts] + (ends - starts).astype(_U) * _U(0xA24BAED4963EE407))


def word_table(is_word, lower: bool) -> tuple[np.ndarray, np.ndarray]:
    """(is a word byte, byte after lower-casing A-Z) for each byte."""
    codes = np.arange(256, dtype=np.uint8)
    folded = codes.copy()
    if lower:
        folded[65:91] += 32
    return np.array([bool(is_word(int(c))) for c in folded]), folded


#: words of [^\x20\x09-\x0D]+
SPACED = word_table(lambda c: c != 0x20 and not 0x09 <= c <= 0x0D, lower=False)
SPACED_LOWER = word_table(lambda c: c != 0x20 and not 0x09 <= c <= 0x0D, lower=True)
#: words of [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ after lower-casing
ALNUM_LOWER = word_table(lambda c: 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80, lower=True)


LONG_WORD = 256


def digests(data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Two 64-bit words of BLAKE2b for each row's bytes."""
    raw = data.tobytes()
    ends = bounds.tolist()
    out = b"".join(hashlib.blake2b(raw[a:b], digest_size=16).digest() for a, b in zip(ends[:-1], ends[1:], strict=True))
    return np.frombuffer(out, _U).reshape(-1, 2)


class Words:
    """Words of a batch: byte ``starts`` and ``ends``, their ``row``, and ``first``: word offsets of the rows."""

    def __init__(self, data: np.ndarray, bounds: np.ndarray, table: tuple[np.ndarray, np.ndarray]):
        inside = table[0][data]
        edge = np.zeros(len(data) + 1, bool)
        edge[bounds] = True
        begins, stops = inside.copy(), inside.copy()
        if len(data):
            begins[1:] &= ~inside[:-1] | edge[1:-1]
            stops[:-1] &= ~inside[1:] | edge[1:-1]
        self.starts, self.ends = np.flatnonzero(begins), np.flatnonzero(stops) + 1
        self.first = np.searchsorted(self.starts, bounds)
        self.counts = np.diff(self.first)
        self.row = np.repeat(np.arange(len(bounds) - 1), self.counts)
        self.data, self.folded = data, table[1]

    def hashes(self, seed: int = 1) -> np.ndarray:
        """A 64-bit hash of each word. Polynomials modulo 2**64 have known collisions from 1,024 bytes on, so words of more
        than ``LONG_WORD`` bytes take theirs from BLAKE2b."""
        folded = self.folded[self.data]
        out = range_hash(prefix_hash(byte_table(seed)[folded]), self.starts, self.ends)
        for i in np.flatnonzero(self.ends - self.starts > LONG_WORD).tolist():
            out[i] = int.from_bytes(hashlib.blake2b(folded[self.starts[i] : self.ends[i]].tobytes(), digest_size=8, key=bytes([seed])).digest(), "little")
        return out


def runs(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of k consecutive items from each place; the last k - 1 places are left out."""
    n = max(len(hashes) - k + 1, 0)
    out = np.zeros(n, _U)
    for j in range(k):
        out = out * _U(0xC2B2AE3D27D4EB4F) + hashes[j : j + n]
    return mix(out + _U(k))


def within(row: np.ndarray, k: int) -> np.ndarray:
    """Whether the k items from each place lie in one row."""
    n = max(len(row) - k + 1, 0)
    return row[:n] == row[k - 1 : k - 1 + n]


def window_minima(values: np.ndarray, w: int) -> np.ndarray:
    """For each window of w values, the place of its smallest, the last one among equals."""
    n = max(len(values) - w + 1, 0)
    best, place = values[:n].copy(), np.zeros(n, np.int64)
    for j in range(1, w):
        lower = values[j : j + n] <= best
        best[lower] = values[j : j + n][lower]
        place[lower] = j
    return place + np.arange(n)


def order_in_rows(row: np.ndarray, key: np.ndarray) -> np.ndarray:
    """The order by (row, key); rows are numbered within a batch, so they mostly fit 16 bits, which sort in linear time."""
    by_key = np.argsort(key)
    rows = row[by_key]
    return by_key[np.argsort(rows.astype(np.uint16) if len(row) and row.max() < 1 << 16 else rows, kind="stable")]


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def list_array(values: pa.Array, counts: np.ndarray) -> pa.Array:
    """A list column with so many of the values in each row."""
    offsets = np.zeros(len(counts) + 1, np.int32)
    np.cumsum(counts, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), values)
