"""Arrow text columns as one byte array: words, hashes and bounded blocks, computed for many documents at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK_BYTES = 1 << 20
BASE = np.uint64(0x9E3779B97F4A7C13)
BASE_INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
BYTE_CODE = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True

_powers: dict[int, np.ndarray] = {}


def powers(base: np.uint64, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64; the table grows by doubling and is kept in the worker."""
    table = _powers.get(int(base))
    if table is None or len(table) < n:
        size = 1 << max(16, int(n - 1).bit_length())
        table = np.ones(size, np.uint64)
        table[1:] = base
        np.multiply.accumulate(table, out=table)
        if size <= 1 << 23:
            _powers[int(base)] = table
    return table[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """Spreads every bit over the whole 64-bit word."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a text column and the n + 1 offsets of its rows; NULL counts as empty."""
    column = pc.fill_null(column.cast(pa.large_string()), "").cast(pa.large_binary())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64, len(column) + 1, column.offset * 8)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def blocks(offsets: np.ndarray, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``limit`` bytes; a longer row is a block of its own."""
    row, n = 0, len(offsets) - 1
    while row < n:
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + limit, "right")) - 1)
        yield row, min(end, n)
        row = end


def rolling_prefix(codes: np.ndarray) -> np.ndarray:
    """Prefix sums of ``codes[i] * BASE**-i``: differences give the hash of any stretch (see ``stretch_hash``)."""
    out = np.zeros(len(codes) + 1, np.uint64)
    np.cumsum(codes * powers(BASE_INVERSE, len(codes)), out=out[1:])
    return out


def stretch_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Rabin-Karp value of codes[start:end], the same wherever the stretch lies."""
    return (prefix[end] - prefix[start]) * powers(BASE, len(prefix))[start]


def fixed_hash(prefix: np.ndarray, width: int) -> np.ndarray:
    """Rabin-Karp values of every stretch of ``width`` codes."""
    n = len(prefix) - width
    if n <= 0:
        return np.zeros(0, np.uint64)
    return (prefix[width:] - prefix[:n]) * powers(BASE, n)


def word_spans(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of every run of bytes for which ``inside`` holds; runs end with their row."""
    if not len(data):
        none = np.zeros(0, np.int64)
        return none, none, none
    full = offsets[1:] > offsets[:-1]
    first, last = offsets[:-1][full], offsets[1:][full] - 1
    before = np.empty(len(data), bool)
    before[0], before[1:] = True, ~inside[:-1]
    before[first] = True
    starts = np.flatnonzero(inside & before)
    after = np.empty(len(data), bool)
    after[-1], after[:-1] = True, ~inside[1:]
    after[last] = True
    ends = np.flatnonzero(inside & after) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each word's bytes."""
    prefix = rolling_prefix(BYTE_CODE[data])
    return mix(stretch_hash(prefix, starts, ends) + (ends - starts).astype(np.uint64))


def row_starts(rows: np.ndarray, n: int) -> np.ndarray:
    """Index of the first word of each row, n + 1 long."""
    return np.searchsorted(rows, np.arange(n + 1))


LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32
