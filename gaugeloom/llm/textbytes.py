"""Vectorised work on the UTF-8 bytes of Arrow string columns, used inside tasks.

A *slab* is a run of rows whose texts lie one after another in one byte array. All
hashes are polynomials modulo 2**64 over a table of random odd numbers; prefix sums make
the hash of any span two look-ups and a product, so no Python loop runs over words or
bytes. A finaliser spreads the result over all 64 bits.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

SLAB_BYTES = 2 << 20

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_TABLE = np.random.default_rng(20240607).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse, kept between calls."""
    if len(_powers.get("up", ())) < n:
        for name, base in (("up", _BASE), ("down", _INVERSE)):
            steps = np.full(max(n, SLAB_BYTES + 1), base, dtype=np.uint64)
            steps[0] = 1
            _powers[name] = np.multiply.accumulate(steps)
    return _powers["up"][:n], _powers["down"][:n]


def mix(h: np.ndarray, salt: int = 0) -> np.ndarray:
    """A finaliser: every bit of the result depends on every bit of h."""
    h = h ^ np.uint64((int(salt) * 0xD6E8FEB86659FD93) & 0xFFFFFFFFFFFFFFFF)
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


@dataclass
class Slab:
    """Rows first..first+len(starts)-1 of a batch; text i is buf[starts[i]:ends[i]]."""

    first: int
    buf: np.ndarray
    starts: np.ndarray
    ends: np.ndarray

    @property
    def rows(self) -> slice:
        return slice(self.first, self.first + len(self.starts))


def slabs(column: pa.Array, most: int = SLAB_BYTES) -> Iterator[Slab]:
    """Cuts an Arrow string or binary column; a null is an empty text. One text is never cut."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    n = len(column)
    if n == 0:
        return
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, off, data = column.buffers()
    offsets = np.frombuffer(off, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    first = 0
    while first < n:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + most, "right")) - 1)
        last = min(last, n)
        a, b = offsets[first], offsets[last]
        yield Slab(first, data[a:b], offsets[first:last] - a, offsets[first + 1 : last + 1] - a)
        first = last


def prefix(codes: np.ndarray) -> np.ndarray:
    """Prefix sums with which span() gives the hash of any span; codes: uint64."""
    up, _ = powers(len(codes) + 1)
    out = np.empty(len(codes) + 1, np.uint64)
    out[0] = 0
    np.cumsum(codes * up[: len(codes)], out=out[1:])
    return out


def span(sums: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    _, down = powers(len(sums))
    return (sums[end] - sums[begin]) * down[begin]


def byte_codes(buf: np.ndarray, fold: np.ndarray | None = None) -> np.ndarray:
    return (_TABLE if fold is None else _TABLE[fold])[buf]


def ascii_lower() -> np.ndarray:
    fold = np.arange(256, dtype=np.uint8)
    fold[65:91] += 32
    return fold


def runs(slab: Slab, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of bytes of one non-zero kind that stay in one text: begin, end, and the row each lies in.

    kind: a number for each of the 256 byte values; 0 never belongs to a run."""
    k = kind[slab.buf]
    n = len(k)
    if n == 0:
        none = np.zeros(0, np.int64)
        return none, none, none
    change = np.empty(n + 1, bool)
    change[0] = change[n] = True
    np.not_equal(k[1:], k[:-1], out=change[1:n])
    change[slab.starts[slab.starts < n]] = True
    edges = np.flatnonzero(change)
    begin, end = edges[:-1], edges[1:]
    real = k[begin] != 0
    begin, end = begin[real], end[real]
    row = np.searchsorted(slab.ends, begin, "right")
    return begin, end, row


def grams(h: np.ndarray, k: int, salt: int) -> np.ndarray:
    """Hashes of each k neighbours of h (len(h)-k+1 of them); callers drop those across rows."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    up, _ = powers(k + 1)
    out = np.zeros(n, np.uint64)
    for j in range(k):
        out += h[j : j + n] * up[j + 1]
    return mix(out, salt)


#: Kinds of bytes for words: letters, digits and every byte of a character beyond ASCII.
WORD = np.zeros(256, np.uint8)
WORD[48:58] = WORD[65:91] = WORD[97:123] = WORD[128:256] = 1


def words(slab: Slab) -> tuple[np.ndarray, np.ndarray]:
    """The hash and the row of each word, A-Z taken as a-z."""
    begin, end, row = runs(slab, WORD)
    sums = prefix(byte_codes(slab.buf, ascii_lower()))
    return mix(span(sums, begin, end)), row
