"""Vectorised word and window hashing over Arrow text columns.

A batch of texts is one byte buffer.  Word bounds come from a table look-up on
the bytes, word hashes from a Rabin-Karp polynomial over each word's bytes
(modulo 2**64, then mixed), and window hashes from a second Rabin-Karp
polynomial over mixed word hashes, so equal word sequences hash alike whatever
white space stands between them.  No Python loop runs over words.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
_WS = np.zeros(256, bool)
_WS[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_P, _R, _R2 = 0x9E3779B97F4A7C15 | 1, 0xD6E8FEB86659FD93 | 1, 0xA0761D6478BD642F | 1
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A bijective scrambling of 64-bit values (the public splitmix64 finaliser)."""
    x = x + U((0x9E3779B97F4A7C15 * (salt + 1)) & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """``base**i`` and ``base**-i`` modulo 2**64 for i < n at least."""
    n, have = int(n), _powers.get(base)
    if have is None or len(have[0]) < n:
        size = max(1 << 16, 1 << (n - 1).bit_length())
        both = []
        for b in (base, pow(base, -1, 1 << 64)):
            step = np.full(size, b & 0xFFFFFFFFFFFFFFFF, U)
            step[0] = 1
            both.append(np.multiply.accumulate(step))
        have = _powers[base] = (both[0], both[1])
    return have


SEGMENT = 1 << 17


def rolling(values: np.ndarray, size: int, base: int, back: bool = False) -> np.ndarray:
    """Rabin-Karp polynomial of every run of ``size`` values, by where it starts; ``back``: by where it ends, shorter at the front."""
    n = len(values)
    first = -(size - 1) if back else 0
    last = n - size
    out = np.empty(max(0, last - first + 1), U)
    for a in range(first, last + 1, SEGMENT):
        b = min(a + SEGMENT, last + 1)
        lo, hi = max(a, 0), b - 1 + size
        up, down = powers(base, SEGMENT + 2 * size + 1)
        c = np.zeros(hi - lo + 1, U)
        np.cumsum(values[lo:hi] * up[: hi - lo], out=c[1:])
        k = np.arange(a, b)
        s = np.maximum(k, 0) - lo
        out[a - first : b - first] = (c[k + size - lo] - c[s]) * down[s]
    return out


@dataclass
class Words:
    """Words of a batch. ``doc``: first word of each document, and the end; ``start``/``end``: bytes in ``data``."""

    data: np.ndarray
    doc: np.ndarray
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray

    def windows(self, size: int, lanes: int = 1) -> tuple[np.ndarray, list[np.ndarray]]:
        """First word of every window of ``size`` words inside one document, and its hash in each lane."""
        n = len(self.start)
        if n < size:
            return np.zeros(0, np.int64), [np.zeros(0, U)] * lanes
        last = np.repeat(self.doc[1:], np.diff(self.doc)) - size
        at = np.flatnonzero(np.arange(n) <= last)
        return at, [mix(rolling(mix(self.hash, lane + 1), size, base)[at], lane + 11) for lane, base in enumerate((_R, _R2)[:lanes])]

    def grams(self, size: int, lane: int = 0) -> np.ndarray:
        """For every word the hash of the ``size`` words that end there (meaningless where fewer precede in the document)."""
        if not len(self.start):
            return np.zeros(0, U)
        return mix(rolling(mix(self.hash, lane + 1), size, (_R, _R2)[lane], back=True), 11 + lane + 31 * size)


def strings(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
    column = pc.fill_null(column, "") if column.null_count else column
    wide = pa.types.is_large_string(column.type)
    offs = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    offs = offs.astype(np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8)[offs[0] : offs[-1]] if len(column) and column.buffers()[2] is not None else np.zeros(0, np.uint8)
    return data, offs - offs[0]


def words(column: pa.Array | pa.ChunkedArray, gaps: np.ndarray = _WS, fold: np.ndarray | None = None) -> Words:
    """Runs of bytes that aren't ``gaps``; ``fold``: what each byte is read as."""
    data, offs = strings(column)
    data = data if fold is None else fold[data]
    n = len(data)
    blank = np.ones(n + 2, bool)
    np.take(gaps, data, out=blank[1 : n + 1])
    ink = ~blank
    fresh = np.zeros(n + 1, bool)  # bytes at which a document begins
    fresh[offs] = True
    starts = np.flatnonzero(ink[1 : n + 1] & (blank[:n] | fresh[:n]))
    ends = np.flatnonzero(ink[1 : n + 1] & (blank[2:] | fresh[1:])) + 1
    h = np.empty(len(starts), U)
    at = 0
    while at < len(starts):  # by segments, so that the power tables stay small
        base = starts[at]
        to = max(at + 1, int(np.searchsorted(starts, base + (SEGMENT << 1))))
        hi = ends[to - 1]
        up, down = powers(_P, hi - base + 1)
        c = np.zeros(hi - base + 1, U)
        np.cumsum((data[base:hi].astype(U) + U(1)) * up[: hi - base], out=c[1:])
        s = starts[at:to] - base
        h[at:to] = (c[ends[at:to] - base] - c[s]) * down[s]
        at = to
    h = mix(h)
    return Words(data, np.searchsorted(starts, offs), starts, ends, h)


def slices(batches: Iterator[pa.RecordBatch], column: str, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Cut batches so that each holds about ``most`` bytes of text, or a single row."""
    for b in batches:
        if b.num_rows == 0:
            continue
        size = pc.fill_null(pc.binary_length(b.column(b.schema.get_field_index(column))), 0).to_numpy(zero_copy_only=False).cumsum()
        at = 0
        while at < b.num_rows:
            base = size[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(size, base + most, "right")))
            yield b.slice(at, to - at)
            at = to


def binaries(parts: list[np.ndarray | bytes]) -> pa.Array:
    return pa.array([p if isinstance(p, bytes) else p.tobytes() for p in parts], pa.binary())
