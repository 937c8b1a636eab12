"""Vectorised word splitting and hashing over Arrow string columns.

A word is a maximal run of bytes outside ``[\\x20\\x09-\\x0D]``; those bytes never occur inside a multi-byte
UTF-8 sequence, so working on bytes gives the same words as working on code points.  Hashes are 64 bits wide.
Null texts count as empty.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

SLICE_BYTES = 2 << 20
#: Bytes that are hashed at a time; the numbers of a byte take some fifty bytes.
BLOCK = 1 << 17
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_RNG = np.random.Generator(np.random.PCG64(20240229))
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64)
_POWERS = np.ones(4096, dtype=np.uint64)
with np.errstate(over="ignore"):
    _POWERS[1:] = np.multiply.accumulate(np.full(4095, 0x9E3779B97F4A7C15, dtype=np.uint64))
    _NEXT = _POWERS[-1] * _POWERS[1]
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32


def mix(h: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64: spreads every input bit over the whole word."""
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and its n+1 offsets into them; null rows have no bytes."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.type != pa.large_string():
        column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    if not len(column):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    _, off, data = column.buffers()
    offsets = np.frombuffer(off, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


@dataclass
class Words:
    """Words of some rows: ``first[i]:first[i + 1]`` are the words of row ``i``."""

    hashes: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray

    @property
    def rows(self) -> int:
        return len(self.first) - 1


def _words_of(data: np.ndarray, offsets: np.ndarray, fold: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes, starts and ends of the words of some bytes; a row starts at every offset."""
    if fold:
        data = _FOLD[data]
    solid = ~_SPACE[data]
    edge = np.zeros(len(data) + 1, dtype=bool)
    edge[offsets] = True
    before = np.empty(len(data), dtype=bool)
    before[0] = True
    np.logical_not(solid[:-1], out=before[1:])
    before |= edge[:-1]
    after = np.empty(len(data), dtype=bool)
    after[-1] = True
    np.logical_not(solid[1:], out=after[:-1])
    after |= edge[1:]
    starts = np.flatnonzero(solid & before)
    ends = np.flatnonzero(solid & after) + 1
    if not len(starts):
        return np.empty(0, np.uint64), starts, ends
    lengths = ends - starts
    heads = np.concatenate(([0], np.cumsum(lengths)[:-1]))
    letters, total = data[solid], np.zeros(len(heads), np.uint64)
    with np.errstate(over="ignore"):
        for lo in range(0, len(letters), BLOCK):
            own = letters[lo : lo + BLOCK]
            a, b = np.searchsorted(heads, lo, side="right") - 1, np.searchsorted(heads, lo + len(own))
            first = np.maximum(heads[a:b], lo) - lo
            inside = np.arange(lo, lo + len(own)) - np.repeat(heads[a:b], np.diff(first, append=len(own)))
            value = _BYTE[own] * _POWERS[inside & 4095]
            if blocks := int(inside.max()) >> 12:  # the powers go on in long words
                value *= np.multiply.accumulate(np.append(np.uint64(1), np.full(blocks, _NEXT)))[inside >> 12]
            total[a:b] += np.add.reduceat(value, first)
        return mix(total + lengths.astype(np.uint64)), starts, ends


def _space_from(data: np.ndarray, at: int) -> int:
    """The first white space at or after ``at``, else the end."""
    step = 1 << 16
    while at < len(data):
        found = np.flatnonzero(_SPACE[data[at : at + step]])
        if len(found):
            return at + int(found[0])
        at += step
    return len(data)


def words(column: pa.Array, fold: bool = False) -> Words:
    """Splits every row; ``fold`` lower-cases A-Z before hashing.

    Rows beyond SLICE_BYTES are cut at white space and worked on in parts, so that a text of any length takes some
    bytes for each of its words besides a fixed amount.
    """
    data, offsets = buffers(column)
    parts, at = [], 0
    while at < len(data):
        to = _space_from(data, at + 2 * SLICE_BYTES) if len(data) - at > 4 * SLICE_BYTES else len(data)
        own = offsets[np.searchsorted(offsets, at) : np.searchsorted(offsets, to, side="right")] - at
        hashes, starts, ends = _words_of(data[at:to], own, fold)
        parts.append((hashes, starts + at, ends + at))
        at = to
    if not parts:
        parts = [(np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64))]
    hashes, starts, ends = parts[0] if len(parts) == 1 else (np.concatenate(x) for x in zip(*parts, strict=True))
    return Words(hashes, starts, ends, np.searchsorted(starts, offsets))


def combine(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of ``n`` neighbours, whichever rows they are in; length ``len(hashes) - n + 1``."""
    size = max(0, len(hashes) - n + 1)
    out = np.full(size, n, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for k in range(n):
            out = out * np.uint64(0xD6E8FEB86659FD93) + hashes[k : k + size]
    return mix(out)


def slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about ``limit`` bytes each, one row at least."""
    _, offsets = buffers(column)
    at, n = 0, len(offsets) - 1
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1)
        yield at, min(to, n)
        at = min(to, n)


def shingles(w: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes of every row in order of position, and ``first`` as for words.

    A row with at least one word but fewer than ``size`` has one shingle: all its words.
    """
    count = np.diff(w.first)
    if len(count) == 1 and count[0] >= size:
        return combine(w.hashes, size), np.array([0, count[0] - size + 1])
    number = np.where(count >= size, count - size + 1, np.minimum(count, 1))
    first = np.concatenate(([0], np.cumsum(number)))
    long = count >= size
    at = np.repeat(w.first[:-1] - first[:-1], number) + np.arange(first[-1])
    out = np.empty(first[-1], dtype=np.uint64)
    full = combine(w.hashes, size)
    is_long = np.repeat(long, number)
    out[is_long] = full[at[is_long]]
    for row in np.flatnonzero(~long & (count > 0)):
        h = w.hashes[w.first[row] : w.first[row + 1]]
        out[first[row]] = combine(h, len(h))[0]
    return out, first
