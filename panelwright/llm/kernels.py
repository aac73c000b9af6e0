"""Vectorised byte and shingle kernels over Arrow buffers.

All work on the concatenated UTF-8 bytes of a slice of rows, so no Python object is made per
word.  Slices are cut by bytes, which bounds a worker's memory by the slice or by the longest
single text, whichever is larger.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 2 << 20
SHINGLE = 5

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
LOWER, WORD = _LOWER.tobytes(), re.compile(rb"[^\x20\x09-\x0D]+")

#: The first n bytes of eight, little-endian.
_MASKS = np.array([(1 << 8 * n) - 1 for n in range(9)], _U)

_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**n modulo 2**64; kept between calls while small."""
    have = _powers.get(base)
    if have is None or len(have) <= n:
        size = max(n + 1, SLICE_BYTES + 1)
        have = np.full(size, base, _U)
        have[0] = 1
        have = np.cumprod(have)
        if size <= 8 * SLICE_BYTES:
            _powers[base] = have
    return have


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (xor-shift-multiply)."""
    h = h ^ (h >> _U(30))
    h = h * _U(0xBF58476D1CE4E5B9)
    h ^= h >> _U(27)
    h *= _U(0x94D049BB133111EB)
    h ^= h >> _U(31)
    return h


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets) of runs of rows of about ``limit`` bytes; nulls are empty."""
    col = batch.column(batch.schema.get_field_index(column))
    if pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type):
        width = np.int64
    else:
        width = np.int32
    if col.null_count:
        col = col.fill_null("")
    bufs = col.buffers()
    n = len(col)
    if not n:
        return
    offs = np.frombuffer(bufs[1], width)[col.offset : col.offset + n + 1].astype(np.int64)
    data = np.frombuffer(bufs[2], np.uint8) if bufs[2] is not None else np.zeros(0, np.uint8)
    i = 0
    while i < n:
        j = int(np.searchsorted(offs, offs[i] + limit, side="right")) - 1
        j = min(n, max(i + 1, j))
        yield i, data[offs[i] : offs[j]], offs[i : j + 1] - offs[i]
        i = j


def word_bounds(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words ``[^\\x20\\x09-\\x0D]+``; words never cross rows."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    inside = ~_SPACE[data]
    before = np.empty_like(inside)
    before[0] = False
    before[1:] = inside[:-1]
    cuts = offs[(offs > 0) & (offs < len(data))]
    before[cuts] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.empty_like(inside)
    after[-1] = False
    after[:-1] = inside[1:]
    after[cuts - 1] = False
    return starts, np.flatnonzero(inside & ~after) + 1


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word with A-Z lowered.

    Every eight bytes of a word are mixed with their place by a bijection that is not linear, then
    added, so no pattern of letters collides by its structure (as, say, Thue-Morse words do in any
    polynomial modulo a power of two), and a word's length counts.
    """
    if not len(starts):
        return np.zeros(0, _U)
    low = np.zeros(len(data) + 8, np.uint8)
    low[: len(data)] = _LOWER[data]
    eight = np.lib.stride_tricks.as_strided(low, (len(data) + 1, 8), (1, 1))
    blocks = (ends - starts + 7) >> 3
    first = np.cumsum(blocks) - blocks
    k = np.arange(int(blocks.sum())) - np.repeat(first, blocks)
    at = np.repeat(starts, blocks) + 8 * k
    held = np.repeat(ends, blocks) - at
    values = np.ascontiguousarray(eight[at]).view("<u8").ravel() & _MASKS[np.minimum(held, 8)]
    values = mix(values ^ mix((k.astype(_U) + _U(1)) * _U(_BASE)))
    return mix(np.add.reduceat(values, first) + (ends - starts).astype(_U) * _U(_BASE))


def shingles(data: np.ndarray, offs: np.ndarray, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each row's word shingles, in order, and their offsets by row.

    A row with fewer than ``size`` words has the whole sequence as one shingle; without words none.
    """
    starts, ends = word_bounds(data, offs)
    words = word_hashes(data, starts, ends)
    first = np.searchsorted(starts, offs)  # word number at which each row begins
    counts = np.diff(first)
    n = len(words)
    rolled = np.zeros(n, _U)
    for k in range(min(size, n)):
        part = words * _U(powers(_BASE ^ 0x5851F42D4C957F2C, size)[k + 1])
        rolled[: n - k] += part[k:] if k else part
    out_counts = np.where(counts >= size, counts - size + 1, np.minimum(counts, 1))
    out_offs = np.zeros(len(counts) + 1, np.int64)
    np.cumsum(out_counts, out=out_offs[1:])
    take = np.repeat(first[:-1] - out_offs[:-1], out_counts) + np.arange(out_offs[-1])
    got = rolled[take]
    for r in np.flatnonzero((counts > 0) & (counts < size)):
        w = words[first[r] : first[r + 1]]
        got[out_offs[r]] = (w * powers(_BASE ^ 0x5851F42D4C957F2C, size)[1 : len(w) + 1]).sum(dtype=_U) + _U(len(w))
    return mix(got), out_offs
