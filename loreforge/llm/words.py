"""Vectorised word splitting and hashing over Arrow string columns.

A word is a maximal run of bytes outside space and the controls 0x09-0x0D. All
of those are ASCII, so splitting UTF-8 bytes equals splitting code points. The
functions work on the bytes of a column as Arrow lays them out: texts one after
another with offsets, hence no Python string is made for a word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_BYTES = 1 << 20
_POW_LEN = 1 << 12
_U = np.uint64
_GOLD = 0x9E3779B97F4A7C15

WHITE = np.zeros(256, bool)
WHITE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambler of 64-bit values (the finaliser of splitmix64)."""
    x = x ^ (x >> _U(30))
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


def _powers(base: int, n: int) -> np.ndarray:
    out, x = np.empty(n, np.uint64), 1
    for i in range(n):
        out[i] = x
        x = x * base & 0xFFFFFFFFFFFFFFFF
    return out


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * _U(_GOLD))
_POW = _powers(0xD6E8FEB86659FD93, _POW_LEN)
#: Spans up to this length are hashed a place at a time, over all spans; what a byte adds at each place.
_SHORT = 32
_PLACED = _BYTE * _POW[:_SHORT, None]


def texts_of(batch: pa.RecordBatch, name: str = "text") -> pa.Array:
    """The column with nulls as empty texts."""
    arr = batch.column(batch.schema.get_field_index(name))
    return pc.fill_null(arr, "") if arr.null_count else arr


def chunks(arr: pa.Array, most: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Yields (first row, end row, bytes, offsets into them) for runs of whole
    texts of about `most` bytes; a longer text comes alone."""
    if not len(arr):
        return
    large = pa.types.is_large_string(arr.type) or pa.types.is_large_binary(arr.type)
    _, offs, data = arr.buffers()
    offs = np.frombuffer(offs, np.int64 if large else np.int32)[arr.offset : arr.offset + len(arr) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    lo = 0
    while lo < len(arr):
        hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + most, side="right")) - 1)
        hi = min(hi, len(arr))
        yield lo, hi, data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo]
        lo = hi


def spans(buf: np.ndarray, offs: np.ndarray, white: np.ndarray = WHITE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word starts and ends in bytes, and each text's offsets into the words."""
    n = len(buf)
    if not n:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.zeros(len(offs), np.int64)
    ws = white[buf]
    edge = np.empty(n, bool)
    edge[0], edge[1:] = True, ws[:-1]
    edge[offs[:-1][offs[:-1] < n]] = True
    starts = np.flatnonzero(edge & ~ws)
    edge[-1], edge[:-1] = True, ws[1:]
    edge[offs[1:][offs[1:] > 0] - 1] = True
    ends = np.flatnonzero(edge & ~ws) + 1
    return starts, ends, np.searchsorted(starts, offs)


def _hash_part(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    base, stop = int(starts[0]), int(ends[-1])
    seg = np.diff(np.append(starts, stop))
    at = np.arange(base, stop, dtype=np.int64)
    at -= np.repeat(starts, seg)
    if len(seg) and seg.max() > _POW_LEN:
        far = at >= _POW_LEN
        at[far] &= _POW_LEN - 1
    val = _BYTE[buf[base:stop]]
    val *= _POW[at]
    # what follows a word up to the next start must not count
    outside = at >= np.repeat(ends - starts, seg) if not (seg.max() > _POW_LEN) else np.arange(base, stop) >= np.repeat(ends, seg)
    val[outside] = 0
    return np.add.reduceat(val, starts - base)


def _hash_short(buf: np.ndarray, starts: np.ndarray, size: np.ndarray) -> np.ndarray:
    """What _hash_part gives, for spans of at most _SHORT bytes."""
    order = np.argsort(size.astype(np.uint8), kind="stable")
    at, from_ = starts[order], np.searchsorted(size[order], np.arange(_SHORT), side="right")
    sums = np.zeros(len(at), np.uint64)
    for j, i in enumerate(from_[: int(size.max(initial=0))]):
        sums[i:] += _PLACED[j][buf[at[i:] + j]]
    out = np.empty_like(sums)
    out[order] = sums
    return out


def hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, most: int = CHUNK_BYTES) -> np.ndarray:
    """A 64-bit hash of each byte span (words, lines); memory stays within a few
    times `most` however long the text, unless one span is longer itself."""
    size = ends - starts
    short = size <= _SHORT
    if len(starts) <= most and 2 * np.count_nonzero(short) > len(starts):  # words: the few long ones are laid next to each other
        out, far = np.empty(len(starts), np.uint64), np.flatnonzero(~short)
        if not len(far):
            out[:] = _hash_short(buf, starts, size)
        else:
            out[short] = _hash_short(buf, starts[short], size[short])
            if int(size[far].sum()) > most:
                out[far] = _raw(buf, starts[far], ends[far], most)
            else:
                to = np.cumsum(size[far])
                out[far] = _raw(buf[np.arange(to[-1]) + np.repeat(starts[far] - to + size[far], size[far])], to - size[far], to, most)
    else:
        out = _raw(buf, starts, ends, most)
    return mix(out + size.astype(np.uint64) * _U(_GOLD))


def _raw(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, most: int) -> np.ndarray:
    """Hashes of spans of any length, before they are mixed with the length."""
    out, i = np.empty(len(starts), np.uint64), 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + most, side="right")))
        out[i:j] = _hash_part(buf, starts[i:j], ends[i:j])
        i = j
    long = np.flatnonzero(ends - starts > _POW_LEN)
    for i in long:  # powers repeat beyond the table: fold the pieces with their places
        x = 0
        for p in range(int(starts[i]), int(ends[i]), _POW_LEN):
            part = buf[p : min(p + _POW_LEN, int(ends[i]))]
            x = (x * _GOLD + int((_BYTE[part] * _POW[: len(part)]).sum(dtype=np.uint64))) & 0xFFFFFFFFFFFFFFFF
        out[i] = x
    return out


def window_hash(h: np.ndarray, k: int, mult: int) -> np.ndarray:
    """Hash of each k consecutive values, by doubling; len(h) - k + 1 results."""
    n = len(h) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    m, out, done, block, length = 0xFFFFFFFFFFFFFFFF, None, 0, h, 1
    while True:
        if k & length:
            if out is None:
                out = block
            else:
                out = out[: len(h) - done - length + 1] * _U(pow(mult, length, m + 1)) + block[done : done + len(h) - done - length + 1]
            done += length
        if done == k:
            return mix(out[:n])
        block = block[:-length] * _U(pow(mult, length, m + 1)) + block[length:]
        length *= 2


def window_argmin(g: np.ndarray, w: int) -> np.ndarray:
    """Place of the leftmost minimum of each w consecutive values."""
    n = len(g) - w + 1
    if n <= 0:
        return np.empty(0, np.int64)
    val, at, length = g, np.arange(len(g), dtype=np.int64), 1

    def later(val, at, by, n):
        right = val[by : by + n] < val[:n]
        return np.where(right, val[by : by + n], val[:n]), np.where(right, at[by : by + n], at[:n])

    while length * 2 <= w:
        val, at = later(val, at, length, len(val) - length)
        length *= 2
    return later(val, at, w - length, n)[1] if length < w else at[:n]


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)
