"""Vectorised byte and word kernels over Arrow string columns.

Texts are handled as one UTF-8 buffer with offsets, never as Python strings, in chunks of bounded size. Words are the runs
of bytes outside ASCII white space, which in UTF-8 is the same as the runs of code points outside it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

CHUNK_BYTES = 2 << 20
LONG_WORD = 256

SPACE = np.zeros(256, dtype=bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_MASK = np.array([0] + [(1 << (8 * k)) - 1 for k in range(1, 9)], dtype=np.uint64)
_M1, _M2, _M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0xD6E8FEB86659FD93)
_S29, _S32, _S31 = np.uint64(29), np.uint64(32), np.uint64(31)


def text_buffer(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; a null is an empty text."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = col.fill_null("" if pa.types.is_string(col.type) or pa.types.is_large_string(col.type) else b"")
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    _, off, data = col.buffers()
    if off is None or len(col) == 0:
        return np.zeros(0, np.uint8), np.zeros(len(col) + 1, np.int64)
    offs = np.frombuffer(off, dtype=np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    buf = np.frombuffer(data, dtype=np.uint8)[offs[0] : offs[-1]] if data is not None else np.zeros(0, np.uint8)
    return buf, offs - offs[0]


def chunks(buf: np.ndarray, offs: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of rows ``lo..hi`` of at most ``limit`` bytes (one row at least), with their bytes and offsets."""
    lo, n = 0, len(offs) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + limit, side="right")) - 1)
        yield lo, hi, buf[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo]
        lo = hi


def word_spans(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every word, and ``first``: words ``first[d]..first[d+1]`` are those of row ``d``."""
    if len(buf) == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offs), np.int64)
    solid = ~SPACE[buf]
    edge = np.zeros(len(buf) + 1, dtype=bool)  # a row starts (or ends) here
    edge[offs] = True
    before = np.empty(len(buf), dtype=bool)
    before[0], before[1:] = False, solid[:-1]
    starts = np.flatnonzero(solid & (~before | edge[:-1]))
    after = np.empty(len(buf), dtype=bool)
    after[-1], after[:-1] = False, solid[1:]
    ends = np.flatnonzero(solid & (~after | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, offs)


def hash_spans(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of each span of bytes, eight bytes at a step for all spans together."""
    size = ends - starts
    h = (size.astype(np.uint64) + np.uint64(seed)) * _M3
    if len(starts) == 0:
        return h
    padded = np.concatenate([buf, np.zeros(8, np.uint8)])
    eight = np.ndarray(shape=(len(buf) + 1,), dtype="<u8", buffer=padded, strides=(1,))
    live, at, left = None, starts, size
    if (big := size > LONG_WORD).any():
        live = np.flatnonzero(~big)
        at, left = starts[live], size[live]
    k = 0
    while True:
        x = eight[at] & _MASK[np.minimum(left, 8)]
        g = h if live is None else h[live]
        g = (g ^ x) * _M1
        g ^= g >> _S29
        g *= _M2
        g ^= g >> _S32
        if live is None:
            h = g
        else:
            h[live] = g
        k += 8
        more = np.flatnonzero(left > 8)
        if len(more) == 0:
            break
        live = more if live is None else live[more]
        at, left = at[more] + 8, left[more] - 8
    for i in np.flatnonzero(big):
        h[i] = np.uint64(xxhash.xxh3_64_intdigest(buf[starts[i] : ends[i]].tobytes(), seed))
    return h


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection on 64 bits that spreads every input bit."""
    h = (h ^ (h >> _S32)) * _M3
    h = (h ^ (h >> _S29)) * _M2
    return h ^ (h >> _S32)


def chained(h: np.ndarray, width: int) -> np.ndarray:
    """Hash of each run of ``width`` items of ``h`` (order counts); ``len(h) - width + 1`` results."""
    n = len(h) - width + 1
    s = np.full(n, np.uint64(width), dtype=np.uint64) * _M3
    for j in range(width):
        s = (s ^ (s >> _S31)) * _M1 + h[j : j + n]
    return mixed(s)


def shingle_rows(words: np.ndarray, first: np.ndarray, width: int) -> list[np.ndarray]:
    """Of each row, the sorted distinct hashes of its ``width``-word shingles; with fewer words the whole sequence is one."""
    out = []
    allh = chained(words, width) if len(words) >= width else np.zeros(0, np.uint64)
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= width:
            out.append(distinct(allh[a : b - width + 1]))
        else:
            out.append(chained(words[a:b], b - a) if b > a else np.zeros(0, np.uint64))
    return out


def distinct(h: np.ndarray) -> np.ndarray:
    s = np.sort(h)
    keep = np.empty(len(s), dtype=bool)
    keep[:1] = True
    np.not_equal(s[1:], s[:-1], out=keep[1:])
    return s[keep]


def gather_bytes(flat: np.ndarray, off: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Concatenate entries ``ids`` of a table of byte strings; the bytes, and where each entry starts (one more at the end)."""
    size = (off[1:] - off[:-1])[ids]
    at = np.zeros(len(ids) + 1, dtype=np.int64)
    np.cumsum(size, out=at[1:])
    index = np.repeat(off[:-1][ids] - at[:-1], size)
    index += np.arange(at[-1])
    return flat[index], at


def to_long(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)


def list_array(rows: list[np.ndarray], kind: pa.DataType = pa.int64()) -> pa.Array:
    off = np.zeros(len(rows) + 1, dtype=np.int32)
    np.cumsum([len(r) for r in rows], out=off[1:])
    flat = np.concatenate(rows) if rows else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(off), pa.array(flat.view(np.int64) if flat.dtype == np.uint64 else flat, type=kind))
