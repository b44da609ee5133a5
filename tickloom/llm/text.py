"""Words of many texts as numpy arrays: boundaries and 64-bit hashes without a Python loop per word.

Texts arrive as Arrow batches inside Spark tasks. All helpers work on the UTF-8 bytes of a
batch, in pieces of about a megabyte, so that a task's memory follows the piece and not the batch.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa

PIECE = 1 << 20
U64 = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_tables: dict[int, tuple[np.ndarray, np.ndarray]] = {}

#: Word bytes of the classes used by the operators; every byte of a multi-byte character is >= 0x80.
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[0x20, *range(0x09, 0x0E)]] = False
ALNUM = np.zeros(256, bool)
ALNUM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


class Words(NamedTuple):
    doc: np.ndarray    # index of the text, ascending
    hash: np.ndarray   # 64-bit hash of the (folded) word
    start: np.ndarray  # byte offsets into data
    end: np.ndarray


def mix(x: np.ndarray) -> np.ndarray:
    """Finalise 64-bit hashes; a bijection."""
    x = x ^ (x >> U64(33))
    x = x * U64(0xFF51AFD7ED558CCD)
    x ^= x >> U64(33)
    x *= U64(0xC4CEB9FE1A85EC53)
    x ^= x >> U64(33)
    return x


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse modulo 2^64."""
    if _BASE not in _tables or len(_tables[_BASE][0]) < n:
        size = max(n, PIECE + (PIECE >> 3))
        both = []
        for b in (_BASE, pow(_BASE, -1, 1 << 64)):
            a = np.full(size, b, U64)
            a[0] = 1
            both.append(np.multiply.accumulate(a))
        if n > 4 * PIECE:
            return both[0], both[1]  # a giant word: not kept
        _tables[_BASE] = (both[0], both[1])
    return _tables[_BASE]


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and offsets of a string array; null texts are empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks() if texts.num_chunks != 1 else texts.chunk(0)
    if texts.null_count:
        texts = texts.fill_null("")
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    _, offs, data = texts.buffers()
    if len(texts) == 0 or offs is None:
        return np.zeros(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    o = np.frombuffer(offs, kind, len(texts) + 1, texts.offset * np.dtype(kind).itemsize).astype(np.int64)
    d = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return d[o[0]:o[-1]], o - o[0]


def slices(offs: np.ndarray, limit: int = 2 * PIECE):
    """Index ranges of texts whose bytes sum to about the limit; a longer text stands alone."""
    lo, n = 0, len(offs) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + limit, "right")) - 1)
        yield lo, min(hi, n)
        lo = hi


def words(data: np.ndarray, offs: np.ndarray, inside: np.ndarray, fold: np.ndarray | None = None) -> Words:
    """Maximal runs of ``inside`` bytes, never across two texts; ``fold`` maps bytes before hashing."""
    docs, hashes, starts, ends = [], [], [], []
    lo, size = 0, len(data)
    while lo < size:
        hi = min(lo + PIECE, size)
        while hi < size and inside[data[hi]]:  # cut at a separator
            stop = min(hi + 4096, size)
            gap = np.flatnonzero(~inside[data[hi:stop]])
            hi = hi + int(gap[0]) if len(gap) else stop
        b = data[lo:hi]
        isw = inside[b]
        before = np.empty_like(isw)
        before[0] = False
        before[1:] = isw[:-1]
        first = offs[np.searchsorted(offs, lo, "right"):np.searchsorted(offs, hi, "left")] - lo
        before[first] = False
        s = np.flatnonzero(isw & ~before)
        after = np.empty_like(isw)
        after[-1] = False
        after[:-1] = isw[1:]
        after[first - 1] = False
        e = np.flatnonzero(isw & ~after) + 1
        if len(s):
            up, down = _powers(hi - lo)
            v = (fold[b] if fold is not None else b).astype(U64)
            v += U64(1)
            v *= up[:hi - lo]
            np.cumsum(v, out=v)
            h = v[e - 1]
            h[s > 0] -= v[s[s > 0] - 1]
            h *= down[s]
            hashes.append(mix(h))
            starts.append(s + lo)
            ends.append(e + lo)
            docs.append(np.searchsorted(offs, s + lo, "right") - 1)
        lo = hi
    if not docs:
        z = np.zeros(0, np.int64)
        return Words(z, np.zeros(0, U64), z, z)
    return Words(np.concatenate(docs), np.concatenate(hashes), np.concatenate(starts), np.concatenate(ends))


def windows(h: np.ndarray, k: int, salt: int = 0x8CB92BA72F3D8DD7) -> np.ndarray:
    """Hash of ``h[i:i+k]`` for every i, by doubling; the caller masks windows that leave a text."""
    m = len(h) - k + 1
    if m <= 0:
        return np.zeros(0, U64)
    base = salt | 1
    out, have, block, width, rest = None, 0, h, 1, k
    while rest:
        if rest & 1:
            part = block[have:have + m]
            out = part.copy() if out is None else out * U64(pow(base, width, 1 << 64)) + part
            have += width
        rest >>= 1
        if rest:
            block = block[:len(block) - width] * U64(pow(base, width, 1 << 64)) + block[width:]
            width *= 2
    return mix(out + U64(k))


def counts_by(index: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(index, minlength=n).astype(np.int64)


def spans(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Concatenated ranges start..start+length."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    shift = np.repeat(starts - np.concatenate(([0], np.cumsum(lengths)[:-1])), lengths)
    return shift + np.arange(total)


def planes(a: np.ndarray) -> bytes:
    """The bytes of an integer array, most alike bytes together, so that block compression finds them."""
    w = a.dtype.itemsize
    return np.ascontiguousarray(a).view(np.uint8).reshape(-1, w).T.tobytes()


def unplanes(b, dtype) -> np.ndarray:
    w = np.dtype(dtype).itemsize
    a = np.frombuffer(b, np.uint8).reshape(w, -1).T
    return np.ascontiguousarray(a).view(dtype).reshape(-1)


def pack_sorted(keys: np.ndarray) -> bytes:
    """Ascending 64-bit keys as differences: four bytes each where they fit."""
    if not len(keys):
        return b""
    d = np.diff(keys, prepend=U64(0))
    head, d = d[0], d[1:]
    wide = bool(len(d)) and int(d.max()) >> 32
    return bytes([8 if wide else 4]) + int(head).to_bytes(8, "little") + planes(d.astype(U64 if wide else np.uint32))


def unpack_sorted(b) -> np.ndarray:
    b = memoryview(b)
    if not len(b):
        return np.zeros(0, U64)
    d = unplanes(b[9:], U64 if b[0] == 8 else np.uint32)
    out = np.empty(len(d) + 1, U64)
    out[0] = int.from_bytes(b[1:9], "little")
    out[1:] = d
    return np.cumsum(out, out=out)
