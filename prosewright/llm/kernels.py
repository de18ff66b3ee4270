"""Numpy kernels over the bytes of Arrow string columns."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
#: Odd bases of the polynomial hashes, and seeds of the byte tables.
BASE = U(0x9E3779B97F4A7C15)
BASE_2 = U(0xC2B2AE3D27D4EB4F)
#: Texts are taken in groups of about so many bytes; one long text is one group.
GROUP_BYTES = 1 << 20
#: Longer spans get a cryptographic hash: sums of powers modulo 2 ** 64 meet on some crafted strings of 2048 bytes.
LONG_SPAN = 512
#: and of at most so many rows.
GROUP_ROWS = 1 << 18


def mix(x: np.ndarray) -> np.ndarray:
    """Finalizer of 64-bit hashes; a bijection."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def byte_table(seed: int) -> np.ndarray:
    """256 odd-looking 64-bit values, from the finalizer."""
    return mix(np.arange(1, 257, dtype=U) * BASE + U(seed))


TABLE = byte_table(1)
TABLE_2 = byte_table(2)
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True


def powers(base: np.uint64, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1), modulo 2 ** 64."""
    out = np.empty(max(n, 1), U)
    out[0] = 1
    have, step = 1, int(base)
    while have < n:
        more = min(have, n - have)
        out[have : have + more] = out[:more] * U(step)
        step = step * step % (1 << 64)
        have += more
    return out


def inverse(base: np.uint64) -> np.uint64:
    return U(pow(int(base), -1, 1 << 64))


class Rolling:
    """Hashes of substrings of ``data`` from prefix sums: equal strings, equal hashes."""

    def __init__(self, data: np.ndarray, base: np.uint64 = BASE, table: np.ndarray = TABLE):
        p = powers(base, len(data))
        self.prefix = np.zeros(len(data) + 1, U)
        np.cumsum(table[data] * p, out=self.prefix[1:])
        self.back = inverse(base)
        self._inv: np.ndarray | None = None
        self.n = len(data)

    def spans(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        if self._inv is None:
            self._inv = powers(self.back, self.n + 1)
        return mix((self.prefix[end] - self.prefix[start]) * self._inv[start] + (end - start).astype(U) * BASE_2)


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of the spans [start, end) of ``data``, which follow one another; memory is bounded by blocks of GROUP_BYTES."""
    out = np.empty(len(start), U)
    long = end - start > LONG_SPAN
    for i in np.flatnonzero(long).tolist():
        out[i] = int.from_bytes(hashlib.blake2b(data[start[i] : end[i]], digest_size=8).digest(), "little")
    rest = np.flatnonzero(~long)
    lo = 0
    while lo < len(rest):
        begin = start[rest[lo]]
        hi = max(lo + 1, int(np.searchsorted(end[rest], begin + GROUP_BYTES, "right")))
        at = rest[lo:hi]
        out[at] = Rolling(data[begin : end[at[-1]]]).spans(start[at] - begin, end[at] - begin)
        lo = hi
    return out


def pack_row(row: np.ndarray, h: np.ndarray, n_rows: int) -> tuple[np.ndarray, int]:
    """Row and as many upper bits of a hash as there is room for in one word each, sorted; and the number of those bits."""
    bits = 64 - max(1, int(n_rows - 1).bit_length())
    return np.sort((row.astype(U) << U(bits)) | (h >> U(64 - bits))), bits


def columns(batch: pa.RecordBatch, name: str) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null counts as empty."""
    col = batch.column(name)
    col = pc.cast(pc.fill_null(col, ""), pa.large_string())
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    _, off, data = col.buffers()
    offsets = np.frombuffer(off, np.int64)[col.offset : col.offset + len(col) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def groups(offsets: np.ndarray, most: int = GROUP_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``most`` bytes."""
    n, lo = len(offsets) - 1, 0
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + most, "right")) - 1
        hi = min(max(hi, lo + 1), n, lo + GROUP_ROWS)
        yield lo, hi
        lo = hi


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, row) of each run of bytes other than \\x20 and \\x09-\\x0D."""
    if not len(data):
        z = np.zeros(0, np.int64)
        return z, z, z
    on = ~SPACE[data]
    first, last = np.empty(len(data), bool), np.empty(len(data), bool)
    first[0] = last[-1] = True
    np.logical_not(on[:-1], out=first[1:])
    np.logical_not(on[1:], out=last[:-1])
    full = offsets[:-1] < offsets[1:]
    first[offsets[:-1][full]] = True
    last[offsets[1:][full] - 1] = True
    start, end = np.flatnonzero(on & first), np.flatnonzero(on & last) + 1
    return start, end, np.searchsorted(offsets, start, "right") - 1


def shingles(word_hash: np.ndarray, row: np.ndarray, n_rows: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, row) of each window of ``k`` words; a text of 1 to k - 1 words is one window."""
    per = np.bincount(row, minlength=n_rows)
    pad = np.concatenate([word_hash, np.zeros(k, U)])
    out = np.zeros(len(word_hash), U)
    at = np.arange(len(word_hash)) - np.repeat(np.cumsum(per) - per, per)  # position in its text
    left = np.repeat(per, per) - at
    for j in range(k):
        part = pad[j : j + len(word_hash)] * powers(BASE_2, k)[j]
        out += part if j == 0 else np.where(left > j, part, U(0))
    keep = (left >= k) | (at == 0)
    return mix(out[keep]), row[keep]


def take_ranges(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Indices of the ranges [start, start + length), one after the other."""
    total = int(length.sum())
    out = np.ones(total, np.int64)
    full = length > 0
    s, n = start[full], length[full]
    if not total:
        return np.zeros(0, np.int64)
    at = np.cumsum(n) - n
    out[at[0]] = s[0]
    out[at[1:]] = s[1:] - (s[:-1] + n[:-1] - 1)
    return np.cumsum(out)
