"""Vectorised word and window hashing over Arrow string columns.

A word is hashed in blocks of eight bytes, each mixed with a key of its place.  A
run of words is hashed by doubling: the hash of 2**k words mixes those of its two
halves, and any other run that of the two overlapping halves that cover it.  No
step is a sum of powers, so there are no texts of which equal hashes are known.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

_U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """The 64-bit finaliser of splitmix64."""
    x = x ^ (x >> _U(30))
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


_FIRST, _SECOND, _SIZE = _U(0x9E3779B97F4A7C15), _U(0xD1342543DE82EF95), _U(0xA0761D6478BD642F)
#: What remains of eight bytes of which so many count.
_MASK = np.array([(1 << 8 * k) - 1 for k in range(9)], _U)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_BLANK = np.zeros(256, bool)
_BLANK[[32, 9, 10, 11, 12, 13]] = True


def hash_bytes(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of the byte runs [start, end), none of them empty."""
    eight = np.ndarray(len(buf), "<u8", np.append(buf, np.zeros(8, np.uint8)), strides=(1,))
    size = end - start
    out = mix((eight[start] & _MASK[np.minimum(size, 8)]) + size.astype(_U) * _SIZE)
    long = np.flatnonzero(size > 8)
    if len(long):
        blocks = (size[long] - 1) // 8
        first = np.cumsum(blocks) - blocks
        which = np.repeat(long, blocks)
        no = np.arange(len(which)) - np.repeat(first, blocks) + 1
        x = eight[start[which] + 8 * no] & _MASK[np.minimum(size[which] - 8 * no, 8)]
        out[long] = mix(out[long] + np.add.reduceat(mix(x ^ mix(no.astype(_U) * _FIRST)), first))
    return out


class Runs:
    """Hashes of runs of words, from the words' own."""

    def __init__(self, words: np.ndarray):
        self.level = [words]

    def _doubled(self, k: int) -> np.ndarray:
        """Hash of the 2**k words from each place on."""
        while len(self.level) <= k:
            half, x = 1 << len(self.level) - 1, self.level[-1]
            n = max(0, len(x) - half)
            self.level.append(mix(x[:n] * _FIRST + x[half : half + n]))
        return self.level[k]

    def of(self, start: np.ndarray, size: np.ndarray | int) -> np.ndarray:
        """Hashes of the runs of ``size`` words (one or more) from ``start`` on."""
        if np.ndim(size) == 0:
            k = int(size).bit_length() - 1
            x = self._doubled(k)
            return x[start] if size == 1 << k else mix(x[start] * _SECOND + x[start + (size - (1 << k))] + _U(size * int(_SIZE) & (1 << 64) - 1))
        out = np.empty(len(start), _U)
        for n in np.unique(size).tolist():
            at = np.flatnonzero(size == n)
            out[at] = self.of(start[at], n)
        return out


def slices(column: pa.Array, most: int = 1 << 21):
    """(first row, last row + 1) of runs of rows with about ``most`` bytes, one row at least."""
    _, offsets, _ = parts(column)
    i, n = 0, len(column)
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
        yield i, min(j, n)
        i = j


def parts(column: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """All bytes and the rows' offsets of a string column; a null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    if column.null_count:
        column = column.fill_null("" if not pa.types.is_binary(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, off, data = column.buffers()
    offsets = np.frombuffer(off, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64) if off else np.zeros(1, np.int64)
    return (np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)), offsets, column


def words(data: np.ndarray, offsets: np.ndarray, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, number of words before each row's end, with 0 first)."""
    at = offsets - offsets[0]
    buf = data[offsets[0] : offsets[-1]]
    if not len(buf):
        return np.zeros(0, _U), np.zeros(len(offsets), np.int64)
    ink = ~_BLANK[buf]
    first, last = ink.copy(), ink.copy()
    first[1:] &= ~ink[:-1]
    last[:-1] &= ~ink[1:]
    inner = at[1:-1]
    inner = inner[(inner > 0) & (inner < len(buf))]
    first[inner] = ink[inner]
    last[inner - 1] = ink[inner - 1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    return hash_bytes(LOWER[buf] if lower else buf, start, end), np.searchsorted(start, at)


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    size, out = 1, x
    while size * 2 <= width:
        out = np.minimum(out[:-size], out[size:])
        size *= 2
    return np.minimum(out[: len(x) - width + 1], out[width - size : len(x) - size + 1]) if size < width else out
