"""Vectorised work on whole texts in numpy: bytes, words and their hashes.

Words are maximal runs of bytes other than the six ASCII spaces (0x20, 0x09 to 0x0D). All hashes are 64 bits and don't
depend on the process, so that they can be compared across executors. Words are hashed eight bytes at a time through a
bijection that no arrangement of bytes passes unmixed (a polynomial of bytes modulo 2**64 takes Thue-Morse words for equal);
only short runs of such hashes, or of bytes, go through polynomials.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

U = np.uint64
M1, M2, M3 = U(0x9E3779B97F4A7C15), U(0xBF58476D1CE4E5B9), U(0x94D049BB133111EB)
#: Odd bases of the two polynomial hashes, modulo 2**64, and their inverses.
BASES = (0xD1342543DE82EF95, 0xA0761D6478BD642F)
SPACES = bytes([0x20, *range(0x09, 0x0E)])
TO_SPACE = bytes(0x20 if b in SPACES else b for b in range(256))
TO_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in TO_SPACE)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits in which each bit of the result depends on all bits given (splitmix64)."""
    x = (x ^ (x >> U(30))) * M2
    x ^= x >> U(27)
    x *= M3
    x ^= x >> U(31)
    return x


_BYTE = [mix((np.arange(256, dtype=U) + U(1)) * M1 * U(2 * k + 1)) for k in range(2)]
_POWERS: dict[tuple[int, bool], np.ndarray] = {}


def powers(k: int, n: int, inverse: bool = False) -> np.ndarray:
    """The first n powers of base k (or of its inverse)."""
    have = _POWERS.get((k, inverse))
    if have is None or len(have) < n:
        base = pow(BASES[k], -1, 1 << 64) if inverse else BASES[k]
        have = np.full(max(n, 1 << 16) + 1, base, dtype=U)
        have[0] = 1
        have = np.multiply.accumulate(have)
        _POWERS[k, inverse] = have
    return have[:n]


def prefix(values: np.ndarray, k: int) -> np.ndarray:
    """Sums s with s[j] - s[i] the polynomial of values[i:j], times base ** i."""
    out = np.empty(len(values) + 1, dtype=U)
    out[0] = 0
    np.cumsum(values * powers(k, len(values)), out=out[1:])
    return out


def ranged(sums: np.ndarray, start: np.ndarray, end: np.ndarray, k: int) -> np.ndarray:
    """The hash of values[start:end], whatever stands before them."""
    back = powers(k, len(sums), inverse=True)
    return mix((sums[end] - sums[start]) * back[start] + (end - start).astype(U) * M1)


def hash_ranges(values: np.ndarray, start: np.ndarray, end: np.ndarray, k: int, most: int = 1 << 18) -> np.ndarray:
    """The hash of each values[start:end] (bytes, or hashes; short runs); start and end don't fall. The values are taken in stretches, so
    that what is held besides them stays small."""
    out, i = np.empty(len(start), dtype=U), 0
    while i < len(start):
        a = int(start[i])
        j = max(i + 1, int(np.searchsorted(end, a + most, "right")))
        part = values[a : int(end[j - 1])]
        sums = prefix(_BYTE[k][part] if part.dtype == np.uint8 else part, k)
        out[i:j] = ranged(sums, start[i:j] - a, end[i:j] - a, k)
        i = j
    return out


def raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column, joined, and n + 1 offsets; null counts as empty."""
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    body = np.frombuffer(data, dtype=np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return body, at - at[0]


#: Masks of the first 0 to 8 bytes of eight, and the longest strings, in bytes, that are hashed eight bytes at a time.
_FIRST = np.array([(1 << 8 * i) - 1 for i in range(9)], dtype=U)
LONG = 256


def string_hashes(body: np.ndarray, start: np.ndarray, end: np.ndarray, k: int) -> np.ndarray:
    """Hash k of each string body[start:end]; those beyond LONG bytes by BLAKE2."""
    size = end - start
    out = mix(size.astype(U) * M1 + U(BASES[k]))
    wide = np.concatenate([body, np.zeros(8, np.uint8)])
    eight = np.ndarray(shape=(len(wide) - 7,), dtype="<u8", buffer=wide, strides=(1,))
    open_ = np.flatnonzero((size > 0) & (size <= LONG))
    at, left, h = start[open_], size[open_], out[open_]
    while len(open_):
        h = mix((h ^ (eight[at] & _FIRST[np.minimum(left, 8)])) * M1 + U(BASES[k]))
        out[open_[left <= 8]] = h[left <= 8]
        on = np.flatnonzero(left > 8)
        open_, at, left, h = open_[on], at[on] + 8, left[on] - 8, h[on]
    for i in np.flatnonzero(size > LONG).tolist():
        digest = hashlib.blake2b(body[start[i] : end[i]].tobytes(), digest_size=8, salt=bytes([k])).digest()
        out[i] = np.frombuffer(digest, dtype="<u8")[0]
    return out


@dataclass
class Words:
    """The words of some texts. doc: offsets of each text's words (n + 1); start, end: places in body."""

    body: np.ndarray
    doc: np.ndarray
    start: np.ndarray
    end: np.ndarray

    def hashes(self, k: int = 0) -> np.ndarray:
        return string_hashes(self.body, self.start, self.end, k)


def words(column: pa.Array, lower: bool = False) -> Words:
    """lower: A-Z as a-z. Spaces of any kind read as 0x20 in the body."""
    body, at = raw(column)
    return split(body, at, lower)


def split(body: np.ndarray, at: np.ndarray, lower: bool = False) -> Words:
    body = np.frombuffer(body.tobytes().translate(TO_LOWER if lower else TO_SPACE), dtype=np.uint8)
    filled = np.zeros(len(body) + 2, dtype=bool)
    filled[1:-1] = body != 32
    cut = filled[1:] != filled[:-1]
    cut[at[(at > 0) & (at < len(body))]] |= filled[at[(at > 0) & (at < len(body))]] & filled[at[(at > 0) & (at < len(body))] + 1]
    edge = np.flatnonzero(cut)
    # where two words of different texts touch, one edge both ends and begins
    touch = filled[edge] & filled[edge + 1]
    edge = np.repeat(edge, 1 + touch)
    start, end = edge[0::2], edge[1::2]
    return Words(body, np.searchsorted(start, at), start, end)


def owner(offsets: np.ndarray) -> np.ndarray:
    """For offsets of n groups, the group of each element."""
    return np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))


def runs(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """starts[i], starts[i] + 1, ... counts[i] of them, joined."""
    if not len(counts):
        return np.zeros(0, np.int64)
    ends = np.cumsum(counts)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - counts - starts, counts)


def joined(body: bytes, start: np.ndarray, end: np.ndarray) -> bytes:
    """The bytes body[start[i]:end[i]], joined: in slices, which for strings of some length is faster than place by place."""
    return b"".join([body[a:b] for a, b in zip(start.tolist(), end.tolist())])


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each `width` consecutive values."""
    have, out = 1, values
    while have * 2 <= width:
        out = np.minimum(out[:-have], out[have:]) if len(out) > have else out[:0]
        have *= 2
    return np.minimum(out[: len(out) - (width - have)], out[width - have :]) if width > have and len(out) > width - have else out if width == have else out[:0]


def merged(begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Half-open ranges as their union: sorted, neither overlapping nor touching."""
    if not len(begin):
        return begin, end
    order = np.argsort(begin, kind="stable")
    begin, end = begin[order], np.maximum.accumulate(end[order])
    first = np.r_[True, begin[1:] > end[:-1]]
    return begin[first], end[np.r_[np.flatnonzero(first)[1:] - 1, len(end) - 1]]


def hash_order(keys: np.ndarray) -> np.ndarray:
    """The order in which Index looks keys up."""
    return np.argsort(mix(keys * M1))


class Index:
    """Finds 64-bit keys among distinct ones: the ones are ordered by a hash, and looked up by its highest bits. Only the keys
    travel to executors; the rest is made where it is first used. Keys given in the order of hash_order() aren't kept twice."""

    def __init__(self, keys: np.ndarray) -> None:
        self.keys = keys
        self.made = False

    def __getstate__(self) -> dict:
        return {"keys": self.keys, "made": False}

    def _make(self) -> None:
        hashed, self.order, self.sorted = mix(self.keys * M1), None, self.keys
        if (hashed[1:] < hashed[:-1]).any():
            self.order = np.argsort(hashed).astype(np.int32)
            hashed, self.sorted = hashed[self.order], self.keys[self.order]
        bits = min(20, max(8, len(self.keys).bit_length() + 1))
        self.shift = U(64 - bits)
        first = np.searchsorted(hashed, np.arange(1 << bits, dtype=U) << self.shift)
        self.first = np.r_[first, len(self.keys)].astype(np.int32)
        self.made = True

    def find(self, wanted: np.ndarray) -> np.ndarray:
        """The place of each in the keys, or -1."""
        if not self.made:
            self._make()
        out = np.full(len(wanted), -1, np.int64)
        high = (mix(wanted * M1) >> self.shift).astype(np.int64)
        at, end = self.first[high], self.first[high + 1]
        open_ = np.flatnonzero(at < end)
        at, end = at[open_], end[open_]
        while len(open_):
            here = self.sorted[at] == wanted[open_]
            out[open_[here]] = at[here] if self.order is None else self.order[at[here]]
            on = ~here & (at + 1 < end)
            open_, at, end = open_[on], at[on] + 1, end[on]
        return out
