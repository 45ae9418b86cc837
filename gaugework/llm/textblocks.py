"""Arrow text columns as numpy byte blocks: word boundaries, word hashes and shingle hashes without a loop over rows."""

from __future__ import annotations

from collections.abc import Iterator
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa

#: Bytes of text that one vectorised step works on. A longer text is a step of its own.
BLOCK_BYTES = 1 << 20

#: Running sums are taken modulo this prime: modulo a power of two, some long words of two letters would collide for any base.
_PRIME = np.uint64((1 << 61) - 1)
_BASE = 0x1B873593CC9E2D51 % ((1 << 61) - 1)
#: Values that one step works on: few, so that they stay in the processor's cache; sums of 2 ** 22 would still fit.
_CARRY = 1 << 15
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20


def mixed(x: np.ndarray) -> np.ndarray:
    """Finalising mix of 64-bit values, so that every bit depends on all of them."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xA0761D6478BD642F)
    return x ^ (x >> np.uint64(32))


def _reduced(x: np.ndarray) -> np.ndarray:
    """Any 64-bit value modulo the prime."""
    x = (x & _PRIME) + (x >> np.uint64(61))
    x -= _PRIME * (x >= _PRIME)
    return x


def _product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Product modulo the prime of values below it."""
    low, s31, s30 = np.uint64((1 << 31) - 1), np.uint64(31), np.uint64(30)
    ah, al, bh, bl = a >> s31, a & low, b >> s31, b & low
    middle = ah * bl + al * bh
    # 2 ** 61 is 1: ah * bh counts twice, and the middle is turned by 31 bits.
    return _reduced(ah * bh * np.uint64(2) + (middle >> s30) + ((middle & np.uint64((1 << 30) - 1)) << s31) + al * bl)


@lru_cache(maxsize=1)
def _powers(bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base, and of its inverse, up to the exponent 2 ** bits - 1."""
    out = []
    for base in (_BASE, pow(_BASE, -1, int(_PRIME))):
        p = np.ones(1 << bits, dtype=np.uint64)
        for k in range(bits):
            m = 1 << k
            p[m : 2 * m] = _product(p[:m], np.uint64(pow(base, m, int(_PRIME))))
        out.append(p)
    return out[0], out[1]


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """Running polynomial sums of bytes or 64-bit values, to be passed to ``range_hash``."""
    power, _ = _powers(max(21, int(len(data)).bit_length()))
    out = np.zeros(len(data) + 1, dtype=np.uint64)
    low, s31, carry = np.uint64((1 << 31) - 1), np.uint64(31), np.zeros(2, np.uint64)
    for lo in range(0, len(data), _CARRY):
        part = data[lo : lo + _CARRY].astype(np.uint64)
        by = power[lo : lo + len(part)]
        if data.dtype == np.uint8:
            part += np.uint64(1)
            halves = [part * (by & low), part * (by >> s31)]
        else:
            part = _product(_reduced(part), by)
            halves = [part & low, part >> s31]
        for k, half in enumerate(halves):
            np.cumsum(half, out=half)
            half += carry[k]
        low_sum, high_sum = halves[0], _reduced(halves[1])
        turned = ((high_sum << s31) & _PRIME) | (high_sum >> np.uint64(30))
        out[lo + 1 : lo + 1 + len(part)] = _reduced(_reduced(low_sum) + turned)
        carry = np.array([_reduced(low_sum[-1:])[0], high_sum[-1]], dtype=np.uint64)
    return out


def range_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the content of each [start, end)."""
    _, inverse = _powers(max(21, int(len(prefix) - 1).bit_length()))
    out = np.empty(len(start), dtype=np.uint64)
    for lo in range(0, len(start), _CARRY):
        a, b = start[lo : lo + _CARRY], end[lo : lo + _CARRY]
        h = _product(_reduced(prefix[b] + _PRIME - prefix[a]), inverse[a])
        out[lo : lo + _CARRY] = mixed(h * np.uint64(0x9E3779B97F4A7C55) + (b - a).astype(np.uint64) * np.uint64(0x2545F4914F6CDD1D))
    return out


def utf8_rows(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts in a row and the n + 1 offsets of the rows; a null text is empty."""
    column = column.fill_null("")
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, offsets, values = column.buffers()
    at = np.frombuffer(offsets, dtype=kind, count=column.offset + len(column) + 1)[column.offset :].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(values, dtype=np.uint8) if values is not None else np.zeros(0, np.uint8)
    return data[at[0] : at[-1]], at - at[0]


def blocks(offsets: np.ndarray, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``limit`` bytes, at least one row each."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, side="right")) - 1)
        yield lo, min(hi, n)
        lo = min(hi, n)


class Words:
    """Words ``[^\\x20\\x09-\\x0D]+`` of the rows of a block: row, byte range and hash of each."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lower: bool = False):
        self.data = _LOWER[data] if lower else data
        self.offsets = offsets
        n = len(data)
        space = np.ones(n + 1, dtype=bool)
        space[:n] = _SPACE[data]
        first = np.zeros(n + 1, dtype=bool)
        first[offsets] = True
        before = np.ones(n + 1, dtype=bool)
        before[1:] = space[:n]
        self.start = np.flatnonzero(~space & (before | first))
        self.end = np.flatnonzero(~space[:n] & (space[1:] | first[1:])) + 1
        self.row = np.searchsorted(offsets, self.start, side="right") - 1
        rows = len(offsets) - 1
        #: Words of row i are bounds[i] up to bounds[i + 1].
        self.bounds = np.searchsorted(self.row, np.arange(rows + 1))

    @cached_property
    def hash(self) -> np.ndarray:
        return range_hash(prefix_hash(self.data), self.start, self.end)

    def ids(self) -> np.ndarray:
        """A number from 0 for each word, the same for equal words of this block only."""
        inside = np.zeros(len(self.data) + 1, dtype=np.int8)
        inside[self.start] += 1
        np.subtract.at(inside, self.end, 1)
        text = self.data[np.cumsum(inside[:-1], dtype=np.int8).astype(bool)]
        ends = np.concatenate([[0], np.cumsum(self.end - self.start)])
        words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(self.start), [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(text))])
        return words.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int32)

    def shingles(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Index of the first word, and hash, of each run of k words inside one row."""
        n = len(self.hash) - k + 1
        if n <= 0:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        h = np.zeros(n, dtype=np.uint64)
        for i in range(k):
            h = h * np.uint64(0xFF51AFD7ED558CCD) + self.hash[i : i + n]
        at = np.flatnonzero(self.row[:n] == self.row[k - 1 :])
        return at, mixed(h[at])


def signed(x: np.ndarray) -> np.ndarray:
    """The same 64 bits as Spark's bigint."""
    return x.view(np.int64)
