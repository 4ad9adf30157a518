"""Hashes of all words, windows and lines of a batch at once.

A prefix sum of ``value[i] * B**i`` modulo the prime P = 2**61 - 1 gives the hash of any slice in O(1):
``(S[b] - S[a]) * B**-a``.  Two unequal slices of n values share it only if B is a root of a polynomial of degree n, of
which there are at most n among the P possible bases, whatever the values are (modulo a power of two there is no such
bound: Thue-Morse sequences of any two symbols cancel there for every base).  Where a result rests on equality alone, the
hashes of two bases are used together.
"""

from __future__ import annotations

import numpy as np

P = (1 << 61) - 1
#: Drawn at random, one for each hash.
BASES = (1_490_276_117_366_541_253, 2_071_654_313_920_470_107)
_P, _LOW31, _LOW30 = np.uint64(P), np.uint64((1 << 31) - 1), np.uint64((1 << 30) - 1)
_30, _31, _61, _TWICE = np.uint64(30), np.uint64(31), np.uint64(61), np.uint64(2 * P)
#: Values that one running sum takes: sums of terms below 2**40 stay below 2**54, and its arrays in the cache.
BLOCK = 1 << 14


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values (xor-shift, multiply)."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


def byte_values() -> np.ndarray:
    """A value for each byte; they need only be different and not null."""
    return np.arange(1, 257, dtype=np.uint64)


def _fold(x: np.ndarray) -> np.ndarray:
    """At most P plus a few, and the same modulo P."""
    return (x & _P) + (x >> _61)


def times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a * b modulo P, for values of at most 61 bits."""
    ah, al, bh, bl = a >> _31, a & _LOW31, b >> _31, b & _LOW31
    middle = al * bh + ah * bl
    return _fold(_fold(ah * bh * np.uint64(2) + (middle >> _30) + ((middle & _LOW30) << _31) + al * bl))


_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(n: int, which: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """B**i and B**-i for i < n."""
    have = _POWERS.get(which)
    if have is None or len(have[0]) < n:
        size = 1 << max(16, int(n).bit_length())
        have = tuple(_power_table(base, size) for base in (BASES[which], pow(BASES[which], -1, P)))
        if size <= 1 << 23:
            _POWERS[which] = have
    return have[0][:n], have[1][:n]


def _power_table(base: int, size: int) -> np.ndarray:
    out = np.ones(size, np.uint64)
    n = 1
    while n < size:
        out[n : 2 * n] = times(out[:n], np.uint64(pow(base, n, P)))
        n *= 2
    return out


class Sums:
    """Prefix sums over values; ``of(a, b)`` hashes the slices a[k]..b[k]."""

    def __init__(self, values: np.ndarray, which: int = 0):
        n = len(values)
        up, self.down = powers(n + 1, which)
        self.s = np.zeros(n + 1, np.uint64)
        carry, small = np.uint64(0), n and values.max() < 512
        for a in range(0, n, BLOCK):
            v, u = values[a : a + BLOCK], up[a : min(a + BLOCK, n)]
            if small:
                low, high = v * (u & _LOW31), v * (u >> _31)
            else:
                v = times(_fold(v), u)
                low, high = v & _LOW31, v >> _31
            np.cumsum(low, out=low)
            np.cumsum(high, out=high)
            low += (high & _LOW30) << _31  # high * 2**31 modulo P
            high >>= _30
            low += high
            low += carry
            self.s[a + 1 : a + 1 + len(v)] = _fold(low)
            carry = self.s[a + len(v)]

    def of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        x = times(_fold(self.s[b] + _TWICE - self.s[a]), self.down[a])
        x = np.where(x >= _P, x - _P, x)
        return mix(x + (b - a).astype(np.uint64))


#: Which bytes belong to a word: everything but [\x20\x09-\x0D], or everything but [\x00-\x2F\x3A-\x60\x7B-\x7F].
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[0x20, *range(0x09, 0x0E)]] = False
LETTERS = np.zeros(256, bool)
LETTERS[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


class Words:
    """Words of a batch of texts: byte spans, the text of each, where each text's words begin, and hashes."""

    def __init__(self, raw: np.ndarray, offsets: np.ndarray, kind: np.ndarray, lower: bool):
        self.raw = raw
        data = LOWER[raw] if lower else raw
        inside = kind[data]
        edge = np.empty(len(raw) + 1, bool)
        edge[0] = False
        # a text's end is a word's end
        before = np.empty(len(raw), bool)
        if len(raw):
            before[0] = False
            before[1:] = inside[:-1]
            heads = offsets[:-1]
            before[heads[heads < len(raw)]] = False
            after = np.empty(len(raw), bool)
            after[-1] = False
            after[:-1] = inside[1:]
            tails = offsets[1:] - 1
            after[tails[tails >= 0]] = False
            self.start = np.flatnonzero(inside & ~before)
            self.end = np.flatnonzero(inside & ~after) + 1
        else:
            self.start = self.end = np.zeros(0, np.int64)
        self.first = np.searchsorted(self.start, offsets).astype(np.int64)  # first word of each text, and the end
        self.doc = np.repeat(np.arange(len(offsets) - 1), np.diff(self.first))
        self.data = data

    def hashes(self, which: int = 0) -> np.ndarray:
        return Sums(byte_values()[self.data], which).of(self.start, self.end)

    def windows(self, values: np.ndarray, k: int, which: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """(first word, hash) of all windows of k words within one text."""
        if len(values) < k:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        at = np.arange(len(values) - k + 1)
        at = at[self.doc[at] == self.doc[at + k - 1]]
        return at, Sums(values, which).of(at, at + k)


def ragged(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Indices of the slices starts[k]..starts[k]+sizes[k], one after the other."""
    total = int(sizes.sum())
    if not total:
        return np.zeros(0, np.int64)
    out = np.ones(total, np.int64)
    keep = sizes > 0
    starts, sizes = starts[keep], sizes[keep]
    heads = np.cumsum(sizes) - sizes
    out[0] = starts[0]
    out[heads[1:]] = starts[1:] - (starts[:-1] + sizes[:-1] - 1)
    return np.cumsum(out)
