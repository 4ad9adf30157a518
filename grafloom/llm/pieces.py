"""Pre-tokens of whole batches without a regular-expression engine: runs of one character class.

Characters are letters, numbers, white space or others.  Both patterns in use cut a text at changes of class; they
differ in what a preceding blank and an apostrophe do:

* ``spaced``: ``'s|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+``
* ``plain``: ``'s|'t|'re|'ve|'m|'ll|'d|\\p{L}+|\\p{N}|[^\\s\\p{L}\\p{N}]+``, where white space is dropped
"""

from __future__ import annotations

import functools
import sys

import numpy as np

OTHER, LETTER, NUMBER, SPACE = 0, 1, 2, 3


@functools.cache
def classes() -> np.ndarray:
    """The class of each code point."""
    import unicodedata

    major = {"L": LETTER, "N": NUMBER}
    out = np.fromiter((major.get(unicodedata.category(chr(c))[0], OTHER) for c in range(sys.maxunicode + 1)), np.uint8)
    # The code points of Unicode's property White_Space.
    out[[*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]] = SPACE
    return out


def code_points(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(code points, byte offset of each and of the end) of valid UTF-8."""
    data = raw.tobytes()
    points = np.frombuffer(data.decode("utf-8").encode("utf-32-le"), np.uint32)
    if len(points) == len(raw):
        return points, np.arange(len(raw) + 1)
    at = np.flatnonzero((raw & 0xC0) != 0x80)
    return points, np.append(at, len(raw))


def cut(points: np.ndarray, heads: np.ndarray, spaced: bool) -> tuple[np.ndarray, np.ndarray]:
    """(starts, ends) of the pre-tokens, as positions in ``points``; ``heads`` are where texts begin."""
    n = len(points)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    kind = classes()[points]
    new = np.empty(n, bool)
    new[0] = True
    new[1:] = kind[1:] != kind[:-1]
    first = np.zeros(n, bool)
    first[heads[heads < n]] = True
    new |= first
    if not spaced:
        new |= kind == NUMBER
    runs = np.flatnonzero(new)
    stops = np.append(runs[1:], n)
    kinds = kind[runs]
    opens = first[runs]  # the run begins a text
    if spaced:
        # A white-space run before other characters of its text gives up its last character: a blank joins the
        # next run, another character stands alone.
        inner = np.flatnonzero((kinds[:-1] == SPACE) & ~opens[1:]) if len(runs) > 1 else np.zeros(0, np.int64)
        last = stops[inner] - 1
        blank = points[last] == 0x20
        new[last] = True
        new[stops[inner[blank]]] = False
        joined = np.zeros(len(runs) + 1, bool)
        joined[inner[blank] + 1] = True
    else:
        joined = np.zeros(len(runs) + 1, bool)
    lone = np.flatnonzero((points[runs] == 0x27) & (stops - runs == 1) & ~joined[:-1])
    if len(lone):
        lone = lone[lone + 1 < len(runs)]
        lone = lone[(kinds[lone + 1] == LETTER) & ~opens[lone + 1]]
        a = runs[lone + 1]
        room = stops[lone + 1] - a
        c1 = points[a]
        c2 = points[np.minimum(a + 1, n - 1)]
        one = np.isin(c1, [ord(c) for c in "stmd"])
        two = (room >= 2) & (((c1 == ord("r")) & (c2 == ord("e"))) | ((c1 == ord("v")) & (c2 == ord("e"))) | ((c1 == ord("l")) & (c2 == ord("l"))))
        size = np.where(one, 1, np.where(two, 2, 0))
        hit = size > 0
        a, room, size = a[hit], room[hit], size[hit]
        new[a] = False
        rest = a[room > size] + size[room > size]
        new[rest] = True
    start = np.flatnonzero(new)
    end = np.append(start[1:], n)
    if not spaced:
        keep = kind[start] != SPACE
        start, end = start[keep], end[keep]
    return start, end


def distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index of one occurrence of each distinct key, number of the distinct key at each place)."""
    import pandas as pd

    codes, uniques = pd.factorize(keys)
    first = np.empty(len(uniques), np.int64)
    first[codes[::-1]] = np.arange(len(keys) - 1, -1, -1)
    return first, codes


def distinct_slices(raw: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """As ``distinct``, for the byte slices raw[a[k]:b[k]], by two 64-bit hashes; slices that share only the first
    are told apart."""
    from grafloom.llm.hashing import Sums, byte_values

    one = Sums(byte_values()[raw], 0).of(a, b)
    two = Sums(byte_values()[raw], 1).of(a, b)
    first, codes = distinct(one)
    if not np.array_equal(two[first[codes]], two):
        first, codes = distinct(one ^ (two * np.uint64(0x9E3779B97F4A7C15)))
    return first, codes
