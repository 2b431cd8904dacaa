"""Vectorised text primitives over Arrow string columns: no per-word Python.

Every function works on blocks of a megabyte of UTF-8 bytes, so memory
doesn't depend on the length of a document; a longer document is cut between
words and its parts carry the same owner. What spans a cut isn't lost: a block
can begin with the last bytes of the part before (``lap``). Only a run without
white space over half a megabyte is cut inside. Pieces of byte-level BPE are
never cut, so there a block is as long as its longest piece.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK = 1 << 20
AHEAD = 16
_PRIME = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))

WORD_BYTE = np.zeros(256, bool)
WORD_BYTE[np.r_[48:58, 65:91, 97:123, 128:256]] = True
SPACE_BYTE = np.zeros(256, bool)
SPACE_BYTE[[9, 10, 11, 12, 13, 32]] = True


def plain(column: pa.Array | pa.ChunkedArray, lower: bool = False) -> pa.Array:
    """One large-string array with nulls as empty strings."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    column = pc.fill_null(column.cast(pa.large_string()), "")
    return pc.utf8_lower(column) if lower else column


def raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and n + 1 offsets of a large-string array."""
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    return np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8), offsets


def word_cut(data: np.ndarray, at: int, end: int, limit: int) -> int:
    """Where the part of a long document that begins at ``at`` ends: after a space."""
    window = data[at + limit // 2 : at + limit]
    gaps = np.flatnonzero(SPACE_BYTE[window])
    if len(gaps):
        return at + limit // 2 + int(gaps[-1]) + 1
    at += limit  # no space: between two characters
    while data[at] & 0xC0 == 0x80:
        at -= 1
    return at


def piece_cut(data: np.ndarray, at: int, end: int, limit: int) -> int:
    """Where the part of a long document that begins at ``at`` ends: before a piece of byte-level BPE, or at the end.

    Cuts follow a character that isn't white space: what white space is split
    into depends on what comes after it. The last ``AHEAD`` bytes of a window
    only show what follows.
    """
    size = limit
    while True:
        window = data[at : min(at + size + AHEAD, end)]
        starts = piece_starts(window, np.array([0, len(window)]))
        starts = starts[(starts > 0) & (starts <= size)]
        starts = starts[_kinds(window)[0][starts - 1] != 0]
        if len(starts):
            return at + int(starts[-1] if size == limit else starts[0])
        if at + size >= end:
            return end
        size *= 2


def blocks(column: pa.Array, limit: int | None = None, cut: Callable[[np.ndarray, int, int, int], int] = word_cut, lap: int = 0, most: int = 1 << 30) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(bytes, n + 1 starts of parts, owner of each part); parts are whole documents, or what ``cut`` makes of long ones.

    Where the first part goes on with a document, it begins at ``lap``, after
    the last bytes of the part before. A block has ``most`` parts at most.
    """
    limit = limit or BLOCK
    data, offsets = raw(column)
    long = np.flatnonzero(np.diff(offsets) > limit)
    owners, starts = np.arange(len(offsets) - 1), offsets[:-1]
    more_owner, more_start = [], []
    for i in long.tolist():
        at, end = int(offsets[i]), int(offsets[i + 1])
        while end - at > limit and (at := cut(data, at, end, limit)) < end:
            more_owner.append(i)
            more_start.append(at)
    if more_start:
        order = np.argsort(np.r_[starts, more_start], kind="stable")
        owners, starts = np.r_[owners, more_owner][order], np.r_[starts, more_start][order]
    ends = np.r_[starts[1:], offsets[-1:]]
    first, n = 0, len(starts)
    while first < n:
        last = min(first + most, max(first + 1, int(np.searchsorted(ends, starts[first] + limit, "right"))))
        base = starts[first] - min(lap, starts[first] - offsets[owners[first]])
        yield data[base : ends[last - 1]], np.r_[starts[first:last], ends[last - 1]] - base, owners[first:last]
        first = last


def word_spans(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and part of every maximal run of letters, digits and non-ASCII bytes."""
    if not len(data):
        empty = np.zeros(0, np.int64)
        return empty, empty, empty
    inside = WORD_BYTE[data]
    fresh = np.zeros(len(data) + 1, bool)
    fresh[starts] = True
    before = np.r_[False, inside[:-1]] & ~fresh[:-1]
    after = np.r_[inside[1:], False] & ~fresh[1:]
    begin = np.flatnonzero(inside & ~before)
    end = np.flatnonzero(inside & ~after) + 1
    return begin, end, np.searchsorted(starts, begin, "right") - 1


@lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = np.full(n, _PRIME), np.full(n, _INVERSE)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def span_hashes(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span's bytes, from one prefix sum over the block."""
    if not len(begin):
        return np.zeros(0, np.uint64)
    size = BLOCK
    while size < len(data) + 1:
        size *= 2
    up, down = _powers(size)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=total[1:])
    return mix((total[end] - total[begin]) * down[begin] + (end - begin).astype(np.uint64))


def gram_codes(data: np.ndarray, n: int) -> np.ndarray:
    """The integer of the n bytes that begin at each position (the last n - 1 positions have none)."""
    if len(data) < n:
        return np.zeros(0, np.uint64)
    code = np.zeros(len(data) - n + 1, np.uint64)
    for i in range(n):
        code = (code << np.uint64(8)) | data[i : len(data) - n + 1 + i]
    return code


@lru_cache(maxsize=1)
def _classes() -> np.ndarray:
    """By code point: 0 white space, 1 letter, 2 number, 3 other."""
    kind = np.full(0x110000, 3, np.uint8)
    for code in range(0x110000):
        category = unicodedata.category(chr(code))[0]
        if category == "L":
            kind[code] = 1
        elif category == "N":
            kind[code] = 2
    kind[[*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]] = 0
    return kind


def _kinds(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Class of the character of each byte, and whether the byte begins it."""
    n = len(data)
    kind = _classes()[data]  # right for ASCII
    lead = np.ones(n, bool)
    high = np.flatnonzero(data >= 128)
    if len(high):
        follow = (data[high] & 0xC0) == 0x80
        lead[high[follow]] = False
        at = high[~follow]
        b = [np.where(at + i < n, data[np.minimum(at + i, n - 1)], 0).astype(np.int64) for i in range(4)]
        code = np.where(b[0] < 0xE0, (b[0] & 31) << 6 | b[1] & 63, np.where(b[0] < 0xF0, (b[0] & 15) << 12 | (b[1] & 63) << 6 | b[2] & 63, (b[0] & 7) << 18 | (b[1] & 63) << 12 | (b[2] & 63) << 6 | b[3] & 63))
        of = _classes()[np.minimum(code, 0x10FFFF)]
        kind[at] = of
        width = np.where(b[0] < 0xE0, 2, np.where(b[0] < 0xF0, 3, 4))
        for i in (1, 2, 3):
            m = (width > i) & (at + i < n)
            kind[at[m] + i] = of[m]
    return kind, lead


def first_kinds(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Class of the character that begins at each place."""
    b = [np.where(at + i < len(data), data[np.minimum(at + i, len(data) - 1)], 0).astype(np.int64) for i in range(4)]
    code = np.where(b[0] < 0x80, b[0], np.where(b[0] < 0xE0, (b[0] & 31) << 6 | b[1] & 63, np.where(b[0] < 0xF0, (b[0] & 15) << 12 | (b[1] & 63) << 6 | b[2] & 63, (b[0] & 7) << 18 | (b[1] & 63) << 12 | (b[2] & 63) << 6 | b[3] & 63)))
    return _classes()[np.minimum(code, 0x10FFFF)]


def piece_starts(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Where the pieces of byte-level BPE begin.

    The rule in words: a contraction after an apostrophe; or an optional blank
    and a run of letters, of numbers, or of other signs; or a run of white
    space, but for its last character where more text follows.
    """
    n = len(data)
    if not n:
        return np.zeros(0, np.int64)
    kind, lead = _kinds(data)
    flag = np.zeros(n + 1, bool)
    fresh = np.zeros(n + 1, bool)
    fresh[starts] = True
    flag[:n] = fresh[:n]
    flag[1:n] |= kind[1:] != kind[:-1]
    text = np.flatnonzero(flag[:n] & (kind != 0) & ~fresh[:n])  # runs of text with something before them
    blank = text[data[text - 1] == 32]
    flag[blank] = False
    flag[blank - 1] = True
    after = text[(kind[text - 1] == 0) & (data[text - 1] != 32)]
    if len(after):  # the last white space, not a blank, stands alone
        at = after - 1
        for _ in range(3):
            at = np.where(lead[at], at, at - 1)
        flag[at] = True
    quote = np.flatnonzero((data == 39) & flag[:n])
    if len(quote):
        end = np.searchsorted(starts, quote, "right")
        stop = starts[np.minimum(end, len(starts) - 1)]
        one = np.where(quote + 1 < stop, data[np.minimum(quote + 1, n - 1)], 0)
        two = np.where(quote + 2 < stop, data[np.minimum(quote + 2, n - 1)], 0)
        short = np.isin(one, np.frombuffer(b"stmd", np.uint8))
        longer = ((one == 114) & (two == 101)) | ((one == 118) & (two == 101)) | ((one == 108) & (two == 108))
        for hit, size in ((quote[short], 2), (quote[longer], 3)):
            inner = hit + 1
            flag[inner] = False
            rest = hit + size
            inside = rest < n
            rest = rest[inside]
            flag[rest] |= kind[rest] == 1  # what remains of the letters is a piece of its own
    return np.flatnonzero(flag[:n])
