"""Words of many texts at once, as stretches of one array of bytes.

A word of up to 16 bytes is two numbers, its bytes padded with zeros: words are told apart,
looked up and counted without an object for each. What the numbers cannot tell apart (longer
words, and those that end with a zero byte) is ``odd`` and goes by its bytes.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

from fieldloom.llm._common import mix64, starts_of

WIDE = 16


@dataclass
class Words:
    """Bytes of the texts (16 or more zeros after them), where each word starts in them and its
    size, and the number of words before each text (one more at the end)."""

    data: np.ndarray
    start: np.ndarray
    size: np.ndarray
    cut: np.ndarray
    place: np.ndarray | None = None

    def keys(self) -> tuple[np.ndarray, np.ndarray]:
        """The two numbers of each word (of an odd one: of its first 16 bytes)."""
        base, at = self.data.view(np.uint64), self.start >> 3
        left = ((self.start & 7) << 3).astype(np.uint64)
        right = np.uint64(64) - left  # a shift by 64 gives zero
        middle = base[at + 1]
        a = base[at] >> left | middle << right
        a &= _ONES[np.minimum(self.size, 8)]
        b = np.zeros(len(a), np.uint64)
        if len(more := np.flatnonzero(self.size > 8)):
            b[more] = middle[more] >> left[more] | base[at[more] + 2] << right[more]
            b[more] &= _ONES[np.minimum(self.size[more] - 8, 8)]
        return a, b

    def odd(self) -> np.ndarray:
        """Numbers of the words that their keys do not tell apart."""
        return np.flatnonzero((self.size > WIDE) | (self.data[self.start + self.size - 1] == 0))

    def bytes_of(self, which: np.ndarray) -> list[bytes]:
        whole, start = self.data, self.start[which]
        return [whole[a:b].tobytes() for a, b in zip(start.tolist(), (start + self.size[which]).tolist())]

    def column(self, which: np.ndarray) -> pa.Array:
        """Some of the words as a binary column."""
        size = self.size[which]
        cut = starts_of(size)
        at = np.repeat(self.start[which] - cut[:-1], size) + np.arange(cut[-1])
        return _binary(cut, self.data[at])


_ONES = np.array([(1 << 8 * n) - 1 for n in range(9)], dtype=np.uint64)


def _binary(cut: np.ndarray, data: np.ndarray) -> pa.Array:
    whole = pa.Array.from_buffers(pa.large_binary(), len(cut) - 1, [None, pa.py_buffer(np.ascontiguousarray(cut, dtype=np.int64)), pa.py_buffer(np.ascontiguousarray(data))])
    return whole.cast(pa.binary())


_POWERS = np.array([1 << 8 * n for n in range(8)], dtype=np.uint64)


def packed(a: np.ndarray, b: np.ndarray) -> pa.Array:
    """The words of these keys as a binary column."""
    size = np.searchsorted(_POWERS, np.where(b > 0, b, a), side="right") + 8 * (b > 0)
    both = np.stack((a, b), axis=1).view(np.uint8).reshape(-1, WIDE)
    return _binary(starts_of(size), both[np.arange(WIDE) < size[:, None]])


def bytes_of_column(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A string column without nulls: its bytes with zeros after them, and where each row starts."""
    wide = column.cast(pa.large_string() if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else pa.large_binary())
    offsets = np.frombuffer(wide.buffers()[1], np.int64)[wide.offset : wide.offset + len(wide) + 1]
    size = int(offsets[-1] - offsets[0])
    data = np.zeros(size + 3 * 8 + -size % 8, np.uint8)
    if size:
        data[:size] = np.frombuffer(wide.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def of_column(column: pa.Array) -> Words:
    """A binary column of words, each as it is."""
    data, at = bytes_of_column(column)
    return Words(data, at[:-1], np.diff(at), np.arange(len(at)))


def split(data: np.ndarray, at: np.ndarray, inside: np.ndarray) -> Words:
    """Longest runs of bytes that are ``inside`` words; none goes over the start of a text."""
    size = int(at[-1])
    inside = inside[:size]
    begins, ends = np.ones(size, bool), np.ones(size, bool)
    np.logical_not(inside[:-1], out=begins[1:])
    np.logical_not(inside[1:], out=ends[:-1])
    edges = at[:-1][at[:-1] < at[1:]]
    begins[edges] = True
    ends[edges[1:] - 1] = True
    begins &= inside
    ends &= inside
    start = np.flatnonzero(begins)
    return Words(data, start, np.flatnonzero(ends) + 1 - start, np.searchsorted(start, at))


def by_ascii_space(column: pa.Array) -> Words:
    """Runs of anything but ASCII white space, A-Z in lower case."""
    data, at = bytes_of_column(column)
    data[(data >= 65) & (data <= 90)] |= 32
    return split(data, at, (data != 32) & ((data < 9) | (data > 13)))


_LETTERS = np.zeros(0x110000, np.uint8)  # of code points met so far: 1 no, 2 yes
_ASCII_WORD = np.array([i >= 128 or chr(i).isalnum() for i in range(256)])


def by_letters(texts: list[str]) -> Words:
    """Matches of ``[^\\W_]+`` in the lower-cased texts, as UTF-8."""
    low = [t.lower() for t in texts]
    raw = "\n".join(low).encode("utf-8", "surrogatepass")
    data = np.zeros(len(raw) + 3 * 8 + -len(raw) % 8, np.uint8)
    data[: len(raw)] = np.frombuffer(raw, np.uint8)
    inside = _ASCII_WORD[data]
    if len(lead := np.flatnonzero(data >= 0xC0)):
        first, more = data[lead], [data[lead + i].astype(np.int32) & 63 for i in (1, 2, 3)]
        one = first.astype(np.int32)
        code = (one & 31) << 6 | more[0]
        code = np.where(first >= 0xE0, (one & 15) << 12 | more[0] << 6 | more[1], code)
        code = np.where(first >= 0xF0, (one & 7) << 18 | more[0] << 12 | more[1] << 6 | more[2], code)
        for c in np.unique(code[_LETTERS[code] == 0]).tolist():
            _LETTERS[c] = 2 if chr(c).isalnum() else 1
        out = _LETTERS[code] == 1
        at, first = lead[out], first[out]
        inside[at] = inside[at + 1] = False
        inside[at[first >= 0xE0] + 2] = False
        inside[at[first >= 0xF0] + 3] = False
    sizes = np.array([len(t) if t.isascii() else len(t.encode("utf-8", "surrogatepass")) for t in low], dtype=np.int64) + 1
    at = starts_of(sizes)
    at[-1] = max(at[-1] - 1, 0)
    return split(data, at, inside)


def hashed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """64 bits for a word's keys; words of up to 8 bytes never share them."""
    return mix64(a ^ mix64(b))


class Lookup:
    """Places of words in a list; others have -1."""

    def __init__(self, words: list[bytes]):
        given = of_column(pa.array(words, pa.binary()))
        a, b = given.keys()
        odd = set(given.odd().tolist()) if words else set()
        self.odd = {words[i]: i for i in odd}
        place = np.array([i for i in range(len(words)) if i not in odd], dtype=np.int32)
        h = hashed(a[place], b[place])
        order = np.argsort(h, kind="stable")
        place = place[order]
        # one more at the end, which no search goes beyond
        self.h, self.a, self.b, self.place = h[order], np.append(a[place], np.uint64(0)), np.append(b[place], np.uint64(0)), np.append(place, np.int32(-1))
        bits = max(4, int(8 * len(place)).bit_length())
        self.shift = np.uint64(64 - bits)
        self.first = np.searchsorted(self.h, np.arange(1 << bits, dtype=np.uint64) << self.shift).astype(np.int32)
        self.h = np.append(self.h, np.uint64(2**64 - 1))

    def __call__(self, words: Words, odd: np.ndarray) -> np.ndarray:
        a, b = words.keys()
        h = hashed(a, b)
        at = self.first[(h >> self.shift).astype(np.int64)]
        same = (self.a[at] == a) & (self.b[at] == b)
        found = np.where(same, self.place[at], np.int32(-1))
        left = np.flatnonzero(~same & (self.h[at] <= h))
        while len(left):  # next ones of the same stretch of hashes
            at[left] += 1
            left = left[at[left] < len(self.h)]
            now = at[left]
            same = (self.a[now] == a[left]) & (self.b[now] == b[left])
            found[left[same]] = self.place[now[same]]
            left = left[~same & (self.h[now] <= h[left])]
        if len(odd):
            found[odd] = [self.odd.get(w, -1) for w in words.bytes_of(odd)]
        return found


def grouped(h: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, first): the words by their hashes, equal ones side by side, and where each
    distinct one begins in that order."""
    order = np.argsort(h)
    x, y, z = h[order], a[order], b[order]
    new = np.ones(len(h), bool)
    new[1:] = x[1:] != x[:-1]
    if ((~new[1:]) & ((y[1:] != y[:-1]) | (z[1:] != z[:-1]))).any():  # different words of one hash
        order = np.lexsort((b, a))
        y, z = a[order], b[order]
        new[1:] = (y[1:] != y[:-1]) | (z[1:] != z[:-1])
    return order, np.flatnonzero(new)


class Tally:
    """How often each word occurs."""

    def __init__(self):
        self.clear()

    def clear(self) -> None:
        self.parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.odd: Counter = Counter()

    def __len__(self) -> int:
        """Rows held, those of a word more than once until they are merged."""
        return sum(len(p[0]) for p in self.parts) + len(self.odd)

    def add(self, words: Words) -> None:
        a, b = words.keys()
        if len(odd := words.odd()):
            self.odd.update(words.bytes_of(odd))
            a, b = np.delete(a, odd), np.delete(b, odd)
        if len(a):
            order, first = grouped(hashed(a, b), a, b)
            at = order[first]
            self.parts.append((a[at], b[at], np.diff(first, append=len(a))))

    def merge(self) -> None:
        if len(self.parts) > 1:
            a, b, n = (np.concatenate(x) for x in zip(*self.parts))
            order, first = grouped(hashed(a, b), a, b)
            at = order[first]
            self.parts = [(a[at], b[at], np.add.reduceat(n[order], first))]

    def columns(self) -> tuple[pa.Array, pa.Array]:
        """The words and how often each occurs."""
        self.merge()
        names, n = [pa.array(list(self.odd.keys()), pa.binary())], [np.array(list(self.odd.values()), np.int64)]
        for a, b, c in self.parts:
            names.append(packed(a, b))
            n.append(c)
        return pa.concat_arrays(names), pa.array(np.concatenate(n))
