"""Words, lines and n-grams of many texts at once, in numpy.

A :class:`Block` lays the UTF-8 bytes of some texts end to end and finds words
and lines with array operations, so that no Python loop runs per word.  Equal
strings get equal 62-bit hashes: two rolling polynomials over the bytes modulo
the prime 2**31 - 1, mixed at the end.  Different strings of L bytes are equal
in both for about L**2 of 2**62 choices of the bases, whatever the strings are.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa

#: Texts are laid out in blocks of about so many bytes and at most so many texts; a longer text is a block of its own.
BLOCK_BYTES, BLOCK_TEXTS = 1 << 20, 1024
#: Rows of an Arrow batch that are turned into Python objects at once.
SLICE_ROWS = 256

#: For runs of words; the words' own hashes are mixed already.
_BASE = 0x9E3779B97F4A7C15
_PRIME = (1 << 31) - 1
_BASES = (1_202_857_339, 1_839_464_317)
#: Bytes whose weighted sums fit 64 bits before they are reduced.
_PLAIN = 1 << 24
_SPACES = np.zeros(256, bool)
_SPACES[[9, 10, 11, 12, 13, 32]] = True
_powers: dict[int, np.ndarray] = {}
_memories: dict[str, dict] = {}


def memory_of(operator: str) -> dict:
    """What this worker remembers for ``operator``; a worker serves many jobs, and what it remembered for other operators is let go."""
    for other in [k for k in _memories if k != operator]:
        del _memories[other]
    return _memories.setdefault(operator, {})


def _reduced(x: np.ndarray) -> np.ndarray:
    """``x`` modulo the prime, for values under 2**63."""
    p, shift = np.uint64(_PRIME), np.uint64(31)
    x = (x & p) + (x >> shift)
    x = (x & p) + (x >> shift)
    x[x >= p] -= p
    return x


def _power(base: int, n: int) -> np.ndarray:
    """Powers 0 to ``n - 1`` of ``base`` modulo the prime."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size, have = max(n, BLOCK_BYTES + 2), np.ones(1, np.uint32)
        while len(have) < size:
            more = _reduced(have[: size - len(have)].astype(np.uint64) * np.uint64(pow(base, len(have), _PRIME)))
            have = np.concatenate((have, more.astype(np.uint32)))
        _powers[base] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (the finaliser of splitmix64)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def sliced(batches: Iterator[pa.RecordBatch], rows: int = SLICE_ROWS) -> Iterator[pa.RecordBatch]:
    """The batches in pieces of ``rows`` rows, so that no task holds all texts of a batch twice."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def blocks(texts: list[bytes]) -> Iterator[tuple[int, list[bytes]]]:
    """Cut a list of texts into (index of the first, texts) by BLOCK_BYTES and BLOCK_TEXTS."""
    first, size = 0, 0
    for i, t in enumerate(texts):
        if i > first and (size + len(t) > BLOCK_BYTES or i - first >= BLOCK_TEXTS):
            yield first, texts[first:i]
            first, size = i, 0
        size += len(t)
    if first < len(texts):
        yield first, texts[first:]


class Block:
    """Words and lines of some texts.

    ``spaces`` marks the bytes that separate words; by default space and
    ``\\x09``-``\\x0d``.  Words and lines never run across texts.
    """

    def __init__(self, texts: list[bytes], spaces: np.ndarray = _SPACES):
        self.n = len(texts)
        self.bytes = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
        self.sizes = np.fromiter(map(len, texts), np.int64, self.n)
        self.firsts = np.concatenate(([0], np.cumsum(self.sizes + 1)[:-1])) if self.n else np.zeros(0, np.int64)
        gap = spaces[self.bytes]
        gap[self.firsts + self.sizes] = True
        edge = np.flatnonzero(np.diff(np.concatenate(([True], gap)).view(np.int8)))
        self.starts, self.ends = edge[0::2], edge[1::2]
        self.words_upto = np.searchsorted(self.starts, np.append(self.firsts, len(self.bytes)))

    @cached_property
    def n_words(self) -> np.ndarray:
        return np.diff(self.words_upto)

    @cached_property
    def doc(self) -> np.ndarray:
        """The text of each word."""
        return np.repeat(np.arange(self.n), self.n_words)

    @cached_property
    def _rolling(self) -> list[np.ndarray]:
        """For each base the sums of the bytes' values before each byte."""
        n, out = len(self.bytes), []
        value = self.bytes.astype(np.uint64) + np.uint64(1)
        for base in _BASES:
            terms = value * _power(base, n)
            upto = np.zeros(n + 1, np.uint64)
            np.cumsum(terms if n < _PLAIN else _reduced(terms), out=upto[1:])
            out.append(upto)
        return out

    def hash(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Hashes of the byte ranges."""
        low, high = (_reduced(_reduced(r[ends] - r[starts]) * _power(pow(base, -1, _PRIME), len(self.bytes) + 1)[starts]) for r, base in zip(self._rolling, _BASES, strict=True))
        return mix(low | high << np.uint64(31))

    @cached_property
    def words(self) -> np.ndarray:
        return self.hash(self.starts, self.ends)

    @cached_property
    def points_upto(self) -> np.ndarray:
        """Code points before each byte."""
        out = np.zeros(len(self.bytes) + 1, np.int64)
        np.cumsum((self.bytes & 0xC0) != 0x80, out=out[1:])
        return out

    @cached_property
    def points(self) -> np.ndarray:
        """Code points of each word."""
        return self.points_upto[self.ends] - self.points_upto[self.starts]

    def per_text(self, values: np.ndarray) -> np.ndarray:
        """Sums over the words of each text."""
        upto = np.concatenate(([0], np.cumsum(values)))
        return np.diff(upto[self.words_upto])

    def grams(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """(first word, hash) of every n-word window that stays inside one text."""
        w = self.words
        if len(w) < n:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        h = np.zeros(len(w) - n + 1, np.uint64)
        for k in range(n):
            h *= np.uint64(_BASE)
            h += w[k : len(w) - n + 1 + k]
        first = np.flatnonzero(self.doc[: len(w) - n + 1] == self.doc[n - 1 :])
        return first, mix(h[first])

    def repeated(self, n: int) -> np.ndarray:
        """Marks the words inside n-word windows that their text has twice or more, the first included."""
        first, h = self.grams(n)
        twice = self.twice(self.doc[first], h)
        cover = np.zeros(len(self.words) + 1, np.int32)
        np.add.at(cover, first[twice], 1)
        np.add.at(cover, first[twice] + n, -1)
        return np.cumsum(cover[:-1]) > 0

    @staticmethod
    def twice(doc: np.ndarray, h: np.ndarray) -> np.ndarray:
        """Marks the values that occur twice or more in their text."""
        key = mix(h ^ mix(doc.astype(np.uint64) + np.uint64(1)))
        order = np.argsort(key)
        same = np.diff(key[order]) == 0
        out = np.zeros(len(key), bool)
        out[order[1:][same]] = True
        out[order[:-1][same]] = True
        return out

    @cached_property
    def lines(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, start, end) of each ``\\n``-separated line that has a word."""
        ends = np.flatnonzero(self.bytes == 10)
        starts = np.concatenate(([0], ends[:-1] + 1))
        has = np.searchsorted(self.starts, ends) > np.searchsorted(self.starts, starts)
        doc = np.searchsorted(self.firsts, starts, "right") - 1
        return doc[has], starts[has], ends[has]

    def later_copies(self) -> np.ndarray:
        """Marks the lines of :attr:`lines` that equal an earlier line of their text."""
        doc, starts, ends = self.lines
        key = mix(self.hash(starts, ends) ^ mix(doc.astype(np.uint64) + np.uint64(1)))
        _, first = np.unique(key, return_index=True)
        out = np.ones(len(key), bool)
        out[first] = False
        return out
