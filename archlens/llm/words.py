"""Words of a batch of texts as numpy arrays: where they lie, and names of any run of them.

A word's name is a sum of mixed values, one for each eight bytes and their place, and a run's name is mixed from the names
of its two overlapping halves of a power of two (each of them mixed from its own halves). Every step is non-linear, so
no arrangement of symbols makes different runs collide. Two families of names use different constants throughout;
together they have 128 bits.
"""

from __future__ import annotations

import numpy as np

U = np.uint64
#: ASCII white space; every other byte belongs to a word.
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: A fixed random value for each byte.
BYTE = np.random.Generator(np.random.PCG64(2024)).integers(0, 1 << 63, 256, dtype=np.uint64) * U(2) + U(1)
#: For each family of names two odd multipliers and a start.
_FAMILIES = ((U(0xBF58476D1CE4E5B9), U(0x94D049BB133111EB), U(0x9E3779B97F4A7C15)), (U(0xFF51AFD7ED558CCD), U(0xC4CEB9FE1A85EC53), U(0xD6E8FEB86659FD93)))


def mix(x: np.ndarray, family: int = 0) -> np.ndarray:
    """A fixed bijection of 64-bit values that spreads every bit."""
    first, second, _ = _FAMILIES[family]
    x = (x ^ (x >> U(30))) * first
    x = (x ^ (x >> U(27))) * second
    return x ^ (x >> U(31))


def _both(left: np.ndarray, right: np.ndarray, family: int) -> np.ndarray:
    """A name of two things in this order."""
    return mix(mix(left + _FAMILIES[family][2], family) * U(3) + right, family)


class Spans:
    """Names of runs of symbols: equal runs have equal names wherever they stand.

    Level k names the 2**k symbols from each place; a run of n symbols takes two overlapping ones.
    """

    def __init__(self, symbols: np.ndarray, family: int = 0):
        self.levels, self.family = [symbols], family

    def _level(self, k: int) -> np.ndarray:
        while len(self.levels) <= k:
            half, below = 1 << len(self.levels) - 1, self.levels[-1]
            self.levels.append(_both(below[:-half], below[half:], self.family) if len(below) > half else below[:0])
        return self.levels[k]

    def name(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Names of the runs start..end, none of them empty."""
        size = end - start
        out = np.zeros(len(start), U)
        top = np.frexp(size.astype(np.float64))[1] - 1
        for k in np.unique(top).tolist():
            at, level = np.flatnonzero(top == k), self._level(k)
            out[at] = _both(level[start[at]], level[end[at] - (1 << k)], self.family)
        return mix(out ^ mix(size.astype(U), self.family), self.family)


def word_names(buf: np.ndarray, start: np.ndarray, end: np.ndarray, family: int = 0) -> np.ndarray:
    """A 64-bit name of the bytes of each word, the same in every task and run."""
    if not len(start):
        return np.zeros(0, U)
    size = end - start
    padded = np.concatenate((buf, np.zeros(8, np.uint8)))
    eight = np.ndarray(len(buf) + 1, "<u8", padded, 0, (1,))  # the eight bytes from each place
    out = np.zeros(len(start), U)
    which, place = np.arange(len(start)), 0
    while len(which):
        left = np.minimum(size[which] - 8 * place, 8)
        value = eight[start[which] + 8 * place] & (U(0xFFFFFFFFFFFFFFFF) >> ((8 - left) * 8).astype(U))
        key = mix(U([place + 1]), family) ^ _FAMILIES[family][2]
        out[which] += mix(mix(value + key, family) ^ key, family)
        which, place = which[size[which] > 8 * (place + 1)], place + 1
    return mix(out ^ mix(size.astype(U), family), family)


class Words:
    """The words of some texts.

    buf: the texts' bytes, a newline after each; start, end: the words' places in it; doc: each word's text;
    name: a 64-bit name of each word.
    """

    def __init__(self, texts: list[bytes], lower: bool = False):
        buf = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
        self.buf = LOWER[buf] if lower else buf
        self.gap = IS_SPACE[self.buf]
        edge = np.flatnonzero(self.gap[1:] != self.gap[:-1]) + 1
        if not self.gap[0]:
            edge = np.concatenate(([0], edge))
        self.start, self.end = edge[0::2], edge[1::2]
        self.first_byte = np.cumsum([0] + [len(t) + 1 for t in texts])
        #: words before each text; the last entry counts all
        self.first = np.searchsorted(self.start, self.first_byte)
        self.count = np.diff(self.first)
        self.doc = np.repeat(np.arange(len(texts), dtype=np.int32), self.count)
        self.name = word_names(self.buf, self.start, self.end)

    def other_names(self) -> np.ndarray:
        """The words' names in the second family."""
        return word_names(self.buf, self.start, self.end, 1)

    def joined(self, keep: np.ndarray | None = None) -> list[bytes]:
        """Each text's words (those of `keep`), joined by one space."""
        start, end, doc = (self.start, self.end, self.doc) if keep is None else (self.start[keep], self.end[keep], self.doc[keep])
        mark = np.zeros(len(self.buf) + 1, np.int8)
        mark[start] = 1
        mark[end] -= 1
        chosen = np.cumsum(mark[:-1], dtype=np.int8).view(bool)
        inner = np.ones(len(start), bool)
        inner[np.flatnonzero(np.diff(doc, append=np.int32(-1)))] = False
        chosen[end[inner]] = True
        out = np.where(self.gap, np.uint8(32), self.buf)[chosen].tobytes()
        at = np.concatenate(([0], np.cumsum(chosen)))[self.first_byte].tolist()
        return [out[a:b] for a, b in zip(at, at[1:], strict=False)]
