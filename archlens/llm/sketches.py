"""Wide SimHash fingerprints and minima of hashes of a text's distinct word shingles, as numpy arrays."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import xxhash

from archlens.llm.pieces import PIECE_BYTES, SPACE, pieces
from archlens.llm.words import Spans, U, Words, mix

#: 64-bit parts of a fingerprint, bands of a sketch, and minima in a band. At a similarity of 0.8 two texts share a band with
#: a probability of 1 - (1 - 0.8 ** 5) ** 12 = 0.99.
PARTS, BANDS, ROWS = 8, 12, 5
BITS = 64 * PARTS
_EIGHTH = U(0x0101010101010101)
#: Shingles whose bits are counted at once.
STEP = 1 << 14

_random = np.random.Generator(np.random.PCG64(77))
#: Fixed random values: for each part of a fingerprint, and a multiplier and a summand for each minimum.
_PART, _ADD = _random.integers(0, 1 << 63, PARTS, dtype=U), _random.integers(0, 1 << 63, BANDS * ROWS, dtype=U)
_TIMES = _random.integers(0, 1 << 63, BANDS * ROWS, dtype=U) * U(2) + U(1)


def _shingles(words: Words, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """Names of the distinct shingles of each text, text by text, and how many each has; fewer words than a shingle takes make one."""
    size = np.where(words.count > 0, np.maximum(words.count - shingle + 1, 1), 0)
    doc = np.repeat(np.arange(len(size)), size)
    start = words.first[doc] + np.arange(len(doc)) - np.repeat(np.cumsum(size) - size, size)
    name = Spans(words.name).name(start, start + np.minimum(words.count, shingle)[doc])
    order = np.lexsort((name, doc))
    name, doc = name[order], doc[order]
    new = np.ones(len(name), bool)
    new[1:] = (name[1:] != name[:-1]) | (doc[1:] != doc[:-1])
    return name[new], np.bincount(doc[new], minlength=len(size))


def _bit_counts(names: np.ndarray, first: np.ndarray) -> np.ndarray:
    """How many hashes of each text have each bit; `first`: where the texts begin, none of them empty."""
    edge = np.append(first, len(names))
    part_first = np.concatenate([np.arange(a, b, 255) for a, b in zip(edge, edge[1:], strict=False)])  # 255 fit into a byte
    of_text = np.searchsorted(part_first, first)
    out = np.empty((len(first), PARTS, 8, 8), np.int32)
    for k in range(PARTS):
        hashes = mix(names + _PART[k])
        for bit in range(8):
            # Eight counters in a word: every eighth bit of a hash, each in its own byte.
            counters = np.add.reduceat(hashes >> U(bit) & _EIGHTH, part_first)
            out[:, k, :, bit] = np.add.reduceat(counters.view(np.uint8).reshape(-1, 8), of_text, axis=0, dtype=np.int32)
    return out.reshape(len(first), BITS)


def _minima(names: np.ndarray, first: np.ndarray) -> np.ndarray:
    return np.stack([np.minimum.reduceat(names * a + b, first) for a, b in zip(_TIMES, _ADD, strict=True)], axis=1)


def _bands(minima: np.ndarray) -> np.ndarray:
    """A key for each band, different for different bands."""
    rows = minima.reshape(len(minima), BANDS, ROWS)
    key = np.broadcast_to(np.arange(1, BANDS + 1, dtype=U), rows.shape[:2])
    for k in range(ROWS):
        key = mix(key * U(3) + mix(rows[:, :, k]))
    return key


def _packed(counts: np.ndarray, total: np.ndarray) -> np.ndarray:
    return np.packbits(2 * counts > total[:, None], axis=1, bitorder="little").view(U)


def _long_sketch(text: bytes, shingle: int) -> tuple[bytes, np.ndarray, np.ndarray]:
    """The sketch of one text, piece by piece: only the names of its shingles are held for all of it."""
    whole, held, found, any_before = xxhash.xxh3_128(), b"", [], False
    for piece in pieces(text, SPACE):
        joined = Words([piece], lower=True).joined()[0]
        if not joined:
            continue
        whole.update(b" " + joined if any_before else joined)
        any_before = True
        held = held + b" " + joined if held else joined
        words = Words([held])
        if len(words.start) >= shingle:
            found.append(_shingles(words, shingle)[0])
            held = b" ".join(held.rsplit(b" ", shingle - 1)[1:])
    if not found and held:
        found.append(_shingles(Words([held]), shingle)[0])
    names = np.unique(np.concatenate([np.zeros(0, U), *found]))
    if not len(names):
        return whole.digest(), np.zeros((1, PARTS), U), np.zeros((0, BANDS), U)
    steps = [names[a : a + STEP] for a in range(0, len(names), STEP)]
    zero = np.zeros(1, np.int64)
    *_, counts = accumulate(_bit_counts(s, zero) for s in steps)
    *_, least = accumulate((_minima(s, zero) for s in steps), np.minimum)
    return whole.digest(), _packed(counts, np.array([len(names)])), _bands(least)


def sketches(texts: list[bytes], shingle: int) -> Iterator[tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray]]:
    """For runs of texts: a 128-bit name of each text's words, its fingerprint, whether it has words, and the bands of those that do.

    A fingerprint's bit is set if over half of the distinct shingles' hashes have it; all bits are zero without words.
    """
    if len(texts) == 1 and len(texts[0]) > PIECE_BYTES:
        name, bits, bands = _long_sketch(texts[0], shingle)
        yield [name], bits, np.array([len(bands) > 0]), bands
        return
    words = Words(texts, lower=True)
    names, size = _shingles(words, shingle)
    full = size > 0
    bits, bands = np.zeros((len(texts), PARTS), U), np.zeros((0, BANDS), U)
    if len(names):
        first = (np.cumsum(size) - size)[full]
        bits[full], bands = _packed(_bit_counts(names, first), size[full]), _bands(_minima(names, first))
    yield [xxhash.xxh3_128_digest(t) for t in words.joined()], bits, full, bands
