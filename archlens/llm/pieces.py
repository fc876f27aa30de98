"""A long text in bounded pieces, so that no list of all its words is ever held."""

from __future__ import annotations

import re
from collections.abc import Iterator

#: A byte of ASCII white space.
SPACE = re.compile(rb"[\x20\x09-\x0D]")
#: Bytes of a piece, but for a single word that is longer.
PIECE_BYTES = 1 << 20


def pieces(text: bytes, gap: re.Pattern[bytes], size: int = PIECE_BYTES) -> Iterator[bytes]:
    """`text` in pieces that end behind the first match of `gap` (one byte that belongs to no word) at or beyond `size` bytes."""
    at = 0
    while len(text) - at > size:
        found = gap.search(text, at + size)
        if not found:
            break
        yield text[at : found.end()]
        at = found.end()
    yield text[at:] if at else text
