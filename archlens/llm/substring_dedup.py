"""Substring deduplication by recompression (operator 1).

A text's words are symbols. Rounds of recompression name runs and pairs: of two neighbours that a coin of their names
puts on the left and on the right, the pair becomes one symbol. A name is a hash of what it stands for, so it is the
same in every task without a dictionary, and equal stretches get the same symbols but for their ends. After
two rounds a symbol inside a window depends on the window's words alone; the smallest name in the window's middle is
its anchor, and neighbouring windows mostly share theirs. The stretch of windows with one anchor is what Spark
exchanges, about one for four words, in two rounds:

1. The anchor's words are the key, the whole stretch is the part. A stretch that an earlier document has is removed
   as a whole. A key that only one stretch has holds no repeat, and nothing more is asked about it.
2. Of keys with several stretches the first of each stretch sends its single windows.

Every stretch and window is settled by its key and by its words' names in two families whose hashes share nothing: 128
bits, and 64 more of the anchor for stretches. Words themselves don't travel. No window is left out, at any number of
occurrences.

Defined results: null and empty texts have no words; a text of fewer words than a window loses nothing; rows of one
doc_id never remove each other's words; rows without doc_id lose nothing and remove nothing; an empty table gives an
empty result; other columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from archlens.llm.common import chunks, cut, id_and_text, map_batches, texts_of
from archlens.llm.earliest import settle
from archlens.llm.words import Spans, U, Words, mix

RESULT = "doc_id long, n_words long, n_removed long, kept_text string"
#: Words before a window's middle on which the symbols there can depend.
REACH = 4


def recompress(name: np.ndarray, doc: np.ndarray, rounds: int = 2) -> tuple[np.ndarray, np.ndarray]:
    """For each word the name and the first word of the symbol that covers it after `rounds` rounds."""
    n = len(name)
    same = np.zeros(n + 1, bool)
    same[1:n] = (name[1:] == name[:-1]) & (doc[1:] == doc[:-1])
    run = same[:-1] | same[1:]
    symbol = np.where(run, mix(name ^ U(0x52554E)), name)  # a run's words stay apart: their number may differ at the ends
    start, single, whose = np.arange(n), ~run, doc
    for k in range(rounds):
        left = (mix(symbol + U(2 * k + 1)) & U(1)).astype(bool)
        pair = np.zeros(len(symbol) + 1, bool)
        pair[1:-1] = left[:-1] & ~left[1:] & single[:-1] & single[1:] & (whose[:-1] == whose[1:])
        head = np.flatnonzero(pair[1:])
        symbol = symbol.copy()
        symbol[head] = mix(symbol[head] * U(3) + mix(symbol[head + 1] + U(k + 1)))
        stay = ~pair[:-1]
        symbol, start, single, whose = symbol[stay], start[stay], single[stay], whose[stay]
    length = np.diff(np.append(start, n))
    return np.repeat(symbol, length), np.repeat(start, length)


class Stretches:
    """The windows of some texts, and the stretches of those that share an anchor."""

    def __init__(self, words: Words, window: int):
        self.window, self.spans = window, Spans(words.name)
        self.others = Spans(words.other_names(), 1)
        n = max(0, len(words.name) - window + 1)
        symbol, begin = recompress(words.name, words.doc)
        best, self.anchor = symbol[REACH : REACH + n], begin[REACH : REACH + n]
        for k in range(REACH + 1, window - REACH):
            better = symbol[k : k + n] < best
            best = np.where(better, symbol[k : k + n], best)
            self.anchor = np.where(better, begin[k : k + n], self.anchor)
        self.at = np.flatnonzero(words.doc[:n] == words.doc[window - 1 : window - 1 + n])
        new = np.ones(len(self.at), bool)
        new[1:] = (np.diff(self.at) != 1) | (self.anchor[self.at[1:]] != self.anchor[self.at[:-1]])
        first = np.flatnonzero(new)
        self.of_window = np.cumsum(new) - 1
        self.low = self.at[first]
        self.high = self.at[np.append(first[1:], len(self.at))[: len(first)] - 1] if len(first) else self.low
        self.doc = words.doc[self.low]
        anchor = self.anchor[self.low]
        self.key = self.spans.name(anchor - 1, anchor + REACH + 1)
        self.part = self.spans.name(self.low, self.high + window)
        self.check = self.others.name(self.low, self.high + window)

    def windows(self, which: np.ndarray) -> np.ndarray:
        """First words of the windows of the stretches marked in `which`."""
        return self.at[which[self.of_window]] if len(self.at) else self.at

    def names(self, at: np.ndarray) -> np.ndarray:
        return self.spans.name(at, at + self.window)

    def checks(self, at: np.ndarray) -> np.ndarray:
        return self.others.name(at, at + self.window)


def _tagged(doc: np.ndarray, name: np.ndarray) -> np.ndarray:
    return mix(name ^ mix(doc.astype(U) + U(1)))


def _listed(column: pa.Array, a: int, b: int) -> np.ndarray:
    """Sorted tags of all entries of the lists in rows a..b."""
    lists = column.slice(a, b - a).to_pylist()
    size = [len(x or ()) for x in lists]
    values = np.array([v for x in lists if x for v in x], np.int64).view(U)
    return np.sort(_tagged(np.repeat(np.arange(b - a), size), values))


def _among(tags: np.ndarray, listed: np.ndarray) -> np.ndarray:
    if not len(listed):
        return np.zeros(len(tags), bool)
    return listed[np.minimum(np.searchsorted(listed, tags), len(listed) - 1)] == tags


def _chunks(batch: pa.RecordBatch, window: int) -> Iterator[tuple[int, int, Words, Stretches]]:
    texts = texts_of(batch.column("text"))
    for a, b in chunks(texts):
        words = Words(texts[a:b])
        yield a, b, words, Stretches(words, window)


def _ids(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    column = batch.column("doc_id")
    return column.fill_null(0).to_numpy(), np.asarray(column.is_valid())


def _stretch_rows(window: int):
    def rows(batch: pa.RecordBatch) -> Iterator[tuple]:
        ids, given = _ids(batch)
        for a, _, _, s in _chunks(batch, window):
            use = given[a + s.doc]
            yield s.key[use], s.part[use], s.check[use], ids[a + s.doc[use]]

    return rows


def _window_rows(window: int):
    def rows(batch: pa.RecordBatch) -> Iterator[tuple]:
        ids, _ = _ids(batch)
        ask = batch.column("contested")
        batch = batch.filter(pa.compute.greater(pa.compute.list_value_length(ask).fill_null(0), 0))
        ids, ask = batch.column("doc_id").to_numpy(), batch.column("contested")
        for a, b, words, s in _chunks(batch, window):
            which = _among(_tagged(s.doc, s.part), _listed(ask, a, b))
            at = s.windows(which)
            name = s.names(at)
            yield name, name, s.checks(at), ids[a + words.doc[at]]

    return rows


def _remove(window: int):
    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, words, s in _chunks(batch, window):
                gone = _among(_tagged(s.doc, s.part), _listed(batch.column("stretches"), a, b))
                low, high = s.low[gone], s.high[gone]
                single = _listed(batch.column("windows"), a, b)
                if len(single):
                    at = s.windows(~gone)
                    at = at[_among(_tagged(words.doc[at], s.names(at)), single)]
                    low, high = np.concatenate((low, at)), np.concatenate((high, at))
                step = np.bincount(low, minlength=len(words.name) + 1) - np.bincount(high + window, minlength=len(words.name) + 1)
                removed = np.cumsum(step)[:-1] > 0
                counted = np.bincount(words.doc[removed], minlength=b - a)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(a, b - a), pa.array(words.count), pa.array(counted), pa.array(words.joined(~removed), pa.binary()).cast(pa.string())],
                    ["doc_id", "n_words", "n_removed", "kept_text"],
                )

    return remove


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 13) -> DataFrame:
    """Removes each word that a window covers whose words also start in a document with a smaller id.

    Returns doc_id, n_words, n_removed and kept_text (the kept words, joined by one space). `window`: at least 9 words.
    """
    if window < 2 * REACH + 1:
        raise ValueError(f"a window has at least {2 * REACH + 1} words")
    texts = id_and_text(docs, id_col, text_col)
    first = cut(settle(texts, _stretch_rows(window), contested=True))
    asked = texts.join(first.select("doc_id", "contested"), "doc_id", "left")
    second = settle(asked, _window_rows(window)).select("doc_id", F.col("later").alias("windows"))
    found = texts.join(first.select("doc_id", F.col("later").alias("stretches")), "doc_id", "left").join(second, "doc_id", "left")
    return map_batches(found, _remove(window), RESULT)
