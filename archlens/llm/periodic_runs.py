"""Periodic runs of words by block convolution (operator 11).

A run is a maximal stretch of words with smallest period q that is at least max(MIN_WORDS, MIN_POWER * q) long. At each
dyadic scale B the blocks of B words at every B/2-th place are looked for in what follows them; `ntt.first_copies` finds each
block's nearest copy exactly. A run with B/2 < q <= B holds such a block with its copy q words further, and no nearer
copy, as its first q words aren't themselves a power (blocks inside runs of smaller scales are left out). Each distance found seeds an extension to both sides; the stretch of
words that equal those d further is maximal and gives the run. Blocks with a word that doesn't come again within B words can't
have a copy; they are left out beforehand.

Defined results: a null or empty text has no words and no runs; without a run the best one is null; rows may repeat and are
judged each; an empty table gives an empty result; other columns are ignored. A text is worked on in one task: about 60
bytes for each of its words beside the text.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from archlens.llm.common import chunks, id_and_text, map_batches, texts_of
from archlens.llm.ntt import first_copies
from archlens.llm.pieces import SPACE, pieces

#: A run's least length in words and in periods; the proof above takes 4 periods or more.
MIN_WORDS, MIN_POWER = 6, 4


def word_ids(text: bytes) -> np.ndarray:
    """A number from 1 for each word of a text, equal for equal words of it."""
    known: dict[bytes, int] = {}
    return np.concatenate([np.array([known.setdefault(w, len(known) + 1) for w in piece.split()], np.int32) for piece in pieces(text, SPACE)])


def _next_distance(ids: list[np.ndarray], places: np.ndarray, size: int) -> np.ndarray:
    """How many words further each word's next copy in its own text stands; very many if there is none."""
    out = np.full(size, np.iinfo(np.int32).max, np.int32)
    offset = np.cumsum([0] + [int(x.max(initial=0)) for x in ids])
    every = np.concatenate([x + o for x, o in zip(ids, offset, strict=False)])
    order = np.argsort(every, kind="stable")
    same = np.flatnonzero(every[order[1:]] == every[order[:-1]])
    out[places[order[same]]] = order[same + 1] - order[same]
    return out


def _equal_right(x: np.ndarray, at: int, d: int) -> int:
    """The first place from `at` whose word differs from that d further; x ends with a word that is nowhere else."""
    step = 64
    while True:
        end = min(at + step, len(x) - d)
        bad = np.flatnonzero(x[at:end] != x[at + d : end + d])
        if len(bad) or end == len(x) - d:
            return at + int(bad[0]) if len(bad) else end
        at, step = end, step * 2


def _equal_left(x: np.ndarray, at: int, d: int) -> int:
    """The first place of the words up to `at` that all equal those d further."""
    step = 64
    while True:
        low = max(at - step, 0)
        bad = np.flatnonzero(x[low:at] != x[low + d : at + d])
        if len(bad) or low == 0:
            return low + int(bad[-1]) + 1 if len(bad) else 0
        at, step = low, step * 2


def _inside(runs: list[tuple[int, int, int]], starts: np.ndarray, block: int, size: int) -> np.ndarray:
    """Blocks that lie in a known run with their copy one period further: their nearest copy belongs to a smaller scale."""
    table = np.array(runs, np.int64).reshape(-1, 3)
    last = table[:, 0] + table[:, 1] - table[:, 2] - block
    low, last = table[last >= table[:, 0], 0], last[last >= table[:, 0]]
    if not len(low):
        return np.zeros(len(starts), bool)
    depth = np.zeros(size + 1, np.int32)
    np.add.at(depth, low, 1)
    np.add.at(depth, last + 1, -1)
    return np.cumsum(depth)[starts] > 0


def runs_of(ids: list[np.ndarray]) -> list[np.ndarray]:
    """Runs (start, length, period) of each text's word numbers, by start and then period."""
    counts = np.array([len(x) for x in ids])
    first = np.cumsum(counts + 1) - counts  # behind a separator each
    longest = int(counts.max(initial=0))
    size = int(counts.sum()) + len(ids) + 1
    symbols = np.full(size, 0, np.int32)
    places = np.repeat(first - np.cumsum(counts) + counts, counts) + np.arange(counts.sum())
    symbols[places] = np.concatenate(ids)
    values = np.concatenate((symbols, np.zeros(max(longest, 2), np.int32)))  # separators differ from any word
    gaps = np.flatnonzero(symbols == 0)
    symbols[gaps] = -1 - np.arange(len(gaps))  # and, in extensions, from each other
    further = _next_distance(ids, places, size)
    found: list[tuple[int, int, int]] = []
    block = 1
    while 2 * block < max(longest, 3):
        bad = np.concatenate(([0], np.cumsum(further > block, dtype=np.int32)))
        starts = np.arange(0, max(size - block + 1, 0), max(block // 2, 1))
        starts = starts[(bad[starts + block] == bad[starts]) & ~_inside(found, starts, block, size)]
        distance = first_copies(values, starts, block)
        seeds = distance > block // 2
        starts, distance = starts[seeds], distance[seeds]
        for d in np.unique(distance).tolist():
            at, k = starts[distance == d], 0
            while k < len(at):
                low, high = _equal_left(symbols, int(at[k]), d), _equal_right(symbols, int(at[k]), d)
                if high - low + d >= max(MIN_WORDS, MIN_POWER * d):
                    found.append((low, high - low + d, d))
                k = int(np.searchsorted(at, high))
        block *= 2
    table = np.array(sorted(found), np.int64).reshape(-1, 3)
    cuts = np.searchsorted(table[:, 0], first)
    out = [table[a:b].copy() for a, b in zip(cuts, [*cuts[1:], len(table)], strict=True)]
    for rows, begin in zip(out, first, strict=True):
        rows[:, 0] -= begin
    return out


def kept_words(runs: np.ndarray, n: int) -> np.ndarray:
    """Which of n words stay: those that no run has behind its first period."""
    depth = np.zeros(n + 1, np.int64)
    np.add.at(depth, runs[:, 0] + runs[:, 2], 1)
    np.add.at(depth, runs[:, 0] + runs[:, 1], -1)
    return np.cumsum(depth[:-1]) == 0


def _collapsed(text: bytes, keep: np.ndarray) -> bytes:
    parts, at = [], 0
    for piece in pieces(text, SPACE):
        words = piece.split()
        part = b" ".join(compress(words, keep[at : at + len(words)].tolist()))
        at += len(words)
        if part:
            parts.append(part)
    return b" ".join(parts)


RUN = "struct<start: bigint, length: bigint, period: bigint>"


def find_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, runs (start, length, period; by start, then period), best (the longest run; ties: smallest start, then
    period) and collapsed_text (each run's first period only; words joined by one space)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = texts_of(batch.column("text"))
            for a, b in chunks(texts):
                ids = [word_ids(t) for t in texts[a:b]]
                runs = runs_of(ids)
                kept = [_collapsed(t, kept_words(r, len(x))).decode() for t, r, x in zip(texts[a:b], runs, ids, strict=True)]
                listed = [[dict(zip(("start", "length", "period"), r, strict=True)) for r in rows.tolist()] for rows in runs]
                kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id")[a:b], pa.array([len(x) for x in ids], pa.int64()), pa.array(listed, kind), pa.array(kept, pa.string())], ["doc_id", "n_words", "runs", "collapsed_text"]
                )

    found = map_batches(id_and_text(docs, id_col, text_col), run, f"doc_id long, n_words long, runs array<{RUN}>, collapsed_text string")
    order = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    best = F.when(F.size("runs") > 0, F.struct((-order["start"]).alias("start"), order["length"].alias("length"), (-order["period"]).alias("period")))
    return found.withColumn("best", best).select("doc_id", "n_words", "runs", "best", "collapsed_text")
