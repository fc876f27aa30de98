"""Greedy word-piece counts by a linear longest-match automaton (operator 2).

The vocabulary is a trie. Every node has a failure link: the node for what is left of its string once greedy matching
has taken whole pieces off its front; how many pieces that takes is computed beforehand. Counting a word then follows
each character once, adds the counts of the links it takes, and never builds a piece.

A word is what stands between ASCII white space, with the vocabulary's word mark before it; its first piece begins
with the mark, the others do not. A word that has no such split counts as one unknown piece, as in word-piece
tokenizers.

Defined results: a null or empty text has no words and no tokens; an empty table gives an empty result; repeated rows
are counted each; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

from archlens.llm.common import id_and_text, map_batches, texts_of

MARK = "▁"
#: Distinct words whose counts a task remembers.
TABLE_WORDS = 500_000


class LongestMatch:
    """Failure-linked trie over `heads` (pieces that begin a word) and `tails` (pieces that go on)."""

    def __init__(self, heads: Iterable[str], tails: Iterable[str]):
        # node 0 begins a word, node 1 stands after a whole piece
        self.next: list[dict[str, int]] = [{}, {}]
        ends = set()
        for root, vocabulary in ((0, heads), (1, tails)):
            for piece in vocabulary:
                node = root
                for c in piece:
                    following = self.next[node].get(c)
                    if following is None:
                        following = self.next[node][c] = len(self.next)
                        self.next.append({})
                    node = following
                ends.add(node)
        n = len(self.next)
        self.fail, self.pops = [-1] * n, [0] * n
        queue = [0, 1]
        for node in queue:
            for c, child in self.next[node].items():
                queue.append(child)
                if child in ends:
                    self.fail[child], self.pops[child] = 1, 1
                    continue
                link, popped = self.fail[node], self.pops[node]
                while link >= 0 and c not in self.next[link]:
                    popped += self.pops[link]
                    link = self.fail[link]
                if link >= 0:
                    self.fail[child], self.pops[child] = self.next[link][c], popped

    def count(self, word: str) -> int:
        """Pieces of the greedy split of `word`; 1 if there is none."""
        following, fail, pops = self.next, self.fail, self.pops
        node = total = 0
        for c in word:
            while (child := following[node].get(c)) is None:
                total += pops[node]
                node = fail[node]
                if node < 0:
                    return 1
            node = child
        while node != 1:
            total += pops[node]
            node = fail[node]
            if node < 0:
                return 1
        return total


@lru_cache(maxsize=2)
def automaton(path: str, mark: str = MARK) -> LongestMatch:
    """The automaton of a piece model file."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = [k for k in range(model.get_piece_size()) if not (model.is_control(k) or model.is_unknown(k) or model.is_byte(k) or model.is_unused(k))]
    pieces = [model.id_to_piece(k) for k in ids]
    return LongestMatch([p for p in pieces if p.startswith(mark)], [p for p in pieces if not p.startswith(mark)])


def count_tokens(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words and n_tokens of each whole text under the piece model file `model`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, known = automaton(model).count, {}
        for batch in batches:
            words, tokens = [], []
            for text in texts_of(batch.column("text")):
                split = text.split()
                if len(known) > TABLE_WORDS:
                    known = {}
                for word in split:
                    if word not in known:  # a set difference would walk the whole table for each text
                        known[word] = count(MARK + word.decode())
                words.append(len(split))
                tokens.append(sum(map(known.__getitem__, split)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(words, pa.int64()), pa.array(tokens, pa.int64())], ["doc_id", "n_words", "n_tokens"])

    return map_batches(id_and_text(docs, id_col, text_col), run, "doc_id long, n_words long, n_tokens long")
