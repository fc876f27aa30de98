"""Spelling variants grouped by finite-state composition (operator 13).

Words are near if one inserted, deleted or replaced character tells them apart. In a partition the words are kept as minimised
acceptors, one for each length. Composing the acceptor with a transducer of exactly one edit and with the acceptor again
gives the near pairs: the composed automaton is walked from its initial state, the pairs of states behind an edit are
intersected once each, however many words lead there.

Partitions. The vocabulary is never in one task. For pairs whose longer word has M characters a key fixes the first a characters
and the last M - b, so the edit lies in a..b; the state behind the fixed beginning is the initial state of that partition's
automata. Keys begin with both halves of a word. A key of more than GROUP_WORDS words is replaced by the keys of its two halves,
until a key leaves one character open and so holds no more words than the alphabet has letters. Each pair is found at the place of its first
difference, so under one key only.

A word's form is its near word of largest count (ties: the smallest) if that is RATIO times its own at least. Counts grow along
forms, so these are trees; a word's root is found by doubling the steps each round.

Defined results: a null or empty text has no words; repeated rows count each; an empty table gives an empty result; other columns are
ignored; a row without doc_id counts like any other.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from archlens.llm.common import cut, id_and_text, map_batches, texts_of
from archlens.llm.pieces import pieces

#: Letters of Latin scripts: A-Z, a-z and U+00C0 to U+00FF, as UTF-8.
LETTERS, NO_LETTER = re.compile(rb"(?:[A-Za-z]|\xc3[\x80-\xbf])+"), re.compile(rb"[\x00-\x40\x5b-\x60\x7b-\x7f]")
MIN_CHARS, MIN_COUNT, RATIO = 5, 3, 2
#: Distinct words that a task counts before it sends counts; words of a partition.
FLUSH_WORDS, GROUP_WORDS = 200_000, 2000


def word_counts(docs: DataFrame, change: Callable[[int | None, bytes], bytes] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """word and n (occurrences) of the lower-cased words of all texts; `change` may give another word for a document's word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter[bytes] = Counter()

        def flush() -> pa.RecordBatch:
            words = [w for w in total if len(w) >= MIN_CHARS and len(w.decode()) >= MIN_CHARS]
            out = pa.RecordBatch.from_arrays([pa.array([w.decode() for w in words], pa.string()), pa.array([total[w] for w in words], pa.int64())], ["word", "n"])
            total.clear()
            return out

        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), texts_of(batch.column("text")), strict=True):
                own: Counter[bytes] = Counter()
                for piece in pieces(text, NO_LETTER):
                    own.update(LETTERS.findall(piece.lower()))  # of bytes: A-Z only
                if change is None:
                    total.update(own)
                else:
                    for word, n in own.items():
                        total[change(doc_id, word)] += n
                if len(total) > FLUSH_WORDS:
                    yield flush()
        yield flush()

    return map_batches(id_and_text(docs, id_col, text_col), run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


class Acceptor:
    """The minimal acyclic acceptor of sorted distinct words of one length; states are numbers, 0 the initial one.

    next[state]: character -> (state, how many words of the state come before those of this character). The place of a
    word is the sum of these along its path.
    """

    def __init__(self, words: list[str]):
        self.next: list[dict[str, tuple[int, int]]] = [{}]
        self.size = [len(words)]
        known: dict[tuple, int] = {}
        # The states along the last word: those below where the next word leaves it are final and meet their equals.
        path: list[list[tuple[str, int, int]]] = [[]]  # (character, state, words)
        last = ""
        for word in [*words, ""]:
            same = 0
            while same < len(word) and same < len(last) and word[same] == last[same]:
                same += 1
            for depth in range(len(last), same, -1):
                arcs = tuple(path.pop())
                state = known.get(arcs)
                if state is None:
                    state = known[arcs] = len(self.next)
                    self._add(arcs)
                path[depth - 1].append((last[depth - 1], state, self.size[state]))
            path += [[] for _ in range(len(word) - same)]
            last = word
        self._put(0, path[0])

    def _add(self, arcs: tuple) -> None:
        self.next.append({})
        self.size.append(sum(n for _, _, n in arcs) if arcs else 1)
        self._put(len(self.next) - 1, arcs)

    def _put(self, state: int, arcs) -> None:
        before = 0
        for c, to, n in arcs:
            self.next[state][c] = (to, before)
            before += n


def near_pairs(words: list[str], shorter: list[str], after: str = "") -> Iterator[tuple[int, int, bool]]:
    """Places of near words among sorted distinct `words` of one length, and (True) of a word and one in `shorter`, one
    character less long, that is left when a character is deleted. Each pair once. `after` is the character that all go on with."""
    one = Acceptor(words)
    two = Acceptor(shorter) if shorter else None
    memo: dict[tuple[int, int, bool], list[tuple[int, int]]] = {}

    def common(p: int, q: int, other: Acceptor, deletes: bool) -> list[tuple[int, int]]:
        """Places of equal words below both states: the transducer behind its edit copies what it reads."""
        todo = [(p, q)]
        while todo:
            p, q = todo[-1]
            if (p, q, deletes) in memo:
                todo.pop()
                continue
            left, right = one.next[p], other.next[q]
            both = left.keys() & right.keys()
            if other is one and p == q:
                memo[p, q, deletes] = [(k, k) for k in range(one.size[p])]
            elif open_ := [k for c in both if ((k := (left[c][0], right[c][0])) + (deletes,)) not in memo]:
                todo += open_
            else:
                out = [] if left or right else [(0, 0)]
                for c in both:
                    (a, i), (b, j) = left[c], right[c]
                    out += [(i + x, j + y) for x, y in memo[a, b, deletes]]
                memo[p, q, deletes] = out
        return memo[p, q, deletes]

    stack: list[tuple[int, int, int | None, int]] = [(0, 0, 0 if two else None, 0)]  # states and places before the edit
    while stack:
        p, i, q, j = stack.pop()
        arcs = list(one.next[p].items())
        for k, (_, (a, x)) in enumerate(arcs):
            for _, (b, y) in arcs[k + 1 :]:
                for u, v in common(a, b, one, False):
                    yield i + x + u, i + y + v, False
        for c, (a, x) in arcs:
            to = None
            if q is not None:
                # Delete c; what the shorter word goes on with isn't c, else the first difference comes later.
                left, right = one.next[a], two.next[q]
                if not left and not right and c != after:
                    yield i + x, j, True
                for d in left.keys() & right.keys():
                    if d != c:
                        (b, y), (e, z) = left[d], right[d]
                        for u, v in common(b, e, two, True):
                            yield i + x + y + u, j + z + v, True
                to = right.get(c)
            if one.next[a] or to:
                stack.append((a, i + x, to[0] if to else None, j + to[1] if to else 0))


def group_result(words: list[str], counts: list[int], longest: int, low: int, high: int) -> dict[str, tuple[int, int, str]]:
    """For words of a key: how many near words each has there, and the best one's count and name."""
    long, short = ({w[low : high - k]: (w, n) for w, n in zip(words, counts, strict=True) if len(w) == longest - k} for k in (0, 1))
    first, second = sorted(long), sorted(short)
    out: dict[str, tuple[int, int, str]] = {}

    def meets(word: str, near: str, n: int) -> None:
        had = out.get(word)
        if had is None:
            out[word] = (1, n, near)
        else:
            better = n > had[1] or n == had[1] and near < had[2]
            out[word] = (had[0] + 1, n, near) if better else (had[0] + 1, had[1], had[2])

    after = long[first[0]][0][high : high + 1] if first else ""
    for a, b, deletes in near_pairs(first, second, after) if first else ():
        (x, m), (y, n) = long[first[a]], (short[second[b]] if deletes else long[first[b]])
        meets(x, y, n)
        meets(y, x, m)
    return out


def _matched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows: list[tuple] = []
        for key in batch.to_pylist():
            found = group_result([w["word"] for w in key["words"]], [w["n"] for w in key["words"]], key["m"], key["low"], key["high"])
            rows += [(word, *got) for word, got in found.items()]
        columns = list(zip(*rows, strict=True)) or [(), (), (), ()]
        kinds = (pa.string(), pa.int64(), pa.int64(), pa.string())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["word", "n_near", "near_n", "near"])


def _keyed(rows: DataFrame, low: Column, high: Column) -> DataFrame:
    """word, n, m, low, high, key for each half of the open characters low..high in pairs of at most m characters."""
    middle = F.floor((low + high) / 2).cast("int")
    halves = F.array(F.struct(low.alias("low"), middle.alias("high")), F.struct(middle.alias("low"), high.alias("high")))
    each = rows.select("word", "n", "m", F.explode(halves).alias("s")).select("word", "n", "m", "s.*")
    # What is fixed: the first `low` characters and the last m - high; with m, low and high it is clear which is which.
    return each.withColumn("key", F.concat(F.expr("left(word, low)"), F.expr("right(word, m - high)")))


def near_words(counts: DataFrame, group_words: int = GROUP_WORDS) -> DataFrame:
    """word, n_near (near words), near and near_n (the near word of largest n; ties: the smallest) of words that have near words."""
    by = ["m", "low", "high", "key"]
    lengths = F.array(F.length("word"), F.length("word") + 1)
    rows = _keyed(counts.select("word", F.col("n").cast("long").alias("n"), F.explode(lengths).alias("m")), F.lit(0), F.col("m"))
    found = None
    while True:
        # A pair takes two words, one of them with m characters.
        sizes = cut(rows.groupBy(*by).agg(F.count("*").alias("rows"), F.max(F.length("word")).alias("top")).filter("rows > 1 and top = m"))
        large = (F.col("rows") > group_words) & (F.col("high") - F.col("low") > 1)
        small = rows.join(sizes.filter(~large).select(*by), by).groupBy(*by).agg(F.collect_list(F.struct("word", "n")).alias("words"))
        part = map_batches(small.select("m", "low", "high", "words"), _matched, "word string, n_near long, near_n long, near string")
        found = part if found is None else found.union(part)
        if sizes.filter(large).isEmpty():
            break
        rows = cut(_keyed(rows.join(sizes.filter(large).select(*by), by), F.col("low"), F.col("high")))
    ranked = found.groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("off"), F.col("near"))).alias("best"))
    return ranked.select("word", "n_near", F.col("best.near").alias("near"), (-F.col("best.off")).alias("near_n"))


def roots(forms: DataFrame) -> DataFrame:
    """(word, form) -> (word, root): forms followed to the last, twice as far each round."""
    reached = cut(forms.select("word", F.col("form").alias("root")))
    while True:
        further = reached.select(F.col("word").alias("root"), F.col("root").alias("next"))
        stepped = cut(reached.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        moved = not stepped.filter("moved").isEmpty()
        reached = stepped.select("word", "root")
        if not moved:
            return reached


def variants(counts: DataFrame, min_count: int = MIN_COUNT, ratio: int = RATIO) -> DataFrame:
    """word, form, root, n, n_near, form_n of the words of `counts` (word, n) with at least min_count occurrences."""
    words = cut(counts.filter(F.col("n") >= min_count))
    near = words.join(near_words(words), "word", "left")
    takes = F.col("near_n") >= ratio * F.col("n")
    formed = cut(near.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(takes, F.col("near")).alias("form"), F.when(takes, F.col("near_n")).alias("form_n")))
    followed = formed.join(roots(formed.filter("form is not null")), "word", "left")
    return followed.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
