"""Line deduplication by a deletion-neighbourhood join (operator 3).

A line is its words; an edit inserts, deletes or replaces one word. A line is removed if an earlier line (smaller doc_id,
or in one document a smaller line number) has the same words, or lies one edit away and the longer of the two has at
least `min_words` words (five: the lines are then 80 % equal or more). The earliest stays.

Copies are grouped by a 128-bit digest of their words. Of each distinct line every variant is hashed as a key: itself,
and itself without the word at each place. Lines with an equal key join the earliest of them, where the places agree or
one of the two is whole (only then is their distance one), and the distance of each such pair is verified on the words
themselves. The earliest line of a key and place is a grouped minimum, so no pairs inside a key are made.

Most lines have no partner. Two lines one edit apart have equal first or equal last words, as many as fit twice beside the
edit, so only lines that share such a beginning or end with another line make variants; this loses none.

The bound is one word whatever a line's length, as the variants of k edits grow with the k-th power of the length; lines
two or more edits apart both stay.

Defined results: lines are split at newlines; lines without words stay and are never removed; a null text stays null;
rows of one doc_id count as the same document and never remove each other's lines, but each row loses the lines it
repeats itself; rows without doc_id lose nothing and remove nothing; empty tables give empty results. A document that
loses all its lines stays, with an empty text.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from archlens.llm.common import cut, fresh, id_and_text, map_batches, named, texts_of, with_columns

LINES = "doc long, number int, a long, b long, head long, tail long, head2 long, tail2 long"
VARIANTS = "key long, place int, lead boolean, doc long, number int, line long, words binary"
#: Lengths of beginnings and ends: whole numbers that grow by about a fifth.
LENGTHS = sorted({int(1.2**k) for k in range(100)})


def _digest(words: list[bytes]) -> tuple[int, int]:
    digest = blake2b(b" ".join(words), digest_size=16).digest()
    return int.from_bytes(digest[:8], "little", signed=True), int.from_bytes(digest[8:], "little", signed=True)


def _key(words: list[bytes], kind: int = 0) -> int:
    return xxhash.xxh3_64_intdigest(b" ".join(words), kind)


@lru_cache(maxsize=1 << 16)
def _lengths(n: int) -> tuple[int, ...]:
    """How many words at a side of a line of n words are keys: for lines of this length, and for those one shorter if other."""
    fit = lambda m: LENGTHS[bisect_right(LENGTHS, (m - 1) // 2) - 1]
    return tuple({fit(n), fit(n - 1)}) if n > 3 else (1,)


def _longs(values: list[int]) -> pa.Array:
    return pa.array(np.array(values, np.uint64).view(np.int64))


def one_edit(a: list[bytes], b: list[bytes]) -> bool:
    """Whether one inserted, deleted or replaced word, or none, makes two lists of words equal."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1:
        return False
    k = next((k for k, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), len(a))
    return a[k + (len(a) == len(b)) :] == b[k + 1 :]


def _lines(min_words: int):
    """The distinct lines of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs, numbers, digests, sides = [], [], [], []
            for doc, text in zip(batch.column("doc_id").to_pylist(), texts_of(batch.column("text")), strict=True):
                seen = set()
                for number, line in enumerate(text.split(b"\n")):
                    words = line.split()
                    if not words or (digest := _digest(words)) in seen:
                        continue
                    seen.add(digest)
                    docs.append(doc)
                    numbers.append(number)
                    digests.append(digest)
                    keys = [_key(part, 2 * t + k) for t in _lengths(len(words)) for k, part in enumerate((words[:t], words[-t:]))] if len(words) >= min_words - 1 else []
                    sides.append((keys + [None] * 4)[:4])
            pairs = np.array(digests, np.int64).reshape(-1, 2)
            columns = [pa.array(docs, pa.int64()), pa.array(numbers, pa.int32()), pa.array(pairs[:, 0]), pa.array(pairs[:, 1])]
            keys = [pa.array(c, pa.uint64()).view(pa.int64()) for c in zip(*sides, strict=True)] or [pa.array([], pa.int64())] * 4
            yield pa.RecordBatch.from_arrays([*columns, *keys], [x.split()[0] for x in LINES.split(", ")])

    return run


def _variants(min_words: int):
    """The variants of each candidate line; its words stand in the row of the whole line alone.

    lead: the first row of its key and place in its document.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, rows = [], []
            for doc, text, asked in zip(batch.column("doc_id").to_pylist(), texts_of(batch.column("text")), batch.column("candidates").to_pylist(), strict=True):
                lines, seen = text.split(b"\n"), set()
                for number, digest in sorted((x["number"], x["a"]) for x in asked):
                    words = lines[number].split() if number < len(lines) else []
                    if not words or _digest(words)[0] != digest:
                        continue  # a line of another row of this doc_id
                    made = [(_key(words), 0)]
                    if len(words) >= min_words:
                        made += [(_key(words[:k] + words[k + 1 :]), k + 1) for k in range(len(words))]
                    keys += [k for k, _ in made]
                    rows += [(place, (key, place) not in seen, doc, number, digest, None if place else b" ".join(words)) for key, place in made]
                    seen.update(made)
            kinds = (pa.int32(), pa.bool_(), pa.int64(), pa.int32(), pa.int64(), pa.binary())
            columns = list(zip(*rows, strict=True)) or [[]] * 6
            yield pa.RecordBatch.from_arrays([_longs(keys), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], [x.split()[0] for x in VARIANTS.split(", ")])

    return run


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Those pairs of lines that are one edit apart."""
    for batch in batches:
        pairs = zip(batch.column("words").to_pylist(), batch.column("earlier").to_pylist(), strict=True)
        yield batch.filter(pa.array([one_edit(a.split(b" "), b.split(b" ")) for a, b in pairs], pa.bool_())).select(["doc", "a"])


def _near(texts: DataFrame, first: DataFrame, min_words: int) -> DataFrame:
    """doc and a of the first lines (rows of LINES) that lie one edit from an earlier one."""
    sides = F.array_compact(F.array("head", "tail", "head2", "tail2"))
    keyed = first.select("doc", "number", "a", F.explode(sides).alias("side"))
    alike = keyed.groupBy("side").agg(F.min("a").alias("low"), F.max("a").alias("high")).filter("low < high").select("side")
    candidates = keyed.join(alike, "side").groupBy("doc").agg(F.collect_set(F.struct("number", "a")).alias("candidates"))
    asked = texts.join(candidates.hint("shuffle_hash"), texts.doc_id == candidates.doc).select("doc_id", "text", "candidates")
    variants = cut(map_batches(asked, _variants(min_words), VARIANTS))
    # Few keys belong to several lines; only those go on.
    several = variants.groupBy("key").agg(F.min("line").alias("low"), F.max("line").alias("high")).filter("low < high").select("key")
    narrow = variants.select("key", "place", "lead", "doc", "number", F.col("line").alias("a"))
    shared = cut(narrow.join(several.hint("shuffle_hash"), "key", "left_semi"))
    by_place = shared.filter("lead").groupBy("key", "place").agg(F.min("doc").alias("d"), F.min_by("number", "doc").alias("n"), F.min_by("a", "doc").alias("a"))
    by_key = by_place.groupBy("key").agg(F.collect_list(F.struct("place", "d", "n", "a")).alias("all"))
    joined = shared.join(by_key, "key")
    fits = F.filter("all", lambda x: ((x["place"] == F.col("place")) | (x["place"] == 0) | (F.col("place") == 0)) & (F.struct(x["d"], x["n"]) < F.struct("doc", "number")))
    earliest = F.array_min(F.transform(fits, lambda x: F.struct(x["d"].alias("d"), x["n"].alias("n"), x["a"].alias("a"))))
    pairs = joined.withColumn("e", earliest).filter("e is not null").select("doc", "a", F.col("e.d").alias("earlier_doc"), F.col("e.a").alias("earlier_a")).distinct()
    known = variants.filter("place = 0").select("doc", F.col("line").alias("a"), "words").distinct()
    both = pairs.join(known, ["doc", "a"]).join(known.toDF("earlier_doc", "earlier_a", "earlier"), ["earlier_doc", "earlier_a"])
    return map_batches(both.select("doc", "a", "words", "earlier"), _verified, "doc long, a long").distinct()


def _drop_lines(text_col: str, own: str, removed_col: str, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            given = batch.column(text_col).is_valid().to_pylist()
            texts, totals, removed = [], [], []
            for ok, doc, text, gone in zip(given, batch.column(own).to_pylist(), texts_of(batch.column(text_col)), batch.column(removed_col).to_pylist(), strict=True):
                lines, seen, kept = text.split(b"\n"), set(gone or ()), []
                for line in lines:
                    if doc is not None and (words := line.split()):
                        digest = _digest(words)[0]
                        if digest in seen:
                            continue
                        seen.add(digest)
                    kept.append(line)
                texts.append(b"\n".join(kept) if ok else None)
                totals.append(len(lines) if ok else 0)
                removed.append(len(lines) - len(kept))
            made = {text_col: pa.array(texts, pa.binary()).cast(pa.string()), "n_lines": pa.array(totals, pa.int64()), "n_removed": pa.array(removed, pa.int64())}
            yield pa.RecordBatch.from_arrays([made[c] if c in made else batch.column(c) for c in names], names)

    return run


def drop_repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = 5) -> DataFrame:
    """Removes lines that equal an earlier line or lie one word edit from it; see the module for the exact rule.

    Returns `docs` with the kept lines as its text, each as it was, and with n_lines and n_removed (which replace
    columns of these names).
    """
    texts = id_and_text(docs, id_col, text_col)
    lines = cut(map_batches(texts.filter("doc_id is not null"), _lines(min_words), LINES))
    sides = ("head", "tail", "head2", "tail2")
    first = cut(lines.groupBy("a", "b").agg(F.min("doc").alias("doc"), F.min_by("number", "doc").alias("number"), *[F.first(c).alias(c) for c in sides]))
    copies = lines.select("doc", "a", "b").join(first.select("a", "b", F.col("doc").alias("least")), ["a", "b"]).filter("doc > least").select("doc", "a")
    near = _near(texts, first, min_words)
    found = docs.drop("n_lines", "n_removed")
    own, other, removed = fresh(found, "line_doc", "line_doc_gone", "line_gone")
    gone = copies.union(near).groupBy(F.col("doc").alias(other)).agg(F.collect_set("a").alias(removed))
    found = found.withColumns({text_col: named(text_col).cast("string"), own: named(id_col).cast("long")})
    schema = with_columns(found.drop(own).schema, n_lines="long", n_removed="long")
    joined = found.join(gone.hint("shuffle_hash"), F.col(own) == F.col(other), "left").drop(other)
    return map_batches(joined, _drop_lines(text_col, own, removed, schema.names), schema)
