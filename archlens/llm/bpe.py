"""BPE encoding and decoding over one table of distinct words (operator 4).

Texts are split at ASCII white space, which no token spans. Spark splits all texts and counts the distinct words of the
corpus; those that repeat, the most frequent first and TABLE_WORDS at most, form the table. Each word of the table is
encoded once, in parallel, and the table, whose size is bounded, goes to every task, which joins its ids back by the
words' positions. What isn't in the table (words that stand once, very long ones, and the tail of a large corpus) is
encoded where it stands, once in a chunk of texts. Decoding joins ids with the pieces of the vocabulary, whose number
the file fixes.

To join the tail back from a table too, texts or token ids would have to travel by document; see the README for figures.

Defined results: a null text counts as empty; an empty text has no ids, and decodes to an empty text; an empty table
gives an empty result; repeated rows are encoded each; other columns are ignored.
"""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from archlens.llm.common import chunks, cut, id_and_text, map_batches, texts_of, with_columns

#: Words of the table at most, and bytes of a word in it: with their ids they take about 50 MB in a task.
TABLE_WORDS, WORD_BYTES = 250_000, 64
#: Steps of a doubling of the words' counts by which the most frequent are chosen.
STEPS = 8

Step = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


@lru_cache(maxsize=1)
def _tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


def _encoded(path: str, words: list[bytes]) -> list[bytes]:
    """The ids of each word as bytes of int32."""
    made = _tokenizer(path).encode_batch([w.decode() for w in words], add_special_tokens=False)
    return [np.array(m.ids, np.int32).tobytes() for m in made]


def word_table(texts: DataFrame, tokenizer: str) -> DataFrame:
    """word and ids (binary) of the most frequent words of `texts` (doc_id, text): TABLE_WORDS rows at most."""
    words = texts.select(F.explode(F.split("text", r"[\x09-\x0D\x20]+")).alias("word"))
    counted = words.groupBy("word").agg(F.count("*").alias("n")).filter(f"n > 1 and word <> '' and octet_length(word) <= {WORD_BYTES}")
    counted = cut(counted.withColumn("step", F.floor(F.log2("n") * STEPS).cast("int")))
    room, least = TABLE_WORDS, None
    for step, n in counted.groupBy("step").agg(F.count("*")).orderBy(F.desc("step")).collect():  # a few hundred rows
        room -= n
        if room < 0:
            break
        least = step
    chosen = counted.filter(F.col("step") >= least) if least is not None else counted.limit(0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("word"), pa.array(_encoded(tokenizer, texts_of(batch.column("word"))), pa.binary())], ["word", "ids"])

    return map_batches(chosen.select("word"), run, "word string, ids binary")


def _encoder(texts: DataFrame, tokenizer: str) -> Step:
    """Makes batches of doc_id and ids from batches of `texts` (doc_id, text)."""
    made = word_table(texts, tokenizer).toArrow().combine_chunks()
    columns = [c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in (made.column("word").cast(pa.binary()), made.column("ids").cast(pa.binary()))]
    table = texts.sparkSession.sparkContext.broadcast(tuple(columns))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, ids = table.value
        known = dict(zip(words.to_pylist(), ids.to_pylist(), strict=True))
        for batch in batches:
            every = texts_of(batch.column("text"))
            for a, b in chunks(every):
                split = [t.split() for t in every[a:b]]
                rest = [w for w in set().union(*split) if w not in known]
                own = dict(zip(rest, _encoded(tokenizer, rest), strict=True))
                placed = [b"".join([known[w] if w in known else own[w] for w in words]) for words in split]
                lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *(len(p) // 4 for p in placed)]), pa.int32()), pa.array(np.frombuffer(b"".join(placed), np.int32)))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, b - a), lists], ["doc_id", "ids"])

    return run


def encode(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and `ids`, the array of token ids of each whole text under the vocabulary file `tokenizer`."""
    texts = id_and_text(docs, id_col, text_col)
    return map_batches(texts, _encoder(texts, tokenizer), "doc_id long, ids array<int>")


def pieces(tokenizer: str) -> list[str]:
    """The vocabulary by id; its size is fixed by the file."""
    vocabulary = _tokenizer(tokenizer).get_vocab(with_added_tokens=True)
    out = [""] * (max(vocabulary.values()) + 1)
    for piece, k in vocabulary.items():
        out[k] = piece
    return out


def _decoder(tokenizer: str, ids_col: str) -> Step:
    """Adds `ids_text` and `decoded` to batches that hold ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_id = pieces(tokenizer)
        tables = [pa.array(by_id), pa.array([str(k) for k in range(len(by_id))])]
        for batch in batches:
            lists = batch.column(ids_col)
            if lists.null_count:
                lists = lists.fill_null([])
            flat = lists.flatten()
            offsets = pa.array(np.concatenate(([0], np.cumsum(pa.compute.list_value_length(lists).to_numpy(zero_copy_only=False)))), pa.int32())
            joined = [pa.compute.binary_join(pa.ListArray.from_arrays(offsets, t.take(flat)), " ") for t in tables]
            yield pa.RecordBatch.from_arrays([*batch.columns, joined[1], joined[0]], [*batch.schema.names, "ids_text", "decoded"])

    return run


def decode(encoded: DataFrame, tokenizer: str, ids_col: str = "ids") -> DataFrame:
    """Adds `ids_text` (decimal ids, joined by one space) and `decoded` (their pieces, joined by one space)."""
    names = encoded.columns
    step = _decoder(tokenizer, ids_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return step(batch.rename_columns(names) for batch in batches)

    return map_batches(encoded, run, with_columns(encoded.schema, ids_text="string", decoded="string"))


def digests(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Sizes and hashes of the encoding and of what it decodes to, by document."""
    texts = id_and_text(docs, id_col, text_col)
    encoded, decoded = _encoder(texts, tokenizer), _decoder(tokenizer, "ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:  # in one worker: two for each task would hold vocabularies and texts twice
        for batch in decoded(encoded(batches)):
            n = pa.compute.list_value_length(batch.column("ids")).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), n, batch.column("ids_text"), batch.column("decoded")], ["doc_id", "n_tokens", "ids_text", "decoded"])

    both = map_batches(texts, run, "doc_id long, n_tokens long, ids_text string, decoded string")
    return both.select("doc_id", "n_tokens", F.sha2("ids_text", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
