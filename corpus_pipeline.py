"""A pipeline over documents: quality, line deduplication, near duplicates, decontamination, token ids."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from archlens.llm import bpe, decontaminate, line_dedup, quality, simhash
from archlens.llm.common import columns_of, cut, fresh
from archlens.llm.queries import BPE, table


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality is likelier good than not, each row judged by its own text, source and lang.

    A null text is judged as an empty one; rows may repeat and ids be null; an empty table stays empty.
    """
    judged, score = quality.judged(docs, table(spark, sf_dir, "labels"), F.col("source"), F.col("lang"))
    return judged.filter(F.col(score) >= 0.5).select(*columns_of(docs))


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that an earlier line equals or nearly equals; all documents stay.

    Null texts stay null, rows of one doc_id are one document, rows without doc_id stay as they are; an empty table stays
    empty.
    """
    kept = line_dedup.drop_repeated_lines(docs.select("doc_id", "text", F.struct(*columns_of(docs)).alias("all")))
    own = {"text": F.col("text"), "n_chars": F.length("text").cast("long")}
    return kept.select(*[own.get(c, F.col("all").getField(c)).alias(c) for c in docs.columns])


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest doc_id, of each group of near duplicates: texts with 80 % of five-word shingles in common.

    Rows of one doc_id stay or go together; rows without doc_id stay; null and empty texts are copies of each other; an
    empty table stays empty.
    """
    (gone_id,) = fresh(docs, "gone_id")
    gone = simhash.similar(docs).filter("component_id <> doc_id").select(F.col("doc_id").alias(gone_id)).distinct()
    # The ids grow with the corpus: always by a shuffle of both sides.
    return docs.join(gone.hint("merge"), docs["doc_id"].cast("long") == F.col(gone_id), "left_anti").select(*columns_of(docs))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which benchmark items cover less than a twentieth; each text is judged by itself, whatever its doc_id.

    Null and empty texts stay; repeated rows go or stay alike; an empty table stays empty.
    """
    found = decontaminate.find_items(docs, table(spark, sf_dir, "benchmark"))
    its_id, its_mark = fresh(docs, "contaminated_id", "contaminated_mark")
    gone = found.filter(decontaminate.is_contaminated()).select(F.col("doc_id").alias(its_id), F.col("mark").alias(its_mark)).distinct()
    same = docs["doc_id"].cast("long").eqNullSafe(F.col(its_id)) & (F.xxhash64(docs["text"].cast("string")) == F.col(its_mark))
    return docs.join(gone.hint("merge"), same, "left_anti").select(*columns_of(docs))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and hashes of token ids and of what they decode to, one row for each row of `docs`.

    Null texts count as empty ones, which have no tokens; ids may be null or repeat; an empty table stays empty.
    """
    return bpe.digests(docs, BPE)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", keep_good),
    ("line_dedup", drop_lines),
    ("near_duplicates", keep_one_of_each),
    ("decontamination", drop_contaminated),
    ("bpe", encode),
]
#: SQL expresses neither the fitted classifier nor the tokenizer; tests compare each stage with a plain version in Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))  # not deleted here: Spark may still read a stage's input for a lost executor
    return STAGES[-1][1](spark, docs, sf_dir)
