"""Counts by language, directory and package; graph measures; budgeted selection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from archlens.functions import dims
from archlens.functions.text import ancestors
from archlens.sources.shared import stored

#: Candidates of a budget that one round looks at.
RUN = 10_000


def languages(files: DataFrame) -> DataFrame:
    """name, files, loc of recognised files."""
    return files.filter("lang is not null").groupBy(F.col("lang").alias("name")).agg(F.count("*").alias("files"), F.sum("loc").alias("loc"))


#: A bit of its own for each language, so that sets of languages merge by bit_or.
LANGUAGE_BITS = {name: 1 << k for k, name in enumerate(sorted({*dims.LANGUAGES, *dims.NAMED_FILES.values()}))}


def language_bits(lang: Column) -> Column:
    """The bit of a language; 0 for none."""
    pairs = [F.lit(x) for name, bit in LANGUAGE_BITS.items() for x in (name, bit)]
    return F.coalesce(F.create_map(*pairs)[lang].cast("long"), F.lit(0).cast("long"))


def languages_of(bits: Column) -> Column:
    """The names of a set of languages, sorted."""
    names = F.array(*[F.struct(F.lit(name).alias("name"), F.lit(bit).cast("long").alias("bit")) for name, bit in LANGUAGE_BITS.items()])
    return F.transform(F.filter(names, lambda x: bits.bitwiseAND(x["bit"]) != 0), lambda x: x["name"])


def directories(files: DataFrame) -> DataFrame:
    """dir, files, loc, languages (sorted) of every directory with all below it, and of the root (dir "").

    Files without text are binary: they count as files without lines or language. Files are summed by their own directory first;
    only these sums go up to the directories above.
    """
    here = F.regexp_extract("path", "^(.*)/[^/]*$", 1)
    text = F.col("loc").isNotNull()
    sums = [F.sum("files").alias("files"), F.sum("loc").alias("loc"), F.bit_or("bits").alias("bits")]
    own = files.select(here.alias("dir"), F.lit(1).alias("files"), F.coalesce("loc", F.lit(0)).alias("loc"), F.when(text, language_bits(F.col("lang"))).otherwise(0).alias("bits")).groupBy("dir").agg(*sums)
    up = F.array_union(F.array(F.lit("")), ancestors(F.col("dir")))
    return own.select(F.explode(up).alias("dir"), "files", "loc", "bits").groupBy("dir").agg(*sums).select("dir", "files", "loc", languages_of(F.col("bits")).alias("languages"))


def primary_language(files: DataFrame, by: str) -> DataFrame:
    """The language with most lines of each group; ties go to the smaller name."""
    sums = files.filter("lang is not null").groupBy(by, "lang").agg(F.sum("loc").alias("loc"))
    return sums.withColumn("rank", F.row_number().over(W.partitionBy(by).orderBy(F.desc("loc"), "lang"))).filter("rank = 1").select(by, F.col("lang").alias("primary_language"), "loc")


def degrees(edges: DataFrame) -> DataFrame:
    """node, fan_out, fan_in by number of edges."""
    both = edges.select(F.col("source").alias("node"), F.lit(1).alias("o"), F.lit(0).alias("i")).union(edges.select("target", F.lit(0), F.lit(1)))
    return both.groupBy("node").agg(F.sum("o").alias("fan_out"), F.sum("i").alias("fan_in"))


def is_chain(tiered: DataFrame, edges: DataFrame) -> DataFrame:
    """linear: one row that says whether the graph is a single chain, with one edge less than nodes and one node in each tier."""
    pairs = edges.select("source", "target").distinct().agg(F.count("*")).scalar()
    return tiered.agg(((F.count("*") == F.count_distinct("tier")) & (pairs == F.count("*") - 1)).alias("linear"))


def budgeted(candidates: DataFrame, budget: int = 200_000, limit: int = 6000) -> DataFrame:
    """The candidates (ord, path, text) that a byte budget takes in order: one that doesn't fit is passed over, smaller
    ones after it may still fit, the first always does. Texts count with their first `limit` characters.

    Each round takes the longest run that fits, by running sums first over parts and then inside the part where the budget
    ends, and goes on behind it with the candidates no larger than what is left; what is left gets smaller each time.
    """
    sized = stored(candidates.select("ord", "path", F.octet_length(F.substring("text", 1, limit)).cast("long").alias("bytes")))
    first = sized.agg(F.min_by(F.struct("ord", "bytes"), "ord").alias("x")).filter("x is not null").select("x.*").first()
    if first is None:
        return sized
    taken, rest, left = F.col("ord") == first.ord, F.col("ord") > first.ord, budget - first.bytes
    while left > 0:
        open_ = sized.filter(rest & (F.col("bytes") <= left))
        # At most this many candidates of more than no bytes fit, so only the first of them can end the run.
        ahead = W.orderBy("ord").rowsBetween(W.unboundedPreceding, W.currentRow)
        window = open_.filter("bytes > 0").orderBy("ord").limit(RUN)
        run = window.withColumn("sum", F.sum("bytes").over(ahead)).agg(
            F.max(F.when(F.col("sum") <= left, F.struct("ord", "sum"))).alias("last"), F.min(F.when(F.col("sum") > left, F.col("ord"))).alias("over"), F.max("ord").alias("end")).first()
        if run.end is None:
            taken = taken | (rest & (F.col("bytes") == 0))
            break
        stop = run.over - 1 if run.over is not None else run.end
        taken = taken | (rest & (F.col("bytes") <= left) & (F.col("ord") <= stop))
        if run.last is not None:
            left -= run.last["sum"]
        rest = F.col("ord") > stop
    else:  # nothing is left, or less than nothing if the first alone is larger
        taken = taken | (rest & (F.col("bytes") == 0)) if left == 0 else taken
    return sized.filter(taken)
