"""Extension: counts over a stream of changed files (Structured Streaming)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from archlens.sources.tree import typed


def language_counts(changes: DataFrame, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """changes(path, text, ts) -> files and lines by language and event-time window; rows later than `late` are left out."""
    known = typed(changes.withWatermark("ts", late)).filter("lang is not null")
    return known.groupBy(F.window("ts", window), "lang").agg(F.count("*").alias("files"), F.sum("loc").alias("loc"))
