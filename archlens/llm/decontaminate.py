"""Benchmark decontamination by a prefix-filtered set join (operator 8), in DataFrame functions throughout.

An item's windows are WINDOW consecutive words (all its words, if fewer). A text that contains a window contains each of
the window's shingles, at the same distances. So of shingles ordered by rarity over all documents the first is the whole
prefix that has to be joined: each window is looked up by its rarest shingle alone. The shingle's place in the window
gives the only place where the window can begin; it has to lie inside the text, and there the words themselves are
compared.

Documents' shingles pass a bit set inside their row, as large as the number of items' shingles asks for up to a bound.
Only stretches of passing shingles that are long enough for a window leave the row, with their words, so texts are
read once and never shuffled. Beyond the bound more stretches leave; the results stay the same.

Defined results: null and empty texts and items have no words; a document is judged by its own text even if its
doc_id is null or repeated; items with equal texts count each; an empty benchmark hits nothing; other columns are
ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from archlens.llm.common import cut, id_and_text
from archlens.llm.native import NOT_ALPHA, ascii_lower, filter_words, hits, shingle_hashes, words

WINDOW, SHINGLE = 13, 3


def _windows(items: DataFrame, window: int, shingle: int) -> DataFrame:
    """window_id, n (words), k (words of its shingles), text and hashes of each distinct window, and its items."""
    sized = items.withColumn("w", words(ascii_lower(F.col("text")), NOT_ALPHA)).withColumn("size", F.size("w")).filter("size > 0")
    sized = sized.withColumn("n", F.least("size", F.lit(window))).withColumn("k", F.least("size", F.lit(shingle)))
    sized = sized.withColumn("hashes", F.coalesce(*[F.when(F.col("k") == k, shingle_hashes("w", k)) for k in range(1, shingle + 1)]))
    each = sized.select("item_id", "n", "k", "w", "hashes", F.explode(F.sequence(F.lit(1), F.col("size") - F.col("n") + 1)).alias("start"))
    cells = each.select("item_id", "n", "k", F.array_join(F.slice("w", F.col("start"), F.col("n")), " ").alias("text"), F.slice("hashes", F.col("start"), F.col("n") - F.col("k") + 1).alias("hashes"))
    distinct = cells.groupBy("n", "k", "text").agg(F.first("hashes").alias("hashes"), F.collect_set("item_id").alias("owners"))
    return distinct.withColumn("window_id", F.monotonically_increasing_id())


def _stretches(k: int, least: int, bits: Column) -> Column:
    """Stretches of at least `least` neighbouring shingles of k words that pass the filter: place, hashes and words."""
    places = f"hits{k}"
    first = F.filter(places, lambda p, j: (j == 0) | (F.get(places, j - 1) != p - 1))
    last = F.filter(places, lambda p, j: (j == F.size(places) - 1) | (F.get(places, j + 1) != p + 1))
    spans = F.filter(F.zip_with(first, last, lambda a, b: F.struct(a.alias("at"), (b - a + 1).alias("n"))), lambda s: s["n"] >= least)
    return F.transform(spans, lambda s: F.struct(F.lit(k).alias("k"), s["at"].alias("at"), F.slice(f"h{k}", s["at"] + 1, s["n"]).alias("hashes"), F.slice("seen", s["at"] + 1, s["n"] + k - 1).alias("own")))


def _covered(spans: Column) -> Column:
    """Words inside the union of (from, to) spans."""
    start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))

    def step(acc: Column, x: Column) -> Column:
        return F.struct((acc["n"] + F.greatest(x["to"] - F.greatest(x["from"], acc["end"]), F.lit(0))).alias("n"), F.greatest(acc["end"], x["to"]).alias("end"))

    return F.aggregate(F.array_sort(spans), start, step, lambda acc: acc["n"])


def find_items(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, n_words, n_hit (words inside windows of items) and items (ids of the items found, sorted as strings).

    `benchmark` has item_id and text. Rows come back as often as they are in `docs`; `mark` tells texts apart.
    """
    items = cut(benchmark.select(F.monotonically_increasing_id().alias("item_id"), F.col("item_id").cast("string").alias("name"), F.col("text").cast("string").alias("text")))
    windows = cut(_windows(items, window, shingle))
    least = {r.k: r.least for r in windows.groupBy("k").agg(F.min(F.col("n") - F.col("k") + 1).alias("least")).collect()}  # a row for each size of shingle
    bits = filter_words(windows.select(F.explode("hashes").alias("h")).distinct())
    texts = id_and_text(docs, id_col, text_col).withColumn("seen", words(ascii_lower(F.col("text")), NOT_ALPHA))
    texts = texts.withColumns({f"h{k}": shingle_hashes("seen", k) for k in least})
    texts = texts.withColumns({f"hits{k}": hits(f"h{k}", bits) for k in least})
    none = F.array().cast("array<struct<k:int,at:int,hashes:array<bigint>,own:array<string>>>")
    found = cut(texts.select(F.monotonically_increasing_id().alias("row"), "doc_id", F.xxhash64("text").alias("mark"), F.size("seen").cast("long").alias("n_words"), F.concat(none, *[_stretches(k, n, bits) for k, n in least.items()]).alias("stretches")))

    placed = found.select("row", F.explode("stretches").alias("s")).select("row", "s.k", "s.at", "s.own", F.posexplode("s.hashes").alias("p", "h"))
    counts = placed.groupBy("h").agg(F.count("*").alias("found"))
    rated = windows.select("window_id", F.posexplode("hashes").alias("offset", "h")).join(counts, "h")
    # A window with a shingle that no text has is in no text: only windows with all of theirs are looked up.
    rarest = rated.groupBy("window_id").agg(F.min(F.struct("found", "h", "offset")).alias("a"), F.count("*").alias("known"))
    anchors = windows.join(rarest, "window_id").filter("known = size(hashes)").select("window_id", "n", "k", F.col("text").alias("wanted"), "a.h", "a.offset")

    # Only the words that a window around the shingle can reach go along with it.
    low = F.greatest(F.col("p") - (window - 1), F.lit(0))
    narrow = placed.select("row", "k", "at", "p", "h", low.alias("low"), F.slice("own", low + 1, 2 * window).alias("own"))
    start = F.col("p") - F.col("offset") - F.col("low")
    held = narrow.join(anchors, ["h", "k"]).withColumn("start", start).filter((F.col("start") >= 0) & (F.col("start") + F.col("n") <= F.size("own")))
    held = held.filter(F.array_join(F.slice("own", F.col("start") + 1, F.col("n")), " ") == F.col("wanted"))
    begin = F.col("at") + F.col("low") + F.col("start")
    verified = cut(held.select("row", "window_id", F.struct(begin.alias("from"), (begin + F.col("n")).alias("to")).alias("span")))

    n_hit = verified.groupBy("row").agg(_covered(F.collect_set("span")).cast("long").alias("n_hit"))
    owners = windows.select("window_id", F.explode("owners").alias("item_id")).join(items.select("item_id", F.coalesce("name", F.lit("")).alias("name")), "item_id")
    named = verified.select("row", "window_id").distinct().join(owners, "window_id").select("row", "item_id", "name").distinct()
    listed = named.groupBy("row").agg(F.array_sort(F.collect_list("name")).alias("items"))
    joined = found.select("row", "doc_id", "mark", "n_words").join(n_hit, "row", "left").join(listed, "row", "left")
    return joined.select("doc_id", "mark", "n_words", F.coalesce("n_hit", F.lit(0)).alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))


def is_contaminated() -> Column:
    """At least a twentieth of the words hit."""
    return (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))
