"""A place for each row in a global order, without putting all rows in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from archlens.sources.shared import stored


def ranked(df: DataFrame, *order: Column | str, name: str = "rank", start: int = 1) -> DataFrame:
    """`df` with the row's place in `order` as an integer, from `start`.

    Ranges of the order are sorted in their own partitions; a row's place is its place in its partition behind the rows of
    those before. Only the partitions' sizes reach the driver. Rows that are equal in `order` get different places.
    """
    rows = df.repartitionByRange(*order).sortWithinPartitions(*order)
    # Behind a sort the id counts a partition's rows from its number shifted by 33 bits.
    placed = stored(rows.withColumn("_at", F.monotonically_increasing_id()))
    part, row = F.shiftright("_at", 33).cast("int"), F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = {r.part: r["count"] for r in placed.groupBy(part.alias("part")).count().collect()}
    before, offsets = start, []
    for k in range(max(sizes, default=0) + 1):
        offsets.append(before)
        before += sizes.get(k, 0)
    offset = F.element_at(F.split(F.lit(",".join(map(str, offsets))), ","), part + 1).cast("long")
    return placed.select(*df.columns, (offset + row).cast("int").alias(name))
