"""Which of the rows that share a key came first: the exchange behind substring deduplication.

A row is (key, part, check, doc). Two answers go back to documents:

later      a document with a smaller id has a row of the same key, part and check
contested  the row is the first of its key, part and check, and its key also has other parts

Spark groups the rows. Before that, each task settles what it can by itself, as a map-side combine does: of the rows with
one key, part and check only the first is sent, the others are answers already. Of a key with several parts in a task only a
notice goes by the key, and its rows by key and part. So a key or a part that a third of all documents hold reaches
its partition as a few rows from each task, and no row is dropped. Rows travel as arrays by bucket of their keys,
since a row of Spark's own for each of them would double what is shuffled.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from archlens.llm.common import map_batches, partitions
from archlens.llm.words import U, mix

#: Rows that a task gathers before it settles and sends them.
FLUSH_ROWS = 1 << 18
#: Marks of a row: nothing known, its key is known to be contested, only a notice that its key is, an answer.
OPEN, CONTESTED, NOTICE, LATER = 0, 1, 2, 3
SENT = "bucket int, key array<long>, part array<long>, check array<long>, doc array<long>, mark array<tinyint>"
_KINDS = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int8())


def _starts(*columns: np.ndarray) -> np.ndarray:
    """Where sorted rows differ from the row before."""
    new = np.ones(len(columns[0]), bool)
    if len(new):
        new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    return new


def _send(columns: list[np.ndarray], to: np.ndarray, buckets: int) -> Iterator[pa.RecordBatch]:
    bucket = (to % U(buckets)).astype(np.int32)
    order = np.argsort(bucket, kind="stable")
    bucket = bucket[order]
    edge = [*np.flatnonzero(_starts(bucket)).tolist(), len(bucket)]
    if len(bucket):
        lists = [pa.ListArray.from_arrays(pa.array(edge, pa.int32()), pa.array(c[order].view(np.int64) if c.dtype == U else c[order], k)) for c, k in zip(columns, _KINDS, strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(bucket[edge[:-1]]), *lists], ["bucket", "key", "part", "check", "doc", "mark"])


def _combine(rows: list[tuple], buckets: int, contested: bool) -> Iterator[pa.RecordBatch]:
    """Sends a task's rows: the first of each key, part and check, and answers for the others."""
    key, part, check, doc = (np.concatenate(c) for c in zip(*rows, strict=True))
    order = np.lexsort((doc, check, part, key))
    key, part, check, doc = key[order], part[order], check[order], doc[order]
    same = _starts(key, part, check)
    late = ~same
    lead = np.flatnonzero(same)[np.cumsum(same) - 1]
    late &= doc != doc[lead]  # rows of one document are never later than each other
    once = late & _starts(key, part, check, doc)
    yield from _send([key[once], part[once], check[once], doc[once], np.full(once.sum(), LATER, np.int8)], mix(doc[once].astype(U)), buckets)
    key, part, check, doc = key[same], part[same], check[same], doc[same]
    mark, to = np.zeros(len(key), np.int8), mix(key)
    if contested and len(key):
        new = _starts(key)
        many = np.bincount(np.cumsum(new) - 1)[np.cumsum(new) - 1] > 1
        notice = many & new
        to = np.concatenate((np.where(many, mix(key ^ mix(part)), to), to[notice]))
        mark = np.concatenate((np.where(many, CONTESTED, OPEN), np.full(notice.sum(), NOTICE))).astype(np.int8)
        key, part, check, doc = (np.concatenate((c, c[notice])) for c in (key, part, check, doc))
    yield from _send([key, part, check, doc, mark], to, buckets)


def settle(df: DataFrame, rows_of: Callable[[pa.RecordBatch], Iterator[tuple]], *, contested: bool = False) -> DataFrame:
    """Answers to the rows (key, part, check, doc) that `rows_of` makes of each Arrow batch of `df`: doc_id with the parts
    of its later rows and, if asked for, of its contested ones."""
    n = partitions(df.sparkSession)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, count = [], 0
        for batch in batches:
            for rows in rows_of(batch):
                held.append(rows)
                count += len(rows[0])
                if count >= FLUSH_ROWS:
                    yield from _combine(held, 4 * n, contested)
                    held, count = [], 0
        if held:
            yield from _combine(held, 4 * n, contested)

    sent = map_batches(df, send, SENT).repartition(n, "bucket")
    rows = sent.select("bucket", F.explode(F.arrays_zip("key", "part", "check", "doc", "mark")).alias("x")).select("bucket", "x.*")
    # Partitioned by bucket already: both windows sort, and neither shuffles.
    same = Window.partitionBy("key", "part", "check", "bucket")
    first = F.min(F.when(F.col("mark") < NOTICE, F.col("doc"))).over(same)
    later = (F.col("mark") == LATER) | ((F.col("mark") < NOTICE) & (F.col("doc") > F.col("first")))
    found = rows.withColumn("first", first).withColumn("later", later)
    if contested:
        of_key = Window.partitionBy("key", "bucket")
        ahead = F.when((F.col("mark") < NOTICE) & ~F.col("later"), F.struct("part", "check"))
        found = found.withColumn("many", (F.max(F.when(F.col("mark") < LATER, F.col("mark"))).over(of_key) > OPEN) | (F.min(ahead).over(of_key) != F.max(ahead).over(of_key)))
        found = found.filter(F.col("later") | (F.col("many") & (F.col("mark") < NOTICE)))
        return found.groupBy(F.col("doc").alias("doc_id")).agg(F.collect_list(F.when(F.col("later"), F.col("part"))).alias("later"), F.collect_list(F.when(~F.col("later"), F.col("part"))).alias("contested"))
    return found.filter("later").groupBy(F.col("doc").alias("doc_id")).agg(F.collect_list("part").alias("later"))
