"""What the operators share: tables cut off from their lineage, Arrow batches, and batches' texts."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from archlens.sources.shared import shared_folder

#: Bytes of text that a task works on at once.
CHUNK_BYTES = 1 << 19
#: Rows of an Arrow batch: long texts shall not add up to gigabytes in a Python worker.
BATCH_ROWS = 400
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def _path(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def cut(df: DataFrame, *used: DataFrame) -> DataFrame:
    """`df` written to the shared folder and read again: later jobs neither recompute it nor need the executors that made it.

    `used`: results of earlier cuts that nothing needs any more; they are deleted. The rest goes when the JVM ends.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/llm-{uuid.uuid4().hex}"
    df.write.parquet(path)
    where, files = _path(spark, path)
    files.deleteOnExit(where)
    for old in used:
        gone, files = _path(spark, old.__dict__["_cut_path"])
        files.delete(gone, True)
    out = spark.read.schema(df.schema).parquet(path)
    out.__dict__["_cut_path"] = path
    return out


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def map_batches(df: DataFrame, function: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | StructType) -> DataFrame:
    """mapInArrow in batches of at most BATCH_ROWS rows, also of columns with dots in their names.

    Spark reads the size when the plan runs, so it stays set in the session; a size that the session has set lower is
    left as it is.
    """
    conf = df.sparkSession.conf
    if not 0 < int(conf.get(_BATCH, "10000")) <= BATCH_ROWS:
        conf.set(_BATCH, str(BATCH_ROWS))
    names = df.columns
    if not any("." in n or "`" in n for n in names):
        return df.mapInArrow(function, schema)

    def renamed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return function(batch.rename_columns(names) for batch in batches)

    return df.toDF(*[f"c{k}" for k in range(len(names))]).mapInArrow(renamed, schema)


def with_columns(schema: StructType, **types: str) -> StructType:
    """The schema with further columns."""
    out = StructType(list(schema.fields))
    for name, kind in types.items():
        out = out.add(name, kind)
    return out


def texts_of(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column; null counts as empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def chunks(texts: list[bytes], limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of `texts` of about `limit` bytes, at least one text each."""
    start = size = 0
    for i, text in enumerate(texts):
        if size and size + len(text) > limit:
            yield start, i
            start, size = i, 0
        size += len(text) + 1
    if start < len(texts):
        yield start, len(texts)


def id_and_text(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The two columns an operator reads, under fixed names, whatever else the table holds."""
    return docs.select(named(id_col).cast("long").alias("doc_id"), named(text_col).cast("string").alias("text"))


def quoted(column: str) -> str:
    return "`" + column.replace("`", "``") + "`"


def named(column: str) -> Column:
    """A column by its name, also one with dots in it."""
    return F.col(quoted(column))


def columns_of(df: DataFrame) -> list[Column]:
    return [named(c) for c in df.columns]


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores as keep it apart from the columns of `df`."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        out.append(name)
    return out
