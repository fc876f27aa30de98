"""A source tree as the relation files(path, text).

Spark's own file sources skip names that begin with "_" or "." and empty files, which matter here. So the tree is listed by tasks,
one round for each level of directories: the driver holds no list of files, only whether there is a next level. What is
listed (path, size) is a table that path rules work on without reading a file; `read_files` reads the contents of any part of it,
whole or only their beginnings. The tree must be on a file system that all executors mount. Corpora that are
tables of (path, text) already need no source.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from archlens.functions import dims
from archlens.functions.text import count_lines, language
from archlens.sources.shared import new_folder, stored

#: Bytes of contents that a task hands on at once, and that it reads in all.
BATCH_BYTES, TASK_BYTES = 8 << 20, 64 << 20


def list_tree(spark: SparkSession, root: str) -> DataFrame:
    """path and size of all files below `root`, listed by tasks, level by level.

    Links, directories that are never scanned and hidden ones but .github are left out; a directory that can't be read is empty.
    """

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for folder in batch.column("path").to_pylist():
                rows = []
                try:
                    with os.scandir(os.path.join(root, folder)) as entries:
                        for e in entries:
                            path = f"{folder}/{e.name}" if folder else e.name
                            if e.is_symlink():
                                continue
                            if e.is_dir():
                                if e.name not in dims.SKIP_DIRS and (e.name[0] != "." or e.name == ".github"):
                                    rows.append((path, None))
                            elif e.is_file():
                                rows.append((path, e.stat().st_size))
                except OSError:
                    continue
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int64())], ["path", "size"])

    out, level = new_folder(spark, "tree"), spark.range(1).select(F.lit("").alias("path"))
    tasks = spark.sparkContext.defaultParallelism
    while True:
        found = stored(level.repartition(tasks).mapInArrow(listed, "path string, size long"))
        files, level = found.filter("size is not null"), found.filter("size is null").select("path")
        files.write.mode("append").parquet(out)
        if level.isEmpty():
            return spark.read.schema(found.schema).parquet(out)


def read_files(files: DataFrame, root: str, head: int | None = None) -> DataFrame:
    """`files` (path, size, ...) with content: their bytes, the first `head` of them if given; null for what can't be read."""
    most = F.least("size", F.lit(head)) if head is not None else F.col("size")
    total = files.agg(F.sum(most)).first()[0] or 0
    names = files.columns
    fields = {f.name: f for f in files.schema.fields}

    def contents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held, start, size = [], 0, 0
            for k, path in enumerate(batch.column("path").to_pylist()):
                try:
                    with open(os.path.join(root, path), "rb") as f:
                        held.append(f.read(-1 if head is None else head))
                except OSError:
                    held.append(None)
                size += len(held[-1] or b"")
                if size >= BATCH_BYTES or k == batch.num_rows - 1:
                    part = batch.slice(start, len(held))
                    yield pa.RecordBatch.from_arrays([*part.columns, pa.array(held, pa.binary())], [*names, "content"])
                    held, start, size = [], k + 1, 0

    dealt = files.repartition(max(1, -(-total // TASK_BYTES)), "path")
    schema = ", ".join(f"`{n}` {fields[n].dataType.simpleString()}" for n in names)
    return dealt.mapInArrow(contents, f"{schema}, content binary")


def read_tree(spark: SparkSession, root: str, where: Column | None = None, head: int | None = None, binaries: bool = False) -> DataFrame:
    """files(path, text, loc) of the text files below `root` for which `where` (over path and size) holds.

    head: only so many bytes of each file. Binary files (a zero byte in the first 1024, or unreadable) are left out, or come with a null
    text and loc if `binaries`. Lines are counted as the file has them; in the text a carriage return ends a line too.
    """
    listed = list_tree(spark, root)
    raw = read_files(listed if where is None else listed.filter(where), root, head)
    is_text = F.coalesce(F.position(F.lit(b"\0"), F.substring("content", 1, 1024)) == 0, F.lit(False))
    own = F.when(is_text, F.expr("make_valid_utf8(cast(content as string))"))
    rows = raw.select("path", own.alias("text"))
    rows = rows if binaries else rows.filter("text is not null")
    return rows.select("path", F.regexp_replace("text", "\r\n?", "\n").alias("text"), count_lines(F.col("text")).alias("loc"))


def typed(files: DataFrame) -> DataFrame:
    """files with lang and loc (kept if they have it); files whose name or directory is never scanned are dropped."""
    parts = F.split("path", "/")
    skipped = F.exists(parts, lambda p: p.isin(dims.SKIP_DIRS)) | F.exists(F.slice(parts, F.lit(1), F.size(parts) - 1), lambda p: F.startswith(p, F.lit(".")) & (p != ".github"))
    loc = F.col("loc") if "loc" in files.columns else count_lines(F.col("text"))
    return files.filter(~skipped).withColumns({"lang": language(F.col("path")), "loc": loc})
