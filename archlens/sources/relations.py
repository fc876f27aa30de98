"""Several relations written as one result that is there whole or not at all, and read again."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MANIFEST = "relations.json"


def _path(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def write_relations(relations: dict[str, DataFrame], folder: str) -> None:
    """Writes each relation below a new folder inside `folder`; the manifest that names them is put in place last, in one step.

    A reader sees the relations of the manifest that is there, the earlier ones until then. An interrupted write leaves no trace but a
    folder that no manifest names; the one before stays. Folders that the new manifest doesn't name are removed by `vacuum`.
    """
    spark = next(iter(relations.values())).sparkSession
    run = f"run-{uuid.uuid4().hex}"
    listed = []
    for name, df in relations.items():
        df.write.parquet(f"{folder}/{run}/{name}")
        listed.append({"name": name, "path": f"{run}/{name}", "schema": df.schema.jsonValue()})
    said = json.dumps({"version": 1, "relations": listed}, sort_keys=True)
    staged, files = _path(spark, f"{folder}/{run}/{MANIFEST}")
    out = files.create(staged, True)
    try:
        out.write(bytearray(said.encode()))
    finally:
        out.close()
    final, _ = _path(spark, f"{folder}/{MANIFEST}")
    options = spark.sparkContext._jvm.org.apache.hadoop.fs.Options.Rename
    array = spark.sparkContext._gateway.new_array(options, 1)
    array[0] = options.OVERWRITE
    context = spark.sparkContext._jvm.org.apache.hadoop.fs.FileContext.getFileContext(final.toUri(), spark.sparkContext._jsc.hadoopConfiguration()) if final.toUri().getScheme() else spark.sparkContext._jvm.org.apache.hadoop.fs.FileContext.getFileContext(spark.sparkContext._jsc.hadoopConfiguration())
    context.rename(staged, final, array)  # atomic where the file system's rename is


def _manifest(spark: SparkSession, folder: str) -> dict:
    return json.loads(spark.read.text(f"{folder}/{MANIFEST}", wholetext=True).first().value)


def read_relations(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """The relations that the manifest names, by name, with the schemas they were written with."""
    from pyspark.sql.types import StructType

    return {r["name"]: spark.read.schema(StructType.fromJson(r["schema"])).parquet(f"{folder}/{r['path']}") for r in _manifest(spark, folder)["relations"]}


def vacuum(spark: SparkSession, folder: str) -> None:
    """Removes runs that the manifest doesn't name; not while anything still reads or writes them."""
    named = {r["path"].split("/")[0] for r in _manifest(spark, folder)["relations"]}
    where, files = _path(spark, folder)
    for status in files.listStatus(where):
        if status.getPath().getName().startswith("run-") and status.getPath().getName() not in named:
            files.delete(status.getPath(), True)


def sizes(relations: dict[str, DataFrame]) -> DataFrame:
    """relation and rows of each, in one table."""
    parts = [df.agg(F.count("*").alias("rows")).select(F.lit(name).alias("relation"), "rows") for name, df in relations.items()]
    out = parts[0]
    for part in parts[1:]:
        out = out.union(part)
    return out
