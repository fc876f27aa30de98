"""Tables in a folder that the driver and all executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. In local mode (tests) an unset one becomes a temporary folder that goes with
    this process; on a cluster it has to be set, as a folder of one machine would lose what the others write."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="spark-checkpoint-")
        atexit.register(shutil.rmtree, root, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def _file_system(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def new_folder(spark: SparkSession, kind: str = "facts") -> str:
    """The name of a folder that goes when the JVM ends."""
    path = f"{shared_folder(spark)}/{kind}-{uuid.uuid4().hex}"
    where, files = _file_system(spark, path)
    files.deleteOnExit(where)
    return path


def stored(df: DataFrame, *used: DataFrame) -> DataFrame:
    """`df` written once and read by whatever follows, so that texts are scanned once however many results use their facts.

    It goes when the JVM ends. `used`: stored tables that nothing needs any more; they go at once.
    """
    spark = df.sparkSession
    path = new_folder(spark)
    df.write.parquet(path)
    for old in used:
        where, files = _file_system(spark, old.__dict__["_stored_path"])
        files.delete(where, True)
    out = spark.read.schema(df.schema).parquet(path)
    out.__dict__["_stored_path"] = path
    return out
