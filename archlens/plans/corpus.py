"""Corpora files(path, text) as functions of the tables, and cases of one file for each row of a table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from archlens.sources.tree import typed


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def spread(files: DataFrame) -> DataFrame:
    """`files` over as many tasks as a shuffle has. Keys of small files become texts here, and all of a small file would be one task's."""
    return files.repartition(int(files.sparkSession.conf.get("spark.sql.shuffle.partitions")), "path")


#: Rows that a task makes texts of: a larger table takes more tasks, not larger ones.
TASK_ROWS = 1 << 19


def tasks_for(rows: DataFrame) -> int:
    """How many tasks rows are dealt to: as many as a shuffle has, and more where each would get more than TASK_ROWS."""
    return max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows.count() // TASK_ROWS))


def with_looked_up(rows: DataFrame, key: str, known: DataFrame, known_key: str, n: int, how: str = "inner") -> DataFrame:
    """Rows with the columns of `known` of their key. A table of at most TASK_ROWS rows goes to every task; of a larger one no
    task gets more than its share, as it and the rows are dealt to `n` tasks by their key, not to the few of a shuffle."""
    if known.count() <= TASK_ROWS:
        known = F.broadcast(known)
    else:
        rows, known = rows.repartition(n, key), known.repartition(n, known_key).hint("merge")
    return rows.join(known, F.col(key) == F.col(known_key), how)


def import_corpus(spark: SparkSession, folder: str, ext: str = ".py", line: str = "import m{n}", lead: str = "") -> DataFrame:
    """A file for each order, in its customer's region and nation, that imports the nation of each line's supplier."""
    nation, customer, supplier = (table(spark, folder, t) for t in ("nation", "customer", "supplier"))
    lineitem = table(spark, folder, "lineitem")
    n = tasks_for(lineitem)
    homes = with_looked_up(customer.select("c_custkey", "c_nationkey"), "c_nationkey", nation.select("n_nationkey", "n_regionkey"), "n_nationkey", n)
    home = with_looked_up(table(spark, folder, "orders"), "o_custkey", homes, "c_custkey", n).select("o_orderkey", "n_regionkey", "n_nationkey").repartition(n, "o_orderkey")
    made = F.replace(F.replace(F.lit(line), F.lit("{n}"), F.col("s_nationkey").cast("string")), F.lit("{r}"), F.col("n_regionkey").cast("string"))
    # Nations are looked up for each supplier, not for each line: there are few, and by their keys all lines would be a few tasks'.
    regions = nation.select(F.col("n_nationkey").alias("k"), F.col("n_regionkey").alias("s_region"))
    suppliers = with_looked_up(supplier.select("s_suppkey", "s_nationkey"), "s_nationkey", regions, "k", n, "left")
    lines = with_looked_up(lineitem, "l_suppkey", suppliers, "s_suppkey", n).select("l_orderkey", "l_linenumber", "s_nationkey", "s_region").repartition(n, "l_orderkey")
    joined = home.join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    target = F.replace(made, F.lit("{s}"), F.col("s_region").cast("string"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("l_linenumber").isNotNull(), F.struct("l_linenumber", target.alias("t"))))), lambda x: x["t"]), "\n")
    rows = joined.groupBy("o_orderkey", "n_regionkey", "n_nationkey").agg(text.alias("body"))
    path = F.concat(F.lit("svc"), "n_regionkey", F.lit("/src/m"), "n_nationkey", F.lit("/f"), "o_orderkey", F.lit(ext))
    top = F.replace(F.replace(F.lit(lead), F.lit("{n}"), F.col("n_nationkey").cast("string")), F.lit("{o}"), F.col("o_orderkey").cast("string"))
    return typed(rows.select(path.alias("path"), F.concat(top, "body", F.lit("\n")).alias("text")))


def http_corpus(spark: SparkSession, folder: str) -> DataFrame:
    """A route for each supplier and a call for each customer, in their regions, and a manifest for each region."""
    nation = table(spark, folder, "nation")
    supplier, customer = table(spark, folder, "supplier"), table(spark, folder, "customer")
    n = supplier.count()
    served = supplier.join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select(
        F.concat(F.lit("svc"), "n_regionkey", F.lit("/src/m"), "n_nationkey", F.lit("/s"), "s_suppkey", F.lit(".ts")).alias("path"),
        F.when(F.col("s_suppkey") % 2 == 0, F.concat(F.lit('router.get("/s/'), "s_suppkey", F.lit('/items", h)\n')))
        .otherwise(F.concat(F.lit('@Controller("s/'), "s_suppkey", F.lit('")\nclass S {\n  @Get("items") all() {}\n}\n'))).alias("text"))
    calls = customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select(
        F.concat(F.lit("svc"), "n_regionkey", F.lit("/src/m"), "n_nationkey", F.lit("/c"), "c_custkey", F.lit(".ts")).alias("path"),
        F.concat(F.lit("axios.post('/s/"), F.col("c_custkey") % (n + 3), F.lit("/items/"), "c_custkey", F.lit("')\n")).alias("text"))
    kind = F.when(F.col("r_regionkey") % 2 == 0, "react").otherwise("express")
    manifests = table(spark, folder, "region").select(F.concat(F.lit("svc"), "r_regionkey", F.lit("/package.json")).alias("path"), F.concat(F.lit('{"dependencies":{"'), kind, F.lit('":"1"}}\n')).alias("text"))
    return spread(typed(served.union(calls).union(manifests)))


EXTENSIONS = [".py", ".ts", ".go", ".ex", ".rb", ".java", ".md", ".json"]


def document_corpus(spark: SparkSession, folder: str) -> DataFrame:
    ext = F.get(F.array(*map(F.lit, EXTENSIONS)), (F.col("doc_id") % 8).cast("int"))
    path = F.concat("source", F.lit("/"), "lang", F.lit("/doc_"), "doc_id", ext)
    return typed(table(spark, folder, "documents").select(path.alias("path"), F.coalesce("text", F.lit("")).alias("text")))


def model_corpus(spark: SparkSession, folder: str) -> DataFrame:
    kinds = [(".py", "class {m}(Base):\n"), (".ts", "mongoose.model('{m}', s)\n"), (".rb", "class {m} < ApplicationRecord\n"), (".java", "@Entity\npublic class {m} {}\n")]
    k = (F.col("p_partkey") % 4).cast("int")
    ext, line = (F.get(F.array(*[F.lit(x[i]) for x in kinds]), k) for i in (0, 1))
    path = F.concat(F.lit("svc"), F.col("p_partkey") % 5, F.lit("/src/models/p"), "p_partkey", ext)
    return typed(table(spark, folder, "part").select(path.alias("path"), F.replace(line, F.lit("{m}"), F.concat(F.lit("M"), F.col("p_size").cast("string"))).alias("text")))


def package_corpus(spark: SparkSession, folder: str) -> DataFrame:
    """A manifest for each 200 parts."""
    part = table(spark, folder, "part").select(F.floor(F.col("p_partkey") / 200).alias("k"), (F.col("p_partkey") % 200).alias("j"), "p_size")
    version = F.when(F.col("p_size") % 3 == 0, "*").otherwise(F.concat(F.lit("^"), F.col("p_size").cast("string")))
    entry = F.struct("j", F.concat(F.lit('"pkg'), (13 * F.col("j") + F.col("k")) % 1000, F.lit('":"'), version, F.lit('"')).alias("t"))
    rows = part.groupBy("k").agg(F.array_join(F.transform(F.array_sort(F.collect_list(entry)), lambda x: x["t"]), ",").alias("body"))
    path = F.concat(F.lit("svc"), F.col("k") % 5, F.lit("/p"), "k", F.lit("/package.json"))
    return typed(rows.select(path.alias("path"), F.concat(F.lit('{"dependencies":{'), "body", F.lit("}}")).alias("text")))


def case_corpus(spark: SparkSession, folder: str, name: str, key: str, path: str, text: str) -> DataFrame:
    """A file for each row of a table; {k} in path and text is the row's key."""
    k = F.col(key).cast("string")
    rows = table(spark, folder, name)
    return typed(rows.select(F.replace(F.lit(path), F.lit("{k}"), k).alias("path"), F.replace(F.lit(text), F.lit("{k}"), k).alias("text")))
