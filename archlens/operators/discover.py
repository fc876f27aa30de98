"""Services and modules of a tree, from its paths alone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from archlens.functions import dims
from archlens.operators.extract import below
from archlens.sources.shared import stored


def place(files: DataFrame, root: str | None = None) -> DataFrame:
    """`files` with service and module: a first-level directory with a manifest or a source root in it is a service;
    its modules are the directories below its source roots (descending through at most two more), or its own.

    Directories that are no services are modules without a service. Without any service and with the tree's name `root`, the tree
    itself is the only service (see `service_kinds`): its modules are the directories below its source roots, or its own directories, and
    no file is said to be of a service, so such a tree has no URL prefixes and no edges between services. The test of a directory is a
    grouped aggregate over paths, stored and joined back by directory. As its size is known then, texts are not shuffled for it unless
    the tree has many directories; shuffled by a few, they would be in as many tasks however large the tree.
    """
    roots = "|".join(dims.SOURCE_ROOTS)
    top = F.when(F.contains("path", F.lit("/")), F.substring_index("path", "/", 1))
    rest = F.expr("substring(path, length(substring_index(path, '/', 1)) + 2)")
    signs = files.select(top.alias("top"), rest.alias("rest")).filter("top is not null").groupBy("top").agg(
        F.bool_or(F.col("rest").isin(dims.SERVICE_MANIFESTS)).alias("manifest"), F.bool_or(F.col("rest").rlike(f"^({roots})/")).alias("rooted"))
    signs = stored(signs)
    below_root = F.regexp_extract("path", rf"^([^/]+/(?:{roots})(?:/(?:{roots})(?=/)){{0,2}}+/[^/.][^/]*)/", 1)
    below_top = F.regexp_extract("path", r"^([^/]+/[^/.][^/]*)/", 1)
    service = F.when(F.col("manifest") | F.col("rooted"), F.col("top"))
    module = F.when(service.isNull(), F.col("top")).when(F.col("rooted"), below_root).otherwise(below_top)
    placed = files.withColumn("top", top).join(signs, "top", "left").select(*files.columns, service.alias("service"), F.nullif(module, F.lit("")).alias("module"))
    if root is None or not signs.filter("manifest or rooted").isEmpty():
        return placed
    of_root = F.nullif(F.regexp_extract("path", rf"^((?:{roots})(?:/(?:{roots})(?=/)){{0,2}}+/[^/.][^/]*)/", 1), F.lit(""))
    seeded = not files.filter(F.col("path").rlike(f"^({roots})/")).isEmpty()
    own = of_root if seeded else F.nullif(F.regexp_extract("path", r"^([^/.][^/]*)/", 1), F.lit(""))
    return placed.withColumns({"service": F.lit(None).cast("string"), "module": own})


def service_kinds(files: DataFrame, root: str | None = None) -> DataFrame:
    """service, kind and stack (sorted hints) from each service's first manifest; hints are plain substrings.

    root: the name of a tree that is one service itself, as its placed files are of none.
    """
    if root is not None:
        files = files.withColumn("service", F.coalesce("service", F.lit(root)))
    order = F.create_map(*[x for k, m in enumerate(dims.SERVICE_MANIFESTS) for x in (F.lit(m), F.lit(k))])
    own = files.filter("service is not null").groupBy("service").agg(
        F.min_by(F.when(~F.contains(below("service"), F.lit("/")), F.lower(F.substring("text", 1, 65536))), order[F.substring_index("path", "/", -1)]).alias("manifest"))
    hits = lambda hints: F.filter(F.array(*map(F.lit, sorted(hints))), lambda h: F.contains(F.col("manifest"), h))
    front, back = hits(dims.FRONTEND_HINTS), hits(dims.BACKEND_HINTS)
    kind = F.when(F.col("manifest").isNull(), "unknown").when(F.size(back) > 0, "backend").when(F.size(front) > 0, "frontend").otherwise("library")
    return own.select("service", kind.alias("kind"), F.coalesce(F.array_sort(F.array_union(front, back)), F.array().cast("array<string>")).alias("stack"))
