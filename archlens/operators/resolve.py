"""Edges between modules, services and stores."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from archlens.functions.text import ancestors
from archlens.operators.extract import counted, http_facts, import_statements, inner_path
from archlens.sources.shared import stored

#: Names that are sent to every task; more are dealt to tasks with the definitions, as many as these need.
TASK_NAMES = 1 << 18


def module_table(files: DataFrame) -> DataFrame:
    """module, service, name, files, loc; ties in size go to the smaller path."""
    own = files.filter("module is not null").groupBy("module").agg(F.first("service").alias("service"), F.count("*").alias("files"), F.sum("loc").alias("loc"))
    return own.withColumn("name", F.substring_index("module", "/", -1))


@dataclass
class Graph:
    """edges (source, target, weight) between different modules, and modules (as `module_table` has them)."""

    edges: DataFrame
    modules: DataFrame


def _defined(found: DataFrame, names: DataFrame) -> DataFrame:
    """target and to (the module of the smallest path) of the Elixir definitions of `names`; the others are no edge's end.

    There may be a definition in each file, so they are neither grouped nor sorted before those that no name asks for are left out.
    """
    defs = found.filter("module is not null and size(defs) > 0").select("module", "path", F.explode("defs").alias("target"))
    if names.count() <= TASK_NAMES:
        names = F.broadcast(names)
    else:
        n = max(int(found.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-defs.count() // TASK_NAMES))
        defs, names = defs.repartition(n, "target"), names.repartition(n, "target").hint("merge")
    return defs.join(names, "target", "left_semi").groupBy("target").agg(F.min_by("module", "path").alias("to"))


def import_edges(files: DataFrame, packages: DataFrame | None = None, go_prefix: str | None = None) -> DataFrame:
    """source, target, weight: import statements between different modules."""
    return import_graph(files, packages, go_prefix).edges


def import_graph(files: DataFrame, packages: DataFrame | None = None, go_prefix: str | None = None) -> Graph:
    """Modules and the import statements between them, from one scan of texts.

    packages: (name, module) of workspace packages, for bare specifiers; else what the modules' package.json files say.
    go_prefix: the Go module prefix of all services; else that of the service's go.mod, or the root's.
    All lookups (names, paths, packages, definitions) are one table, met by one equi-join of the distinct facts.
    """
    statements = stored(import_statements(files))
    facts = stored(counted(statements, F.col("stated")))
    own = facts.filter("module is not null")
    modules = own.filter("kind = 'file'").groupBy("module").agg(F.first("service").alias("service"), F.sum("n").alias("files"), F.sum("loc").alias("loc")).withColumn("name", F.substring_index("module", "/", -1))
    scope = F.coalesce(F.concat(F.lit("="), "service"), F.lit(""))
    order = F.struct(-F.coalesce("loc", F.lit(0)), "module")
    entry = lambda df, kind, scope, key, to: df.select(F.lit(kind).alias("kind"), scope.alias("scope"), key.alias("key"), to.alias("to"))
    names = modules.groupBy(scope.alias("s"), "name").agg(F.min_by("module", order).alias("to"))
    if packages is None:
        stated = own.filter("kind = 'pkgname'").select("module", F.col("target").alias("package")).join(modules.select("module", "loc"), "module")
        packages = stated.groupBy(F.col("package").alias("name")).agg(F.min_by("module", order).alias("module"))
    defined = _defined(statements, own.filter("kind = 'ref'").select("target").distinct())
    none = F.lit("")
    known = (
        entry(names, "name", F.col("s"), F.col("name"), F.col("to")).union(entry(modules, "path", none, F.col("module"), F.col("module")))
        .union(entry(packages, "package", none, F.col("name"), F.col("module"))).union(entry(defined, "ref", none, F.col("target"), F.col("to"))))
    found = own.filter("kind in ('name', 'path', 'package', 'ref', 'go')")
    if go_prefix is None:
        prefixes = facts.filter("kind = 'gomod' and target <> ''").groupBy("service").agg(F.min_by("target", "path").alias("prefix"))
        root = prefixes.filter("service is null").select(F.col("prefix").alias("root_prefix"))
        found = found.join(prefixes.filter("service is not null"), "service", "left").withColumn("prefix", F.coalesce("prefix", root.scalar()))
    else:
        found = found.withColumn("prefix", F.lit(go_prefix))
    go = F.col("kind") == "go"
    wanted = F.when(go, inner_path(F.col("target"), F.col("prefix"))).otherwise(F.col("target"))
    found = found.select("module", "service", "n", "kind", "target", F.when(go, "path").otherwise(F.col("kind")).alias("way"), wanted.alias("wanted"))
    paths = F.transform(ancestors(F.col("wanted")), lambda p, i: F.struct(i.alias("depth"), none.alias("scope"), p.alias("key")))
    single = F.array(F.struct(F.lit(0).alias("depth"), F.when(F.col("way") == "name", scope).otherwise(none).alias("scope"), F.col("wanted").alias("key")))
    each = F.explode(F.when(F.col("way") == "path", paths).otherwise(single)).alias("k")
    keyed = found.select("module", "service", "n", "kind", "target", "way", each).select("module", "service", "n", F.col("kind").alias("of"), "target", F.col("way").alias("kind"), "k.*")
    best = keyed.join(known, ["kind", "scope", "key"]).groupBy("service", "module", "of", "target").agg(F.max_by("to", "depth").alias("to"), F.first("n").alias("n"))
    edges = best.filter("to is not null and module <> to").groupBy(F.col("module").alias("source"), F.col("to").alias("target")).agg(F.sum("n").alias("weight"))
    return Graph(edges, modules)


def _segment_prefixes(url: Column) -> Column:
    """All beginnings of a path with a leading slash by whole segments, itself included; the path is not put together again for each."""
    return F.transform(F.sequence(F.lit(1), F.size(F.split(url, "/")) - 1), lambda n: F.call_function("substring_index", url, F.lit("/"), n + 1))


def _under(url: Column, prefix: Column) -> Column:
    return (url == prefix) | F.startswith(url, F.concat(prefix, F.lit("/")))


def stated_prefixes(prefixes: list[str] | DataFrame, spark: SparkSession) -> DataFrame:
    """Distinct prefixes with one leading slash and none at the end, of a list or a table (prefix); none for the bare root."""
    if isinstance(prefixes, list):
        prefixes = spark.range(1).select(F.explode(F.array(*map(F.lit, prefixes)).cast("array<string>")).alias("prefix"))
    cleaned = F.concat(F.lit("/"), F.regexp_replace("prefix", "^/+|/+$", ""))
    return prefixes.select(cleaned.alias("prefix")).filter("prefix <> '/'").distinct()


def resolve_clients(calls: DataFrame, served: DataFrame, prefixes: list[str] | DataFrame | None = None, bare: DataFrame | None = None) -> DataFrame:
    """Relative calls with the endpoint whose path equals the url or is its longest prefix by segments; null if none.

    An equal path scores its length and 100 more. Prefixes (of a base URL that the client leaves out; a list or a table with column
    prefix) are tried in front of the urls that aren't below them; ties go to the url itself, then to the smaller prefix. The call's method doesn't matter.
    bare: paths (column path) that count as no endpoint for the calls that reach them; marked before calls meet endpoints, since
    the calls that reach none would then all be one task's.

    Urls are never put together with prefixes. Endpoints are indexed by what is left of their paths behind each stated prefix
    they begin with, and the distinct urls meet that index on their own segments. A url may lie below no more prefixes than
    it has segments, so of the endpoints with one rest the best few (one more than that) hold the answer: an index entry never grows
    with the number of prefixes.
    """
    relative = calls.filter("is_relative")
    first = served.groupBy("path").agg(F.min_by(F.struct("service", "module", "method"), F.struct("file", "seq")).alias("e"))
    first = stored(first.withColumn("bare", F.lit(None).cast("boolean")) if bare is None else first.join(bare.select("path").distinct().withColumn("bare", F.lit(True)), "path", "left"))
    urls = relative.select("url").distinct()
    few = 1 + (relative.agg(F.max(F.size(F.split("url", "/")))).first()[0] or 0)
    pieces = urls.select("url", F.explode(_segment_prefixes(F.col("url"))).alias("rest"))
    known = stated_prefixes(prefixes or [], calls.sparkSession)
    size = F.length("path").alias("size")
    own = first.select(F.col("path").alias("rest"), F.lit("").alias("prefix"), "path", size)
    deeper = first.select("path", F.explode(_segment_prefixes(F.col("path"))).alias("prefix")).join(known, "prefix").filter("path <> prefix")
    rests = deeper.select(F.expr("substring(path, length(prefix) + 1)").alias("rest"), "prefix", "path", size)
    place = F.row_number().over(W.partitionBy("rest").orderBy(F.desc("size"), "prefix"))
    index = own.union(rests.withColumn("place", place).filter(F.col("place") <= few).drop("place"))
    met = pieces.join(index, "rest").filter((F.col("prefix") == "") | ~_under(F.col("url"), F.col("prefix")))
    met = met.filter((F.col("path") != "/") | (F.col("url") == "/"))
    found = met.select("url", "prefix", "path", (F.col("size") + F.when(F.col("rest") == F.col("url"), 100).otherwise(0)).alias("score"))
    # An endpoint that is a prefix, or lies above one, begins every url with that prefix in front.
    above = known.select("prefix", F.explode(_segment_prefixes(F.col("prefix"))).alias("path")).join(first.select("path"), "path")
    above = above.groupBy("prefix").agg(F.max_by("path", F.length("path")).alias("path")).orderBy(F.desc(F.length("path")), "prefix").limit(few)
    listed = above.agg(F.array_sort(F.collect_list(F.struct((-F.length("path")).alias("off"), "prefix", "path"))).alias("all")).scalar()
    open_ = F.filter("all", lambda x: ~_under(F.col("url"), x["prefix"]))
    general = urls.withColumn("all", listed).select("url", F.get(open_, F.lit(0)).alias("x")).filter("x is not null")
    found = found.union(general.select("url", "x.prefix", "x.path", -F.col("x.off")))
    best = found.groupBy("url").agg(F.min_by("path", F.struct(-F.col("score"), "prefix")).alias("path")).join(first.filter("bare is null"), "path")
    joined = relative.join(best.select("url", "path", "e"), "url", "left")
    return joined.select(*calls.columns, F.col("path").alias("endpoint_path"), F.col("e.service").alias("endpoint_service"), F.col("e.method").alias("endpoint_method"))


@dataclass
class Http:
    """Endpoints with their prefixes, client calls, and relative calls with the endpoint they reach (null: none)."""

    served: DataFrame
    calls: DataFrame
    resolved: DataFrame

    def edges(self) -> DataFrame:
        """source_service, target_service, method, path, weight: calls between different services."""
        between = self.resolved.filter("service is not null and endpoint_service is not null and service <> endpoint_service")
        return between.groupBy(F.col("service").alias("source_service"), F.col("endpoint_service").alias("target_service"), F.col("endpoint_method").alias("method"), F.col("endpoint_path").alias("path")).agg(F.count("*").alias("weight"))


def http(files: DataFrame, prefixes: list[str] | DataFrame | None = None) -> Http:
    """HTTP facts of placed files, from one scan of their texts.

    Calls are tried with each prefix that some service states (or with `prefixes`); a call that only reaches such a bare
    prefix, /api or /api/v1 counts as unresolved.
    """
    served, calls, stated = http_facts(files)
    known = stated if prefixes is None else stated_prefixes(prefixes, files.sparkSession)
    known = stored(stated_prefixes(known, files.sparkSession))
    bare = known.select(F.col("prefix").alias("path")).union(files.sparkSession.range(1).select(F.explode(F.array(F.lit("/api"), F.lit("/api/v1")))))
    return Http(served, calls, resolve_clients(calls, served, known, bare))


def http_edges(files: DataFrame, prefixes: list[str] | DataFrame | None = None) -> DataFrame:
    """source_service, target_service, method, path, weight: calls between different services."""
    return http(files, prefixes).edges()


def lineage_edges(models: DataFrame) -> DataFrame:
    """source_service, target_store, models, frameworks (sorted lists), weight."""
    return models.filter("service is not null").groupBy(F.col("service").alias("source_service"), F.col("store").alias("target_store")).agg(
        F.array_sort(F.collect_set("model")).alias("models"), F.array_sort(F.collect_set("framework")).alias("frameworks"), F.count_distinct("model").alias("weight"))
