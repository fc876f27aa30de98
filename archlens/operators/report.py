"""Rankings and totals that a report shows, from services, modules, edges and endpoints. All ties go to the smaller name."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from archlens.functions import dims as D
from archlens.operators.rank import ranked
from archlens.operators.resolve import module_table
from archlens.operators.rollup import primary_language


def _top(df: DataFrame, cap: int | None, *order: Column) -> DataFrame:
    return df if cap is None else df.orderBy(*order).limit(cap)


def totals(files: DataFrame) -> DataFrame:
    """files, loc and the language with most lines, in one row."""
    known = files.filter("lang is not null")
    first = known.groupBy("lang").agg(F.sum("loc").alias("loc")).agg(F.min_by("lang", F.struct(-F.col("loc"), "lang")).alias("primary_language"))
    return known.agg(F.count("*").alias("files"), F.coalesce(F.sum("loc"), F.lit(0)).alias("loc")).withColumn("primary_language", first.scalar())


def services(files: DataFrame) -> DataFrame:
    """service, files, loc, primary_language, share: of the lines of all services; 0 if they have none."""
    own = files.filter("service is not null")
    sums = own.groupBy("service").agg(F.count("*").alias("files"), F.sum("loc").alias("loc"))
    main = primary_language(own, "service").select("service", "primary_language")
    return sums.join(main, "service", "left").withColumn("share", F.when(F.col("loc") > 0, F.col("loc") / sums.agg(F.sum("loc")).scalar()).otherwise(0.0))


def modules_at(modules: DataFrame, depth: str, use: str = "cards") -> DataFrame:
    """The modules that a depth (shallow, medium, full) shows as cards or in the graph: those with most lines."""
    return _top(modules, D.DEPTH_TIERS.get(depth, D.DEPTH_TIERS["medium"])[use], F.desc("loc"), F.asc("module"))


def shown_files(files: DataFrame, depth: str) -> DataFrame:
    """Placed files, of which those of modules that a depth leaves out of the graph are of no module: nothing resolves to them."""
    shown = modules_at(module_table(files), depth, "graph").select(F.col("module").alias("shown"))
    return files.join(shown, F.col("module") == F.col("shown"), "left").withColumn("module", F.col("shown")).select(*files.columns)


def cards(modules: DataFrame, vendored: DataFrame, described: DataFrame) -> DataFrame:
    """modules (module, loc, description) with vendored and the better description, in the order `idx` of a report.

    vendored: (module, kind); described: (module, description). Products come first, by lines; a vendored module's own
    description doesn't count.
    """
    joined = modules.join(vendored.select("module", F.col("kind").alias("vendored")), "module", "left").join(described.select("module", F.col("description").alias("told")), "module", "left")
    text = F.coalesce(F.nullif("told", F.lit("")), F.when(F.col("vendored").isNull(), F.col("description")))
    shown = joined.select("module", "loc", "vendored", text.alias("description"))
    return ranked(shown, F.col("vendored").isNotNull(), F.desc("loc"), F.asc("module"), name="idx", start=0)


def tree(directories: DataFrame, depth: str) -> DataFrame:
    """dir, files, loc, level of the directories that a depth shows, with the totals of all below them; and their place
    among the directory's children, by lower-cased name."""
    levels = D.DEPTH_TIERS.get(depth, D.DEPTH_TIERS["medium"])["tree"]
    shown = directories.filter("dir <> ''").select("dir", "files", "loc", F.size(F.split("dir", "/")).alias("level"))
    shown = shown if levels is None else shown.filter(F.col("level") <= levels)
    place = W.partitionBy(F.regexp_extract("dir", "^(.*)/[^/]*$", 1)).orderBy(F.lower(F.substring_index("dir", "/", -1)), "dir")
    return shown.withColumn("place", F.row_number().over(place))


def tree_children(files: DataFrame, directories: DataFrame, depth: str) -> DataFrame:
    """parent ("" for the root), path, type (dir, file), language, loc, place of what a depth shows behind each directory: directories
    before files, each by lower-cased name. A directory at the last level has its totals and nothing behind it."""
    dirs = directories.filter("dir <> ''").select(F.col("dir").alias("path"), F.lit("dir").alias("type"), F.lit(None).cast("string").alias("language"), "loc")
    every = dirs.union(files.select("path", F.lit("file"), "lang", F.coalesce("loc", F.lit(0))))
    levels = D.DEPTH_TIERS.get(depth, D.DEPTH_TIERS["medium"])["tree"]
    shown = every if levels is None else every.filter(F.size(F.split("path", "/")) <= levels)
    parent = F.regexp_extract("path", "^(.*)/[^/]*$", 1)
    place = W.partitionBy("parent").orderBy("type", F.lower(F.substring_index("path", "/", -1)), "path")
    return shown.withColumn("parent", parent).select("parent", "path", "type", "language", "loc", F.row_number().over(place).alias("place"))


def graph_within(edges: DataFrame, modules: DataFrame) -> DataFrame:
    """Edges both of whose ends are among the modules."""
    known = modules.select("module")
    return edges.join(known.toDF("source"), "source", "left_semi").join(known.toDF("target"), "target", "left_semi").select(*edges.columns)


def hottest(edges: DataFrame, cap: int = 10) -> DataFrame:
    """source, target, weight of the heaviest edges."""
    return edges.orderBy(F.desc("weight"), "source", "target").limit(cap)


def pairs(calls: DataFrame) -> DataFrame:
    """source_service, target_service, calls and routes (method, path, weight; heaviest first) of each pair."""
    routes = F.array_sort(F.collect_list(F.struct((-F.col("weight")).alias("w"), "method", "path")))
    each = F.transform(routes, lambda x: F.struct(x["method"].alias("method"), x["path"].alias("path"), (-x["w"]).alias("weight")))
    return calls.groupBy("source_service", "target_service").agg(F.sum("weight").alias("calls"), each.alias("routes"))


def referenced(known: DataFrame, calls: DataFrame) -> DataFrame:
    """The services (column service) that some call starts from or reaches."""
    ends = calls.select(F.col("source_service").alias("service")).union(calls.select("target_service")).distinct()
    return known.join(ends, "service", "left_semi")


def neighbours(calls: DataFrame) -> DataFrame:
    """service, direction (in, out), rank, other, calls: each service's neighbours, most calls first."""
    sums = calls.groupBy("source_service", "target_service").agg(F.sum("weight").alias("calls"))
    out = sums.select(F.col("source_service").alias("service"), F.lit("out").alias("direction"), F.col("target_service").alias("other"), "calls")
    both = out.union(sums.select("target_service", F.lit("in"), "source_service", "calls"))
    return both.withColumn("rank", F.row_number().over(W.partitionBy("service", "direction").orderBy(F.desc("calls"), "other")))


def entry_modules(served: DataFrame) -> DataFrame:
    """service, module, endpoint_count of modules with endpoints."""
    return served.filter("service is not null and module is not null").groupBy("service", "module").agg(F.count("*").alias("endpoint_count"))


def entries_per_service(entries: DataFrame, cap: int = 3) -> DataFrame:
    """The modules with most endpoints of each service, with their rank."""
    line = W.partitionBy("service").orderBy(F.desc("endpoint_count"), "module")
    return entries.withColumn("rank", F.row_number().over(line)).filter(F.col("rank") <= cap)


def methods(served: DataFrame) -> DataFrame:
    """method, n, place: how often each method is served; known methods in their usual order, others behind by name."""
    counted = served.groupBy(F.upper(F.coalesce(F.nullif("method", F.lit("")), F.lit("ANY"))).alias("method")).agg(F.count("*").alias("n"))
    usual = F.array_position(F.array(*map(F.lit, D.METHOD_ORDER)), F.col("method"))
    return ranked(counted, usual == 0, usual, F.asc("method"), name="place")


def endpoints_by_service(served: DataFrame, cap: int = 8) -> DataFrame:
    """service ('unknown' if none) and n of the services with most endpoints."""
    return served.groupBy(F.coalesce("service", F.lit("unknown")).alias("service")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "service").limit(cap)


def detected(served: DataFrame, calls: DataFrame) -> DataFrame:
    """kind (framework, client) and name of each framework and client library that is used."""
    return served.select(F.lit("framework").alias("kind"), F.col("framework").alias("name")).union(calls.select(F.lit("client"), "client")).distinct()


def coverage(calls: DataFrame, served: DataFrame) -> DataFrame:
    """edges, endpoints and their ratio (null without endpoints), in one row."""
    both = served.agg(F.count("*").alias("endpoints")).withColumn("edges", calls.agg(F.count("*")).scalar())
    return both.select("edges", "endpoints", (F.col("edges") / F.nullif("endpoints", F.lit(0))).alias("coverage"))


def lineage_by_service(lineage: DataFrame) -> DataFrame:
    """service, models (their number) and sorted frameworks of services that write stores, with their rank by models."""
    sums = lineage.groupBy(F.col("source_service").alias("service")).agg(F.sum("weight").alias("models"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("frameworks")))).alias("frameworks"))
    return ranked(sums, F.desc("models"), F.asc("service"))


def store_order(stores: DataFrame, lineage: DataFrame) -> DataFrame:
    """id, models, rank of stores: those with models first, most models first; then the others by id."""
    sums = lineage.groupBy(F.col("target_store").alias("id")).agg(F.sum("weight").alias("models"))
    every = stores.select("id").distinct().join(sums, "id", "left").select("id", F.coalesce("models", F.lit(0)).alias("models"))
    return ranked(every, F.desc("models"), F.asc("id"))


def store_writers(lineage: DataFrame) -> DataFrame:
    """store, service, models, rank: who writes each store, most models first."""
    line = W.partitionBy("target_store").orderBy(F.desc("weight"), "source_service")
    return lineage.select(F.col("target_store").alias("store"), F.col("source_service").alias("service"), F.col("weight").alias("models"), F.row_number().over(line).alias("rank"))


def parsed_languages(files: DataFrame) -> DataFrame:
    """language, parsed: whether import statements of a language in modules are read; files without text don't count."""
    own = files.filter("module is not null and lang is not null")
    read = F.col("lang").isin(D.GRAPH_LANGUAGES)
    return own.filter(~read | (F.length("text") > 0)).select(F.col("lang").alias("language"), read.alias("parsed")).distinct()


def top_paths(paths: DataFrame, cap: int = 20) -> DataFrame:
    """The critical paths of the modules with most endpoints."""
    return paths.orderBy(F.desc("endpoint_count"), "service", "module").limit(cap)


def traced(paths: DataFrame) -> DataFrame:
    """paths, traced (with callers, dependencies and a store), orphans (without callers), in one row."""
    whole = (F.size("callers") > 0) & (F.size("deps") > 0) & F.col("store").isNotNull()
    return paths.agg(F.count("*").alias("paths"), F.count_if(whole).alias("traced"), F.count_if(F.size("callers") == 0).alias("orphans"))


def sections(calls: DataFrame, known: DataFrame, entries: DataFrame, stores: DataFrame, lineage: DataFrame) -> DataFrame:
    """section, shown: topology needs a call between two known services, critical paths need entry modules, lineage needs
    stores or edges."""
    some = lambda df: df.agg(F.count("*") > 0).scalar()
    two = referenced(known, calls).agg(F.count_distinct("service") >= 2).scalar()
    rows = F.array(*[F.struct(F.lit(n).alias("section"), c.alias("shown")) for n, c in (("topology", some(calls) & two), ("critical_paths", some(entries)), ("lineage", some(stores) | some(lineage)))])
    return calls.sparkSession.range(1).select(rows.alias("all")).select(F.inline("all"))
