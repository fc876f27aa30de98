"""Second-order results over facts and edges: critical paths, the matrix of modules, observations, citations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from archlens.functions import dims as D
from archlens.functions.text import normalise_path, package_of, unquoted
from archlens.operators.extract import inner_path


def critical_paths(served: DataFrame, calls: DataFrame, edges: DataFrame, lineage: DataFrame) -> DataFrame:
    """service, module, endpoint_count, sample_method, sample_path, callers, deps, store, store_models of each module
    with endpoints. served: endpoints; calls: http edges; edges: import edges; lineage: lineage edges.

    The sample is the first endpoint that has a caller, else the first. deps are names by weight, ties by path.
    """
    own = served.filter("service is not null and module is not null")
    called = calls.groupBy(F.col("target_service").alias("service"), "method", "path").agg(F.collect_set("source_service").alias("from"))
    place = F.struct(F.col("from").isNull(), "file", "seq")
    modules = own.join(called, ["service", "method", "path"], "left").groupBy("service", "module").agg(
        F.count("*").alias("endpoint_count"), F.min_by("method", place).alias("sample_method"), F.min_by("path", place).alias("sample_path"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("from")))).alias("callers"))
    last = lambda e: F.element_at(F.split(e["target"], "/"), -1)
    ordered = F.array_sort(F.collect_list(F.struct((-F.col("weight")).alias("w"), "target")))
    deps = edges.groupBy(F.col("source").alias("module")).agg(F.transform(ordered, last).alias("deps"))
    main = lineage.groupBy(F.col("source_service").alias("service")).agg(F.min_by(F.struct("target_store", "weight"), F.struct(-F.col("weight"), "target_store")).alias("s"))
    none = F.array().cast("array<string>")
    return modules.join(deps, "module", "left").join(main, "service", "left").select(
        "service", "module", "endpoint_count", "sample_method", "sample_path", "callers", F.coalesce("deps", none).alias("deps"),
        F.col("s.target_store").alias("store"), F.coalesce("s.weight", F.lit(0)).alias("store_models"))


def matrix_order(modules: DataFrame, cap: int = 55) -> DataFrame:
    """idx, module, service, block, divider of the matrix's rows: by service, domain, size and name; blocks are runs of a service.

    divider: whether the row begins another domain inside its block; a block of one domain has none. The cap is the matrix's size.
    What is numbered is the capped list alone.
    """
    inside = F.when(F.col("service").isNotNull() & F.startswith("module", F.concat("service", F.lit("/"))), F.expr("substring(module, length(service) + 2)")).otherwise(F.col("module"))
    keyed = modules.withColumn("domain", F.regexp_extract(inside, r"^(.*)/[^/]*$", 1))
    keys = [F.asc_nulls_last("service"), F.asc("domain"), F.desc("loc"), F.asc("module")]
    top = keyed.orderBy(*keys).limit(cap)
    line = W.orderBy(*keys)
    changed = ~F.col("service").eqNullSafe(F.lag("service").over(line)) | (F.col("idx") == 0)
    blocks = top.withColumn("idx", F.row_number().over(line) - 1).withColumn("new", changed.cast("int")).withColumn("block", F.sum("new").over(line) - 1)
    within = W.partitionBy("block").orderBy("idx")
    before = F.lag("domain").over(within)
    return blocks.select("idx", "module", "service", "block", (before.isNotNull() & (before != F.col("domain"))).alias("divider"))


def graph_observations(edges: DataFrame, modules: DataFrame) -> DataFrame:
    """rule, subject, value: modules with fan-out or fan-in of 4 or more (the highest), no or many crossings between
    services, and a utility module that 5 or more depend on."""
    pairs = edges.filter("source <> target")
    best = lambda df, by, rule, least: (
        df.groupBy(F.col(by).alias("subject")).agg(F.count("*").alias("value")).orderBy(F.desc("value"), "subject").limit(1)
        .filter(F.col("value") >= least).select(F.lit(rule).alias("rule"), "subject", "value"))
    of = modules.select(F.col("module").alias("m"), F.col("service").alias("s"))
    sides = pairs.join(of.toDF("source", "ss"), "source").join(of.toDF("target", "ts"), "target")
    counted = sides.agg(F.count_if(F.col("ss").eqNullSafe(F.col("ts"))).alias("intra"), F.count_if(~F.col("ss").eqNullSafe(F.col("ts"))).alias("crossing"))
    none = counted.filter("crossing = 0 and intra > 0").select(F.lit("no_crossings").alias("rule"), F.lit("").alias("subject"), F.col("intra").alias("value"))
    many = counted.filter("crossing > 0 and crossing >= greatest(2, intra div 4)").select(F.lit("many_crossings").alias("rule"), F.lit("").alias("subject"), F.col("crossing").alias("value"))
    shared = pairs.filter(F.lower(F.substring_index("target", "/", -1)).isin(D.UTILITY_MODULES))
    return best(pairs, "source", "fan_out", 4).union(best(pairs, "target", "fan_in", 4)).union(none).union(many).union(best(shared, "target", "utility_hub", 5))


def topology_observations(calls: DataFrame, unresolved: DataFrame, frameworks: DataFrame, kinds: DataFrame) -> DataFrame:
    """rule, subject, value over http edges: a hub on 2 or more pairs, a pair with 0.7 of all calls (value in thousandths)
    if there are more, frontends that reach 2 or more services, 2 or more frameworks, 3 or more unresolved calls.

    unresolved: (unresolved) in one row; frameworks: (framework), one row each at least; kinds: (service, kind).
    """
    pairs = calls.groupBy("source_service", "target_service").agg(F.sum("weight").alias("n"))
    ends = pairs.select(F.col("source_service").alias("subject")).union(pairs.select("target_service"))
    hub = ends.groupBy("subject").agg(F.count("*").alias("value")).orderBy(F.desc("value"), "subject").limit(1).filter("value >= 2")
    name = F.concat("source_service", F.lit(">"), "target_service")
    most = F.min_by(F.struct(name.alias("name"), "n"), F.struct(-F.col("n"), "source_service", "target_service"))
    heavy = pairs.agg(most.alias("m"), F.sum("n").alias("total"), F.count("*").alias("pairs")).select("m.*", "total", "pairs").filter("pairs > 1 and n / total >= 0.7")
    fans = pairs.join(kinds.filter("kind = 'frontend'"), F.col("source_service") == F.col("service")).groupBy("service").agg(F.count_distinct("target_service").alias("value")).filter("value >= 2")
    many = frameworks.agg(F.count_distinct("framework").alias("value")).filter("value >= 2")
    row = lambda df, rule, subject, value: df.select(F.lit(rule).alias("rule"), subject.alias("subject"), value.cast("long").alias("value"))
    v = F.col("value")
    return (
        row(hub, "hub", F.col("subject"), v).union(row(heavy, "heaviest_pair", F.col("name"), F.floor(1000 * F.col("n") / F.col("total")))).union(row(fans, "frontend_fan", F.col("service"), v))
        .union(row(many, "frameworks", F.lit(""), v)).union(row(unresolved.filter("unresolved >= 3"), "unresolved", F.lit(""), F.col("unresolved"))))


def lineage_observations(lineage: DataFrame, found_stores: DataFrame) -> DataFrame:
    """rule, subject, value over lineage edges: a store with 0.9 of 5 or more models, stores with 2 or more writers, stores
    without models when there are edges, 2 or more model frameworks, stores when there are no edges."""
    by_store = lineage.groupBy(F.col("target_store").alias("id")).agg(F.sum("weight").alias("n"), F.count_distinct("source_service").alias("writers"))
    edges = lineage.agg(F.count("*")).scalar()
    top = by_store.agg(F.min_by(F.struct("id", "n"), F.struct(-F.col("n"), "id")).alias("m"), F.sum("n").alias("total")).select("m.*", "total").filter("total >= 5 and n / total >= 0.9")
    row = lambda df, rule, subject, value: df.select(F.lit(rule).alias("rule"), subject.alias("subject"), value.cast("long").alias("value"))
    unlinked = found_stores.join(by_store, "id", "left_anti")
    frameworks = lineage.select(F.explode("frameworks").alias("f")).agg(F.count_distinct("f").alias("value")).filter("value >= 2")
    return (
        row(top, "dominant_store", F.col("id"), F.col("n")).union(row(by_store.filter("writers >= 2"), "shared_store", F.col("id"), F.col("writers")))
        .union(row(unlinked.filter(edges > 0), "unlinked_store", F.col("id"), F.lit(0))).union(row(frameworks, "frameworks", F.lit(""), F.col("value")))
        .union(row(unlinked.filter(edges == 0), "store_without_models", F.col("id"), F.lit(0))))


def path_observations(paths: DataFrame, n_calls: int) -> DataFrame:
    """rule, subject, value over critical paths: the module with most endpoints (8 or more), modules without callers, the
    utility that a third of all modules and three at least depend on, one store for all of 5 or more, calls per endpoint
    below 0.4 (in thousandths; `n_calls`: the number of http edges)."""
    row = lambda df, rule, subject, value: df.select(F.lit(rule).alias("rule"), subject.cast("string").alias("subject"), value.cast("long").alias("value"))
    top = paths.orderBy(F.desc("endpoint_count"), "service", "module").limit(1).filter("endpoint_count >= 8")
    sums = paths.agg(F.count("*").alias("n"), F.count_if(F.size("callers") == 0).alias("orphans"), F.sum("endpoint_count").alias("endpoints"), F.array_sort(F.collect_set("store")).alias("stores"))
    used = paths.select(F.explode("deps").alias("d")).select(F.lower("d").alias("d")).filter(F.col("d").isin(D.UTILITY_MODULES)).groupBy("d").agg(F.count("*").alias("uses"))
    most = used.orderBy(F.desc("uses"), "d").limit(1).filter(F.col("uses") >= F.greatest(F.lit(3), F.floor(paths.agg(F.count("*")).scalar() / 3)))
    return (
        row(top, "most_exposed", F.col("module"), F.col("endpoint_count")).union(row(sums.filter("orphans > 0"), "no_callers", F.lit(""), F.col("orphans")))
        .union(row(most, "shared_utility", F.col("d"), F.col("uses"))).union(row(sums.filter("size(stores) = 1 and n >= 5"), "one_store", F.col("stores")[0], F.col("n")))
        .union(row(sums.filter((F.col("endpoints") > 0) & F.lit(n_calls > 0) & (F.lit(n_calls) < 0.4 * F.col("endpoints"))), "coverage", F.lit(""), F.floor(1000 * F.lit(n_calls) / F.col("endpoints")))))


def first_rules(observations: DataFrame, rules: list[str], cap: int = 5) -> DataFrame:
    """Observations in the order of their rules, `cap` at most."""
    place = F.array_position(F.array(*map(F.lit, rules)), F.col("rule"))
    return observations.filter(place > 0).orderBy(place, F.desc("value"), "subject").limit(cap)


def unresolved_citations(steps: DataFrame, files: DataFrame) -> DataFrame:
    """Steps (flow, step, file, symbol) that name no file, a missing one or no symbol, with the problem."""
    known = files.select(F.col("path").alias("file"), F.lit(True).alias("there")).distinct()
    problem = F.when(F.coalesce("file", F.lit("")) == "", "no file").when(F.col("there").isNull(), "file not found").when(F.coalesce("symbol", F.lit("")) == "", "no symbol")
    return steps.join(known, "file", "left").select("flow", "step", "file", problem.alias("problem")).filter("problem is not null")


def valid_flows(steps: DataFrame, files: DataFrame) -> DataFrame:
    """Flows all of whose steps name a file that is there and a symbol."""
    return steps.select("flow").distinct().join(unresolved_citations(steps, files).select("flow").distinct(), "flow", "left_anti")


MATCH = "struct<file:string,ruleId:string,text:string,metaVariables:struct<single:struct<SRC:struct<text:string>,MOD:struct<text:string>>>>"
#: What the rules of a parser's configuration find, by the rule's id.
RULE_KINDS = {"py-import": "python", "py-from-import": "python", "go-import": "go", "elixir-ref": "elixir", "elixir-defmodule": "definition"} | {
    f"{dialect}-{form}": "script" for dialect in ("typescript", "tsx", "javascript") for form in ("import", "export-from", "require", "dynamic-import")
}


def rule_table(spark: SparkSession) -> DataFrame:
    """rule and kind of each rule that a parser is asked to apply."""
    rows = F.array(*[F.struct(F.lit(rule).alias("rule"), F.lit(kind).alias("kind")) for rule, kind in RULE_KINDS.items()])
    return spark.range(1).select(F.inline(rows))


def hits_of(outputs: DataFrame, rules: DataFrame | None = None) -> DataFrame:
    """file, rule, captured of a parser's outputs (text), each a JSON array of matches, by the rules that are known.

    What a match captured is its source, else its module, else its whole text. An output that is no JSON array gives no hits, so its
    files are read by patterns (`prefer_parsed`); matches without rule or file are passed over.
    """
    valid = F.col("text").rlike(r"^\s*\[") & F.try_parse_json("text").isNotNull()
    each = outputs.filter(valid).select(F.explode(F.from_json("text", f"array<{MATCH}>")).alias("m")).select("m.*")
    caught = F.coalesce(F.nullif("metaVariables.single.SRC.text", F.lit("")), F.nullif("metaVariables.single.MOD.text", F.lit("")), "text", F.lit(""))
    rows = each.select(F.regexp_replace("file", r"^(\./)+", "").alias("file"), F.col("ruleId").alias("rule"), caught.alias("captured")).filter("file <> '' and rule <> ''")
    rules = rule_table(outputs.sparkSession) if rules is None else rules
    return rows.join(rules.select("rule").distinct(), "rule", "left_semi").select("file", "rule", "captured")


def read_hits(spark: SparkSession, path: str) -> DataFrame:
    """Hits in the output files of a parser below `path`."""
    return hits_of(spark.read.text(path, wholetext=True).select(F.col("value").alias("text")))


def parsed_imports(hits: DataFrame, go_prefix: str | None = None, rules: DataFrame | None = None) -> DataFrame:
    """file, kind and target of a parser's hits (file, rule, captured), as `imports` has them.

    rules: (rule, kind), what each rule finds, `rule_table` if not given; unknown rules are of JavaScript and TypeScript. Of an
    Elixir alias of several modules the parent is no target.
    """
    rules = rule_table(hits.sparkSession) if rules is None else rules
    hits = hits.join(rules.select("rule", F.col("kind").alias("finds")), "rule", "left")
    cap, finds = F.regexp_replace("captured", r"^\s+|\s+$", ""), F.col("finds")
    none = F.array().cast("array<struct<kind:string,target:string>>")
    row = lambda kind, target: F.struct(F.lit(kind).alias("kind"), target.alias("target"))
    python = F.when((cap != "") & ~F.startswith(cap, F.lit(".")), F.array(row("name", F.regexp_extract(cap, r"^([^\s.]+)", 1)))).otherwise(none)
    spec = unquoted(cap)
    path = F.when(~F.startswith(spec, F.lit("/")), normalise_path(F.concat(F.regexp_extract("file", "^(.*)/[^/]*$", 1), F.lit("/"), spec)))
    script = F.when(spec == "", none).when(spec.rlike("^[./]"), F.array(row("path", path))).otherwise(F.array(row("package", package_of(spec))))
    go = F.array(row("inner", inner_path(F.coalesce(F.nullif(F.regexp_extract(cap, '"([^"]*)"?', 1), F.lit("")), cap), F.lit(go_prefix or "\0"))))
    parts = F.filter(F.transform(F.split(F.regexp_extract(cap, r"(?s)\{(.*)\}$", 1), ","), lambda x: F.trim(x)), lambda x: x != "")
    elixir = F.when(cap.rlike(r"(?s)\{.*\}$"), F.transform(parts, lambda x: row("ref", F.concat(F.regexp_extract(cap, r"(?s)^(.*?)\.\{", 1), F.lit("."), x)))).when(cap != "", F.array(row("ref", F.regexp_replace(cap, r"\.+$", "")))).otherwise(none)
    rows = F.when(finds == "python", python).when(finds == "go", go).when(finds == "elixir", elixir).when(finds == "definition", F.array(row("def", cap))).otherwise(script)
    return hits.select("file", F.explode(rows).alias("x")).select("file", "x.*").filter("target is not null and (target <> '' or kind = 'inner')")


def prefer_parsed(by_pattern: DataFrame, parsed: DataFrame) -> DataFrame:
    """Hits of a parser where it has any for a file, those of patterns elsewhere."""
    return by_pattern.join(parsed.select("file").distinct(), "file", "left_anti").select(*by_pattern.columns).unionByName(parsed.select(*by_pattern.columns))
