"""What a tree says about itself: stores, URL prefixes, entry points, READMEs and descriptions, from single files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from archlens.functions import dims as D
from archlens.functions.text import ancestors, first, found, lookup, route
from archlens.operators.extract import bootstrap_place, prefix_rows
from archlens.operators.rank import ranked

FOLDER = r"^(.*)/[^/]*$"


def _order(names: list[str], key: Column) -> Column:
    """Place of `key` in a short list of names, from 1; 0 if it isn't there."""
    return F.array_position(F.array(*map(F.lit, names)), key)


def stores(files: DataFrame) -> DataFrame:
    """id, name, evidence (sorted): stores that compose and environment files name, at the root or one directory below.

    Takes files before names that are never scanned are dropped, as .env is such a name.
    """
    folder = F.substring_index("path", "/", 1)
    below = F.col("path").rlike(r"^[^/.][^/]*/\.env(\.example)?$") & ~folder.isin(D.SKIP_DIRS)
    source = F.when(F.col("path").isin(D.COMPOSE_FILES), "docker-compose").when(F.col("path").isin(D.STORE_FILES) | below, F.col("path"))
    text = F.lower(F.substring("text", 1, 64 * 1024))
    compose = F.lower(F.substring("text", 1, 128 * 1024))
    text = F.when(F.col("path").isin(D.COMPOSE_FILES), compose).otherwise(text)
    hits = F.array_compact(F.array(*[F.when(text.rlike(p), F.struct(F.lit(kind).alias("id"), F.lit(name).alias("name"))) for p, kind, name in D.STORE_PATTERNS]))
    rows = files.select(source.alias("source"), F.explode(hits).alias("s")).filter("source is not null")
    return rows.groupBy("s.id", "s.name").agg(F.array_sort(F.collect_set("source")).alias("evidence"))


def with_inferred(found_stores: DataFrame, lineage: DataFrame) -> DataFrame:
    """Stores, and those that only models refer to."""
    only = lineage.select(F.col("target_store").alias("id")).distinct().join(found_stores, "id", "left_anti")
    return found_stores.unionByName(only.select("id", F.initcap("id").alias("name"), F.array(F.lit("inferred from ORM usage")).alias("evidence")))


def service_prefixes(placed: DataFrame) -> DataFrame:
    """service, framework, prefix: the first global URL prefix in the bootstrap files of a service, in their order."""
    rows = placed.filter("service is not null").select("service", bootstrap_place().alias("place"), F.explode(prefix_rows()).alias("x"))
    return rows.groupBy("service", "x.framework").agg(F.min_by(route(F.col("x.path")), "place").alias("prefix"))


def entry_points(files: DataFrame) -> DataFrame:
    """path and kind of files that start something: known names at the root, in src or cmd; bin/*; cmd/*/main.go."""
    known = lookup(D.ENTRY_FILES, F.regexp_extract("path", r"^(?:src/|cmd/)?([^/]+)$", 1))
    service = F.regexp_extract("path", r"^cmd/([^/]+)/main\.go$", 1)
    kind = F.coalesce(known, F.when(F.col("path").rlike("^bin/[^/]+$"), "CLI script"), F.when(service != "", F.concat(F.lit("Go service: "), service)))
    return files.select("path", kind.alias("kind")).filter("kind is not null")


def is_prose(line: Column) -> Column:
    """A line that reads as a sentence: no markup at its start, and twelve letters without links and emphasis."""
    s = F.regexp_replace(line, r"^\s+|\s+$", "")
    cleaned = s
    for noise in D.PROSE_NOISE:
        cleaned = F.regexp_replace(cleaned, noise, "")
    return (s != "") & ~s.rlike(D.NOT_PROSE) & (F.length(F.regexp_replace(cleaned, r"[^\p{L}]", "")) >= 12)


def first_paragraph(text: Column) -> Column:
    """The prose of the first paragraph that has any, on one line, 500 characters at most; else empty."""
    paragraphs = F.split(F.regexp_replace(text, r"^\s+|\s+$", ""), r"\n\s*\n")
    prose = F.transform(paragraphs, lambda p: F.trim(F.regexp_replace(F.array_join(F.filter(F.split(p, "\n"), is_prose), " "), r"\s+", " ")))
    return F.substring(F.coalesce(F.get(F.filter(prose, lambda p: p != ""), F.lit(0)), F.lit("")), 1, 500)


def readme(files: DataFrame) -> DataFrame:
    """file, first_paragraph, headings (25 at most) of the root's README; no row if it has none."""
    own = files.filter(F.col("path").isin(D.ROOT_READMES)).orderBy(_order(D.ROOT_READMES, F.col("path"))).limit(1)
    text = F.substring("text", 1, 128 * 1024)
    headings = F.slice(F.transform(found(text, D.HEADING, 2), lambda m: F.trim(m["g2"])), 1, 25)
    return own.select(F.col("path").alias("file"), first_paragraph(text).alias("first_paragraph"), headings.alias("headings"))


def descriptions(files: DataFrame) -> DataFrame:
    """dir, description: from package.json, else the README's prose, else the docstring of __init__.py."""
    name = F.substring_index("path", "/", -1)
    text = F.col("text")
    stated = F.trim(F.get_json_object(text, "$.description"))
    doc = first_paragraph(first(F.substring(text, 1, 2048), r'(?s)^"""(.+?)"""'))
    said = F.when(name == "package.json", stated).when(name.isin(D.MODULE_READMES), first_paragraph(F.substring(text, 1, 4096))).when(name == "__init__.py", doc)
    order = F.when(name == "package.json", 0).when(name == "__init__.py", 9).otherwise(_order(D.MODULE_READMES, name))
    rows = files.filter(name.isin("package.json", "__init__.py", *D.MODULE_READMES)).select(F.regexp_extract("path", FOLDER, 1).alias("dir"), said.alias("said"), order.alias("ord"))
    return rows.filter("said <> ''").groupBy("dir").agg(F.min_by("said", "ord").alias("description"))


def evidence_candidates(files: DataFrame, modules: DataFrame, cap: int = 400) -> DataFrame:
    """ord, path, text of the files that tell most about a tree, most valuable first, each once.

    First the root's READMEs, manifests and architecture documents; then READMEs and manifests of modules (column module, in the order of
    their `loc`), those directly in a module before those below; then main files; then route and schema files. The last three
    sources end when there are more than `cap` candidates. Which files are candidates is decided on paths; only those that are get their texts.
    """
    known = D.EVIDENCE_READMES + D.EVIDENCE_MANIFESTS
    name, path = F.substring_index("path", "/", -1), F.col("path")
    folder = F.regexp_extract("path", FOLDER, 1)
    at_root = ~F.contains(path, F.lit("/"))
    doc = path.rlike("^docs/[^/]+$") & name.rlike(D.ARCHITECTURE_DOCS)
    named = _order(known, name)
    own = F.when(at_root & name.isin(known), 1).when(doc, 1).when(name.isin(known), 3).when(name.rlike(D.MAIN_FILES), 4).when(name.rlike(D.ROUTE_FILES), 5)
    paths = files.select("path", own.alias("own"), F.when(doc, 100).otherwise(named).alias("named")).filter("own is not null")
    order = ranked(modules.select("module", "loc"), F.desc("loc"), F.asc("module")).select("module", F.col("rank").alias("place"))
    dirs = paths.filter("own = 3").select("path", folder.alias("folder"), F.explode(ancestors(folder)).alias("module"))
    of = dirs.join(order, "module").select("path", "place", (F.col("folder") != F.col("module")).alias("below"))
    best = of.groupBy("path").agg(F.min(F.struct("place", "below")).alias("m"))
    joined = paths.join(best, "path", "left").filter("own <> 3 or m is not null")
    below = F.coalesce("m.below", F.lit(False))
    keyed = joined.select("path", F.col("own").alias("source"), F.coalesce("m.place", F.lit(0)).alias("k0"), below.cast("int").alias("k1"), F.when(below | (F.col("own") > 3), 0).otherwise(F.col("named")).alias("k2"))
    keys = ["source", "k0", "k1", "k2", "path"]
    # What has to be in the list whatever its length is source 1 and modules' own files; the rest fills it up.
    always = (F.col("source") == 1) | ((F.col("source") == 3) & (F.col("k1") == 0))
    least = keyed.filter(always).union(keyed.filter(~always).orderBy(*keys).limit(cap + 1))
    numbered = ranked(least.withColumn("keep", always), *keys, name="ord", start=0)
    kept = numbered.filter((F.col("ord") <= cap) | F.col("keep")).select("ord", F.col("path").alias("of"))
    return kept.join(files.select("path", "text"), F.col("of") == F.col("path")).select("ord", "path", "text")
