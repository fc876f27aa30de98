"""Packages that manifests name, by ecosystem. Parsing stays in column expressions; a malformed manifest gives no rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from archlens.functions import dims as D
from archlens.functions.text import first, found, lookup

PACKAGES = "array<struct<name:string,version:string>>"


def _package(name: Column, version: Column) -> Column:
    return F.struct(name.alias("name"), version.alias("version"))


def _or_star(version: Column) -> Column:
    return F.when(version == "", "*").otherwise(version)


def _strip(x: Column) -> Column:
    return F.regexp_replace(x, r"^\s+|\s+$", "")


def _matches(text: Column, pattern: str, groups: int = 2, name=lambda m: m["g1"], version=lambda m: _or_star(m["g2"])) -> Column:
    return F.transform(found(text, pattern, groups), lambda m: _package(name(m), version(m)))


def _json_map(text: Column, key: str) -> Column:
    entries = F.map_entries(F.from_json(F.get_json_object(text, f"$.{key}"), "map<string,string>"))
    return F.transform(F.coalesce(entries, F.array().cast("array<struct<key:string,value:string>>")), lambda e: _package(e["key"], e["value"]))


def _requirements(text: Column) -> Column:
    lines = F.transform(F.split(text, "\n"), lambda x: _strip(F.regexp_replace(x, "#.*$", "")))
    stated = F.filter(lines, lambda x: ~F.startswith(x, F.lit("-")) & x.rlike(D.REQUIREMENT))
    return F.transform(stated, lambda x: _package(F.regexp_extract(x, D.REQUIREMENT, 1), _or_star(F.trim(F.regexp_extract(x, D.REQUIREMENT, 2)))))


def _pipfile(text: Column) -> Column:
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(D.PIPFILE_LINE))
    return F.transform(lines, lambda x: _package(F.regexp_extract(x, D.PIPFILE_LINE, 1), F.regexp_extract(x, D.PIPFILE_LINE, 2)))


def _go(text: Column) -> Column:
    """Lines of require blocks and single require lines: the text is cut before each block, a block ends at a lone )."""

    def lines(chunk: Column) -> Column:
        block = chunk.rlike(r"^\s*require \(")
        cut = F.split(chunk, r"(?m)^[^\S\n]*\)[^\S\n]*$", 2)
        inside = F.when(block, F.slice(F.split(cut[0], "\n"), F.lit(2), F.size(F.split(cut[0], "\n")))).otherwise(F.array().cast("array<string>"))
        rest = F.when(block, F.coalesce(F.get(cut, F.lit(1)), F.lit(""))).otherwise(chunk)
        return F.concat(inside, F.filter(F.split(rest, "\n"), lambda x: F.startswith(F.ltrim(x), F.lit("require "))))

    all_lines = F.flatten(F.transform(F.split(text, r"(?m)^(?=[^\S\n]*require \()"), lines))
    parts = F.filter(F.transform(all_lines, lambda x: F.split(_strip(F.replace(x, F.lit("require "), F.lit(""))), r"\s+")), lambda p: F.size(p) >= 2)
    return F.transform(parts, lambda p: _package(p[0], p[1]))


def _cargo(text: Column) -> Column:
    """Assignments in the sections of dependencies; the first quoted string is the version, else the value as it stands."""
    sections = F.filter(F.split(text, r"(?m)^(?=\s*\[)"), lambda s: _strip(F.substring_index(_strip(s), "\n", 1)).isin(D.CARGO_SECTIONS))
    lines = F.filter(F.flatten(F.transform(sections, lambda s: F.transform(F.split(s, "\n"), _strip))), lambda x: x.rlike(D.CARGO_LINE))
    value = lambda x: F.regexp_extract(x, D.CARGO_LINE, 2)
    quoted = lambda x: F.regexp_extract(value(x), '"([^"]+)"', 1)
    return F.transform(lines, lambda x: _package(F.regexp_extract(x, D.CARGO_LINE, 1), F.when(quoted(x) == "", value(x)).otherwise(quoted(x))))


def _mix(text: Column) -> Column:
    """Tuples of the deps block; a string that says where a package comes from is no version."""
    block = F.when(text.rlike(D.MIX_DEPS), first(text, D.MIX_DEPS)).otherwise(text)

    def version(m: Column) -> Column:
        before = F.rtrim(F.regexp_extract(m["g2"], r'(?s)^(.*?)"[^"]+"', 1))
        return F.when(before.rlike(D.MIX_SOURCE), "*").otherwise(_or_star(F.regexp_extract(m["g2"], '"([^"]+)"', 1)))

    return _matches(block, D.MIX_TUPLE, version=version)


def packages(files: DataFrame) -> DataFrame:
    """file, ecosystem, ord, name, version of the packages in manifests, in their order within the file."""
    text, name = F.substring("text", 1, 512 * 1024), F.substring_index("path", "/", -1)
    rules = {
        "npm": F.concat(_json_map(text, "dependencies"), _json_map(text, "peerDependencies")),
        "composer": F.filter(_json_map(text, "require"), lambda p: p["name"] != "php"),
        "pip": _requirements(text),
        "python": F.filter(_matches(text, D.QUOTED_REQUIREMENT, version=lambda m: _or_star(F.trim(m["g2"]))), lambda p: F.lower(p["name"]) != "python"),
        "pipenv": _pipfile(text),
        "go": _go(text),
        "cargo": _cargo(text),
        "bundler": _matches(text, D.GEM),
        "hex": _mix(text),
        "maven": _matches(text, D.POM, 3, lambda m: F.concat(m["g1"], F.lit(":"), m["g2"]), lambda m: _or_star(m["g3"])),
        "gradle": _matches(text, D.GRADLE),
    }
    own = files.filter(name.isin(list(D.MANIFESTS))).withColumn("ecosystem", lookup(D.MANIFESTS, name))
    made = F.lit(None).cast(PACKAGES)
    for ecosystem, rule in rules.items():
        made = F.when(F.col("ecosystem") == ecosystem, rule.cast(PACKAGES)).otherwise(made)
    rows = own.select(F.col("path").alias("file"), "ecosystem", F.posexplode(made).alias("ord", "p")).select("file", "ecosystem", "ord", "p.*")
    # A pyproject names a package once, as it first does; manifests of other kinds may repeat names.
    once = F.when(F.col("ecosystem") != "python", F.col("ord"))
    return rows.groupBy("file", "ecosystem", "name", once.alias("k")).agg(F.min("ord").alias("ord"), F.min_by("version", "ord").alias("version")).drop("k")


def by_ecosystem(found_packages: DataFrame, cap: int | None = None) -> DataFrame:
    """ecosystem, name, version: each name once, with its first version that isn't * in file order; the first `cap` names."""
    kept = found_packages.groupBy("ecosystem", "name").agg(F.min_by("version", F.struct(F.col("version") == "*", "file", "ord")).alias("version"))
    if cap is None:
        return kept
    return kept.withColumn("rank", F.row_number().over(W.partitionBy("ecosystem").orderBy("name"))).filter(F.col("rank") <= cap).drop("rank")


def ecosystems(files: DataFrame, cap: int | None = None) -> DataFrame:
    """ecosystem, file (a path, or a manifest's name and how many there are), count of packages after the cap, has_star."""
    name = F.substring_index("path", "/", -1)
    seen = files.filter(name.isin(list(D.MANIFESTS))).groupBy(lookup(D.MANIFESTS, name).alias("ecosystem")).agg(F.min("path").alias("path"), F.count("*").alias("n"))
    label = F.when(F.col("n") == 1, F.col("path")).otherwise(F.concat(F.substring_index("path", "/", -1), F.lit(" ×"), F.col("n").cast("string")))
    counts = by_ecosystem(packages(files), cap).groupBy("ecosystem").agg(F.count("*").alias("count"), F.bool_or(F.col("version") == "*").alias("has_star"))
    return counts.join(seen, "ecosystem").select("ecosystem", label.alias("file"), "count", "has_star")
