"""Column expressions over paths and file texts."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from archlens.functions import dims


def lookup(table: dict[str, str], key: Column) -> Column:
    """The value of a small constant table; null if absent."""
    return F.create_map(*[F.lit(x) for x in chain(*table.items())])[key]


def language(path: Column) -> Column:
    """Language of a file by its name or its last extension."""
    name = F.substring_index(path, "/", -1)
    by_ext = {ext: lang for lang, exts in dims.LANGUAGES.items() for ext in exts}
    return F.coalesce(lookup(dims.NAMED_FILES, name), lookup(by_ext, F.lower(F.regexp_extract(name, r"^.+(\.[^.]+)$", 1))))


def count_lines(text: Column) -> Column:
    """Newlines, plus one for an unterminated last line; a file beyond 5 MiB counts as one line."""
    n = F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + F.when(F.endswith(text, F.lit("\n")), 0).otherwise(1)
    return F.when(F.octet_length(text) == 0, 0).when(F.octet_length(text) > 5 * 1024 * 1024, 1).otherwise(n).cast("long")


def found(text: Column, pattern: str, groups: int) -> Column:
    """Groups of all matches as an array of structs g1, g2, ...; a group without match is empty.

    ^ and $ match at newlines only, and \\w and \\s know all letters.
    """
    p = F.lit("(?mdU)" + pattern)
    return F.arrays_zip(*[F.regexp_extract_all(text, p, F.lit(g)).alias(f"g{g}") for g in range(1, groups + 1)])


def first(text: Column, pattern: str) -> Column:
    """Group 1 of the first match, or an empty string."""
    return F.regexp_extract(text, "(?mdU)" + pattern, 1)


def route(raw: Column) -> Column:
    """A route's canonical form: one leading slash, none at the end, parameters as :id.

    A chain of replacements that uses each step once: a step that branches on the one before would double the code of all before it.
    Routes of plain segments, in which no step would find anything, are left as they are: one search instead of all of these.
    """
    p = F.regexp_replace(F.trim(raw), "^(?!/)", "/")
    p = F.regexp_replace(p, "/+$", "")
    for pattern in dims.ROUTE_PARAMETERS:
        p = F.regexp_replace(p, "(?U)" + pattern, ":id")
    return F.when(raw.rlike(dims.PLAIN_ROUTE), raw).otherwise(F.regexp_replace(F.regexp_replace(p, "/+", "/"), r"\A\z", "/"))


def join_route(prefix: Column, leaf: Column) -> Column:
    """The route of `leaf` below `prefix`; either may be empty."""
    strip = lambda c: F.regexp_replace(c, "^/+|/+$", "")
    return route(F.when(prefix == "", leaf).when(leaf == "", prefix).otherwise(F.concat(F.lit("/"), strip(prefix), F.lit("/"), strip(leaf))))


def path_prefix(path: Column, depth: int = 3) -> Column:
    return F.concat(F.lit("/"), F.array_join(F.slice(F.split(F.regexp_replace(path, "^/+|/+$", ""), "/"), 1, depth), "/"))


def package_of(specifier: Column) -> Column:
    """Package of a bare specifier; null for a relative one or a scope alone."""
    parts = F.split(specifier, "/")
    scoped = F.when(F.size(parts) >= 2, F.concat(parts[0], F.lit("/"), F.get(parts, F.lit(1))))
    return F.when(specifier.rlike(r"^[./]") | (specifier == ""), None).when(F.startswith(specifier, F.lit("@")), scoped).otherwise(parts[0])


def normalise_path(path: Column) -> Column:
    """a/./b/../c -> a/c; null for a path that leaves the tree, as a/../../b does, also if it comes back."""

    def step(acc: Column, x: Column) -> Column:
        up = F.when(F.size(acc) > 0, F.slice(acc, F.lit(1), F.size(acc) - 1))  # null stays null in all that follows
        return F.when((x == ".") | (x == ""), acc).when(x == "..", up).otherwise(F.concat(acc, F.array(x)))

    return F.array_join(F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), step), "/")


def ancestors(path: Column) -> Column:
    """All prefixes of a path by whole segments, itself included."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))


def unquoted(text: Column) -> Column:
    """A trimmed text without the quotes around it, if they are equal."""
    t = F.regexp_replace(text, r"^\s+|\s+$", "")
    return F.when(t.rlike(r"(?s)^(['\"]).*\1$") & (F.length(t) >= 2), F.substr(t, F.lit(2), F.length(t) - 2)).otherwise(t)
