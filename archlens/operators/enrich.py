"""What a written enrichment of a tree says: reading it, checking it against the tree, and terms that a report explains."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from archlens.functions import dims as D

#: Aliases that are looked for in one reading of the texts.
BLOCK_TERMS = 50_000
STEP = "struct<file:string,symbol:string,label:string,note:string>"
FLOW = f"struct<name:string,kind:string,trigger:string,narration:string,terminates:string,steps:array<{STEP}>>"
OVERVIEW = "struct<what_it_is:string,what_it_does:string,how_it_works:string,confidence:string,primary_stack:array<string>,caveats:array<string>>"
VENDORED = "array<struct<module_id:string,kind:string,source:string,why:string>>"
SCHEMA = f"schema_version int, overview {OVERVIEW}, classification struct<vendored:{VENDORED},products:array<struct<module_id:string,why:string>>>, flows array<{FLOW}>, module_descriptions array<struct<module_id:string,description:string>>"


def parse(texts: DataFrame, text_col: str = "text") -> DataFrame:
    """Documents as columns of SCHEMA beside those of `texts`; a text that is no JSON object gives none (warn and go on)."""
    made = F.from_json(F.col(text_col), SCHEMA, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_broken"})
    valid = F.try_parse_json(F.col(text_col)).isNotNull() & F.col(text_col).rlike(r"^\s*\{")
    return texts.filter(valid).withColumn("made", made).select(*texts.columns, "made.*")


def read_enrichment(spark: SparkSession, path: str) -> DataFrame:
    """Enrichment documents below `path`, one row for each file that holds valid JSON, with its `path`."""
    whole = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))
    return parse(whole).drop("text")


def _missing(x: Column) -> Column:
    return F.coalesce(x, F.lit("")) == ""


def errors(documents: DataFrame, files: DataFrame, key: str = "path") -> DataFrame:
    """key, place, error: what is wrong in each document; a document without rows is valid.

    files: path of each file of the tree. Cited files are met by one join.
    """
    own = documents.withColumn("key", F.col(key))
    err = lambda place, error: F.struct(place.alias("place"), F.lit(error).alias("error"))
    need = lambda x, place, keys: [F.when(_missing(x[k]), err(place, f"missing {k}")) for k in keys]
    overview = F.lit("overview")
    top = [
        F.when(~F.coalesce(F.col("schema_version") == 1, F.lit(False)), err(F.lit("schema_version"), "not 1")),
        F.when(F.col("overview").isNull(), err(overview, "missing")),
        *[F.when(F.col("overview").isNotNull() & _missing(F.col(f"overview.{k}")), err(overview, f"missing {k}")) for k in ("what_it_is", "what_it_does", "how_it_works")],
        F.when(F.col("overview").isNotNull() & ~F.coalesce(F.col("overview.confidence").isin(D.FLOW_CONFIDENCE), F.lit(False)), err(F.lit("overview.confidence"), "unknown")),
    ]
    general = own.select("key", F.explode(F.array_compact(F.array(*top))).alias("e"))
    flows = own.select("key", F.posexplode("flows").alias("i", "f")).withColumn("place", F.concat(F.lit("flows["), "i", F.lit("]")))
    place = F.col("place")
    of_flow = [*need(F.col("f"), place, ("name", "kind", "trigger", "terminates")), F.when(~F.coalesce(F.col("f.kind").isin(D.FLOW_KINDS), F.lit(False)), err(place, "unknown kind")), F.when(F.coalesce(F.size("f.steps"), F.lit(0)) <= 0, err(place, "no steps"))]
    steps = flows.select("key", "place", F.posexplode("f.steps").alias("j", "s")).select("key", F.concat("place", F.lit(".steps["), "j", F.lit("]")).alias("place"), "s.file", "s.symbol")
    known = files.select(F.col("path").alias("file"), F.lit(True).alias("there")).distinct()
    cited = steps.join(known, "file", "left")
    of_step = [F.when(_missing(F.col("file")), err(place, "missing file")), F.when(_missing(F.col("symbol")), err(place, "missing symbol")), F.when(~_missing(F.col("file")) & F.col("there").isNull(), err(place, "cited file not found"))]
    rows = lambda df, e: df.select("key", F.explode(F.array_compact(F.array(*e))).alias("e"))
    return general.union(rows(flows, of_flow)).union(rows(cited, of_step)).select("key", "e.place", "e.error")


def kept_flows(documents: DataFrame, files: DataFrame, key: str = "path") -> DataFrame:
    """key, flow (its place), name, kind, lane: flows with steps all of which name a file that is there and a symbol.

    lane: the place of its kind among those of the document, known kinds in their usual order, then others by first use.
    """
    flows = documents.select(F.col(key).alias("key"), F.posexplode("flows").alias("flow", "f")).select("key", "flow", "f.name", "f.kind", "f.steps")
    known = files.select(F.col("path").alias("file"), F.lit(True).alias("there")).distinct()
    good = F.bool_and(F.col("there").isNotNull() & ~_missing(F.col("symbol")))
    sound = flows.select("key", "flow", F.explode("steps").alias("s")).select("key", "flow", "s.file", "s.symbol").join(known, "file", "left").groupBy("key", "flow").agg(good.alias("good")).filter("good").drop("good")
    kept = flows.drop("steps").join(sound, ["key", "flow"])
    usual = F.array_position(F.array(*map(F.lit, D.FLOW_KINDS)), F.col("kind"))
    lanes = kept.groupBy("key", "kind").agg(F.min("flow").alias("first")).withColumn("order", F.when(usual > 0, usual).otherwise(F.lit(100) + F.col("first")))
    from pyspark.sql import Window as W

    numbered = lanes.withColumn("lane", F.row_number().over(W.partitionBy("key").orderBy("order"))).select("key", F.col("kind").alias("k"), "lane")
    return kept.join(numbered.withColumnRenamed("key", "of"), (F.col("key") == F.col("of")) & F.col("kind").eqNullSafe(F.col("k"))).select("key", "flow", "name", "kind", "lane")


TOKEN = re.compile("[A-Za-z0-9]+")


class TermMatcher:
    """Finds which aliases a text mentions between characters other than letters and digits, in one walk over its tokens.

    An alias that begins with a letter or digit begins with a whole token of the text, so a table from first tokens to aliases
    says where to compare; other aliases are searched for as they stand. Aliases that were found once are not looked for again.
    """

    def __init__(self, aliases: Iterable[tuple[int, str, bool]]):
        self.by_token: tuple[dict[str, dict[str, set[int]]], ...] = ({}, {})  # of texts as they are, and of lower-cased ones
        self.symbols: tuple[dict[str, set[int]], ...] = ({}, {})
        for term, alias, exact in aliases:
            which, alias = (0, alias) if exact else (1, alias.lower())
            token = TOKEN.match(alias)
            if token:
                self.by_token[which].setdefault(token.group(), {}).setdefault(alias, set()).add(term)
            elif alias:
                self.symbols[which].setdefault(alias, set()).add(term)

    @staticmethod
    def _ends(text: str, at: int) -> bool:
        return at == len(text) or not TOKEN.match(text, at)

    def found(self, text: str) -> set[int]:
        """Terms of the aliases that are found for the first time."""
        out: set[int] = set()
        for which in (0, 1):
            table, symbols = self.by_token[which], self.symbols[which]
            if which:
                text = text.lower()
            for token in TOKEN.finditer(text) if table else ():
                rest = table.get(token.group())
                if rest:
                    hits = [a for a in rest if text.startswith(a, token.start()) and self._ends(text, token.start() + len(a))]
                    for alias in hits:
                        out |= rest.pop(alias)
                    if not rest:
                        del table[token.group()]
            for alias in list(symbols):
                at = text.find(alias)
                while at >= 0 and not (self._ends(text, at + len(alias)) and (at == 0 or not TOKEN.match(text, at - 1))):
                    at = text.find(alias, at + 1)
                if at >= 0:
                    out |= symbols.pop(alias)
        return out


def terms_found(corpus: DataFrame, terms: DataFrame, block: int = BLOCK_TERMS) -> DataFrame:
    """name, definition of the terms that some text of `corpus` (text) mentions, between characters other than letters and digits.

    terms: (name, definition, alias, case_sensitive), one row for each alias; an alias without letters or digits may be one. Each text is
    read once for every `block` aliases, the blocks by a hash of the alias, and a task sends each term once.
    """
    blocks = -(-terms.count() // block)
    numbered = terms.select("name", "definition", "alias", "case_sensitive", F.pmod(F.xxhash64("alias"), F.lit(max(blocks, 1))).alias("block"))
    texts = corpus.select("text").filter("text is not null")
    found = terms.select("name", "definition").limit(0)
    for k in range(blocks):
        own = numbered.filter(F.col("block") == k).select("name", "definition", "alias", "case_sensitive").collect()  # about `block` rows
        names = sorted({(r.name, r.definition) for r in own}, key=repr)
        at = {n: i for i, n in enumerate(names)}
        aliases = [(at[r.name, r.definition], r.alias, bool(r.case_sensitive)) for r in own if r.alias]

        def run(batches: Iterator[pa.RecordBatch], aliases=aliases) -> Iterator[pa.RecordBatch]:
            matcher = TermMatcher(aliases)
            for batch in batches:
                for text in batch.column("text"):
                    if new := matcher.found(text.as_py()):
                        yield pa.RecordBatch.from_arrays([pa.array(sorted(new), pa.int32())], ["term"])

        said = corpus.sparkSession.createDataFrame([(i, *n) for i, n in enumerate(names)], "term int, name string, definition string")
        found = found.union(said.join(texts.mapInArrow(run, "term int").distinct(), "term").select("name", "definition"))
    return found.distinct()


def glossary_corpus(readme: DataFrame, packages: DataFrame, modules: DataFrame, descriptions: DataFrame) -> DataFrame:
    """text: what a report says without prose of an enrichment (README, package names, modules and their descriptions)."""
    parts = readme.select(F.explode(F.concat(F.array("first_paragraph"), "headings")).alias("text"))
    return parts.union(packages.select("name")).union(modules.select("module")).union(descriptions.select("description")).filter("text <> ''")


def glossary(languages: DataFrame, ecosystems: DataFrame, corpus: DataFrame, terms: DataFrame) -> DataFrame:
    """kind, name, definition of a report's glossary: languages and ecosystems that the tree has, all structural terms, and the tools,
    libraries and services that its text mentions.

    terms: (kind, name, definition, alias, case_sensitive), kind one of language, ecosystem, term, tool; languages and ecosystems: (name).
    """
    of = lambda kind: terms.filter(F.col("kind") == kind)
    there = lambda kind, names: of(kind).join(names.select("name").distinct(), "name", "left_semi").select("kind", "name", "definition").distinct()
    tools = terms_found(corpus, of("tool")).select(F.lit("tool").alias("kind"), "name", "definition")
    return there("language", languages).union(there("ecosystem", ecosystems)).union(of("term").select("kind", "name", "definition").distinct()).union(tools)
