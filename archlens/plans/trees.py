"""Queries over trees, graphs with rings, glossaries, parser hits and stored relations that grow with the tables, with SQL for each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from archlens.operators import enrich, graph, insight, report, rollup
from archlens.operators.discover import place
from archlens.operators.extract import imports
from archlens.operators.resolve import http, import_edges
from archlens.plans import corpus
from archlens.plans import queries as base
from archlens.sources.relations import read_relations, write_relations
from archlens.sources.shared import new_folder
from archlens.sources.tree import typed


def _text(*parts: str | Column) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def _files(*parts: DataFrame) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.union(part)
    return out


def _pair(df: DataFrame, path: Column, text: Column) -> DataFrame:
    return df.select(path.alias("path"), text.alias("text"))


def _mixed_tree(spark: SparkSession, folder: str) -> DataFrame:
    """The documents as files; every ninth is binary."""
    files = corpus.document_corpus(spark, folder)
    binary = F.regexp_extract("path", r"_(\d+)\.", 1).cast("long") % 9 == 0
    return files.select("path", F.when(~binary, F.col("text")).alias("text"), "lang", F.when(~binary, F.col("loc")).alias("loc"))


def _directories(spark: SparkSession, folder: str) -> DataFrame:
    return rollup.directories(_mixed_tree(spark, folder)).withColumn("languages", F.array_join("languages", ","))


def _children(spark: SparkSession, folder: str) -> DataFrame:
    files = _mixed_tree(spark, folder)
    return report.tree_children(files, rollup.directories(files), "medium")


def _ring_edges(spark: SparkSession, folder: str) -> DataFrame:
    """Parts depend on the eighth of their number; every third block of five parts is a ring."""
    part, k = corpus.table(spark, folder, "part").filter("p_partkey > 0"), F.col("p_partkey")
    tree = part.select(F.floor(k / 8).alias("source"), k.alias("target"))
    ring = part.filter(F.floor(k / 5) % 3 == 0).select(k.alias("source"), F.when(k % 5 == 4, k - 4).otherwise(k + 1).alias("target"))
    # The last block may not be whole: its parts are no ring then.
    both = tree.union(ring.join(part.select(k.alias("target")).union(part.limit(1).select(F.lit(0).cast(part.schema["p_partkey"].dataType))), "target", "left_semi").select("source", "target"))
    return both.select(F.col("source").cast("string"), F.col("target").cast("string"))


def _many_prefixes(spark: SparkSession, folder: str) -> DataFrame:
    """A service for each order that states its own prefix; its client leaves the prefix out, names it, or asks for what isn't there."""
    orders, k = corpus.table(spark, folder, "orders").select("o_orderkey"), F.col("o_orderkey")
    orders = orders.repartition(corpus.tasks_for(orders), "o_orderkey")  # keys are dealt to tasks, not the texts made of them
    files = typed(_files(
        _pair(orders, _text("api", k, "/src/main.ts"), _text('app.setGlobalPrefix("p', k, '/v1");\n')),
        _pair(orders, _text("api", k, "/src/m/c.ts"), _text('@Controller("c', k, '")\nclass C {\n  @Get("all") all() {}\n}\n')),
        _pair(orders, _text("web", k, "/src/m/a.ts"), _text("axios.get('/c", k, "/all/7')\naxios.get('/p", k, "/v1/c", k, "/all')\naxios.get('/p", k, "/v1')\naxios.get('/c", k, "')\n")),
    ))
    return http(place(files)).edges()


def _outside(spark: SparkSession, folder: str) -> DataFrame:
    """Relative imports inside the tree, beyond its root, and of absolute paths."""
    supplier, k = corpus.table(spark, folder, "supplier"), F.col("s_suppkey")
    up = F.when(k % 3 == 0, "../../../../../").when(k % 3 == 1, "../").otherwise("/")
    lines = _text('import q from "', up, F.when(k % 3 == 1, "b").otherwise("s/src/b"), k, '"\nimport r from "../../../s/src/b', k, '/x"\n')
    files = _files(_pair(supplier, _text("s/src/a", k, "/i.ts"), lines), _pair(supplier, _text("s/src/b", k, "/j.ts"), F.lit("export {}\n")))
    return import_edges(place(typed(files)))


def _single_http(spark: SparkSession, folder: str) -> DataFrame:
    """A tree that is one service: its files are of no service, so its prefix stands before no route."""
    supplier, k = corpus.table(spark, folder, "supplier"), F.col("s_suppkey")
    main = corpus.table(spark, folder, "region").limit(1).select(F.lit("main.ts").alias("path"), F.lit('app.setGlobalPrefix("v1");\n').alias("text"))
    files = _files(main, _pair(supplier, _text("users/u", k, ".ts"), _text('@Controller("u', k, '")\nclass U {\n @Get() a() {}\n}\n')))
    return http(place(typed(files), "repo")).served.select("service", "module", "path")


def _domains(spark: SparkSession, folder: str) -> DataFrame:
    """A module for each supplier, in one of three domains of its service; the last service has one domain."""
    k, s = F.col("s_suppkey"), F.col("s_nationkey") % 4
    domain = F.when(s == 3, "d0").otherwise(_text("d", k % 3))
    modules = corpus.table(spark, folder, "supplier").select(_text("svc", s, "/", domain, "/m", k).alias("module"), _text("svc", s).alias("service"), (k % 7).alias("loc"))
    return insight.matrix_order(modules, 40)


def _card_modules(spark: SparkSession, folder: str) -> DataFrame:
    k = F.col("s_suppkey")
    return corpus.table(spark, folder, "supplier").select(_text("m", k).alias("module"), (k * 7 % 50).alias("loc"), F.when(k % 5 > 0, _text("own ", k)).alias("description"))


def _cards(spark: SparkSession, folder: str) -> DataFrame:
    supplier, k = corpus.table(spark, folder, "supplier"), F.col("s_suppkey")
    vendored = supplier.filter(k % 4 == 0).select(_text("m", k).alias("module"), F.lit("fork").alias("kind"))
    described = supplier.filter(k % 3 == 0).select(_text("m", k).alias("module"), F.when(k % 2 == 0, "").otherwise(_text("told ", k)).alias("description"))
    return report.cards(_card_modules(spark, folder), vendored, described)


def _parser_output(spark: SparkSession, folder: str) -> DataFrame:
    """An output of a parser for each supplier's file; every fifth is cut short, every seventh is no list."""
    k = F.col("s_suppkey")
    match = lambda rule, capture, extra="": _text('{"ruleId":"', rule, '","file":"./d/f', k, '.py","text":"import x"', extra, ',"metaVariables":{"single":{', capture, "}}}")
    module = _text('"MOD":{"text":"p', k, '.q"}')
    whole = _text("[", match("py-import", module), ",", match("py-from-import", '"MOD":{"text":".rel"}'), ",", match("no-such-rule", module), ',{"ruleId":"py-import"}]')
    said = F.when(k % 5 == 0, F.expr("left(whole, 40)")).when(k % 7 == 0, '{"error": "x"}').otherwise(F.col("whole"))
    return corpus.table(spark, folder, "supplier").withColumn("whole", whole).select(said.alias("text"))


def _chosen_imports(spark: SparkSession, folder: str) -> DataFrame:
    """A parser's hits where it has any for a file, what patterns find elsewhere."""
    supplier, k = corpus.table(spark, folder, "supplier"), F.col("s_suppkey")
    files = typed(_pair(supplier, _text("d/f", k, ".py"), _text("import s", k, "\nimport t\n"))).withColumns({"service": F.lit(None).cast("string"), "module": F.lit("d")})
    parsed = insight.parsed_imports(insight.hits_of(_parser_output(spark, folder)))
    return insight.prefer_parsed(imports(files).select("file", "kind", "target"), parsed)


def _round_trip(spark: SparkSession, folder: str) -> DataFrame:
    """Two relations written together and read again."""
    files = _mixed_tree(spark, folder)
    where = new_folder(spark, "relations")
    write_relations({"languages": rollup.languages(files.filter("loc is not null")), "directories": rollup.directories(files)}, where)
    back = read_relations(spark, where)
    return back["languages"].select(F.lit("languages").alias("relation"), F.col("name").alias("key"), "files", "loc").union(back["directories"].select(F.lit("directories"), "dir", "files", "loc"))


#: kind, name, definition, alias, case_sensitive
GLOSSARY = [
    ("language", "Python", "a language", "", False), ("language", "Cobol", "a language", "", False), ("ecosystem", "npm", "packages", "", False), ("ecosystem", "cargo", "packages", "", False),
    ("term", "module", "a part", "", False), ("tool", "Pipe", "a sign", "|", False), ("tool", "Word", "a word", "THE", False), ("tool", "Exact", "a word", "THE", True),
    ("tool", "Two", "two words", "of the", False), ("tool", "None", "no word", "qqzzqq", False), ("tool", "Sign", "a sign", "++", False),
]


def _glossary(spark: SparkSession, folder: str) -> DataFrame:
    """The glossary of a tree whose README is all documents' texts."""
    terms = spark.createDataFrame(GLOSSARY, "kind string, name string, definition string, alias string, case_sensitive boolean")
    files = corpus.document_corpus(spark, folder)
    readme = corpus.table(spark, folder, "documents").select(F.col("text").alias("first_paragraph"), F.array().cast("array<string>").alias("headings"))
    named = spark.range(1).select(F.lit("left-pad").alias("name"))
    modules = files.select(F.substring_index("path", "/", 2).alias("module")).distinct()
    told = modules.select(F.lit("C++ kept here").alias("description"))
    text = enrich.glossary_corpus(readme, named, modules, told)
    return enrich.glossary(rollup.languages(files), spark.range(1).select(F.lit("npm").alias("name")), text, terms)


def queries() -> dict:
    return {
        "dir_rollup": _directories,
        "tree_children": _children,
        "ring_tiers": lambda s, d: graph.tiers(_ring_edges(s, d)),
        "ring_components": lambda s, d: graph.strong_components(_ring_edges(s, d)),
        "many_prefixes": _many_prefixes,
        "edges_outside": _outside,
        "single_service_routes": _single_http,
        "matrix_dividers": _domains,
        "cards": _cards,
        "cards_medium": lambda s, d: report.modules_at(_card_modules(s, d), "medium").select("module", "loc"),
        "cards_full": lambda s, d: report.modules_at(_card_modules(s, d), "full").select("module", "loc"),
        "parser_hits": lambda s, d: insight.hits_of(_parser_output(s, d)),
        "chosen_imports": _chosen_imports,
        "relations_round_trip": _round_trip,
        "report_glossary": _glossary,
    }


def oracle_sql() -> dict[str, str]:
    loc, lang = base._LOC, base._LANG
    # One row for each file with its directories; binary files have no lines and no language.
    files = f"SELECT doc_id, source, lang, CASE WHEN doc_id % 9 = 0 THEN 0 ELSE {loc} END AS loc, CASE WHEN doc_id % 9 > 0 THEN {lang} END AS language FROM documents"
    dirs = f"""SELECT dir, count(*) AS files, CAST(sum(loc) AS BIGINT) AS loc, coalesce(string_agg(DISTINCT language, ',' ORDER BY language), '') AS languages
        FROM (SELECT unnest(['', source, source || '/' || lang]) AS dir, loc, language FROM ({files})) GROUP BY dir"""
    ext = "CASE doc_id % 8 WHEN 0 THEN '.py' WHEN 1 THEN '.ts' WHEN 2 THEN '.go' WHEN 3 THEN '.ex' WHEN 4 THEN '.rb' WHEN 5 THEN '.java' WHEN 6 THEN '.md' ELSE '.json' END"
    top = "(SELECT max(p_partkey) FROM part)"
    block = f"CASE WHEN {{k}} // 5 % 3 = 0 AND {{k}} // 5 * 5 + 4 <= {top} THEN {{k}} // 5 * 5 ELSE {{k}} END"
    # Whole blocks are rings; the rest of the last block is a chain.
    edges = f"""SELECT p_partkey // 8 AS s, p_partkey AS t FROM part WHERE p_partkey > 0 UNION ALL
        SELECT p_partkey, p_partkey + 1 FROM part WHERE p_partkey > 0 AND p_partkey // 5 % 3 = 0 AND p_partkey % 5 < 4 AND p_partkey < {top}"""
    ring = f"""WITH RECURSIVE n AS (SELECT DISTINCT unnest([s, t]) AS node FROM ({edges})), b AS (SELECT node, {block.format(k="node")} AS c FROM n),
        e AS (SELECT DISTINCT x.c AS s, y.c AS t FROM ({edges}) q JOIN b x ON q.s = x.node JOIN b y ON q.t = y.node WHERE x.c <> y.c),
        w(node, tier) AS (SELECT DISTINCT c, 0 FROM b WHERE c NOT IN (SELECT t FROM e) UNION SELECT e.t, w.tier + 1 FROM w JOIN e ON e.s = w.node)"""
    k = "CAST(s_suppkey AS VARCHAR)"
    clean = "s_suppkey % 5 > 0 AND s_suppkey % 7 > 0"
    cards = "SELECT 'm' || s_suppkey AS module, s_suppkey * 7 % 50 AS loc FROM supplier"
    domain = "SELECT 'svc' || s_nationkey % 4 AS service, CASE WHEN s_nationkey % 4 = 3 THEN 'd0' ELSE 'd' || s_suppkey % 3 END AS domain, s_suppkey % 7 AS loc, s_suppkey FROM supplier"
    return {
        "dir_rollup": dirs,
        "tree_children": f"""WITH x AS (SELECT dir AS path, 'dir' AS type, NULL AS language, loc FROM ({dirs}) WHERE dir <> '' UNION ALL SELECT source || '/' || lang || '/doc_' || doc_id || {ext}, 'file', {lang}, loc FROM ({files})),
            y AS (SELECT *, CASE WHEN contains(path, '/') THEN regexp_extract(path, '^(.*)/[^/]*$', 1) ELSE '' END AS parent FROM x)
            SELECT parent, path, type, language, loc, CAST(row_number() OVER (PARTITION BY parent ORDER BY type, lower(split_part(path, '/', -1)), path) AS INTEGER) AS place FROM y""",
        "ring_tiers": f"{ring}, m AS (SELECT node, max(tier) AS tier FROM w GROUP BY node) SELECT CAST(b.node AS VARCHAR) AS node, tier FROM b JOIN m ON b.c = m.node",
        "ring_components": f"{ring} SELECT CAST(node AS VARCHAR) AS node, min(CAST(node AS VARCHAR)) OVER (PARTITION BY c) AS component FROM b",
        "many_prefixes": "SELECT 'web' || o_orderkey AS source_service, 'api' || o_orderkey AS target_service, 'GET' AS method, '/p' || o_orderkey || '/v1/c' || o_orderkey || '/all' AS path, CAST(2 AS BIGINT) AS weight FROM orders",
        "edges_outside": f"SELECT 's/src/a' || {k} AS source, 's/src/b' || {k} AS target, CAST(CASE s_suppkey % 3 WHEN 1 THEN 2 ELSE 1 END AS BIGINT) AS weight FROM supplier",
        "single_service_routes": f"SELECT CAST(NULL AS VARCHAR) AS service, 'users' AS module, '/u' || {k} AS path FROM supplier",
        "matrix_dividers": f"""WITH m AS (SELECT *, row_number() OVER (ORDER BY service, domain, loc DESC, service || '/' || domain || '/m' || s_suppkey) - 1 AS idx FROM ({domain}) QUALIFY idx < 40)
            SELECT CAST(idx AS INTEGER) AS idx, service || '/' || domain || '/m' || s_suppkey AS module, service, CAST(dense_rank() OVER (ORDER BY service) - 1 AS BIGINT) AS block,
              coalesce(lag(domain) OVER (PARTITION BY service ORDER BY idx) <> domain, false) AS divider FROM m""",
        "cards": f"""SELECT module, loc, vendored, description, CAST(row_number() OVER (ORDER BY vendored IS NOT NULL, loc DESC, module) - 1 AS INTEGER) AS idx FROM (SELECT module, loc, CASE WHEN s_suppkey % 4 = 0 THEN 'fork' END AS vendored,
            CASE WHEN s_suppkey % 6 = 3 THEN 'told ' || s_suppkey WHEN s_suppkey % 4 > 0 AND s_suppkey % 5 > 0 THEN 'own ' || s_suppkey END AS description FROM ({cards}) c JOIN supplier ON module = 'm' || s_suppkey)""",
        "cards_medium": f"SELECT * FROM ({cards}) ORDER BY loc DESC, module LIMIT 25",
        "cards_full": cards,
        "parser_hits": f"SELECT 'd/f' || {k} || '.py' AS file, unnest(['py-import', 'py-from-import']) AS rule, unnest(['p' || {k} || '.q', '.rel']) AS captured FROM supplier WHERE {clean}",
        "chosen_imports": f"SELECT 'd/f' || {k} || '.py' AS file, 'name' AS kind, 'p' || {k} AS target FROM supplier WHERE {clean} UNION ALL SELECT 'd/f' || {k} || '.py', 'name', unnest(['s' || {k}, 't']) FROM supplier WHERE NOT ({clean})",
        "relations_round_trip": f"SELECT 'languages' AS relation, language AS key, count(*) AS files, CAST(sum(loc) AS BIGINT) AS loc FROM ({files}) WHERE language IS NOT NULL GROUP BY language UNION ALL SELECT 'directories', dir, files, loc FROM ({dirs})",
        "report_glossary": """SELECT 'language' AS kind, 'Python' AS name, 'a language' AS definition WHERE EXISTS (SELECT 1 FROM documents WHERE doc_id % 8 = 0) UNION ALL SELECT 'ecosystem', 'npm', 'packages' UNION ALL SELECT 'term', 'module', 'a part'
            UNION ALL SELECT DISTINCT 'tool', name, definition FROM (SELECT text FROM documents UNION ALL SELECT 'C++ kept here'), (VALUES ('Pipe', 'a sign', '|', false), ('Word', 'a word', 'the', false), ('Exact', 'a word', 'THE', true), ('Two', 'two words', 'of the', false), ('None', 'no word', 'qqzzqq', false), ('Sign', 'a sign', '++', false)) t(name, definition, alias, exact)
            WHERE regexp_matches(CASE WHEN exact THEN text ELSE lower(text) END, '(^|[^A-Za-z0-9])' || regexp_escape(alias) || '($|[^A-Za-z0-9])')""",
    }
