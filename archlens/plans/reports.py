"""Queries of rankings, totals, checks and second forms of rules over corpora made from the tables, with SQL for each."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from archlens.operators import enrich, graph, insight, project, report, rollup
from archlens.operators.discover import place
from archlens.operators.extract import clients, endpoints, imports, models
from archlens.operators.resolve import http, import_edges, module_table
from archlens.plans import corpus, facts, queries as base
from archlens.sources.shared import stored


def _modules(spark: SparkSession, folder: str) -> DataFrame:
    return module_table(place(corpus.import_corpus(spark, folder)))


def _case(spark: SparkSession, folder: str, path: str, text: str) -> DataFrame:
    return corpus.case_corpus(spark, folder, "supplier", "s_suppkey", path, text)


def _join(spark: SparkSession, folder: str, *cases: tuple[str, str]) -> DataFrame:
    files = _case(spark, folder, *cases[0])
    for case in cases[1:]:
        files = files.union(_case(spark, folder, *case))
    return files


def _clamped(spark: SparkSession, folder: str) -> DataFrame:
    found = base.python_graph(spark, folder)
    return report.graph_within(found.edges, report.modules_at(found.modules, "shallow"))


def _traced(spark: SparkSession, folder: str) -> DataFrame:
    return report.traced(facts._paths(spark, folder)[1])


def _path_rules(spark: SparkSession, folder: str) -> DataFrame:
    found, paths = facts._paths(spark, folder)
    return insight.path_observations(paths, found.edges().count())


def _first_rules(spark: SparkSession, folder: str) -> DataFrame:
    every = stored(facts._graph(spark, folder).unionByName(facts._lineage_notes(spark, folder)))
    return insight.first_rules(every, ["unlinked_store", "shared_store", "fan_in", "fan_out"], 3).select("rule", "subject", "value")


def _sections(spark: SparkSession, folder: str) -> DataFrame:
    found = http(place(corpus.http_corpus(spark, folder)))
    calls, known = stored(found.edges()), corpus.table(spark, folder, "region").select(F.concat(F.lit("svc"), "r_regionkey").alias("service"))
    lineage = facts._lineage(spark, folder)
    return report.sections(calls, known, report.entry_modules(found.served), facts._stores(spark, folder), lineage)


def _prefixed(spark: SparkSession, folder: str) -> DataFrame:
    """A service for each supplier that states a prefix for its controllers, and calls to it with and without the prefix.

    A literal id reaches the collection's route, never that of ":id"; a call of the bare prefix reaches nothing.
    """
    files = _join(
        spark, folder, ("api{k}/src/main.ts", 'app.setGlobalPrefix("api/v2");\n'), ("api{k}/src/m/c{k}.ts", '@Controller("c{k}")\nclass C {\n  @Get() all() {}\n  @Get(":id") one() {}\n}\n'),
        ("web{k}/src/m/a.ts", "axios.get('/c{k}/7')\naxios.get('/api/v2/c{k}/8')\naxios.get('/api/v2')\naxios.get('/none')\n"))
    return http(place(files)).edges()


def _single(spark: SparkSession, folder: str) -> DataFrame:
    """A tree without service directories: the tree is the service, also of the modules and files that `place` says to be of none."""
    files = _join(spark, folder, ("main.py", "import a\n"), ("docs/d{k}.md", "x\n"), ("src/m{k}/a.py", "import m{k}\nimport x\n"))
    return place(files, "tree").groupBy(F.coalesce("service", F.lit("tree")).alias("service"), "module").agg(F.count("*").alias("files"))


def _workspace(spark: SparkSession, folder: str) -> DataFrame:
    """Packages known by the names in their modules' own package.json, and other packages."""
    files = _join(spark, folder, ("svc/packages/p{k}/package.json", '{"name": "@org/p{k}"}\n'), ("svc/packages/q{k}/i.ts", 'import x from "@org/p{k}/deep"\nimport "react"\nexport * from "@org/p{k}"\nconst y = require("@org/none")\n'))
    return import_edges(place(files))


def _go_module(spark: SparkSession, folder: str) -> DataFrame:
    """Go imports below the prefix of the root's go.mod, as single lines and in blocks, and of other modules."""
    files = _join(spark, folder, ("svc/src/a{k}/a.go", 'package a\nimport "x.org/repo/svc/src/b{k}"\nimport (\n\t"fmt"\n\ty "x.org/repo/svc/src/b{k}/inner"\n\t"x.org/repository/svc/src/b{k}"\n)\n'), ("svc/src/b{k}/b.go", "package b\n"))
    root = files.limit(1).select(F.lit("go.mod").alias("path"), F.lit("// tools\nmodule x.org/repo\n\ngo 1.22\n").alias("text"))
    return import_edges(place(corpus.typed(files.select("path", "text").union(root))))


def _candidates(spark: SparkSession, folder: str) -> DataFrame:
    files = _join(spark, folder, ("README.md", "# T\n"), ("m{k}/README", "x\n"), ("m{k}/x/package.json", "{}\n"), ("m{k}/y/main.py", "\n"), ("m{k}/y/urls.py", "\n"), ("m{k}/z.py", "\n")).distinct()
    modules = corpus.table(spark, folder, "supplier").select(F.concat(F.lit("m"), "s_suppkey").alias("module"), (-F.col("s_suppkey")).alias("loc"))
    return project.evidence_candidates(files, modules, 1_000_000).select("ord", "path")


def _documents(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """An enrichment for each supplier; every fifth is no JSON, every third flow cites a missing file."""
    k = F.col("s_suppkey")
    step = F.concat(F.lit('{"file":"f'), F.when(k % 3 == 0, F.lit("-1")).otherwise(k.cast("string")), F.lit('.py","symbol":"go"}'))
    text = F.concat(
        F.lit('{"schema_version":'), F.when(k % 4 == 0, F.lit("2")).otherwise(F.lit("1")), F.lit(',"overview":{"what_it_is":"a","what_it_does":"b","how_it_works":"","confidence":"high"},"flows":[{"name":"x","kind":"odd","steps":[]},{"name":"n'),
        k.cast("string"), F.lit('","kind":"request","trigger":"t","terminates":"u","steps":['), step, F.lit("]}]}"))
    rows = corpus.table(spark, folder, "supplier").select(k.cast("string").alias("path"), F.when(k % 5 == 0, F.concat(F.lit("["), text)).otherwise(text).alias("text"))
    files = corpus.table(spark, folder, "supplier").select(F.concat(F.lit("f"), "s_suppkey", F.lit(".py")).alias("path"))
    return enrich.parse(rows), files


def _terms(spark: SparkSession, folder: str) -> DataFrame:
    """Words of documents as terms: alias boundaries, letter case, and terms that no text has."""
    words = [("w1", "the", "the", False), ("w2", "of", "OF", True), ("w3", "of", "OF", False), ("w4", "none", "qqzzqq", False), ("w5", "dot", "un.", False), ("w6", "part", "th", False)]
    terms = spark.createDataFrame(words, "name string, definition string, alias string, case_sensitive boolean")
    return enrich.terms_found(corpus.table(spark, folder, "documents").select("text"), terms)


def _hits(spark: SparkSession, folder: str) -> DataFrame:
    """Hits of a parser for each supplier, of every rule."""
    raw = [("py-import", "a{k}.b as c"), ("py-from-import", ".local"), ("ts-import", '"../x/y{k}"'), ("js-require", "'@s/p{k}/q'"), ("go-import", 'z "x.org/r/d{k}"'), ("go-import", '"x.org/r"'), ("go-import", '"fmt"'), ("elixir-ref", "A{k}.{B, C.D}"), ("elixir-ref", "A{k}."), ("elixir-defmodule", " M{k} "), ("ts-import", "''")]
    rule = F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(c).alias("c")) for r, c in raw])).alias("x")
    rows = corpus.table(spark, folder, "supplier").select(F.concat(F.lit("d/e/f"), "s_suppkey").alias("file"), "s_suppkey", rule)
    hits = rows.select("file", "x.rule", F.replace("x.c", F.lit("{k}"), F.col("s_suppkey").cast("string")).alias("captured"))
    return insight.parsed_imports(hits, "x.org/r")


#: Second forms of rules, negatives beside them, in one corpus for each family: (path, text, rows).
MIXED_ENDPOINTS = [
    ("svc/src/m/a{k}.ts", "app.use('/mw{k}', h)\nfastify.all(`/all/{k}/:x`, h)\n// myapp.get('/ok{k}')\nserver.get(\n  '/multi/{k}', h)\nhono.patch('', h)\nobj.route('/no')\n", [("Express", "ALL", "/all/:id"), ("Express", "GET", "/multi/{k}")]),
    ("svc/src/m/b{k}.py", "@bp.route('/b/{k}/<uuid:x>', methods=['GET', \"POST\"])\n@users_router.delete('/d/{k}')\n@thing.get('/no')\npath('x/{k}')\n", [("Flask", "GET", "/b/{k}/:id"), ("Flask", "POST", "/b/{k}/:id"), ("FastAPI", "DELETE", "/d/{k}")]),
    ("svc/src/m/c{k}.rb", "  resources :posts{k}\n  match '/m/{k}', via: :all\n  # get '/no'\n  getter '/no'\n", [("Rails", "ANY", "/posts{k}"), ("Rails", "MATCH", "/m/{k}")]),
    ("svc/src/m/d{k}.txt", "app.get('/no')\n", []),
]
MIXED_CLIENTS = [
    ("svc/src/m/a{k}.ts", "import { get, post } from '../api'\nget<T>('/g/{k}')\npost(`/p/{k}?q=1`)\nfetch(`/f/{k}`, { headers: {}, method: 'delete' })\nconst axiosx = 1\napi.send('/s/{k}')\n", None),
]
MIXED_MODELS = [
    ("svc/src/m/a{k}.py", "class A{k}(Mixin, Base):\n  pass\nsession.query(B{k})\nselect(C{k})\nclass D{k}(Other):\n  pass\nE{k}.objects.filter()\nF{k}.objectsx.all()\n", [("SQLAlchemy", "A{k}"), ("SQLAlchemy", "B{k}"), ("SQLAlchemy", "C{k}"), ("Django ORM", "E{k}")]),
    ("svc/src/m/b{k}.rb", "class G{k} < ApplicationController\nclass H{k} < ApplicationRecord\n", [("ActiveRecord", "H{k}")]),
]


def _mixed(spark: SparkSession, folder: str, cases: list) -> DataFrame:
    return _join(spark, folder, *[(path, text) for path, text, _ in cases])


def queries() -> dict:
    h = lambda s, d: http(place(corpus.http_corpus(s, d)))
    return {
        "project_totals": lambda s, d: report.totals(corpus.document_corpus(s, d)),
        "service_shares": lambda s, d: report.services(place(corpus.import_corpus(s, d))).withColumn("share", F.round("share", 6)),
        "module_cards": lambda s, d: report.modules_at(_modules(s, d), "shallow").select("module", "loc"),
        "matrix_clamp": _clamped,
        "hottest_edges": lambda s, d: report.hottest(base._python_edges(s, d)),
        "service_neighbours": lambda s, d: report.neighbours(h(s, d).edges()),
        "referenced_services": lambda s, d: report.referenced(corpus.table(s, d, "nation").select(F.concat(F.lit("svc"), "n_nationkey").alias("service")), h(s, d).edges()),
        "entries_per_service": lambda s, d: report.entries_per_service(report.entry_modules(h(s, d).served)),
        "endpoint_methods": lambda s, d: report.methods(endpoints(_mixed(s, d, MIXED_ENDPOINTS))),
        "endpoints_by_service": lambda s, d: report.endpoints_by_service(h(s, d).served),
        "detected_libraries": lambda s, d: (lambda x: report.detected(x.served, x.calls))(h(s, d)),
        "endpoint_coverage": lambda s, d: (lambda x: report.coverage(x.edges(), x.served))(h(s, d)).withColumn("coverage", F.round("coverage", 6)),
        "lineage_by_service": lambda s, d: report.lineage_by_service(facts._lineage(s, d)).withColumn("frameworks", F.array_join("frameworks", ",")),
        "store_order": lambda s, d: report.store_order(facts._stores(s, d), facts._lineage(s, d)),
        "store_writers": lambda s, d: report.store_writers(facts._lineage(s, d)),
        "parsed_languages": lambda s, d: report.parsed_languages(place(corpus.document_corpus(s, d))),
        "traced_paths": _traced,
        "top_paths": lambda s, d: report.top_paths(facts._paths(s, d)[1], 7).select("service", "module", "endpoint_count"),
        "path_observations": _path_rules,
        "first_observations": _first_rules,
        "report_sections": _sections,
        "tree_levels": lambda s, d: report.tree(rollup.directories(corpus.import_corpus(s, d)), "shallow"),
        "linear_chain": lambda s, d: rollup.is_chain(graph.tiers(base._tree_edges(s, d)), base._tree_edges(s, d)),
        "prefixed_http_edges": _prefixed,
        "single_service": _single,
        "workspace_edges": _workspace,
        "go_module_edges": _go_module,
        "evidence_candidates": _candidates,
        "enrichment_errors": lambda s, d: enrich.errors(*_documents(s, d)),
        "enrichment_flows": lambda s, d: enrich.kept_flows(*_documents(s, d)),
        "glossary_terms": _terms,
        "parsed_imports": _hits,
        "mixed_endpoints": lambda s, d: endpoints(_mixed(s, d, MIXED_ENDPOINTS)).select("file", "framework", "method", "path"),
        "mixed_clients": lambda s, d: clients(_mixed(s, d, MIXED_CLIENTS)).select("file", "client", "method", "url"),
        "mixed_models": lambda s, d: models(_mixed(s, d, MIXED_MODELS)).select("framework", "model"),
        "mixed_imports": lambda s, d: imports(_mixed(s, d, MIXED_IMPORTS).withColumns({"service": F.lit(None).cast("string"), "module": F.lit("m")}), "x.org/r").select("file", "kind", "target"),
    }


MIXED_IMPORTS = [
    ("d/m/a{k}.py", "import a{k}.b, c\nfrom .rel import x\nfrom ..up{k} import x\nfrom pkg{k}.sub import y\n  import late\nimporter = 1\n# import hidden\n", [("name", "a{k}"), ("name", "pkg{k}"), ("name", "late")]),
    ("d/m/b{k}.ts", 'import a, { b } from "./x{k}/../y"\nexport { c } from \'@s/p{k}\'\nconst d = require("q/deep")\nconst e = await import("../z")\nimport "side"\n', [("path", "d/m/y"), ("package", "@s/p{k}"), ("package", "q"), ("path", "d/z"), ("package", "side")]),
    ("d/m/c{k}.ex", "  alias A{k}.{B, C}\n  use D{k}.E\n  require F{k}\n", [("ref", "A{k}.B"), ("ref", "A{k}.C"), ("ref", "A{k}"), ("ref", "D{k}.E"), ("ref", "F{k}")]),
    ("d/m/e{k}.go", 'import x "x.org/r/s{k}"\nimport "x.org/r"\nimport "x.org/rr/s"\n', [("inner", "s{k}"), ("inner", "")]),
]

_SERVICES = "SELECT 'svc' || n_regionkey AS service, count(*) AS files, CAST(sum(greatest(1, n)) AS BIGINT) AS loc FROM (SELECT o_custkey, count(l_orderkey) AS n FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey, o_custkey) JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1"
_ENDPOINTS = "SELECT 'svc' || n_regionkey AS service, 'svc' || n_regionkey || '/src/m' || n_nationkey AS module, s_suppkey FROM supplier JOIN nation ON s_nationkey = n_nationkey"


def _rows(cases: list, names: tuple[str, ...], file: bool = True) -> str:
    each = []
    for path, _, rows in cases:
        for row in rows:
            own = [f"{facts._literal(path)} AS file"] if file else []
            each.append(f"SELECT {', '.join([*own, *(f'{facts._literal(v)} AS {n}' for n, v in zip(names, row, strict=True))])} FROM supplier")
    return " UNION ALL ".join(each)


def oracle_sql() -> dict[str, str]:
    k = "CAST(s_suppkey AS VARCHAR)"
    numbered = "row_number() OVER (PARTITION BY {by} ORDER BY {order})"
    pairs = f"SELECT source_service AS s, target_service AS t, CAST(sum(weight) AS BIGINT) AS n FROM ({base._HTTP}) GROUP BY 1, 2"
    both = "SELECT s AS service, 'out' AS direction, t AS other, n AS calls FROM p UNION ALL SELECT t, 'in', s, n FROM p"
    doc = "FROM supplier WHERE s_suppkey % 5 <> 0"
    known = facts.oracle_sql()
    return {
        "project_totals": f"SELECT count(*) AS files, CAST(sum({base._LOC}) AS BIGINT) AS loc, (SELECT arg_min(name, (-loc, name)) FROM (SELECT {base._LANG} AS name, sum({base._LOC}) AS loc FROM documents GROUP BY 1)) AS primary_language FROM documents",
        "service_shares": f"SELECT service, files, loc, 'Python' AS primary_language, round(loc / sum(loc) OVER (), 6) AS share FROM ({_SERVICES})",
        "module_cards": f"SELECT module, CAST(loc AS BIGINT) AS loc FROM ({facts._MODULES}) ORDER BY loc DESC, module LIMIT 10",
        "matrix_clamp": f"WITH m AS (SELECT module FROM ({facts._MODULES}) ORDER BY loc DESC, module LIMIT 10) SELECT * FROM ({base._SAME}) WHERE source IN (FROM m) AND target IN (FROM m)",
        "hottest_edges": f"SELECT * FROM ({base._SAME}) ORDER BY weight DESC, source, target LIMIT 10",
        "service_neighbours": f"WITH p AS ({pairs}) SELECT service, direction, other, calls, CAST({numbered.format(by='service, direction', order='calls DESC, other')} AS INTEGER) AS rank FROM ({both})",
        "referenced_services": f"WITH p AS ({pairs}) SELECT 'svc' || n_nationkey AS service FROM nation WHERE 'svc' || n_nationkey IN (SELECT s FROM p UNION SELECT t FROM p)",
        "entries_per_service": f"SELECT * FROM (SELECT service, module, n AS endpoint_count, CAST({numbered.format(by='service', order='n DESC, module')} AS INTEGER) AS rank FROM (SELECT service, module, count(*) AS n FROM ({_ENDPOINTS}) GROUP BY 1, 2)) WHERE rank <= 3",
        "endpoint_methods": "SELECT * FROM (SELECT count(*) * 2 AS n FROM supplier) CROSS JOIN (VALUES ('GET', 1)) t(method, place) UNION ALL SELECT count(*), m, p FROM supplier, (VALUES ('POST', 2), ('DELETE', 3), ('ANY', 4), ('ALL', 5), ('MATCH', 6)) t(m, p) GROUP BY m, p",
        "endpoints_by_service": f"SELECT service, count(*) AS n FROM ({_ENDPOINTS}) GROUP BY 1 ORDER BY n DESC, service LIMIT 8",
        "detected_libraries": "SELECT DISTINCT 'framework' AS kind, CASE s_suppkey % 2 WHEN 0 THEN 'Express' ELSE 'NestJS' END AS name FROM supplier UNION ALL SELECT 'client', 'axios'",
        "endpoint_coverage": f"SELECT (SELECT count(*) FROM ({base._HTTP})) AS edges, count(*) AS endpoints, round((SELECT count(*) FROM ({base._HTTP})) / count(*), 6) AS coverage FROM supplier",
        "lineage_by_service": f"WITH l AS ({base._LINEAGE}), f AS (SELECT service, string_agg(DISTINCT framework, ',' ORDER BY framework) AS frameworks FROM ({base._MODELS}) GROUP BY 1), s AS (SELECT source_service AS service, CAST(sum(weight) AS BIGINT) AS models FROM l GROUP BY 1) SELECT service, models, frameworks, CAST(row_number() OVER (ORDER BY models DESC, service) AS INTEGER) AS rank FROM s JOIN f USING (service)",
        "store_order": f"WITH l AS (SELECT target_store AS id, CAST(sum(weight) AS BIGINT) AS n FROM ({base._LINEAGE}) GROUP BY 1), s AS (SELECT DISTINCT {facts._KIND} AS id FROM supplier) SELECT id, coalesce(n, 0) AS models, CAST(row_number() OVER (ORDER BY coalesce(n, 0) DESC, id) AS INTEGER) AS rank FROM s LEFT JOIN l USING (id)",
        "store_writers": f"SELECT target_store AS store, source_service AS service, weight AS models, CAST({numbered.format(by='target_store', order='weight DESC, source_service')} AS INTEGER) AS rank FROM ({base._LINEAGE})",
        "parsed_languages": f"SELECT DISTINCT {base._LANG} AS language, {base._LANG} IN ('Python', 'TypeScript', 'Go', 'Elixir') AS parsed FROM documents WHERE {base._LANG} NOT IN ('Python', 'TypeScript', 'Go', 'Elixir') OR length(text) > 0",
        "traced_paths": f"SELECT count(*) AS paths, count(*) FILTER (WHERE callers <> '' AND deps <> '' AND store IS NOT NULL) AS traced, count(*) FILTER (WHERE callers = '') AS orphans FROM ({facts.critical_paths_sql()})",
        "top_paths": f"SELECT service, module, endpoint_count FROM ({facts.critical_paths_sql()}) ORDER BY endpoint_count DESC, service, module LIMIT 7",
        "path_observations": f"""WITH p AS ({facts.critical_paths_sql()}), s AS (SELECT count(*) AS n, count(*) FILTER (WHERE callers = '') AS orphans, CAST(sum(endpoint_count) AS BIGINT) AS e, count(DISTINCT store) AS stores, max(store) AS store FROM p), h AS (SELECT count(*) AS c FROM ({base._HTTP}))
            SELECT * FROM (SELECT 'most_exposed' AS rule, module AS subject, endpoint_count AS value FROM p WHERE endpoint_count >= 8 ORDER BY endpoint_count DESC, service, module LIMIT 1)
            UNION ALL SELECT 'no_callers', '', orphans FROM s WHERE orphans > 0 UNION ALL SELECT 'one_store', store, n FROM s WHERE stores = 1 AND n >= 5
            UNION ALL SELECT 'coverage', '', CAST(floor(1000 * c / e) AS BIGINT) FROM s, h WHERE c > 0 AND c < 0.4 * e""",
        "first_observations": f"""WITH o AS (SELECT * FROM ({known["graph_observations"]}) UNION ALL SELECT * FROM ({known["lineage_observations"]})) SELECT rule, subject, value FROM o WHERE rule IN ('unlinked_store', 'shared_store', 'fan_in', 'fan_out')
            ORDER BY list_position(['unlinked_store', 'shared_store', 'fan_in', 'fan_out'], rule), value DESC, subject LIMIT 3""",
        "report_sections": f"WITH p AS ({pairs}) SELECT 'topology' AS section, count(*) > 0 AS shown FROM p UNION ALL SELECT 'critical_paths', count(*) > 0 FROM supplier UNION ALL SELECT 'lineage', (SELECT count(*) FROM supplier) + (SELECT count(*) FROM ({base._LINEAGE})) > 0",
        "tree_levels": f"""WITH d AS (SELECT service AS dir, files, loc, 1 AS level, '' AS up FROM ({_SERVICES}) UNION ALL SELECT service || '/src', files, loc, 2, service FROM ({_SERVICES}))
            SELECT dir, files, loc, level, CAST(row_number() OVER (PARTITION BY up ORDER BY dir) AS INTEGER) AS place FROM d""",
        "linear_chain": f"SELECT count(*) = count(DISTINCT tier) AND (SELECT count(*) FROM (SELECT DISTINCT unnest([p_partkey // 8, p_partkey // 64]) AS s, p_partkey AS t FROM part WHERE p_partkey > 0)) = count(*) - 1 AS linear FROM ({base.tiers_sql()})",
        "prefixed_http_edges": f"SELECT 'web' || {k} AS source_service, 'api' || {k} AS target_service, 'GET' AS method, '/api/v2/c' || {k} AS path, CAST(2 AS BIGINT) AS weight FROM supplier",
        "single_service": f"SELECT 'tree' AS service, NULL AS module, 2 * count(*) AS files FROM supplier UNION ALL SELECT 'tree', 'src/m' || {k}, 1 FROM supplier",
        "workspace_edges": f"SELECT 'svc/packages/q' || {k} AS source, 'svc/packages/p' || {k} AS target, CAST(2 AS BIGINT) AS weight FROM supplier",
        "go_module_edges": f"SELECT 'svc/src/a' || {k} AS source, 'svc/src/b' || {k} AS target, CAST(2 AS BIGINT) AS weight FROM supplier",
        "evidence_candidates": f"""WITH c AS (SELECT 'README.md' AS path, 1 AS a, 0 AS b, 0 AS c, 0 AS d UNION ALL SELECT 'm' || {k} || '/README', 3, s_suppkey, 0, 0 FROM supplier UNION ALL SELECT 'm' || {k} || '/x/package.json', 3, s_suppkey, 1, 0 FROM supplier
            UNION ALL SELECT 'm' || {k} || '/y/main.py', 4, 0, 0, 0 FROM supplier UNION ALL SELECT 'm' || {k} || '/y/urls.py', 5, 0, 0, 0 FROM supplier) SELECT CAST(row_number() OVER (ORDER BY a, b, c, path) - 1 AS INTEGER) AS ord, path FROM c""",
        "enrichment_errors": f"""SELECT {k} AS key, 'schema_version' AS place, 'not 1' AS error {doc} AND s_suppkey % 4 = 0 UNION ALL SELECT {k}, 'overview', 'missing how_it_works' {doc} UNION ALL SELECT {k}, 'flows[0]', unnest(['missing trigger', 'missing terminates', 'unknown kind', 'no steps']) {doc}
            UNION ALL SELECT {k}, 'flows[1].steps[0]', 'cited file not found' {doc} AND s_suppkey % 3 = 0""",
        "enrichment_flows": f"SELECT {k} AS key, 1 AS flow, 'n' || {k} AS name, 'request' AS kind, 1 AS lane {doc} AND s_suppkey % 3 <> 0",
        "glossary_terms": """SELECT DISTINCT name, definition FROM (SELECT text FROM documents), (VALUES ('w1', 'the', 'the', false), ('w2', 'of', 'OF', true), ('w3', 'of', 'of', false), ('w4', 'none', 'qqzzqq', false), ('w5', 'dot', 'un.', false), ('w6', 'part', 'th', false)) t(name, definition, alias, exact)
            WHERE regexp_matches(CASE WHEN exact THEN text ELSE lower(text) END, '(^|[^A-Za-z0-9])' || replace(alias, '.', '[.]') || '($|[^A-Za-z0-9])')""",
        "parsed_imports": " UNION ALL ".join(f"SELECT 'd/e/f' || {k} AS file, '{kind}' AS kind, {facts._literal(t)} AS target FROM supplier" for kind, t in (("name", "a{k}"), ("path", "d/x/y{k}"), ("package", "@s/p{k}"), ("inner", "d{k}"), ("inner", ""), ("ref", "A{k}.B"), ("ref", "A{k}.C.D"), ("ref", "A{k}"), ("def", "M{k}"))),
        "mixed_endpoints": _rows(MIXED_ENDPOINTS, ("framework", "method", "path")).replace("'/all/:id'", "'/all/' || s_suppkey || '/:id'"),
        "mixed_clients": _rows([(MIXED_CLIENTS[0][0], "", [("local API wrapper", "GET", "/g/{k}"), ("fetch", "GET", "/f/{k}"), ("httpClient (custom)", "ANY", "/s/{k}")])], ("client", "method", "url")),
        "mixed_models": _rows(MIXED_MODELS, ("framework", "model"), False),
        "mixed_imports": _rows(MIXED_IMPORTS, ("kind", "target")),
    }
