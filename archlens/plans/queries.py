"""Queries over corpora made from the tables, and SQL that gets the same results from the tables directly."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from archlens.functions.text import path_prefix, route
from archlens.operators import graph, manifests, report, rollup
from archlens.operators.discover import place
from archlens.operators.extract import clients, endpoints, models
from archlens.operators.resolve import Graph, Http, http, import_edges, import_graph, lineage_edges
from archlens.plans import corpus

#: key: (path, text, framework, method, route); {k} stands for the row's key.
ENDPOINT_CASES = {
    "nestjs": ("svc/src/m/c{k}.ts", '@Controller("c{k}")\nclass C {\n  @Get(":id") one() {}\n}\n', "NestJS", "GET", "/c{k}/:id"),
    "express": ("svc/src/m/e{k}.js", "app.post('/e/{k}/items', h)\napp.use('/x', y)\n", "Express", "POST", "/e/{k}/items"),
    "next_pages": ("svc/src/pages/api/p{k}/index.ts", "export default h\n", "Next.js (Pages Router)", "GET", "/api/p{k}"),
    "next_app": ("svc/src/app/api/a{k}/[slug]/route.ts", "export async function PUT(r) {}\n", "Next.js (App Router)", "PUT", "/api/a{k}/:id"),
    "fastapi": ("svc/src/m/f{k}.py", 'router = APIRouter(prefix="/v1")\n@router.get("/f/{k}/{item}")\n', "FastAPI", "GET", "/v1/f/{k}/:id"),
    "flask": ("svc/src/m/l{k}.py", "@app.route('/l/{k}', methods=['DELETE'])\n", "Flask", "DELETE", "/l/{k}"),
    "django": ("svc/src/m{k}/urls.py", "urlpatterns = [path('d/{k}/<int:pk>/', v)]\n", "Django", "ANY", "/d/{k}/:id"),
    "rails": ("svc/src/m/r{k}.rb", "  get '/r/{k}'\n", "Rails", "GET", "/r/{k}"),
    "spring": ("svc/src/m/S{k}.java", 'class S { @GetMapping("/s/{k}/{id}") void a() {} }\n', "Spring Boot", "GET", "/s/{k}/:id"),
    "laravel": ("svc/src/m/v{k}.php", "Route::any('/v/{k}', h);\n", "Laravel", "ANY", "/v/{k}"),
    "go_router": ("svc/src/m/g{k}.go", 'r.Handle("/g/{k}/", h)\n', "Go router", "ANY", "/g/{k}"),
}
#: A file whose call is stated by two rules: key: (path, text, [(framework, method, route)]).
GO_HTTP = ("svc/src/m/h{k}.go", 'http.HandleFunc("/h/{k}", f)\n', [("Go net/http", "ANY", "/h/{k}"), ("Go router", "ANY", "/h/{k}")])
CLIENT_CASES = {
    "axios": ("svc/src/m/a{k}.ts", "axios.post('/a/{k}/items/7')\n", [("axios", "POST", "/a/{k}/items/7")]),
    "axios_object": ("svc/src/m/o{k}.ts", "axios({ method: 'get', url: '/o/{k}' })\n", [("axios", "ANY", "/o/{k}")]),
    "fetch": ("svc/src/m/f{k}.ts", "fetch('/f/{k}')\nfetch('/f/{k}', { method: 'PUT' })\n", [("fetch", "GET", "/f/{k}"), ("fetch", "PUT", "/f/{k}")]),
    "ky": ("svc/src/m/k{k}.ts", "ky.patch('/k/{k}')\n", [("ky/got", "PATCH", "/k/{k}")]),
    "jquery": ("svc/src/m/j{k}.js", "$.ajax('/j/{k}')\n", [("jQuery", "ANY", "/j/{k}")]),
    "client_object": ("svc/src/m/c{k}.ts", "this.http.request<T>('/c/{k}')\n", [("httpClient (custom)", "ANY", "/c/{k}")]),
    "bare_verb": ("svc/src/m/b{k}.ts", "import { del } from './client'\ndel('/b/{k}')\n", [("local API wrapper", "DELETE", "/b/{k}")]),
    "requests": ("svc/src/m/r{k}.py", "requests.get('https://x.org/r/{k}')\n", [("requests/httpx", "GET", "https://x.org/r/{k}")]),
    "urllib": ("svc/src/m/u{k}.py", "urlopen('/u/{k}')\n", [("urllib", "GET", "/u/{k}")]),
    "aiohttp": ("svc/src/m/i{k}.py", "client.get('/i/{k}')\n", [("requests/httpx", "GET", "/i/{k}"), ("aiohttp", "GET", "/i/{k}")]),
    "go_http": ("svc/src/m/g{k}.go", 'http.NewRequest(method, "/g/{k}")\n', [("net/http", "NEWREQUEST", "/g/{k}")]),
    "ruby_http": ("svc/src/m/y{k}.rb", "Faraday.get('/y/{k}')\n", [("Net::HTTP/HTTParty/Faraday", "GET", "/y/{k}")]),
    "java_http": ("svc/src/m/J{k}.java", 'restTemplate.getForObject("/j/{k}", A.class);\n', [("RestTemplate/WebClient", "GETFOROBJECT", "/j/{k}")]),
}
MODEL_CASES = {
    "prisma": ("svc/src/m/p{k}.ts", "this.prisma.userLog{k}.create()\n", "Prisma", "Userlog{k}", "postgres"),
    "prisma_schema": ("svc/src/m{k}/schema.prisma", "model User{k} {\n", "Prisma", "User{k}", "postgres"),
    "sqlalchemy": ("svc/src/m/s{k}.py", "class User{k}(Base):\n", "SQLAlchemy", "User{k}", "postgres"),
    "mongoose": ("svc/src/m/g{k}.js", "mongoose.model('User{k}', s)\n", "Mongoose", "User{k}", "mongodb"),
    "django": ("svc/src/m/d{k}.py", "class User{k}(models.Model):\n", "Django ORM", "User{k}", "postgres"),
    "activerecord": ("svc/src/m/a{k}.rb", "class User{k} < ApplicationRecord\n", "ActiveRecord", "User{k}", "postgres"),
    "jpa": ("svc/src/m/j{k}.kt", "@Entity\nclass User{k}\n", "Spring Data JPA", "User{k}", "postgres"),
}

Query = Callable[[SparkSession, str], DataFrame]


def _cases() -> tuple[dict[str, Query], dict[str, str]]:
    queries: dict[str, Query] = {}
    sql: dict[str, str] = {}

    def literal(x: str, key: str) -> str:
        quoted = x.replace("'", "''")
        return f"replace('{quoted}', '{{k}}', CAST({key} AS VARCHAR))"

    shaped = {f"endpoints_{n}": (p, t, [(f, m, r)]) for n, (p, t, f, m, r) in ENDPOINT_CASES.items()} | {"endpoints_go_http": GO_HTTP}
    for name, (path, text, rows) in (shaped | {f"clients_{n}": c for n, c in CLIENT_CASES.items()}).items():
        serves = name.startswith("endpoints")
        table, key = ("supplier", "s_suppkey") if serves else ("customer", "c_custkey")

        def query(spark, folder, path=path, text=text, table=table, key=key, serves=serves):
            files = corpus.case_corpus(spark, folder, table, key, path, text)
            return endpoints(files).select("file", "framework", "method", "path") if serves else clients(files).select("file", "client", "method", "url")

        queries[name] = query
        names = ("framework", "path") if serves else ("client", "url")
        sql[name] = " UNION ALL ".join(f"SELECT {literal(path, key)} AS file, '{f}' AS {names[0]}, '{m}' AS method, {literal(r, key)} AS {names[1]} FROM {table}" for f, m, r in rows)
    for n, (path, text, framework, model, store) in MODEL_CASES.items():
        queries[f"models_{n}"] = lambda spark, folder, path=path, text=text: models(corpus.case_corpus(spark, folder, "supplier", "s_suppkey", path, text))
        sql[f"models_{n}"] = f"SELECT '{framework}' AS framework, {literal(model, 's_suppkey')} AS model, '{store}' AS store FROM supplier"
    return queries, sql


def python_graph(spark: SparkSession, folder: str) -> Graph:
    return import_graph(place(corpus.import_corpus(spark, folder)))


def _python_edges(spark: SparkSession, folder: str) -> DataFrame:
    return python_graph(spark, folder).edges


def _elixir_edges(spark: SparkSession, folder: str) -> DataFrame:
    files = corpus.import_corpus(spark, folder, ".ex", "  alias N{n}.Main", "defmodule N{n}.F{o} do\n")
    first = files.groupBy(F.regexp_extract("path", "^(.*)/[^/]*$", 1).alias("d")).agg(F.min("path").alias("p"))
    mains = first.select(F.concat("d", F.lit("/a_main.ex")).alias("path"), F.concat(F.lit("defmodule N"), F.regexp_extract("d", r"m(\d+)$", 1), F.lit(".Main do\n")).alias("text"))
    return import_edges(place(corpus.typed(files.select("path", "text").union(mains))))


def _fan(spark: SparkSession, folder: str) -> DataFrame:
    return rollup.degrees(_python_edges(spark, folder))


def _intra_cross(spark: SparkSession, folder: str) -> DataFrame:
    edges = _python_edges(spark, folder)
    same = F.substring_index("source", "/", 1).eqNullSafe(F.substring_index("target", "/", 1))
    return edges.agg(F.count_if(same).alias("intra"), F.count_if(~same).alias("crossing"))


def _http(spark: SparkSession, folder: str) -> Http:
    return http(place(corpus.http_corpus(spark, folder)))


def _routes(spark: SparkSession, folder: str) -> DataFrame:
    params = F.get(F.array(F.lit("{id}"), F.lit(":pid"), F.lit("<int:pk>"), F.lit("[slug]"), F.concat(F.lit("$"), F.lit("{x}"))), (F.col("page_id") % 5).cast("int"))
    return corpus.table(spark, folder, "pages").select("page_id", route(F.concat(F.lit("h//"), params, F.lit("/"), F.col("page_id") % 7, F.lit("/"))).alias("path"))


def _tree_edges(spark: SparkSession, folder: str) -> DataFrame:
    """Each part depends on the eighth and the sixty-fourth part of its number."""
    part, k = corpus.table(spark, folder, "part").filter("p_partkey > 0"), F.col("p_partkey")
    ends = F.explode(F.array(F.floor(k / 8), F.floor(k / 64))).alias("source")
    return part.select(ends, k.alias("target")).select(F.col("source").cast("string"), F.col("target").cast("string"))


def _lineage(spark: SparkSession, folder: str) -> DataFrame:
    found = models(place(corpus.model_corpus(spark, folder)))
    return lineage_edges(found).select("source_service", "target_store", F.array_join("models", ",").alias("models"), F.array_join("frameworks", ",").alias("frameworks"), "weight")


def _hot_models(spark: SparkSession, folder: str) -> DataFrame:
    found = models(place(corpus.model_corpus(spark, folder)))
    return found.groupBy("model").agg(F.count("*").alias("rows"), F.count_distinct("service").alias("services"), F.count_distinct("framework").alias("frameworks")).orderBy(F.desc("rows"), "model").limit(8)


def _evidence(spark: SparkSession, folder: str) -> DataFrame:
    docs = corpus.table(spark, folder, "documents").filter("text is not null")
    return rollup.budgeted(docs.select(F.col("doc_id").alias("ord"), F.col("doc_id").cast("string").alias("path"), "text"))


def queries() -> dict[str, Query]:
    from archlens.plans import facts, reports, rules, trees

    cases, _ = _cases()
    return {
        "import_edges": _python_edges,
        "import_edges_js": lambda s, d: import_edges(place(corpus.import_corpus(s, d, ".ts", 'import x from "../../../svc{r}/src/m{n}/y"'))),
        "import_edges_go": lambda s, d: import_edges(place(corpus.import_corpus(s, d, ".go", '  import "x.org/repo/svc{r}/src/m{n}"')), go_prefix="x.org/repo"),
        "import_edges_elixir": _elixir_edges,
        "fan_in_out": _fan,
        "intra_cross": _intra_cross,
        "lang_rollup": lambda s, d: rollup.languages(corpus.document_corpus(s, d)),
        "primary_language": lambda s, d: rollup.primary_language(corpus.document_corpus(s, d).withColumn("dir", F.substring_index("path", "/", 1)), "dir"),
        "http_edges": lambda s, d: _http(s, d).edges(),
        "service_pairs": lambda s, d: report.pairs(_http(s, d).edges()).select("source_service", "target_service", "calls", F.size("routes").cast("long").alias("routes"), F.col("routes")[0]["path"].alias("first_route")),
        "unresolved_clients": lambda s, d: _http(s, d).resolved.agg(F.count_if(F.col("endpoint_path").isNull()).alias("unresolved"), F.count("*").alias("calls")),
        "entry_modules": lambda s, d: report.entry_modules(_http(s, d).served),
        "route_normalize": _routes,
        "route_prefix_topk": lambda s, d: _routes(s, d).groupBy(path_prefix(F.col("path"), 2).alias("prefix")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "prefix").limit(10),
        "topology_tiers": lambda s, d: graph.tiers(_tree_edges(s, d)),
        "lineage_edges": _lineage,
        "hot_models": _hot_models,
        "store_dominance": lambda s, d: _lineage(s, d).groupBy("target_store").agg(F.sum("weight").alias("weight")).withColumn("share", F.round(F.col("weight") / F.expr("sum(weight) over ()"), 6)),
        "deps_by_ecosystem": lambda s, d: manifests.by_ecosystem(manifests.packages(corpus.package_corpus(s, d))),
        "evidence_pack": _evidence,
    } | cases | facts.queries() | reports.queries() | trees.queries() | rules.queries()


_EDGES = """
SELECT 'svc' || a.n_regionkey || '/src/m' || a.n_nationkey AS source, 'svc' || {to}.n_regionkey || '/src/m' || b.n_nationkey AS target, count(*) AS weight
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation a ON c_nationkey = a.n_nationkey
JOIN supplier ON l_suppkey = s_suppkey JOIN nation b ON s_nationkey = b.n_nationkey
WHERE a.n_nationkey <> b.n_nationkey AND {same}
  AND EXISTS (SELECT 1 FROM orders o2 JOIN customer c2 ON o2.o_custkey = c2.c_custkey WHERE c2.c_nationkey = b.n_nationkey)
GROUP BY 1, 2"""
_SAME = _EDGES.format(to="b", same="a.n_regionkey = b.n_regionkey")
_ALL = _EDGES.format(to="b", same="true")
_HTTP = """
SELECT 'svc' || cn.n_regionkey AS source_service, 'svc' || sn.n_regionkey AS target_service, 'GET' AS method, '/s/' || s_suppkey || '/items' AS path, count(*) AS weight
FROM customer JOIN nation cn ON c_nationkey = cn.n_nationkey JOIN supplier ON s_suppkey = c_custkey % ((SELECT count(*) FROM supplier) + 3)
JOIN nation sn ON s_nationkey = sn.n_nationkey WHERE cn.n_regionkey <> sn.n_regionkey GROUP BY 1, 2, 3, 4"""
_LOC = "length(coalesce(text, '')) - length(replace(coalesce(text, ''), chr(10), '')) + CASE WHEN coalesce(text, '') = '' OR suffix(text, chr(10)) THEN 0 ELSE 1 END"
_LANG = "CASE doc_id % 8 WHEN 0 THEN 'Python' WHEN 1 THEN 'TypeScript' WHEN 2 THEN 'Go' WHEN 3 THEN 'Elixir' WHEN 4 THEN 'Ruby' WHEN 5 THEN 'Java' WHEN 6 THEN 'Markdown' ELSE 'JSON' END"
_ROUTE = "SELECT page_id, '/h/:id/' || page_id % 7 AS path FROM pages"
_MODELS = """SELECT DISTINCT 'svc' || p_partkey % 5 AS service, CASE p_partkey % 4 WHEN 0 THEN 'SQLAlchemy' WHEN 1 THEN 'Mongoose' WHEN 2 THEN 'ActiveRecord' ELSE 'Spring Data JPA' END AS framework,
  'M' || p_size AS model, CASE p_partkey % 4 WHEN 1 THEN 'mongodb' ELSE 'postgres' END AS store FROM part"""
_LINEAGE = f"""SELECT service AS source_service, store AS target_store, string_agg(DISTINCT model, ',' ORDER BY model) AS models, string_agg(DISTINCT framework, ',' ORDER BY framework) AS frameworks,
  count(DISTINCT model) AS weight FROM ({_MODELS}) GROUP BY 1, 2"""


_PACKAGES = """SELECT name, arg_min(version, (version = '*', file, j)) AS version FROM (SELECT 'pkg' || CAST((13 * (p_partkey % 200) + p_partkey // 200) % 1000 AS VARCHAR) AS name,
  CASE WHEN p_size % 3 = 0 THEN '*' ELSE '^' || p_size END AS version, 'svc' || (p_partkey // 200) % 5 || '/p' || p_partkey // 200 || '/package.json' AS file, p_partkey % 200 AS j FROM part) GROUP BY name"""


def tiers_sql() -> str:
    return """WITH RECURSIVE e AS (SELECT DISTINCT s, t FROM (SELECT p_partkey // 8 AS s, p_partkey AS t FROM part WHERE p_partkey > 0 UNION ALL SELECT p_partkey // 64, p_partkey FROM part WHERE p_partkey > 0)),
        w(node, tier) AS (SELECT DISTINCT s, 0 FROM e WHERE s NOT IN (SELECT t FROM e) UNION SELECT e.t, w.tier + 1 FROM w JOIN e ON e.s = w.node) SELECT CAST(node AS VARCHAR) AS node, max(tier) AS tier FROM w GROUP BY node"""


def oracle_sql() -> dict[str, str]:
    from archlens.plans import facts, reports, rules, trees

    _, cases = _cases()
    return {
        "import_edges": _SAME,
        "import_edges_js": _ALL.replace("'svc' || b.n_regionkey", "'svc' || a.n_regionkey").replace("true", "a.n_regionkey = b.n_regionkey"),
        "import_edges_go": _SAME,
        "import_edges_elixir": _ALL,
        "fan_in_out": f"WITH e AS ({_SAME}) SELECT node, CAST(sum(o) AS BIGINT) AS fan_out, CAST(sum(i) AS BIGINT) AS fan_in FROM (SELECT source AS node, 1 AS o, 0 AS i FROM e UNION ALL SELECT target, 0, 1 FROM e) GROUP BY node",
        "intra_cross": f"WITH e AS ({_SAME}) SELECT count(*) AS intra, CAST(0 AS BIGINT) AS crossing FROM e",
        "lang_rollup": f"SELECT {_LANG} AS name, count(*) AS files, CAST(sum({_LOC}) AS BIGINT) AS loc FROM documents GROUP BY 1",
        "primary_language": f"SELECT dir, name AS primary_language, loc FROM (SELECT *, row_number() OVER (PARTITION BY dir ORDER BY loc DESC, name) AS r FROM (SELECT source AS dir, {_LANG} AS name, CAST(sum({_LOC}) AS BIGINT) AS loc FROM documents GROUP BY 1, 2)) WHERE r = 1",
        "http_edges": _HTTP,
        "service_pairs": f"SELECT source_service, target_service, CAST(sum(weight) AS BIGINT) AS calls, count(*) AS routes, arg_min(path, (-weight, path)) AS first_route FROM ({_HTTP}) GROUP BY 1, 2",
        "unresolved_clients": "SELECT count(*) FILTER (WHERE c_custkey % (n + 3) >= n) AS unresolved, count(*) AS calls FROM customer, (SELECT count(*) AS n FROM supplier)",
        "entry_modules": "SELECT 'svc' || n_regionkey AS service, 'svc' || n_regionkey || '/src/m' || n_nationkey AS module, count(*) AS endpoint_count FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY 1, 2",
        "route_normalize": _ROUTE,
        "route_prefix_topk": "SELECT '/h/:id' AS prefix, count(*) AS n FROM pages",
        "topology_tiers": tiers_sql(),
        "lineage_edges": _LINEAGE,
        "hot_models": f"SELECT model, count(*) AS rows, count(DISTINCT service) AS services, count(DISTINCT framework) AS frameworks FROM ({_MODELS}) GROUP BY model ORDER BY rows DESC, model LIMIT 8",
        "store_dominance": f"SELECT target_store, CAST(sum(weight) AS BIGINT) AS weight, round(sum(weight) / sum(sum(weight)) OVER (), 6) AS share FROM ({_LINEAGE}) GROUP BY target_store",
        "deps_by_ecosystem": f"SELECT 'npm' AS ecosystem, name, version FROM ({_PACKAGES})",
        "evidence_pack": """WITH RECURSIVE c AS (SELECT doc_id, strlen(substr(text, 1, 6000)) AS size, row_number() OVER (ORDER BY doc_id) AS r FROM documents WHERE text IS NOT NULL),
            f AS (SELECT r, doc_id, size, size AS used, true AS taken FROM c WHERE r = 1 UNION ALL SELECT c.r, c.doc_id, c.size, CASE WHEN f.used + c.size <= 200000 THEN f.used + c.size ELSE f.used END, f.used + c.size <= 200000 FROM f JOIN c ON c.r = f.r + 1)
            SELECT doc_id AS ord, CAST(doc_id AS VARCHAR) AS path, size AS bytes FROM f WHERE taken""",
    } | cases | facts.oracle_sql() | reports.oracle_sql() | trees.oracle_sql() | rules.oracle_sql()
