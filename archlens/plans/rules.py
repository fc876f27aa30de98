"""Queries in which rules of observation fire that the other corpora leave silent, graphs cut to what a depth shows, and further branches
of single-file rules, with SQL for each."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from archlens.operators import insight, manifests, project, report
from archlens.operators.discover import place
from archlens.operators.extract import models
from archlens.operators.resolve import http, import_edges, lineage_edges
from archlens.plans import corpus, facts
from archlens.plans.trees import _files, _pair, _text
from archlens.sources.shared import stored
from archlens.sources.tree import typed

def _supplier(spark: SparkSession, folder: str) -> DataFrame:
    return corpus.table(spark, folder, "supplier")


def _graph(spark: SparkSession, folder: str) -> DataFrame:
    """Modules of three services, each depends on six others; every fifth needs a module of utilities."""
    k = F.col("s_suppkey")
    supplier = _supplier(spark, folder)
    name = lambda k: _text("svc", k % 3, "/src/m", k)
    tree = supplier.select(name(F.floor(k / 6)).alias("source"), name(k).alias("target"))
    shared = supplier.filter(k % 5 == 0).select(name(k).alias("source"), F.lit("svc0/src/utils").alias("target"))
    edges = tree.union(shared).withColumn("weight", F.lit(1))
    ends = edges.select(F.col("source").alias("module")).union(edges.select("target")).distinct()
    return insight.graph_observations(stored(edges), ends.withColumn("service", F.substring_index("module", "/", 1)))


def _topology(spark: SparkSession, folder: str) -> DataFrame:
    """Two pairs of services, one with four fifths of the calls; nothing else that a rule speaks of."""
    k = F.col("s_suppkey")
    supplier = _supplier(spark, folder)
    heavy = k % 10 < 8
    calls = supplier.select(F.when(heavy, "a").otherwise("c").alias("source_service"), F.when(heavy, "b").otherwise("d").alias("target_service"), F.lit("GET").alias("method"), _text("/", k).alias("path"), F.lit(1).cast("long").alias("weight"))
    unresolved = supplier.agg(F.count_if(k < 2).alias("unresolved"))
    kinds = supplier.select(F.lit("a").alias("service"), F.lit("frontend").alias("kind")).distinct()
    return insight.topology_observations(stored(calls), unresolved, supplier.select(F.lit("Express").alias("framework")), kinds)


def _lineage(spark: SparkSession, folder: str) -> DataFrame:
    """Files that name stores, and code without any model."""
    code = corpus.case_corpus(spark, folder, "supplier", "s_suppkey", "svc/src/m{k}/a.py", "class A{k}(Other):\n  pass\n")
    return insight.lineage_observations(stored(lineage_edges(models(place(code)))), project.stores(facts._store_files(spark, folder)))


def _paths(spark: SparkSession, folder: str) -> DataFrame:
    """A module for each supplier, with up to nine endpoints; every second depends on utilities; one store; few calls."""
    k = F.col("s_suppkey")
    supplier = _supplier(spark, folder)
    module = _text("svc/src/m", k)
    each = F.explode(F.sequence(F.lit(0), (k % 9).cast("int"))).alias("seq")
    served = supplier.select(F.lit("svc").alias("service"), module.alias("module"), _text("f", k).alias("file"), each, k.alias("k")).select("service", "module", "file", "seq", F.lit("GET").alias("method"), _text("/", F.col("k"), "/", F.col("seq")).alias("path"))
    calls = supplier.filter(k % 50 == 1).select(F.lit("web").alias("source_service"), F.lit("svc").alias("target_service"), F.lit("GET").alias("method"), _text("/", k, "/0").alias("path"), F.lit(1).alias("weight"))
    edges = supplier.filter(k % 2 == 0).select(module.alias("source"), F.lit("svc/src/Utils").alias("target"), F.lit(1).alias("weight"))
    lineage = supplier.groupBy(F.lit("svc").alias("source_service"), F.lit("postgres").alias("target_store")).agg(F.count("*").alias("weight"))
    found = stored(insight.critical_paths(served, calls, edges, lineage))
    return insight.path_observations(found, calls.count())


def _sixty_modules(spark: SparkSession, folder: str) -> DataFrame:
    """A file for each part, of as many lines as its size, in one of sixty modules; it imports another one of its service."""
    p = F.col("p_partkey")
    text = F.concat(_text("import m", p * 6 % 60, "\n"), F.repeat(F.lit("\n"), F.col("p_size") - 1))
    part = corpus.table(spark, folder, "part")
    part = part.repartition(corpus.tasks_for(part), "p_partkey")  # its file is small, and its texts would be made by one task
    return typed(part.select(_text("svc", p % 5, "/src/m", p % 60, "/f", p, ".py").alias("path"), text.alias("text")))


def _entries(spark: SparkSession, folder: str) -> DataFrame:
    k = F.col("s_suppkey")
    supplier = _supplier(spark, folder)
    paths = [("main.py",), ("src/index.tsx",), ("cmd/server.js",), ("bin/run", k), ("bin/deep/run", k), ("cmd/s", k, "/main.go"), ("x", k, "/main.py"), ("src/app", k, ".py"), ("Dockerfile",)]
    files = _files(*[_pair(supplier, _text(*parts), F.lit("x\n")) for parts in paths]).distinct()
    return project.entry_points(files)


def _descriptions(spark: SparkSession, folder: str) -> DataFrame:
    """Directories with a manifest, a README and a docstring, in all choices of them."""
    k = F.col("s_suppkey")
    supplier = _supplier(spark, folder)
    return project.descriptions(_files(
        _pair(supplier.filter(k % 2 == 0), _text("m", k, "/package.json"), _text('{"description": " From the manifest ', k, ' "}')),
        _pair(supplier.filter(k % 3 == 0), _text("m", k, "/README"), _text("Heading\n\nThe words of a README, number ", k, ".\n")),
        _pair(supplier, _text("m", k, "/__init__.py"), F.when(k % 5 == 0, "import a\n").otherwise(_text('"""The docstring of a package, ', k, '.\n\nMore.\n"""\n'))),
    ))


def _prefixed(spark: SparkSession, folder: str) -> DataFrame:
    """Prefixes of classes, routers and applications: a route in the file that states its application's prefix gets it twice."""
    k = F.col("s_suppkey")
    supplier = _supplier(spark, folder)
    files = _files(
        _pair(supplier, _text("svc", k, "/main.py"), _text('app.include_router(r, prefix="/api', k, '")\n@app.get("/y")\ndef y(): ...\n')),
        _pair(supplier, _text("svc", k, "/src/m/r.py"), _text('router = APIRouter(tags=[], prefix="/r")\n@router.post("/x/{id}/")\n')),
        _pair(supplier, _text("svc", k, "/src/m/S.java"), _text('@RestController\n@RequestMapping("/v', k, '/")\nclass S {\n  @GetMapping("x")\n  void a() {}\n  @RequestMapping(value = "/z")\n  void b() {}\n}\n')),
        _pair(supplier, _text("svc", k, "/src/m/n.ts"), _text("@Controller(`n", k, "`)\nclass N {\n  @Post()\n  a() {}\n  @All('*')\n  b() {}\n}\n")),
        _pair(supplier, _text("svc", k, "/src/m/w.php"), _text("Route::apiResource('posts', P::class);\nRoute::get ( \"/w", k, "/{id?}\", f);\n")),
        _pair(supplier, _text("svc", k, "/src/m/h.go"), _text('e.GET("/h/:id", f)\nmux.HandleFunc(`/k', k, "`, g)\nx.Use(\"/no\")\n")),
    )
    return http(place(typed(files))).served.select("service", "framework", "method", "path")


#: Second forms and what looks like a package but isn't: (path, text); the rows are in the SQL.
MANIFESTS = [
    ("a{k}/requirements.in", "flask[async]>=2\n-e git+x\n# c\nDjango ~= 4.2 # x\n\n"),
    ("b{k}/package.json", '{"dependencies": {"x{k}": "1"}, broken'),
    ("b{k}/x/package.json", '{"name": "n", "dependencies": ["x"], "peerDependencies": {"p{k}": "2"}}'),
    ("c{k}/Cargo.toml", '[dependencies]\n# x = "1"\nserde = { features = ["a"] }\n[package]\nversion = "1"\n'),
    ("d{k}/Gemfile", "  gem 'rails{k}', \"7.0\", require: false\ngemspec\n"),
    ("e{k}/composer.json", '{"require-dev": {"a": "1"}}'),
    ("f{k}/go.mod", "module x\n// require y v1\nexclude z v1\n"),
    ("g{k}/setup.cfg", "[options]\ninstall_requires = a\n"),
]


def _manifests(spark: SparkSession, folder: str) -> DataFrame:
    files = _files(*[corpus.case_corpus(spark, folder, "supplier", "s_suppkey", path, text) for path, text in MANIFESTS])
    return manifests.packages(files).select("file", "ecosystem", "name", "version")


def queries() -> dict:
    return {
        "graph_rules": _graph,
        "topology_rules": _topology,
        "lineage_rules": _lineage,
        "path_rules": _paths,
        "edges_shown": lambda s, d: import_edges(report.shown_files(place(_sixty_modules(s, d)), "shallow")),
        "edges_medium": lambda s, d: import_edges(report.shown_files(place(_sixty_modules(s, d)), "medium")),
        "entry_points_all": _entries,
        "descriptions_all": _descriptions,
        "prefixed_endpoints": _prefixed,
        "mixed_manifests": _manifests,
    }


def oracle_sql() -> dict[str, str]:
    k = "CAST(s_suppkey AS VARCHAR)"
    name = lambda x: f"'svc' || ({x}) % 3 || '/src/m' || ({x})"
    edges = f"SELECT {name('s_suppkey // 6')} AS s, {name('s_suppkey')} AS t FROM supplier UNION ALL SELECT {name('s_suppkey')}, 'svc0/src/utils' FROM supplier WHERE s_suppkey % 5 = 0"
    best = lambda rule, by, least, where="true": f"SELECT * FROM (SELECT '{rule}' AS rule, {by} AS subject, count(*) AS value FROM e WHERE {where} GROUP BY {by} ORDER BY value DESC, subject LIMIT 1) WHERE value >= {least}"
    cross = "split_part(s, '/', 1) <> split_part(t, '/', 1)"
    shown = """WITH f AS (SELECT 'svc' || p_partkey % 5 || '/src/m' || p_partkey % 60 AS m, 'svc' || p_partkey % 5 || '/src/m' || p_partkey * 6 % 60 AS t, p_size FROM part),
        m AS (SELECT m FROM f GROUP BY m ORDER BY sum(p_size) DESC, m {limit}) SELECT f.m AS source, t AS target, count(*) AS weight FROM f WHERE f.m IN (FROM m) AND t IN (FROM m) AND f.m <> t GROUP BY ALL"""
    return {
        "graph_rules": f"""WITH e AS (SELECT * FROM ({edges}) WHERE s <> t), c AS (SELECT count(*) FILTER (WHERE {cross}) AS x, count(*) FILTER (WHERE NOT {cross}) AS i FROM e)
            {best("fan_out", "s", 4)} UNION ALL {best("fan_in", "t", 4)} UNION ALL SELECT 'no_crossings', '', i FROM c WHERE x = 0 AND i > 0
            UNION ALL SELECT 'many_crossings', '', x FROM c WHERE x > 0 AND x >= greatest(2, i // 4) UNION ALL {best("utility_hub", "t", 5, "t LIKE '%/utils'")}""",
        "topology_rules": "SELECT 'heaviest_pair' AS rule, 'a>b' AS subject, CAST(floor(1000 * count(*) FILTER (WHERE s_suppkey % 10 < 8) / count(*)) AS BIGINT) AS value FROM supplier HAVING count(*) FILTER (WHERE s_suppkey % 10 >= 8) > 0",
        "lineage_rules": f"SELECT DISTINCT 'store_without_models' AS rule, {facts._KIND} AS subject, CAST(0 AS BIGINT) AS value FROM supplier",
        "path_rules": """WITH p AS (SELECT s_suppkey, s_suppkey % 9 + 1 AS n, s_suppkey % 50 = 1 AS called FROM supplier), s AS (SELECT count(*) AS c, CAST(sum(n) AS BIGINT) AS e, count(*) FILTER (WHERE NOT called) AS o, count(*) FILTER (WHERE called) AS k, count(*) FILTER (WHERE s_suppkey % 2 = 0) AS u FROM p)
            SELECT * FROM (SELECT 'most_exposed' AS rule, 'svc/src/m' || s_suppkey AS subject, CAST(n AS BIGINT) AS value FROM p WHERE n >= 8 ORDER BY n DESC, subject LIMIT 1) UNION ALL SELECT 'no_callers', '', o FROM s WHERE o > 0
            UNION ALL SELECT 'shared_utility', 'utils', u FROM s WHERE u >= greatest(3, c // 3) UNION ALL SELECT 'one_store', 'postgres', c FROM s WHERE c >= 5 UNION ALL SELECT 'coverage', '', CAST(floor(1000 * k / e) AS BIGINT) FROM s WHERE k > 0 AND k < 0.4 * e""",
        "edges_shown": shown.format(limit="LIMIT 30"),
        "edges_medium": shown.format(limit="LIMIT 80"),
        "entry_points_all": f"""SELECT * FROM (VALUES ('main.py', 'Python main'), ('src/index.tsx', 'TypeScript React entry'), ('cmd/server.js', 'JavaScript server'), ('Dockerfile', 'Container build')) t(path, kind) WHERE (SELECT count(*) FROM supplier) > 0
            UNION ALL SELECT 'bin/run' || {k}, 'CLI script' FROM supplier UNION ALL SELECT 'cmd/s' || {k} || '/main.go', 'Go service: s' || {k} FROM supplier""",
        "mixed_manifests": f"""SELECT 'a' || {k} || '/requirements.in' AS file, 'pip' AS ecosystem, unnest(['flask', 'Django']) AS name, unnest(['*', '~= 4.2']) AS version FROM supplier UNION ALL SELECT 'b' || {k} || '/x/package.json', 'npm', 'p' || {k}, '2' FROM supplier
            UNION ALL SELECT 'c' || {k} || '/Cargo.toml', 'cargo', 'serde', 'a' FROM supplier UNION ALL SELECT 'd' || {k} || '/Gemfile', 'bundler', 'rails' || {k}, '7.0' FROM supplier""",
        "prefixed_endpoints": f"""SELECT 'svc' || {k} AS service, unnest(['FastAPI', 'FastAPI', 'Spring Boot', 'Spring Boot', 'Spring Boot', 'NestJS', 'NestJS', 'Laravel', 'Laravel', 'Go router', 'Go router']) AS framework,
            unnest(['GET', 'POST', 'ANY', 'GET', 'ANY', 'POST', 'ALL', 'ANY', 'GET', 'GET', 'ANY']) AS method,
            unnest(['/api' || {k} || '/api' || {k} || '/y', '/api' || {k} || '/r/x/:id', '/v' || {k} || '/v' || {k}, '/v' || {k} || '/x', '/v' || {k} || '/z', '/n' || {k}, '/n' || {k} || '/*', '/posts', '/w' || {k} || '/:id', '/h/:id', '/k' || {k}]) AS path FROM supplier""",
        "descriptions_all": f"""SELECT * FROM (SELECT 'm' || {k} AS dir, CASE WHEN s_suppkey % 2 = 0 THEN 'From the manifest ' || {k} WHEN s_suppkey % 3 = 0 THEN 'The words of a README, number ' || {k} || '.'
            WHEN s_suppkey % 5 > 0 THEN 'The docstring of a package, ' || {k} || '.' END AS description FROM supplier) WHERE description IS NOT NULL""",
    }
