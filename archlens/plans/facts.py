"""Queries over manifests, configuration, READMEs and second-order results, with SQL for each."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from archlens.functions import dims
from archlens.operators import insight, manifests, project, rollup
from archlens.operators.discover import place, service_kinds
from archlens.operators.extract import models
from archlens.operators.resolve import Http, http, lineage_edges, module_table
from archlens.plans import corpus, queries as base
from archlens.sources.shared import stored

#: key: (path, text, [(ecosystem, name, version)]); {k} stands for the row's key.
MANIFEST_CASES = {
    "npm": ("m{k}/package.json", '{"dependencies": {"a{k}": "^{k}"}, "peerDependencies": {"b": "*"}, "devDependencies": {"c": "1"}}', [("npm", "a{k}", "^{k}"), ("npm", "b", "*")]),
    "composer": ("m{k}/composer.json", '{"require": {"php": "8", "v/a{k}": "~{k}"}}', [("composer", "v/a{k}", "~{k}")]),
    "pip": ("m{k}/requirements.txt", "-r base.txt\na{k} >= 1.{k} ; python_version > '3' # why\n\nbare_{k}\n", [("pip", "a{k}", ">= 1.{k}"), ("pip", "bare_{k}", "*")]),
    "pyproject": ("m{k}/pyproject.toml", '[project]\ndependencies = ["a{k}>=2", "python", "b", "a{k}>=3"]\n', [("python", "a{k}", ">=2"), ("python", "b", "*")]),
    "pipfile": ("m{k}/Pipfile", '[packages]\na{k} = "=={k}"\nb = {version = "1"}\n', [("pipenv", "a{k}", "=={k}")]),
    "gomod": ("m{k}/go.mod", "module x.org/y\nrequire x.org/one v0.{k}.0\nrequire (\n\tx.org/a{k} v1.{k}.0 // indirect\n\n)\nreplace x => y\nrequire x.org/two v2\n", [("go", "x.org/one", "v0.{k}.0"), ("go", "x.org/a{k}", "v1.{k}.0"), ("go", "x.org/two", "v2")]),
    "cargo": ("m{k}/Cargo.toml", '[package]\nname = "x"\n[dependencies]\na{k} = { version = "1.{k}" }\n[features]\nf = "1"\n[dev-dependencies]\nb = true\n', [("cargo", "a{k}", "1.{k}"), ("cargo", "b", "true")]),
    "gem": ("m{k}/Gemfile", "source 'https://x'\ngem 'a{k}', '~> {k}'\ngem \"b\"\n", [("bundler", "a{k}", "~> {k}"), ("bundler", "b", "*")]),
    "mix": ("m{k}/mix.exs", 'defp deps do\n [{:a{k}, "~> 1.{k}"}, {:b, path: "../b"}, {:c, github: "x/c", branch: "m"}]\nend\ndef other, do: {:d, "1"}\n', [("hex", "a{k}", "~> 1.{k}"), ("hex", "b", "*"), ("hex", "c", "*")]),
    "pom": ("m{k}/pom.xml", "<dependency><groupId>g</groupId>\n <artifactId>a{k}</artifactId><version>{k}</version></dependency><dependency><groupId>g</groupId><artifactId>b</artifactId></dependency>", [("maven", "g:a{k}", "{k}"), ("maven", "g:b", "*")]),
    "gradle": ("m{k}/build.gradle.kts", "implementation(\"g:a{k}:1.{k}\")\ntestImplementation 'g:b:2'\n", [("gradle", "g:a{k}", "1.{k}"), ("gradle", "g:b", "2")]),
}


def _literal(x: str, key: str = "s_suppkey") -> str:
    quoted = x.replace("'", "''")
    return f"replace('{quoted}', '{{k}}', CAST({key} AS VARCHAR))"


def _suppliers(spark: SparkSession, folder: str, path: str, text: str) -> DataFrame:
    return corpus.case_corpus(spark, folder, "supplier", "s_suppkey", path, text)


def _store_files(spark: SparkSession, folder: str) -> DataFrame:
    """An environment file for each supplier that names a store by the supplier's nation."""
    kind = F.get(F.array(*map(F.lit, ["postgres", "mysql", "mongodb"])), F.col("s_nationkey") % 3)
    return corpus.table(spark, folder, "supplier").select(F.concat(F.lit("s"), "s_suppkey", F.lit("/.env")).alias("path"), F.concat(F.lit("DB="), kind, F.lit("://h\n")).alias("text"))


def _stores(spark: SparkSession, folder: str) -> DataFrame:
    return project.stores(_store_files(spark, folder)).select("id", "name", F.array_join("evidence", ",").alias("evidence"))


def _lineage(spark: SparkSession, folder: str) -> DataFrame:
    return lineage_edges(models(place(corpus.model_corpus(spark, folder))))


def _paths(spark: SparkSession, folder: str) -> tuple[Http, DataFrame]:
    found = http(place(corpus.http_corpus(spark, folder)))
    return found, stored(insight.critical_paths(found.served, found.edges(), base._python_edges(spark, folder), _lineage(spark, folder)))


def _critical_paths(spark: SparkSession, folder: str) -> DataFrame:
    _, found = _paths(spark, folder)
    return found.withColumns({"callers": F.array_join("callers", ","), "deps": F.array_join("deps", ",")})


def _matrix(spark: SparkSession, folder: str) -> DataFrame:
    return insight.matrix_order(module_table(place(corpus.import_corpus(spark, folder))))


def _graph(spark: SparkSession, folder: str) -> DataFrame:
    found = base.python_graph(spark, folder)
    return insight.graph_observations(stored(found.edges), found.modules)


def _topology(spark: SparkSession, folder: str) -> DataFrame:
    files = place(corpus.http_corpus(spark, folder))
    found = http(files)
    missing = found.resolved.agg(F.count_if(F.col("endpoint_path").isNull()).alias("unresolved"))
    return insight.topology_observations(stored(found.edges()), missing, found.served.select("framework"), service_kinds(files))


def _lineage_notes(spark: SparkSession, folder: str) -> DataFrame:
    return insight.lineage_observations(stored(_lineage(spark, folder)), project.stores(_store_files(spark, folder)))


def _all_stores(spark: SparkSession, folder: str) -> DataFrame:
    redis = project.stores(_store_files(spark, folder)).filter("id = 'mysql'")
    return project.with_inferred(redis, _lineage(spark, folder)).select("id", "name", F.size("evidence").alias("refs"))


def _flow_inputs(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """A step for each line item; its file is there if the part is of size 45 or less, its symbol is absent for returns."""
    file = F.concat(F.lit("p/"), "l_partkey", F.lit(".py"))
    steps = corpus.table(spark, folder, "lineitem").select(F.col("l_orderkey").alias("flow"), F.col("l_linenumber").alias("step"), file.alias("file"), F.when(F.col("l_returnflag") != "R", F.lit("main")).alias("symbol"))
    files = corpus.table(spark, folder, "part").filter("p_size <= 45").select(F.concat(F.lit("p/"), "p_partkey", F.lit(".py")).alias("path"))
    return steps, files


def _share(spark: SparkSession, folder: str) -> DataFrame:
    sums = rollup.languages(corpus.document_corpus(spark, folder))
    return sums.select("name", F.round(F.col("loc") / F.expr("sum(loc) over ()"), 6).alias("share"))


def queries() -> dict:
    cases = {
        f"manifest_{n}": lambda s, d, path=path, text=text: manifests.packages(_suppliers(s, d, path, text)).select("file", "ecosystem", "name", "version")
        for n, (path, text, _) in MANIFEST_CASES.items()
    }
    return cases | {
        "dep_ecosystems": lambda s, d: manifests.ecosystems(corpus.package_corpus(s, d)),
        "deps_shallow": lambda s, d: manifests.by_ecosystem(manifests.packages(corpus.package_corpus(s, d)), dims.DEPTH_TIERS["shallow"]["packages"]),
        "stores": _stores,
        "stores_inferred": _all_stores,
        "entry_points": lambda s, d: project.entry_points(_suppliers(s, d, "cmd/s{k}/main.go", "package main\n")),
        "service_prefixes": lambda s, d: project.service_prefixes(place(_suppliers(s, d, "svc{k}/src/main.ts", 'app.setGlobalPrefix("api/v{k}/");\napp.use("/e{k}", r)\n'))),
        "descriptions": lambda s, d: project.descriptions(_suppliers(s, d, "m{k}/README.md", "# T\n\n[![b](u)](v)\n\n<p>x</p>\nThis is module  number {k} of the tree,\nsee https://x.org.\n\nMore than enough words.\n")),
        "critical_paths": _critical_paths,
        "matrix_order": _matrix,
        "graph_observations": _graph,
        "topology_observations": _topology,
        "lineage_observations": _lineage_notes,
        "unresolved_citations": lambda s, d: insight.unresolved_citations(*_flow_inputs(s, d)),
        "valid_flows": lambda s, d: insight.valid_flows(*_flow_inputs(s, d)),
        "language_share": _share,
    }


_KIND = "CASE s_nationkey % 3 WHEN 0 THEN 'postgres' WHEN 1 THEN 'mysql' ELSE 'mongodb' END"
_MODULES = """SELECT 'svc' || n_regionkey AS service, 'svc' || n_regionkey || '/src/m' || n_nationkey AS module, sum(greatest(1, n)) AS loc
    FROM (SELECT o_custkey, count(l_orderkey) AS n FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey, o_custkey) JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2"""
_TOP = "SELECT '{rule}' AS rule, {by} AS subject, count(*) AS value FROM e GROUP BY 2 HAVING count(*) >= 4 ORDER BY value DESC, subject LIMIT 1"
_STEPS = """SELECT l_orderkey AS flow, l_linenumber AS step, 'p/' || l_partkey || '.py' AS file,
    CASE WHEN p_partkey IS NULL THEN 'file not found' WHEN l_returnflag = 'R' THEN 'no symbol' END AS problem FROM lineitem LEFT JOIN (SELECT p_partkey FROM part WHERE p_size <= 45) ON l_partkey = p_partkey"""


def critical_paths_sql() -> str:
    return f"""WITH ep AS (SELECT 'svc' || n_regionkey AS service, 'svc' || n_regionkey || '/src/m' || n_nationkey AS module, '/s/' || s_suppkey || '/items' AS path, 'svc' || n_regionkey || '/src/m' || n_nationkey || '/s' || s_suppkey || '.ts' AS file FROM supplier JOIN nation ON s_nationkey = n_nationkey),
            h AS ({base._HTTP}), e AS ({base._SAME}), l AS ({base._LINEAGE}),
            m AS (SELECT ep.service, module, count(DISTINCT ep.path) AS endpoint_count, 'GET' AS sample_method, arg_min(ep.path, (source_service IS NULL, file)) AS sample_path, coalesce(string_agg(DISTINCT source_service, ',' ORDER BY source_service), '') AS callers FROM ep LEFT JOIN h ON h.target_service = ep.service AND h.path = ep.path GROUP BY 1, 2),
            d AS (SELECT source, string_agg(split_part(target, '/', 3), ',' ORDER BY weight DESC, target) AS deps FROM e GROUP BY 1),
            s AS (SELECT source_service, arg_min(target_store, (-weight, target_store)) AS store, max(weight) AS w FROM l GROUP BY 1)
            SELECT service, module, endpoint_count, sample_method, sample_path, callers, coalesce(deps, '') AS deps, store, coalesce(w, 0) AS store_models FROM m LEFT JOIN d ON source = module LEFT JOIN s ON source_service = service"""


def oracle_sql() -> dict[str, str]:
    cases = {
        f"manifest_{n}": " UNION ALL ".join(f"SELECT {_literal(path)} AS file, '{e}' AS ecosystem, {_literal(name)} AS name, {_literal(v)} AS version FROM supplier" for e, name, v in rows)
        for n, (path, _, rows) in MANIFEST_CASES.items()
    }
    return cases | {
        "dep_ecosystems": f"SELECT 'npm' AS ecosystem, (SELECT CASE count(DISTINCT p_partkey // 200) WHEN 1 THEN 'svc0/p0/package.json' ELSE 'package.json ×' || count(DISTINCT p_partkey // 200) END FROM part) AS file, count(*) AS count, bool_or(version = '*') AS has_star FROM ({base._PACKAGES})",
        "deps_shallow": f"SELECT 'npm' AS ecosystem, name, version FROM ({base._PACKAGES}) ORDER BY name LIMIT 20",
        "stores": f"SELECT k AS id, CASE k WHEN 'postgres' THEN 'PostgreSQL' WHEN 'mysql' THEN 'MySQL' ELSE 'MongoDB' END AS name, string_agg(f, ',' ORDER BY f) AS evidence FROM (SELECT {_KIND} AS k, 's' || s_suppkey || '/.env' AS f FROM supplier) GROUP BY 1, 2",
        "stores_inferred": f"SELECT 'mysql' AS id, 'MySQL' AS name, CAST(count(*) AS INTEGER) AS refs FROM supplier WHERE s_nationkey % 3 = 1 UNION ALL SELECT DISTINCT store, upper(store[1]) || store[2:], 1 FROM ({base._MODELS})",
        "entry_points": "SELECT 'cmd/s' || s_suppkey || '/main.go' AS path, 'Go service: s' || s_suppkey AS kind FROM supplier",
        "service_prefixes": "SELECT 'svc' || s_suppkey AS service, 'NestJS' AS framework, '/api/v' || s_suppkey AS prefix FROM supplier UNION ALL SELECT 'svc' || s_suppkey, 'Express', '/e' || s_suppkey FROM supplier",
        "descriptions": "SELECT 'm' || s_suppkey AS dir, 'This is module number ' || s_suppkey || ' of the tree,' AS description FROM supplier",
        "critical_paths": critical_paths_sql(),
        "matrix_order": f"SELECT CAST(row_number() OVER (ORDER BY service, loc DESC, module) - 1 AS INTEGER) AS idx, module, service, dense_rank() OVER (ORDER BY service) - 1 AS block, false AS divider FROM ({_MODULES})",
        "graph_observations": f"WITH e AS ({base._SAME}) SELECT * FROM ({_TOP.format(rule='fan_out', by='source')}) UNION ALL SELECT * FROM ({_TOP.format(rule='fan_in', by='target')}) UNION ALL SELECT 'no_crossings', '', count(*) FROM e HAVING count(*) > 0",
        "topology_observations": f"""WITH p AS (SELECT source_service AS s, target_service AS t, sum(weight) AS n FROM ({base._HTTP}) GROUP BY 1, 2), d AS (SELECT s AS subject FROM p UNION ALL SELECT t FROM p),
            u AS (SELECT count(*) AS n FROM customer, (SELECT count(*) AS k FROM supplier) WHERE c_custkey % (k + 3) >= k)
            SELECT * FROM (SELECT 'hub' AS rule, subject, count(*) AS value FROM d GROUP BY subject HAVING count(*) >= 2 ORDER BY value DESC, subject LIMIT 1)
            UNION ALL SELECT 'heaviest_pair', s || '>' || t, CAST(floor(1000 * n / (SELECT sum(n) FROM p)) AS BIGINT) FROM p WHERE n >= 0.7 * (SELECT sum(n) FROM p) AND (SELECT count(*) FROM p) > 1
            UNION ALL SELECT 'frontend_fan', s, count(*) FROM p WHERE s IN ('svc0', 'svc2', 'svc4') GROUP BY s HAVING count(*) >= 2
            UNION ALL SELECT 'frameworks', '', count(DISTINCT s_suppkey % 2) FROM supplier HAVING count(DISTINCT s_suppkey % 2) >= 2
            UNION ALL SELECT 'unresolved', '', n FROM u WHERE n >= 3""",
        "lineage_observations": f"""WITH l AS ({base._LINEAGE}), s AS (SELECT target_store AS id, sum(weight) AS n, count(DISTINCT source_service) AS w FROM l GROUP BY 1), t AS (SELECT sum(n) AS total FROM s)
            SELECT 'dominant_store' AS rule, id AS subject, CAST(n AS BIGINT) AS value FROM s, t WHERE total >= 5 AND n >= 0.9 * total UNION ALL SELECT 'shared_store', id, w FROM s WHERE w >= 2
            UNION ALL SELECT 'unlinked_store', k, 0 FROM (SELECT DISTINCT {_KIND} AS k FROM supplier) WHERE k NOT IN (SELECT id FROM s) UNION ALL SELECT 'frameworks', '', count(DISTINCT framework) FROM ({base._MODELS}) HAVING count(DISTINCT framework) >= 2""",
        "unresolved_citations": f"SELECT * FROM ({_STEPS}) WHERE problem IS NOT NULL",
        "valid_flows": f"SELECT flow FROM ({_STEPS}) GROUP BY flow HAVING count(problem) = 0",
        "language_share": f"SELECT name, round(loc / sum(loc) OVER (), 6) AS share FROM (SELECT {base._LANG} AS name, sum({base._LOC}) AS loc FROM documents GROUP BY 1)",
    }
