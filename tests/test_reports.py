import os

import duckdb
import pytest
from pyspark.sql import functions as F

from archlens.functions.text import unquoted
from archlens.operators import enrich, project, rollup
from archlens.operators.discover import place, service_kinds
from archlens.operators.extract import import_facts
from archlens.operators.resolve import http
from archlens.plans import corpus, reports
from archlens.sources.tree import read_tree, typed

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("key", sorted(reports.queries()))
def test_queries_equal_sql(spark, key):
    con = duckdb.connect()
    for name in os.listdir(FOLDER):
        con.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{FOLDER}/{name}'")
    sql = reports.oracle_sql()[key]
    columns = sorted(con.sql(sql).columns)
    got = reports.queries()[key](spark, FOLDER)
    assert sorted(got.columns) == columns
    rows = con.sql(f"SELECT {', '.join(columns)} FROM ({sql})").fetchall()
    assert sorted(map(tuple, got.select(*columns).collect()), key=repr) == sorted(rows, key=repr)


def files(spark, rows):
    return corpus.typed(spark.createDataFrame(list(rows.items()), "path string, text string"))


def test_budget_is_a_fold(spark):
    sizes = [150, 40, 30, 0, 20, 15, 0, 5, 1, 1]
    for budget in (1, 150, 200, 215, 400):
        used, want = 0, []
        for k, n in enumerate(sizes):
            if used + n <= budget or used == 0:
                used, want = used + n, [*want, k]
        rows = spark.createDataFrame([(k, f"p{k}", "x" * n) for k, n in enumerate(sizes)], "ord long, path string, text string")
        assert sorted(r.ord for r in rollup.budgeted(rows, budget).collect()) == want, budget
    assert rollup.budgeted(rows.limit(0)).isEmpty()


def test_a_tree_that_is_one_service(spark):
    tree = place(files(spark, {"go.mod": "module x.org/y\n", "main.ts": 'app.setGlobalPrefix("v1");\n', "users/u.ts": '@Controller("u")\nclass U {\n @Get() a() {}\n}\n', "package.json": '{"dependencies": {"@nestjs/core": "1"}}'}), "repo")
    assert {(r.path, r.service, r.module) for r in tree.collect()} == {("go.mod", None, None), ("main.ts", None, None), ("users/u.ts", None, "users"), ("package.json", None, None)}
    assert [tuple(r) for r in service_kinds(tree, "repo").collect()] == [("repo", "backend", ["@nestjs/"])]
    assert [r.path for r in http(tree).served.collect()] == ["/u"]


def test_texts_are_scanned_once(spark):
    source = files(spark, {"a/src/m/x.py": "import n\n", "a/src/n/y.py": "\n"})
    plan = import_facts(place(source))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("text#") and plan.count("explode(concat(") == 1


def test_root_fields_and_quotes(spark):
    got = spark.range(1).select(*[unquoted(F.lit(x)).alias(str(k)) for k, x in enumerate([" 'a' ", '"b', "'", "''", "c"])]).first()
    assert tuple(got) == ("a", '"b', "'", "", "c")


def test_enrichment_files_that_are_broken_are_left_out(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"schema_version": 1, "overview": {"what_it_is": "x", "what_it_does": "y", "how_it_works": "z", "confidence": "low"}}\n')
    (tmp_path / "b.json").write_text("{broken")
    found = enrich.read_enrichment(spark, str(tmp_path))
    assert found.count() == 1 and enrich.errors(found, files(spark, {"x.py": ""})).isEmpty() and enrich.kept_flows(found, files(spark, {"x.py": ""})).isEmpty()


def test_evidence_prefers_known_files_and_ends_when_full(spark):
    rows = {"README.md": "r", "docs/architecture.md": "d", "main.py": "m", **{f"m/x{k}/index.ts": "i" for k in range(9)}, "m/README.md": "q", "m/urls.py": "u"}
    modules = spark.createDataFrame([("m", 5)], "module string, loc long")
    got = [r.path for r in project.evidence_candidates(files(spark, rows), modules, 6).orderBy("ord").collect()]
    assert got == ["README.md", "docs/architecture.md", "m/README.md", "m/x0/index.ts", "m/x1/index.ts", "m/x2/index.ts", "m/x3/index.ts"]


def test_binary_files_are_left_out(spark, tmp_path):
    (tmp_path / "a.py").write_text("x\n")
    (tmp_path / "c.py").write_bytes(b"\0")
    assert [r.path for r in typed(read_tree(spark, str(tmp_path))).collect()] == ["a.py"]


def test_modules_of_a_tree_that_is_one_service_are_of_that_service(spark):
    got = reports.queries()["single_service"](spark, FOLDER).collect()
    n = corpus.table(spark, FOLDER, "supplier").count()
    assert {r.service for r in got} == {"tree"} and sorted(r.files for r in got) == [1] * n + [2 * n]
