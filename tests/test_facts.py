import os

import duckdb
import pytest
from pyspark.sql import functions as F

from archlens.operators import insight, manifests, project
from archlens.plans import facts

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("key", sorted(facts.queries()))
def test_queries_equal_sql(spark, key):
    con = duckdb.connect()
    for name in os.listdir(FOLDER):
        con.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{FOLDER}/{name}'")
    sql = facts.oracle_sql()[key]
    columns = sorted(con.sql(sql).columns)
    got = facts.queries()[key](spark, FOLDER)
    assert sorted(got.columns) == columns
    rows = con.sql(f"SELECT {', '.join(columns)} FROM ({sql})").fetchall()
    assert sorted(map(tuple, got.select(*columns).collect()), key=repr) == sorted(rows, key=repr)


def files(spark, rows):
    return spark.createDataFrame(list(rows.items()), "path string, text string")


def packages(spark, rows):
    return {(r.file, r.name, r.version) for r in manifests.packages(files(spark, rows)).collect()}


def test_malformed_empty_and_null_manifests_give_no_rows(spark):
    assert packages(spark, {"package.json": "{", "composer.json": '{"require": 3}', "go.mod": "", "Cargo.toml": None, "a/mix.exs": "x", "x.txt": "a==1"}) == set()


def test_mix_versions(spark):
    text = 'defp deps do\n[{:phoenix, "~> 1.7"}, {:sentry, "~> 8.0", only: :prod}, {:vbt, path: "../vbt"}, {:some_dep, github: "x/y"}]\nend\n'
    assert {p[1:] for p in packages(spark, {"mix.exs": text})} == {("phoenix", "~> 1.7"), ("sentry", "~> 8.0"), ("vbt", "*"), ("some_dep", "*")}


def test_merged_manifests_keep_first_stated_version_and_cap_after_merging(spark):
    rows = {"a/package.json": '{"dependencies": {"x": "*", "b": "1"}}', "b/package.json": '{"dependencies": {"x": "^2", "c": "1"}}', "c/package.json": '{"dependencies": {"x": "^3"}}'}
    found = manifests.packages(files(spark, rows))
    assert {(r.name, r.version) for r in manifests.by_ecosystem(found, 2).collect()} == {("b", "1"), ("c", "1")}
    assert {(r.name, r.version) for r in manifests.by_ecosystem(found).collect()} == {("b", "1"), ("c", "1"), ("x", "^2")}
    assert [tuple(r) for r in manifests.ecosystems(files(spark, rows), 2).collect()] == [("npm", "package.json ×3", 2, False)]


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("# T\n\nA tiny fixture repo for tests.\n", "A tiny fixture repo for tests."), ("", ""), (None, ""), ("[a](http://long.example.org/words)\n\n![x](y)", ""),
        ("<p>\n\n[![b](u)](v)\nOne sentence   that reads\nas two lines do.\n\nMore", "One sentence that reads as two lines do."), ("word " * 300, ("word " * 300)[:500]),
    ],
)
def test_first_paragraph(spark, text, want):
    assert spark.range(1).select(project.first_paragraph(F.lit(text).cast("string")).alias("x")).first().x == want


def test_readme_descriptions_and_entry_points(spark):
    tree = files(spark, {"README.md": "# mini\n\nA tiny fixture repo for tests.\n", "web/package.json": '{"description": "Customer web app."}', "web/README.md": "Something different altogether.", "lib/__init__.py": '"""Helpers that all of the services use."""', "bin/run": "", "src/main.py": "", "cmd/api/main.go": "", "deep/src/main.py": ""})
    assert [tuple(r) for r in project.readme(tree).collect()] == [("README.md", "A tiny fixture repo for tests.", ["mini"])]
    assert {tuple(r) for r in project.descriptions(tree).collect()} == {("", "A tiny fixture repo for tests."), ("web", "Customer web app."), ("lib", "Helpers that all of the services use.")}
    assert {tuple(r) for r in project.entry_points(tree).collect()} == {("bin/run", "CLI script"), ("src/main.py", "Python main"), ("cmd/api/main.go", "Go service: api")}


def test_stores_of_compose_and_environment_files(spark):
    tree = files(spark, {"docker-compose.yml": "image: postgres:16\nimage: redis:7\n", "compose.yaml": "image: Postgres\n", "api/.env": "URL=redis://x", "node_modules/.env": "mysql", "a/b/.env": "kafka", "api/x.py": "mysql"})
    assert {(r.id, *r.evidence) for r in project.stores(tree).collect()} == {("postgres", "docker-compose"), ("redis", "api/.env", "docker-compose")}


def test_citations_and_parsed_hits(spark):
    steps = spark.createDataFrame([("a", 0, "x.py", "f"), ("b", 0, "x.py", None), ("b", 1, None, "f"), ("c", 0, "gone.py", "f")], "flow string, step int, file string, symbol string")
    tree = files(spark, {"x.py": ""})
    assert {tuple(r) for r in insight.unresolved_citations(steps, tree).collect()} == {("b", 0, "x.py", "no symbol"), ("b", 1, None, "no file"), ("c", 0, "gone.py", "file not found")}
    assert [r.flow for r in insight.valid_flows(steps, tree).collect()] == ["a"]
    pattern, parsed = (spark.createDataFrame(rows, "file string, target string") for rows in ([("x", "p"), ("y", "p")], [("x", "q")]))
    assert {tuple(r) for r in insight.prefer_parsed(pattern, parsed).collect()} == {("x", "q"), ("y", "p")}
