import os

import duckdb
import pytest
from pyspark.sql import functions as F

from archlens.functions.text import normalise_path, package_of, route
from archlens.operators.discover import place
from archlens.operators.manifests import packages
from archlens.operators.resolve import http_edges, import_edges
from archlens.plans import queries as plans
from archlens.sources.tree import read_tree, typed

FOLDER = "/root/testdata/sf0.001"
KEYS = ["import_edges", "import_edges_js", "import_edges_go", "import_edges_elixir", "lang_rollup", "dir_rollup", "http_edges", "unresolved_clients", "lineage_edges", "deps_by_ecosystem", "evidence_pack", "topology_tiers", "endpoints_nestjs", "endpoints_flask", "clients_fetch", "clients_bare_verb", "models_prisma"]


@pytest.mark.parametrize("key", KEYS)
def test_queries_equal_sql(spark, key):
    con = duckdb.connect()
    for name in os.listdir(FOLDER):
        con.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{FOLDER}/{name}'")
    expected = con.sql(plans.oracle_sql()[key])
    columns = sorted(expected.columns)
    got = plans.queries()[key](spark, FOLDER)
    assert sorted(got.columns) == columns
    rows = con.sql(f"SELECT {', '.join(columns)} FROM ({plans.oracle_sql()[key]})").fetchall()
    assert sorted(map(tuple, got.select(*columns).collect())) == sorted(rows) and rows


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize(("raw", "want"), [("users/{id}/", "/users/:id"), ("/a//[...slug]", "/a/:id"), ("/<int:pk>/<x>", "/:id/:id"), ("/:a/b", "/:id/b"), ("/", "/"), ("", "/")])
def test_route(spark, raw, want):
    assert one(spark, route(F.lit(raw))) == want


@pytest.mark.parametrize(("raw", "want"), [("@s/p/x", "@s/p"), ("p/x", "p"), ("./x", None), ("@s", None), ("", None)])
def test_package(spark, raw, want):
    assert one(spark, package_of(F.lit(raw))) == want


@pytest.mark.parametrize(("raw", "want"), [("a/./b/../c//d", "a/c/d"), ("a/..", ""), ("a/../..", None), ("a/../../a", None), ("../a", None)])
def test_normalise_path(spark, raw, want):
    assert one(spark, normalise_path(F.lit(raw))) == want


def test_tree_source_reads_hidden_and_empty_files(spark, tmp_path):
    for path, text in {"a/__init__.py": b"", "a/.env": b"x", ".github/w.yml": b"a: 1\r\n", "node_modules/x.js": b"1", "b.bin": b"\0", "_p.py": b"import a\n"}.items():
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_bytes(text)
    files = {r.path: r for r in typed(read_tree(spark, str(tmp_path))).collect()}
    assert set(files) == {"a/__init__.py", ".github/w.yml", "_p.py"}
    assert (files["_p.py"].lang, files["_p.py"].loc, files["a/__init__.py"].loc, files[".github/w.yml"].text) == ("Python", 1, 0, "a: 1\n")


def test_edges_of_a_small_tree(spark):
    rows = {
        "web/src/pages/home.ts": 'import axios from "axios";\naxios.get("/users/42");\naxios.post("/orders");\naxios.get("/nope");\nfetch("https://ext.example.com/x");\n',
        "web/package.json": '{"dependencies":{"react":"^18"}}',
        "backend/package.json": '{"dependencies":{"express":"^4"}}',
        "backend/src/main.ts": 'app.setGlobalPrefix("api/v1");\n',
        "backend/src/users/users.controller.ts": '@Controller("users")\nclass U {\n @Get(":id")\n a() {}\n @Get()\n b() {}\n}\n',
        "backend/src/orders/orders.controller.ts": 'import { U } from "../users/users.controller";\n@Controller("orders")\nclass O {\n @Post()\n a() {}\n}\n',
        "broken/package.json": "{not json",
    }
    files = place(typed(spark.createDataFrame(list(rows.items()), "path string, text string")))
    got = {tuple(r) for r in http_edges(files).collect()}
    assert got == {("web", "backend", "GET", "/api/v1/users", 1), ("web", "backend", "POST", "/api/v1/orders", 1)}
    assert {tuple(r) for r in import_edges(files).collect()} == {("backend/src/orders", "backend/src/users", 1)}
    assert {(r.name, r.version) for r in packages(files).collect()} == {("react", "^18"), ("express", "^4")}
