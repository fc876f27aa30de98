import json

import pytest
from pyspark.sql import functions as F

from archlens.operators import insight, rollup
from archlens.operators.discover import place
from archlens.operators.extract import clients, endpoints, import_facts, imports
from archlens.operators.resolve import import_edges
from archlens.sources import relations
from archlens.sources.shared import stored
from archlens.sources.tree import list_tree, read_files, read_tree, typed


@pytest.fixture
def tree(tmp_path):
    for path, data in {"a/x.py": b"import b\n", "a/b/c/d.txt": b"1\r2\r", "a/node_modules/y.js": b"", ".git/z": b"", ".github/w.yml": b"a: 1\r\nb: 2", "a/pic.png": b"\x89\0\1", "top.md": b"# T\n"}.items():
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_bytes(data)
    (tmp_path / "a/link.py").symlink_to(tmp_path / "top.md")
    (tmp_path / "loop").symlink_to(tmp_path / "a")
    return str(tmp_path)


def test_listing_reads_no_contents(spark, tree):
    listed = list_tree(spark, tree)
    assert {tuple(r) for r in listed.collect()} == {("a/x.py", 9), ("a/b/c/d.txt", 4), (".github/w.yml", 10), ("a/pic.png", 3), ("top.md", 4)}
    some = read_files(listed.filter(F.endswith("path", F.lit(".py"))), tree)
    assert [(r.path, bytes(r.content)) for r in some.collect()] == [("a/x.py", b"import b\n")]
    assert {r.path: bytes(r.content) for r in read_files(listed, tree, head=2).collect()}["top.md"] == b"# "
    gone = read_files(listed.union(spark.createDataFrame([("none", 1)], listed.schema)), tree)
    assert {r.path for r in gone.filter("content is null").collect()} == {"none"} and list_tree(spark, tree + "/nowhere").isEmpty()


def test_lines_are_those_of_the_file(spark, tree):
    files = {r.path: r for r in typed(read_tree(spark, tree)).collect()}
    assert set(files) == {"a/x.py", "a/b/c/d.txt", ".github/w.yml", "top.md"}
    assert (files["a/b/c/d.txt"].loc, files["a/b/c/d.txt"].text) == (1, "1\n2\n")
    assert (files[".github/w.yml"].loc, files[".github/w.yml"].text) == (2, "a: 1\nb: 2")


def test_directories_count_binary_files(spark, tree):
    got = {r.dir: (r.files, r.loc, r.languages) for r in rollup.directories(typed(read_tree(spark, tree, binaries=True))).collect()}
    assert got["a"] == (3, 2, ["Python"]) and got["a/b"] == (1, 1, []) and got[""] == (5, 5, ["Markdown", "Python", "YAML"])


@pytest.mark.parametrize("over", [-1, 0, 1])
def test_texts_count_up_to_their_limit(spark, over):
    row = lambda path, line, limit: (path, " " * (limit - len(line) + over) + line)
    rows = [row("s/m/e.js", "app.get('/x'", 512 * 1024), row("s/m/i.py", "\nimport abc", 256 * 1024)]
    files = typed(spark.createDataFrame(rows, "path string, text string")).withColumns({"service": F.lit("s"), "module": F.lit("s/m")})
    assert endpoints(files).count() == (1 if over <= 0 else 0)
    names = {r.target for r in import_facts(files).filter("kind = 'name'").collect()}
    assert names == ({"abc"} if over <= 0 else {"ab"}) and clients(files).isEmpty()


@pytest.mark.parametrize(("size", "lines"), [(5 * 1024 * 1024, 5 * 1024 * 1024), (5 * 1024 * 1024 + 1, 1)])
def test_very_large_files_count_as_one_line(spark, size, lines):
    assert typed(spark.range(1).select(F.lit("x.py").alias("path"), F.repeat(F.lit("\n"), F.lit(size)).alias("text"))).first().loc == lines


def test_relations_are_there_whole_or_not_at_all(spark, tmp_path):
    where = f"file://{tmp_path}/out"
    one, two = spark.range(3).select(F.col("id").alias("a b")), spark.createDataFrame([("x", [1])], "k string, v array<int>")
    relations.write_relations({"one": one, "two": two}, where)
    back = relations.read_relations(spark, where)
    assert back["one"].dtypes == one.dtypes and back["two"].collect() == two.collect() and relations.sizes(back).collect() == [("one", 3), ("two", 1)]
    broken = two.withColumn("v", F.raise_error(F.lit("no")))
    with pytest.raises(Exception, match="no"):
        relations.write_relations({"one": one.limit(1), "two": broken}, where)
    assert relations.read_relations(spark, where)["one"].count() == 3
    relations.write_relations({"one": one.limit(1)}, where)
    assert {k: d.count() for k, d in relations.read_relations(spark, where).items()} == {"one": 1}
    relations.vacuum(spark, where)
    assert len(list((tmp_path / "out").glob("run-*"))) == 1 and relations.read_relations(spark, where)["one"].count() == 1


def test_hits_of_parser_files(spark, tmp_path):
    match = lambda rule, file, **single: {"ruleId": rule, "file": file, "text": "whole", "metaVariables": {"single": {k: {"text": v} for k, v in single.items()}}}
    (tmp_path / "a.json").write_text(json.dumps([match("py-import", "x.py", MOD="a.b"), match("go-import", "y.go"), match("tsx-require", "./z.ts", SRC="'q'", MOD="m"), match("", "x.py"), match("unknown", "x.py"), {"file": "x.py"}, {"ruleId": "go-import", "file": "w.go", "text": '"f"', "metaVariables": None}], indent=1))
    (tmp_path / "b.json").write_text("[{")
    (tmp_path / "c.json").write_text("{}")
    (tmp_path / "d.json").write_text("")
    got = insight.read_hits(spark, str(tmp_path))
    assert {tuple(r) for r in got.collect()} == {("x.py", "py-import", "a.b"), ("y.go", "go-import", "whole"), ("z.ts", "tsx-require", "'q'"), ("w.go", "go-import", '"f"')}


def test_import_edges_read_whole_texts(spark):
    """What stands behind 256 KiB of a text, or behind 4 KiB of a go.mod, counts as what stands before."""
    far = lambda before, line: before * (300 * 1024 // len(before)) + line
    rows = {
        "p/src/a/i.py": far("# x\n", "import b\n"), "p/src/b/j.py": "",
        "e/src/a/i.ex": far("# x\n", "  alias E.B\n"), "e/src/b/j.ex": far("# x\n", "defmodule E.B do\n"), "go.mod": "// x\n" * 1000 + "module x.org/r\n", "g/src/a/i.go": far("// x\n", 'import "x.org/r/g/src/b"\n'), "g/src/b/j.go": "",
    }
    files = place(typed(spark.createDataFrame(list(rows.items()), "path string, text string")))
    assert {tuple(r) for r in import_edges(files).collect()} == {(f"{s}/src/a", f"{s}/src/b", 1) for s in "peg"}


def test_blank_lines_are_walked_once(spark):
    """Two million of them before a statement; walked again from each, they would take hours."""
    rows = spark.range(3).select(F.concat(F.lit("s/src/a/i."), F.get(F.array(*map(F.lit, ["py", "go", "ex"])), F.col("id").cast("int"))).alias("path"), F.concat(F.repeat(F.lit("\n"), F.lit(2_000_000)), F.lit('\r  import b\n\nimport "x/c"\n\t import D\n')).alias("text"))
    files = stored(typed(rows)).withColumns({"service": F.lit("s"), "module": F.lit("s/src/a")})
    assert {(r.lang, r.target) for r in imports(files, "x").collect()} == {("Python", "b"), ("Python", "D"), ("Go", "c"), ("Elixir", "D")}


def test_js_import_edges_read_whole_texts(spark):
    """Each form of a statement counts behind 256 KiB of a text too."""
    lines = 'import q from "../b/y"\nexport * from "../b/z"\nconst r = require("../b")\nconst s = import("../b/i")\n'
    rows = [(f"s{k}/src/a/i.{ext}", "// x\n" * (60_000 * k) + lines) for ext in ("ts", "jsx") for k in range(2)] + [(f"s{k}/src/b/y.ts", "") for k in range(2)]
    got = import_edges(place(typed(spark.createDataFrame(rows, "path string, text string"))))
    assert {tuple(r) for r in got.collect()} == {("s0/src/a", "s0/src/b", 8), ("s1/src/a", "s1/src/b", 8)}
