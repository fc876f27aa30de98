from pyspark.sql import functions as F

from archlens.operators import graph, resolve
from archlens.operators.discover import place
from archlens.operators.extract import import_facts, import_statements
from archlens.plans import corpus, rules
from archlens.sources.shared import stored
from archlens.sources.tree import typed


def planned(df):
    """The plan before anything of it has run: what it says holds at any size of the tables."""
    return df._jdf.queryExecution().sparkPlan().toString()


def test_texts_of_a_few_directories_are_not_shuffled_or_sorted(spark):
    k = F.col("id")
    files = typed(spark.range(2000).select(F.concat(F.lit("svc"), k % 2, F.lit("/src/m"), k % 5, F.lit("/f"), k, F.lit(".py")).alias("path"), F.lit("import m1\n" * 9).alias("text")))
    threshold = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(threshold)
    spark.conf.set(threshold, "16k")
    try:
        facts = import_facts(place(files))
        plan = planned(facts)
        assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan and "SortAggregate" not in plan
        got = {(r.module, r.kind, r.target, r.path): (r.n, r["loc"]) for r in facts.collect()}
    finally:
        spark.conf.set(threshold, before)
    assert len(got) == 20 and got["svc1/src/m3", "name", "m1", None][0] == 1800 and got["svc1/src/m3", "file", "", None] == (200, 1800)


def test_definitions_come_with_their_files(spark):
    rows = [("s/src/m/b.ex", "defmodule A do\n"), ("s/src/m/a.ex", "defmodule A do\n"), ("s/src/n/c.ex", "alias A\n")]
    got = {(r.kind, r.target, r.path) for r in import_facts(place(typed(spark.createDataFrame(rows, "path string, text string")))).collect()}
    assert got == {("def", "A", "s/src/m/a.ex"), ("def", "A", "s/src/m/b.ex"), ("ref", "A", None), ("file", "", None)}


def test_rounds_over_a_graph_send_nothing_through_the_driver(spark):
    edges = stored(spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d")], "source string, target string"))
    for df in (graph._trimmed(edges), graph._chained(edges), graph.strong_components(edges), graph.tiers(edges)):
        assert "Broadcast" not in planned(df)


def test_texts_made_of_small_tables_are_spread_over_tasks(spark):
    assert corpus.http_corpus(spark, "/root/testdata/sf0.001").rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_texts_made_of_orders_take_more_tasks_of_a_larger_table(spark, monkeypatch):
    monkeypatch.setattr(corpus, "TASK_ROWS", 500)
    rows = corpus.table(spark, "/root/testdata/sf0.001", "lineitem").count()
    assert corpus.import_corpus(spark, "/root/testdata/sf0.001").rdd.getNumPartitions() == -(-rows // 500) > 4


def test_orders_and_lines_meet_large_tables_in_as_many_tasks(spark, monkeypatch):
    """No shuffle of the session's few tasks is left where customers and suppliers are too many to go to every task."""
    threshold, folder = "spark.sql.autoBroadcastJoinThreshold", "/root/testdata/sf0.001"
    plain = sorted(map(repr, corpus.import_corpus(spark, folder).collect()))
    before = spark.conf.get(threshold)
    spark.conf.set(threshold, "-1")
    try:
        assert planned(corpus.import_corpus(spark, folder)).count("BroadcastHashJoin") == 4
        monkeypatch.setattr(corpus, "TASK_ROWS", 25)
        monkeypatch.setattr(corpus, "tasks_for", lambda rows: 7)
        files = corpus.import_corpus(spark, folder)
        shuffles = [x for x in files._jdf.queryExecution().executedPlan().toString().splitlines() if "Exchange hashpartitioning" in x]
        assert len(shuffles) > 2 and all(", 7)" in x and "nationkey" not in x for x in shuffles), shuffles
        assert sorted(map(repr, files.collect())) == plain
    finally:
        spark.conf.set(threshold, before)


def test_texts_made_of_parts_are_spread_over_tasks(spark):
    assert rules._sixty_modules(spark, "/root/testdata/sf0.001").rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_texts_with_definitions_take_more_tasks_of_a_larger_table(spark, monkeypatch):
    monkeypatch.setattr(corpus, "TASK_ROWS", 500)
    files = corpus.import_corpus(spark, "/root/testdata/sf0.001", ".ex", "  alias N{n}.Main", "defmodule N{n}.F{o} do\n")
    assert files.rdd.getNumPartitions() > 4


def test_definitions_are_not_grouped_before_those_that_no_name_asks_for_are_left_out(spark, monkeypatch):
    """Few names go to every task; many are dealt with the definitions to as many tasks as these need. The edges are the same."""
    k = F.col("id")
    own = spark.range(600).select(F.concat(F.lit("svc/src/m"), k % 3, F.lit("/f"), k, F.lit(".ex")).alias("path"), F.concat(F.lit("defmodule A.F"), k, F.lit(" do\n  alias A.F"), k % 5, F.lit("\nend\n")).alias("text"))
    files = place(typed(own.union(spark.createDataFrame([("svc/src/m0/a.ex", "defmodule A.F1 do\nend\n")], "path string, text string"))))
    plain = sorted(map(tuple, resolve.import_edges(files).collect()))
    assert plain == [(f"svc/src/m{a}", f"svc/src/m{b}", 40 * n) for a in range(3) for b, n in ((0, 3), (1, 1), (2, 1)) if a != b]
    found, names = stored(import_statements(files)), spark.createDataFrame([("A.F1",), ("A.F599",), ("B",)], "target string")
    few = resolve._defined(found, names)
    plan = planned(few)
    assert "BroadcastHashJoin" in plan and plan.index("Aggregate") < plan.index("BroadcastHashJoin") < plan.index("size(defs")
    monkeypatch.setattr(resolve, "TASK_NAMES", 2)
    many = resolve._defined(found, names)
    shuffles = [x for x in many._jdf.queryExecution().executedPlan().toString().splitlines() if "Exchange hashpartitioning(target" in x]
    assert len(shuffles) > 1 and all(", 301)" in x for x in shuffles), shuffles
    assert sorted(map(tuple, few.collect())) == sorted(map(tuple, many.collect())) == [("A.F1", "svc/src/m0"), ("A.F599", "svc/src/m2")]
    assert sorted(map(tuple, resolve.import_edges(files).collect())) == plain


def test_relative_imports_are_read_beside_a_path_that_is_left_out(spark):
    rows = [("s/src/m/b.ts", 'import x from "../n/y"\n'), ("s/src/n/y.ts", "\n")]
    files = place(typed(spark.createDataFrame(rows, "path string, text string")))
    assert [tuple(r) for r in resolve.import_edges(files).collect()] == [("s/src/m", "s/src/n", 1)]
