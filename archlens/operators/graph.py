"""Strongly connected components, and the tiers of a graph with rings, by rounds of joins over edges (source, target).

A chain of nodes that have one edge in and one out takes rounds in the logarithm of its length, as such nodes are taken out
between their neighbours; so do long rings. What is left is coloured: each node takes the least node that reaches it, and the least
that it reaches. Where these are one, the nodes are its component; edges between other colours belong to no component.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from archlens.sources.shared import new_folder, stored


def _join(left: DataFrame, right: DataFrame, on: str | list[str] | Column, how: str = "inner") -> DataFrame:
    """A join in which both sides are shuffled. What nodes and edges of a round fit into a broadcast would pass through the driver,
    and over all rounds that is the graph several times."""
    return left.join(right.hint("merge"), on, how)


def _trimmed(edges: DataFrame) -> DataFrame:
    """Edges between nodes that have edges in and out; any other node is a component of its own."""
    # A target that is also a source leads on; a source that is also a target is led to.
    onward = _join(edges, edges.select(F.col("source").alias("target")).distinct(), "target", "left_semi")
    return _join(onward, edges.select(F.col("target").alias("source")).distinct(), "source", "left_semi").select("source", "target")


def _chained(edges: DataFrame) -> DataFrame:
    """node, before, after of some nodes with one edge in and one out, no two of them neighbours."""
    into = edges.groupBy(F.col("target").alias("node")).agg(F.count("*").alias("ins"), F.min("source").alias("before"))
    out = edges.groupBy(F.col("source").alias("node")).agg(F.count("*").alias("outs"), F.min("target").alias("after"))
    single = _join(into, out, "node").filter("ins = 1 and outs = 1").select("node", "before", "after")
    # Of neighbours that could both go, the one with the smaller hash goes.
    rank = lambda c: F.struct(F.xxhash64(c).alias("h"), F.col(c).alias("n"))
    also = single.select("node")
    met = _join(_join(single, also.toDF("b"), F.col("before") == F.col("b"), "left"), also.toDF("a"), F.col("after") == F.col("a"), "left")
    first = (F.col("b").isNull() | (rank("node") < rank("b"))) & (F.col("a").isNull() | (rank("node") < rank("a")))
    return met.filter(first).select("node", "before", "after")


def _colored(edges: DataFrame) -> DataFrame:
    """node, down, up: the least node (by hash) that reaches each node, and the least that each node reaches."""
    nodes = edges.select(F.col("source").alias("node")).union(edges.select("target")).distinct()
    own = F.struct(F.xxhash64("node").alias("h"), F.col("node").alias("n"))
    now = stored(nodes.select("node", own.alias("down"), own.alias("up")))
    nothing = F.lit(None).cast(now.schema["down"].dataType)
    while True:
        from_above = _join(edges, now.select(F.col("node").alias("source"), "down"), "source").select(F.col("target").alias("node"), "down", nothing.alias("up"))
        from_below = _join(edges, now.select(F.col("node").alias("target"), "up"), "target").select(F.col("source").alias("node"), nothing.alias("down"), "up")
        every = now.select("node", "down", "up", F.lit(True).alias("own")).union(from_above.union(from_below).withColumn("own", F.lit(False)))
        least = every.groupBy("node").agg(F.min("down").alias("down"), F.min("up").alias("up"), F.max(F.when(F.col("own"), F.struct("down", "up"))).alias("was"))
        after = stored(least.select("node", "down", "up", ((F.col("down") < F.col("was.down")) | (F.col("up") < F.col("was.up"))).alias("changed")), now)
        if after.filter("changed").isEmpty():
            return after.drop("changed")
        path = after.__dict__["_stored_path"]
        now = after.drop("changed")
        now.__dict__["_stored_path"] = path


def strong_components(edges: DataFrame) -> DataFrame:
    """(node, component) of all nodes that edges (source, target) join; a component is named by its smallest node."""
    every = stored(edges.select("source", "target").filter("source <> target").distinct())
    work, taken, found = every, [], None
    size = work.count()
    while size:
        trimmed = stored(_trimmed(work))
        chained = stored(_chained(trimmed))
        n = trimmed.count()
        if not chained.isEmpty():
            taken.append(chained)
            # A node between two others gives way to an edge between them.
            gone = chained.select("node")
            rest = _join(_join(trimmed, gone.toDF("source"), "source", "left_anti"), gone.toDF("target"), "target", "left_anti").select("source", "target")
            work = stored(rest.union(chained.select("before", "after")).filter("source <> target").distinct())
        elif n < size:
            work = trimmed
        else:
            # What the same node reaches and is reached by is its component; a component has the same two colours throughout.
            colors = stored(_colored(trimmed))
            whole = F.col("down") == F.col("up")
            part = colors.filter(whole).select("node", F.col("down.n").alias("component"))
            found = stored(part if found is None else found.union(part))
            of = [colors.filter(~whole).select(F.col("node").alias(c), F.struct("down", "up").alias(f"{c}_color")) for c in ("source", "target")]
            work = stored(_join(_join(trimmed, of[0], "source"), of[1], "target").filter("source_color = target_color").select("source", "target"))
        size = work.count()
    nodes = every.select(F.col("source").alias("node")).union(every.select("target")).distinct()
    found = nodes.limit(0).withColumn("component", F.col("node")) if found is None else found
    for chained in reversed(taken):
        of = [found.select(F.col("node").alias(c), F.col("component").alias(f"of_{c}")) for c in ("before", "after")]
        ends = _join(_join(chained, of[0], "before", "left"), of[1], "after", "left")
        first, last = F.coalesce("of_before", "before"), F.coalesce("of_after", "after")
        # On a ring if its neighbours are of one component, that of the node itself else. A neighbour that is alone so far now has company.
        own = ends.select("node", F.when(first == last, first).otherwise(F.col("node")).alias("component"))
        hosts = ends.filter((first == last) & F.col("of_before").isNull()).select(F.col("before").alias("node"), F.col("before").alias("component")).distinct()
        found = stored(found.union(own).union(hosts))
    named = _join(found.groupBy("component").agg(F.min("node").alias("name")), found, "component").select("node", F.col("name").alias("component"))
    return _join(nodes, named, "node", "left").select("node", F.coalesce("component", "node").alias("component"))


def tiers(edges: DataFrame) -> DataFrame:
    """node, tier: 0 without predecessors, else one more than the highest tier of the predecessors, over edges (source, target).

    The nodes of a ring share a tier, one more than the highest of those that lead into the ring. An edge from a node to itself
    counts for nothing, also not for the node being there. Each round takes the nodes that nothing open leads to off the graph, so
    there are as many rounds as tiers; only when all that is left hangs on rings are their components sought and each put
    in one node's place, once.
    """
    spark = edges.sparkSession
    work = stored(edges.select("source", "target").filter("source <> target").distinct())
    # tier: so far, by the nodes that are off already
    nodes = stored(work.select(F.col("source").alias("node")).union(work.select("target")).distinct().withColumn("tier", F.lit(0)))
    out, members, none = new_folder(spark, "tiers"), None, nodes.limit(0)
    none.write.parquet(out)
    while not nodes.isEmpty():
        first = stored(_join(nodes, work.select(F.col("target").alias("node")), "node", "left_anti"))
        if first.isEmpty():
            members = stored(strong_components(work))
            of = [members.select(F.col("node").alias(c), F.col("component").alias(f"of_{c}")) for c in ("source", "target")]
            moved = _join(_join(work, of[0], "source"), of[1], "target").select(F.col("of_source").alias("source"), F.col("of_target").alias("target"))
            work = stored(moved.filter("source <> target").distinct(), work)
            nodes = stored(_join(members, nodes, "node").groupBy(F.col("component").alias("node")).agg(F.max("tier").alias("tier")), nodes)
            continue
        first.write.mode("append").parquet(out)
        left = _join(work, first.withColumnRenamed("node", "source"), "source", "left")
        raised = left.filter("tier is not null").groupBy(F.col("target").alias("node")).agg((F.max("tier") + 1).alias("least"))
        later = _join(_join(nodes, first.select("node"), "node", "left_anti"), raised, "node", "left")
        nodes = stored(later.select("node", F.greatest("tier", F.coalesce("least", F.lit(0))).alias("tier")), nodes)
        work = stored(left.filter("tier is null").select("source", "target"), work)
    found = spark.read.schema(none.schema).parquet(out)
    if members is None:
        return found
    inside = _join(members, found.withColumnRenamed("node", "component"), "component").select("node", "tier")
    return _join(found, members.select("node"), "node", "left_anti").union(inside)
