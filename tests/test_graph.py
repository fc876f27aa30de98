import random

import pytest

from archlens.operators.graph import strong_components, tiers


def frame(spark, edges):
    return spark.createDataFrame([(f"{a:05}", f"{b:05}") for a, b in edges], "source string, target string")


def plain(edges):
    """Components by reachability of every node, and tiers over them."""
    edges = {(a, b) for a, b in edges if a != b}
    nodes = {x for e in edges for x in e}
    reach = {}
    for n in nodes:
        seen, todo = {n}, [n]
        while todo:
            x = todo.pop()
            new = {b for a, b in edges if a == x} - seen
            seen |= new
            todo += new
        reach[n] = seen
    of = {n: min(m for m in reach[n] if n in reach[m]) for n in nodes}
    between = {(of[a], of[b]) for a, b in edges if of[a] != of[b]}
    tier = dict.fromkeys(of.values(), 0)
    for _ in tier:
        for a, b in between:
            tier[b] = max(tier[b], tier[a] + 1)
    return of, {n: tier[of[n]] for n in nodes}


def check(spark, edges):
    of, tier = plain(edges)
    assert {r.node: r.component for r in strong_components(frame(spark, edges)).collect()} == {f"{k:05}": f"{v:05}" for k, v in of.items()}
    rows = tiers(frame(spark, edges)).collect()
    assert {r.node: r.tier for r in rows} == {f"{k:05}": v for k, v in tier.items()} and len(rows) == len(tier)


@pytest.mark.parametrize("seed", range(4))
def test_random_graphs(spark, seed):
    rng = random.Random(seed)
    n = rng.choice([6, 14, 25])
    check(spark, [(rng.randrange(n), rng.randrange(n)) for _ in range(int(n * rng.choice([0.8, 1.2, 1.6])))])


def test_rings_with_tails_and_between(spark):
    ring = lambda a, n: [(a + k, a + (k + 1) % n) for k in range(n)]
    check(spark, [(0, 10), *ring(10, 5), (12, 20), *ring(20, 2), (21, 30), (30, 31), (5, 5), *ring(40, 3), (41, 31)])


def test_a_long_ring_takes_few_rounds(spark):
    n = 600
    jobs = spark.sparkContext.statusTracker()
    edges = [(k, (k + 1) % n) for k in range(n)] + [(700, 0), (300, 701)]
    before = len(jobs.getJobIdsForGroup(None))
    rows = {r.node: r.tier for r in tiers(frame(spark, edges)).collect()}
    assert rows == {f"{k:05}": 1 for k in range(n)} | {"00700": 0, "00701": 2}
    assert len(jobs.getJobIdsForGroup(None)) - before < 900


def test_dense_graph_and_no_graph(spark):
    rows = tiers(frame(spark, [(a, b) for a in range(12) for b in range(a + 1, 12)])).collect()
    assert {r.node: r.tier for r in rows} == {f"{k:05}": k for k in range(12)}
    assert tiers(frame(spark, [(1, 1)])).isEmpty() and strong_components(frame(spark, [(1, 1)])).isEmpty()
