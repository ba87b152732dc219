"""Components against union-find, and how often a round deals its edges out."""

import random

import pytest

from tidemark.llm import graph


def least_of(edges):
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for u, v in edges:
        if u is not None and v is not None and u != v:
            a, b = sorted((root(u), root(v)))
            parent[b] = a
    return sorted((x, root(x)) for x in parent if root(x) != x)


def random_edges(seed, nodes, n):
    rng = random.Random(seed)
    return [(rng.randrange(nodes) - nodes // 2, rng.randrange(nodes) - nodes // 2) for _ in range(n)]


PATH = list(range(90))
random.Random(3).shuffle(PATH)

GRAPHS = {
    "empty": [],
    "odd": [(1, None), (None, 2), (None, None), (3, 3), (5, 4), (4, 5), (5, 4)],
    "hub": [(i, 0) for i in range(1, 300)] * 2,
    "last": [(500, i) for i in range(300)],
    "repeated": [(9, 1), (9, 5), (5, 1), (9, 5), (9, 1)],
    "path": list(zip(PATH, PATH[1:], strict=False)),
    "sparse": random_edges(1, 400, 180),
    "dense": random_edges(2, 60, 300),
}


@pytest.mark.parametrize("which", GRAPHS)
def test_components(spark, which):
    got = graph.components(spark.createDataFrame(GRAPHS[which], "u long, v long"))
    assert got.columns == ["u", "v"]
    assert sorted(tuple(r) for r in got.collect()) == least_of(GRAPHS[which])


def test_exchanges_of_a_round(spark):
    """Each is a task for every partition, and the driver keeps what it knows of each task."""
    edges = spark.range(1000).selectExpr("id + 1 u", "id v")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = graph._star(edges)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert plan.count("Exchange hashpartitioning") <= 3
