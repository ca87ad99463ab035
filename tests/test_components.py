import random

from sparkloom.operators.components import connected_components


def brute(edges):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is None or b is None or a == b:
            continue
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    return {x: find(x) for x in parent}


def got(spark, edges):
    df = spark.createDataFrame(edges, "a long, b long")
    return {r.node: r.component for r in connected_components(df).collect()}


def test_random_chain_star_and_odd_rows(spark):
    rng = random.Random(3)
    edges = [(i, i + 1) for i in range(100, 160)] + [(500, i) for i in range(501, 540)]
    edges += [(rng.randrange(80), rng.randrange(80)) for _ in range(50)]
    edges += [(7, 7), (None, 3), (3, None), (1000, -5), (1000, -5), (-5, 1000)]
    assert got(spark, edges) == brute(edges)


def test_empty(spark):
    assert got(spark, []) == {}
