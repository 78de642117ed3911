import random

from touchline.llm.graph import components


def roots(spark, edges, extra=False):
    frame = spark.createDataFrame(edges, "a long, b long")
    if extra:
        frame = frame.selectExpr("a", "b", "1 root", "2 node")
    return {r.node: r.root for r in components(frame).collect()}


def plain(edges):
    """Root of each node by joining sets one edge at a time."""
    sets = {}
    for a, b in edges:
        if a is None or b is None:
            continue
        joined = sets.get(a, {a}) | sets.get(b, {b})
        for node in joined:
            sets[node] = joined
    return {node: min(group) for node, group in sets.items()}


def test_random_graphs(spark):
    rng = random.Random(5)
    for n in (3, 40):
        edges = [(rng.randrange(n * 2), rng.randrange(n * 2)) for _ in range(n)]
        assert roots(spark, edges) == plain(edges)


def test_long_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(60)] + [(1000, i) for i in range(1001, 1100)]
    assert roots(spark, edges) == plain(edges)


def test_odd_edges(spark):
    edges = [(7, 7), (3, 2), (2, 3), (3, 2), (None, 2), (4, None), (None, None)]
    assert roots(spark, edges, extra=True) == {7: 7, 2: 2, 3: 2}
    assert roots(spark, []) == {}
