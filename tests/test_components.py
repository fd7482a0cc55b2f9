"""Strongly connected components against a plain version."""

from __future__ import annotations

import random

import pytest

from attestry.operators.components import strong_components


def plain(edges):
    """(key, node, smallest node of its component) of nodes that reach themselves."""
    after = {}
    for key, a, b in edges:
        if a is not None and b is not None:
            after.setdefault((key, a), set()).add((key, b))

    def reached(start):
        seen, todo = set(), [start]
        while todo:
            for n in after.get(todo.pop(), ()):
                if n not in seen:
                    seen.add(n)
                    todo.append(n)
        return seen

    ways = {n: reached(n) for n in after}
    on = [n for n in ways if n in ways[n]]
    return sorted(((n[0], n[1], min(m[1] for m in on if m in ways[n] and n in ways[m])) for n in on), key=repr)


def ring(key, *nodes):
    return [(key, a, b) for a, b in zip(nodes, nodes[1:] + nodes[:1], strict=True)]


rng = random.Random(8)
GRAPHS = {
    "none": [],
    "chain": [("a", k, k + 1) for k in range(20)],
    "ring": ring("a", *range(13)),
    "rings joined by a chain": ring("a", 1, 2, 3) + [("a", 3, 10), ("a", 10, 11), ("a", 11, 12)] + ring("a", 12, 13),
    "loops, nulls and repeats": [("a", 7, 7), ("a", 7, 8), ("a", 6, 7), ("a", 6, 7), ("a", None, 1), ("a", 1, None), (None, 1, 1), (None, 2, 3), (None, 3, 2)],
    "one node of two rings": ring("a", 1, 2, 3) + ring("a", 1, 4, 5, 6),
    "rings on the chains of others": ring("a", 1, 2, 3, 4) + ring("a", 2, 10, 11) + ring("a", 10, 12) + [("a", 1, 3), ("a", 4, 20), ("a", 20, 21)] + ring("a", 21, 22, 23) + ring("a", 22, 24),
    "keys apart": ring("a", 1, 2) + [("b", 1, 2), ("c", 2, 1)],
    "thin": [("a", rng.randrange(60), rng.randrange(60)) for _ in range(70)],
    "thick": [(rng.choice("ab"), rng.randrange(25), rng.randrange(25)) for _ in range(110)],
}


@pytest.mark.parametrize("name", GRAPHS)
def test_small_graphs(spark, name):
    got = strong_components(spark.createDataFrame(GRAPHS[name], "key string, a long, b long"))
    assert sorted((tuple(r) for r in got.collect()), key=repr) == plain(GRAPHS[name])


def test_nodes_may_be_strings(spark):
    got = strong_components(spark.createDataFrame([(1, "x", "y"), (1, "y", "x"), (2, "x", "y")], "key int, a string, b string"))
    assert sorted(tuple(r) for r in got.collect()) == [(1, "x", "x"), (1, "y", "x")]


def test_long_ways(spark):
    """A chain of 100,000 nodes into a ring of 50,000, of which one node has a way out: rounds grow with the logarithm, or this would not end."""
    chain = spark.range(100_000).selectExpr("'k' AS key", "id AS a", "id + 1 AS b")
    circle = spark.range(100_000, 150_000).selectExpr("'k' AS key", "id AS a", "if(id = 149999, 100000, id + 1) AS b")
    out = spark.range(1).selectExpr("'k' AS key", "120000L AS a", "-1L AS b")
    got = strong_components(chain.unionByName(circle).unionByName(out))
    assert got.selectExpr("count(*) AS n", "count(DISTINCT component) AS c", "min(node) AS low", "max(node) AS high", "min(component) AS least").first()[:] == (50_000, 1, 100_000, 149_999, 100_000)
