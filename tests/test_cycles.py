"""Nodes on a cycle or leading to one, over all events, against a plain version."""

from __future__ import annotations

import pytest

from attestry.operators import tabular
from attestry.plans import catalog


def plain(edges):
    """Of (key, a, b): nodes that are left when those without a successor have been taken away again and again."""
    left = set(edges)
    while True:
        nodes = {(key, a) for key, a, _ in left}
        kept = {e for e in left if (e[0], e[2]) in nodes}
        if kept == left:
            return nodes
        left = kept


def test_all_events_count(spark, tmp_path):
    # the loop of "far" needs values of 6 and more and users over 150; folded by 150 "folded" would be a loop
    edges = [("far", 200, 301, 50.0), ("far", 301, 200, 7.5), ("far", 400, 200, 1.0), ("far", 5, 6, 1.0), ("folded", 151, 1, 2.0), ("folded", 1, 2, 2.0), ("own", 3, 3, 9.0)]
    rows = [(k, key, a, value, f'{{"k": {b}}}') for k, (key, a, b, value) in enumerate(edges)]
    spark.createDataFrame(rows, "event_id long, event_type string, user_id long, value double, props string").write.parquet(f"{tmp_path}/events.parquet")
    got = {(r.key, r.node) for r in catalog.queries()["cycle_nodes"](spark, str(tmp_path)).collect()}
    assert got == plain({(key, a, b) for key, a, b, _ in edges}) == {("far", 200), ("far", 301), ("far", 400), ("own", 3)}


GRAPHS = {
    "chain": [("a", 1, 2), ("a", 2, 3), ("a", 3, 4)],
    "one of two": [("a", 1, 2), ("a", 2, 1), ("a", 0, 1), ("b", 1, 2)],
    "none": [],
    "self": [("a", 7, 7), ("a", 7, 8), ("a", 6, 7), ("a", 6, 7)],
    "nulls": [("a", None, 1), ("a", 1, None), (None, 1, 1), (None, 2, 3)],
}


@pytest.mark.parametrize("in_one_task", [100_000, 0])
@pytest.mark.parametrize("name", GRAPHS)
def test_small_graphs(spark, name, in_one_task):
    edges = GRAPHS[name]
    got = {(r.key, r.node) for r in tabular.cycle_nodes(spark.createDataFrame(edges, "key string, a long, b long"), in_one_task).collect()}
    assert got == plain({e for e in edges if None not in e[1:]})


def test_nodes_may_be_strings(spark):
    edges = spark.createDataFrame([("a", "x", "y"), ("a", "y", "x"), ("b", "x", "y")], "key string, a string, b string")
    assert {tuple(r) for r in tabular.cycle_nodes(edges).collect()} == {("a", "x"), ("a", "y")}
