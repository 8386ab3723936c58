"""Neighbours read the facts by a pushed filter."""

import pytest

from loomgraph.operators import graph


@pytest.mark.parametrize("most", [1000, 1])
def test_neighbours_of_a_name_of_several(spark, monkeypatch, most):
    monkeypatch.setattr(graph, "MOST_STARTS", most)
    entities = spark.createDataFrame([("a", "x"), ("b", "x"), ("c", "y"), ("d", "z"), (None, "x")], "uuid string, name string")
    facts = spark.createDataFrame([("a", "c", "e"), ("b", "d", "e"), ("c", "a", "f"), ("d", "c", "g"), (None, "c", "h")], "src string, dst string, name string")
    got = sorted((r.neighbour, r.edge, r.direction) for r in graph.neighbours(entities, facts, "x").collect())
    assert got == [("y", "e", "out"), ("y", "f", "in"), ("z", "e", "out")]


def test_the_filter_stands_below_the_distinct_of_the_facts(spark):
    entities = spark.createDataFrame([("a", "x"), ("c", "y")], "uuid string, name string")
    facts = spark.createDataFrame([("a", "c", "e"), ("c", "a", "f")], "src string, dst string, name string").distinct()
    plan = graph.neighbours(entities, facts, "x")._jdf.queryExecution().optimizedPlan().toString()
    parts = [p for p in plan.split("Aggregate [src")[1:]]
    assert len(parts) == 2 and all("Filter" in p and "= a" in p for p in parts)
