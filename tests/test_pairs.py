"""Similar pairs by cells of blocks against all pairs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomgraph.operators import graph, pairs
from loomgraph.tables import components

SCHEMA = "uuid long, label string, v array<float>"


def sample():
    draw = np.random.default_rng(3)
    rows = [(i, "hot" if i % 6 else "cold", draw.standard_normal(8).astype("f4").tolist()) for i in range(150)]
    rows += [(200 + i, "hot", rows[1][2]) for i in range(40)]  # equal copies
    rows += [(300, "hot", [0.0] * 8), (301, "hot", [1.0] * 3), (302, "hot", [2.0] * 3), (303, "hot", None), (304, None, [1.0] * 8), (305, "hot", [1.0, None]), (306, "hot", [1.0, None]), (307, "hot", []), (308, "hot", [])]
    return rows


def wanted(rows, least):
    out = set()
    for a, x, v in rows:
        for b, y, w in rows:
            if a < b and x is not None and x == y and v is not None and w is not None and len(v) == len(w) and None not in (*v, *w):
                dot, n, m = (sum(p * q for p, q in zip(*k, strict=True)) for k in ((v, w), (v, v), (w, w)))
                if dot >= least * n**0.5 * m**0.5:
                    out.add((a, b))
    return out


@pytest.mark.parametrize("part", [7, 2048])
def test_all_pairs_once_and_no_cell_holds_a_block(spark, monkeypatch, part):
    monkeypatch.setattr(pairs, "PART", part)
    rows = sample()
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = [(r.a, r.b) for r in graph.resolve_entities(df, F.col("label"), "v", 0.5).collect()]
    assert len(got) == len(set(got)) and set(got) == wanted(rows, 0.5)


@pytest.mark.parametrize("part", [7, 2048])
def test_connecting_pairs_have_the_components_of_all(spark, monkeypatch, part):
    monkeypatch.setattr(pairs, "PART", part)
    rows = sample()
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    found, all_pairs = graph.connecting(df, F.col("label"), "v", 0.6), wanted(rows, 0.6)
    links = {(r.a, r.b) for r in found.collect()}
    assert links <= all_pairs and len(links) < len(all_pairs) / 3
    root = lambda of: {r.node: r.root for r in components(spark.createDataFrame(sorted(of), "a long, b long")).collect()}
    assert root(links) == root(all_pairs)


def test_bounds_are_met_as_sql_adds(spark):
    """At a bound that a pair meets to the last digit it is found, one digit above it isn't."""
    v, w = [0.1, 0.2, 0.3], [0.3, 0.1, 0.7]
    n, m, dot = (sum(x * x for x in v)) ** 0.5, (sum(x * x for x in w)) ** 0.5, sum(x * y for x, y in zip(v, w, strict=True))
    least = next(x for x in np.nextafter(dot / n / m, [-1, dot / n / m, 1]).tolist()[::-1] if dot >= x * n * m)
    df = spark.createDataFrame([(1, "a", v), (2, "a", w)], "uuid long, label string, v array<double>")
    assert graph.resolve_entities(df, F.col("label"), "v", least).count() == 1
    assert graph.resolve_entities(df, F.col("label"), "v", least + 1e-15).count() == 0
