"""Entity resolution by hashing against all pairs."""

import numpy as np
from pyspark.sql import functions as F

from loomgraph.operators import graph, resolution
from loomgraph.tables import components

SCHEMA = "uuid long, label string, v array<double>"


def roots(df):
    return {r.node: r.root for r in components(df).collect()}


def test_links_give_the_components_of_all_pairs(spark):
    """Groups around seeds in one hot block, many equal copies, chains whose ends aren't similar."""
    draw, rows = np.random.default_rng(1), []
    for seed in draw.standard_normal((40, 16)):
        for _ in range(int(draw.integers(1, 9))):
            rows.append((len(rows), "hot" if len(rows) % 5 else "cold", (seed + 0.12 * draw.standard_normal(16)).tolist()))
    step = draw.standard_normal(16)
    for k in range(12):  # a chain: neighbours are similar, its ends aren't
        rows.append((len(rows), "hot", (step + 0.25 * k * np.roll(step, 1)).tolist()))
    rows += [(len(rows) + i, "hot", rows[0][2]) for i in range(60)]
    rows += [(900, None, rows[0][2]), (901, "hot", None), (902, "hot", [0.0] * 16), (903, "hot", []), (904, "hot", [1.0, 2.0]), (905, "hot", [2.0, 4.0])]
    df = spark.createDataFrame(rows + rows[:3], SCHEMA).repartition(4)
    got = resolution.hashed_links(df, F.col("label"), "v", 0.95)
    unit = {u: np.array(v) / np.linalg.norm(v) for u, label, v in rows if label and v and any(v)}
    label = {u: x for u, x, _ in rows}
    for r in got.collect():
        assert r.a < r.b and label[r.a] == label[r.b] and len(unit[r.a]) == len(unit[r.b]) and unit[r.a] @ unit[r.b] >= 0.95 - 1e-9
    pairs = [(a, b) for a in unit for b in unit if a < b and label[a] == label[b] and len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= 0.95]
    want = roots(spark.createDataFrame(pairs, "a long, b long"))
    found = roots(got)
    same = sum(found.get(a, a) == found.get(b, b) for a, b in pairs)
    assert same >= 0.99 * len(pairs) and len(pairs) > 2000
    assert all(want[a] == want[b] for a, b in ((r.a, r.b) for r in got.collect()))
    assert got.count() < len(pairs) / 2  # copies and full buckets aren't expanded
    assert found[904] == found[905] == 904


def test_plan_reaches_its_recall_and_keeps_buckets_small():
    assert resolution.plan(100, 0.9, 0.99) == (8, 14)
    bits, bands = resolution.plan(10**9, 0.95, 0.99)
    assert 10**9 / 2**bits <= 2 * resolution.BUCKET and bands < 200
    assert resolution.plan(0, 1.0, 0.99) == (8, 1)


def test_no_entities(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert resolution.hashed_links(none, F.col("label"), "v", 0.9).count() == 0
    assert graph.resolved(none, resolution.hashed_links(none, F.col("label"), "v", 0.9)).count() == 0
