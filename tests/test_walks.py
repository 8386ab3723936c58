"""Paths and chains against plain enumeration on small graphs with dead ends, hubs, cycles and odd rows."""

import random

import pytest

from loomgraph.operators import walks


def simple_paths(edges, starts, hops):
    """All simple paths of 1 to ``hops`` edges."""
    found, level = [], [(s,) for s in sorted(starts)]
    for _ in range(hops):
        level = [(*p, b) for p in level for a, b in edges if a == p[-1] and b not in p]
        found += level
    return found


def tables(spark, nodes, edges):
    n = spark.createDataFrame([(u, f"{'from' if u.startswith('s') else 'to' if u.startswith('t') else 'via'} {u}") for u in nodes] + [(None, "from"), ("v9", None)], "uuid string, name string")
    rows = [(a, b, "r") for a, b in edges] + [(a, b, "again") for a, b in edges[:5]] + [(None, "t1", "r"), ("s1", None, "r"), ("v1", "v1", "r")]
    return n, spark.createDataFrame(rows, "src string, dst string, name string")


@pytest.fixture(scope="module")
def graph():
    r = random.Random(5)
    # Names that begin each other, so that the order with and without the separator differs.
    nodes = ["s1", "s10", "s2", "v1", "v11", "v2", "v21", "v3", "t1", "t10", "t2"]
    return nodes, sorted({(a, b) for a in nodes for b in nodes if a != b and r.random() < 0.3})


@pytest.mark.parametrize(("hops", "most", "beam"), [(6, 30, 5), (6, 10_000, 100), (1, 5, 2)])
def test_paths_equal_enumeration_and_hold_a_beam(spark, graph, monkeypatch, hops, most, beam):
    nodes, edges = graph
    held, plain = [], walks._extended

    def counted(edges, prefixes):
        held.append(prefixes.count())
        return plain(edges, prefixes)

    monkeypatch.setattr(walks, "_extended", counted)
    all_paths = [p for p in simple_paths(edges, [n for n in nodes if n.startswith("s")], hops) if p[-1].startswith("t")]
    want = sorted((len(p) - 1, ">".join(p)) for p in all_paths)[:most]
    got = [(r.hops, r.names) for r in walks.paths(*tables(spark, nodes, edges), "from", "to", hops, most, beam).collect()]
    assert got == want
    assert max(held) <= beam


def test_paths_of_dead_ends_wait_for_the_next_beam(spark):
    # The first forty ways of three edges come back to a node they hold; only the last one reaches the target.
    edges = [("s", f"a{i:02}") for i in range(40)] + [(f"a{i:02}", "s") for i in range(40)] + [("s", "z"), ("z", "y"), ("y", "t")]
    n, f = tables(spark, ["s", "z", "y", "t", *(f"a{i:02}" for i in range(40))], edges)
    assert [(r.hops, r.names) for r in walks.paths(n, f, "from s", "to t", 6, 3, beam=4).collect()] == [(3, "s>z>y>t")]


def test_chains_equal_enumeration_over_several_lots_of_starts(spark, graph):
    nodes, edges = graph
    best = {}
    for p in simple_paths(edges, nodes, 4):
        if len(p) > 3:
            best[p[0], p[-1]] = min(best.get((p[0], p[-1]), 9), len(p) - 1)
    for k in (2, 30, 1000):
        got = [(r["first"], r["last"], r.hops) for r in walks.chains(tables(spark, nodes, edges)[1], 3, 4, k).collect()]
        assert got == sorted((a, b, h) for (a, b), h in best.items())[:k]


def test_walk_counts_equal_enumeration(spark, graph):
    nodes, edges = graph
    want, level = {}, {n: 1 for n in nodes}
    for hop in range(1, 5):
        level = {n: sum(level[b] for a, b in edges if a == n) for n in nodes}
        want |= {(n, hop): c for n, c in level.items() if c}
    got = {(r.uuid, r.hops): int(r.walks) for r in walks.walk_counts(walks.plain_edges(tables(spark, nodes, edges)[1]), 4).collect()}
    assert got == want


def test_drawn_chains_are_simple_distinct_and_repeatable(spark, graph):
    nodes, edges = graph
    f = tables(spark, nodes, edges)[1]
    first = walks.drawn_chains(f, 3, 5, 12, 1).collect()
    assert walks.drawn_chains(f.repartition(7), 3, 5, 12, 1).collect() == first
    assert walks.drawn_chains(f, 3, 5, 12, 2).collect() != first
    assert len(first) == 12 == len({(r["first"], r["last"]) for r in first})
    for r in first:
        p = r.names.split(">")
        assert 3 <= len(p) - 1 == r.hops <= 5 and len(set(p)) == len(p) and (p[0], p[-1]) == (r["first"], r["last"])
        assert all(e in edges for e in zip(p, p[1:]))


def test_nothing_to_walk(spark):
    n, f = tables(spark, ["s1", "t1"], [])
    empty = f.where("false")
    assert walks.paths(n, f, "from", "to").count() == walks.paths(n.where("false"), empty, "from", "to").count() == 0
    assert walks.chains(empty, 2, 3, 5).count() == walks.drawn_chains(empty, 2, 3, 5, 1).count() == 0
