"""What walks write besides the edges: not more than they have to look at."""

import pytest

from loomgraph.operators import walks


@pytest.fixture
def written(monkeypatch):
    out, plain = [], walks.materialise

    def noted(df, name):
        made = plain(df, name)
        out.append((name, made.count()))
        return made

    monkeypatch.setattr(walks, "materialise", noted)
    return out


def facts(spark, edges):
    return spark.createDataFrame(edges, "src string, dst string").coalesce(1)


def test_drawn_chains_pass_over_outer_layers_once(spark, written):
    edges = [(f"c{i:02}", f"p{i % 6}") for i in range(40)] + [(f"p{i}", f"n{i % 2}") for i in range(6)] + [("n0", "n1"), ("n1", "n0")]
    got = walks.drawn_chains(facts(spark, edges), 2, 4, 5, 1).collect()
    assert len(got) == 5 and all(set(zip(r.names.split(">"), r.names.split(">")[1:])) <= set(edges) for r in got)
    assert [n for name, n in written if name == "inner"] == [8, 2, 2]
    assert all(n < len(edges) for name, n in written if name not in ("edges", "counts"))
    assert sum(n == 48 for name, n in written if name == "counts") == 1


def test_chains_look_for_starts_in_their_lot_alone(spark, written):
    edges = [(f"c{i:02}", f"p{i:02}") for i in range(30)] + [(f"p{i:02}", "n0") for i in range(12, 30)] + [("n0", "n1")]
    got = walks.chains(facts(spark, edges), 3, 3, 2).collect()
    assert [(r["first"], r["last"], r.hops) for r in got] == [("c12", "n1", 3), ("c13", "n1", 3)]
    assert [n for name, n in written if name == "alive"] == [0, 6]


def test_paths_go_back_over_reached_edges_alone(spark, written):
    edges = [("s", "v"), ("v", "t")] + [(f"x{i:02}", "v") for i in range(40)] + [(f"y{i:02}", "t") for i in range(40)]
    names = spark.createDataFrame([("s", "from"), ("t", "to")], "uuid string, name string")
    got = [(r.hops, r.names) for r in walks.paths(names, facts(spark, edges), "from", "to", 4, 5).collect()]
    assert got == [(2, "s>v>t")]
    assert max(n for name, n in written if name != "edges") <= 2
