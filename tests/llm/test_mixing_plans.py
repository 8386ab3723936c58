"""The mixing solver's queries stay small, however many steps it takes."""

import numpy as np

from loomgraph.llm import soft_mixing

ROWS = [(10 + i % 7, *p) for i, p in enumerate([(0.7, 0.2, 0.1), (0.2, 0.5, 0.3), (0.1, 0.3, 0.6), (0.45, 0.3, 0.25)] * 5)]
SCHEMA = "n_tokens bigint, p_clean double, p_low double, p_toxic double"
#: No rates meet these; seven steps come near.
TARGETS = {"clean": 100.0, "low": 50.0, "toxic": 5.0}


def test_plans_do_not_grow_with_the_steps(spark, monkeypatch):
    rows, sizes = spark.createDataFrame(ROWS, SCHEMA), []
    first = type(rows).first

    def seen(df):
        sizes.append(len(df._jdf.queryExecution().analyzed().toString()))
        return first(df)

    monkeypatch.setattr(type(rows), "first", seen)
    steps, met = soft_mixing.solve(rows, targets=TARGETS)
    assert not met and len(steps) >= 3
    assert max(sizes[1:]) < 1.5 * sizes[1]


def test_one_pass_takes_the_step_that_single_passes_take(spark, monkeypatch):
    rows = spark.createDataFrame(ROWS, SCHEMA)
    got = soft_mixing.solve(rows, targets=TARGETS)
    monkeypatch.setattr(soft_mixing, "TRIED", 1)
    alone = soft_mixing.solve(rows, targets=TARGETS)
    assert got[1] == alone[1] and np.allclose(got[0], alone[0], rtol=1e-9, atol=1e-12)


def test_sums_equal_a_plain_computation(spark):
    steps, tried = [np.array([0.5, 0.2, 1.5])], [np.array([0.0, 0.0, 0.0]), np.array([0.1, -0.4, 0.9])]
    for row, last in zip(soft_mixing._sums(spark.createDataFrame(ROWS, SCHEMA).repartition(3), steps, tried), tried, strict=True):
        want = np.zeros(13)
        for t, *p in ROWS:
            rate = 1.0
            for step in (*steps, last):
                rate = max(0.0, rate - float(np.dot(p, step)))
            want += t * np.concatenate(([1], np.array(p) * rate, np.outer(p, p).ravel() * (rate > 0)))
        assert np.allclose(row, want)
    assert not soft_mixing._sums(spark.createDataFrame([], SCHEMA), steps, tried).any()
