"""Running values by segments, and quotas cut before the shuffle, against plain loops."""

import random

import pytest
from pyspark.sql import functions as F

from loomgraph.config import GateConfig
from loomgraph.operators import gate, windows


def log(seed, n=400):
    """Rows of one hot key, some small ones and a null key, in random order, with missing states."""
    draw = random.Random(seed)
    rows = [(draw.choice(["hot"] * 8 + ["a", "b", None]), i, draw.choice(["red", "red", "green", "grey", None])) for i in range(n)]
    return draw.sample(rows, n)


def frame(spark, rows):
    return spark.createDataFrame(rows, "host string, pos long, overall string").repartition(5)


def by_host(rows):
    out = {}
    for host, pos, overall in sorted(rows, key=lambda r: r[1]):
        out.setdefault(host, []).append((pos, overall))
    return out


@pytest.mark.parametrize("parts", [1, 3, 16])
def test_transitions_debounce_and_hold_of_a_hot_key(spark, parts):
    rows = log(parts)
    fired, runs, held = set(), set(), set()
    for host, states in by_host(rows).items():
        before, run, last = False, 0, "none"
        for pos, overall in states:
            bad = overall == "red"
            if bad != before:
                fired.add((host, pos, "fire" if bad else "clear"))
            before, run = bad, run + 1 if bad else 0
            if run == 3:
                runs.add((host, pos))
            last = last if overall in ("grey", None) else overall
            held.add((host, pos, last))
    df, red = frame(spark, rows), F.col("overall") == "red"
    assert {(r.host, r.pos, r.event) for r in windows.transitions(df, red, "host", ["pos"], parts).collect()} == fired
    assert {(r.host, r.pos) for r in windows.debounced(df, red, "host", ["pos"], 3, parts).collect()} == runs
    known = F.when(F.col("overall") != "grey", F.col("overall"))
    assert {(r.host, r.pos, r.held) for r in windows.hold_last(df, known, "host", ["pos"], "none", parts=parts).collect()} == held


def test_one_key_is_cut_into_many_segments(spark):
    cut = windows.segmented(spark.range(4000).select(F.lit("hot").alias("host"), F.col("id").alias("pos")), ["host"], ["pos"], 16)
    sizes = [r["count"] for r in cut.groupBy("_segment").count().collect()]
    assert len(sizes) == 16 and max(sizes) < 1000
    ranked = windows.prefixed(cut, ["host"], ["pos"], counts={"n": F.lit(True), "even": F.col("pos") % 2 == 0}, lasts={"last": F.when(F.col("pos") % 1000 == 0, F.col("pos"))})
    assert ranked.where("n <> pos + 1 or even <> pos div 2 + 1 or last <> pos - pos % 1000").count() == 0
    earlier = windows.prefixed(cut, ["host"], ["pos"], counts={"n": F.lit(True)}, lasts={"last": F.col("pos")}, upto=-1)
    assert earlier.where("n <> pos or not (last <=> if(pos = 0, null, pos - 1))").count() == 0


def test_segments_of_an_empty_table(spark):
    empty = spark.createDataFrame([], "host string, pos long, overall string")
    red = F.col("overall") == "red"
    assert windows.transitions(empty, red, "host", ["pos"]).count() == 0
    assert windows.debounced(empty, red, "host", ["pos"]).count() == 0
    assert windows.hold_last(empty, F.col("overall"), "host", ["pos"], "green").count() == 0


def test_quota_of_a_hot_key_with_null_keys_and_repeated_ids(spark):
    """Every row asks; the first ids of each key are let in, copies of an id with it, what was admitted before counts."""
    draw = random.Random(5)
    rows = [(i, draw.choice(["p", "p", "p", "q", "", None]), draw.choice(["change", "note"]), draw.choice(["cursor", "codex", None])) for i in range(300)]
    rows += rows[:20]
    cfg = GateConfig(types=("change", "note"), type_weight={}, thresholds={}, default_threshold=-1, skip_threshold=(), skip_quota=(), least_narrative=0, substantive_narrative=0, quotas={"cursor": 7}, default_quota=4)
    df = spark.createDataFrame(rows, "id long, project string, type string, platform string").withColumns({c: F.lit(None).cast("string") for c in ("title", "narrative", "facts", "concepts", "files_modified", "generated_by_model")}).withColumn("relevance_count", F.lit(0)).repartition(6)
    past = spark.createDataFrame([("codex", "p", "change", "pass")] * 2 + [("cursor", "", "note", "pass")] * 9, "platform string, project string, type string, layer string")
    key = lambda r: (r[3], r[1] or "(unknown)", r[2])
    for before, used in ((None, {}), (past, {("codex", "p", "change"): 2, ("cursor", "(unknown)", "note"): 9})):
        want = set()
        for k in {key(r) for r in rows}:
            ids = sorted({r[0] for r in rows if key(r) == k})
            want |= set(ids[: max(0, (7 if k[0] == "cursor" else 4) - used.get(k, 0))])
        got = gate.decide(df, cfg, before=before)
        assert got.count() == len(rows) and set(got.columns) >= set(df.columns)
        assert {r.id for r in got.where("layer = 'pass'").collect()} == want
        assert {r.layer for r in got.collect()} == {"pass", "quota"}
