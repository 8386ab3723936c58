"""Usage reports folded into stored feedback, against a loop that merges them one by one; deliveries' invariants; payloads."""

import random

from pyspark.sql import functions as F

from loomgraph.operators import classify, evaluate, graph, intake, lifecycle, ranking, windows

STORED = "id long, episode_name string, verdict string, query string, status string, report_count long, replacement string, handled_action string"
REPORTS = "report_id long, episode_name string, verdict string, query string, replacement string"
EPISODES = [("a", False, False), ("hot", False, None), ("v", True, False), ("canonical-1", False, False), ("gone", False, True), ("new", None, False)]


def merged(stored, reports):
    """One report after the other, as a service would take them."""
    rows = [list(r) for r in stored]
    verified = {n: bool(v) for n, v, _ in EPISODES}
    live = {n for n, _, archived in EPISODES if not archived}
    for rid, name, verdict, query, repl in sorted(reports):
        name, query = (name or "").strip(), (query or "").strip()
        if verdict not in ("stale", "conflict", "supplement", "inaccurate", "irrelevant", "missed") or name not in verified:
            continue
        search = verdict in ("irrelevant", "missed")
        if search and not query:
            continue
        status, query = ("diagnostic", query) if search else ("pending", "")
        waiting = [r for r in rows if r[1] == name and r[2] == verdict and r[4] == status and (not search or (r[3] or "") == query)]
        if waiting:
            row = min(waiting, key=lambda r: (r[0] is None, r[0] or 0))
        else:
            row = [None, name, verdict, query, status, 0, None, None]
            rows.append(row)
        row[5] = (1 if row[5] is None else row[5]) + 1
        if repl in live:
            row[6] = repl
        if search:
            continue
        action = None
        if verdict in ("stale", "inaccurate") and not name.startswith("canonical-") and not verified[name] and (repl in live or row[5] >= 2):
            action = "auto_retire"
        elif verdict == "supplement" and repl in live:
            action = "auto_noted"
        if action:
            row[4], row[7] = "auto_handled", action
    return sorted((r[1], r[2], r[3] or "", r[4], r[5] or 0, r[6] or "", r[7] or "") for r in rows)


def test_reports_folded_as_if_one_by_one(spark):
    episodes = spark.createDataFrame(EPISODES, "name string, verified boolean, archived boolean")
    verdicts = ["stale", "conflict", "supplement", "inaccurate", "irrelevant", "missed", "nonsense", None]
    for seed in range(2):
        draw = random.Random(seed)
        stored = [(1, "hot", "stale", None, "pending", 1, None, None), (2, "a", "conflict", "", "pending", 4, None, None), (3, "a", "conflict", "x", "pending", 2, None, None), (4, "v", "missed", "q1", "diagnostic", None, None, None), (5, "a", "stale", "", "auto_handled", 2, "new", "auto_retire")]
        reports = [(i, draw.choice(["hot"] * 9 + ["a", "v", " a ", "canonical-1", "nobody", "", None]), draw.choice(["stale"] * 8 + verdicts), draw.choice(["q1", "q2", "", None]), draw.choice([None, None, "new", "gone", "nobody"])) for i in range(300)]
        got = intake.folded(spark.createDataFrame(stored, STORED), spark.createDataFrame(reports, REPORTS).repartition(5), episodes, "canonical-").collect()
        assert len({r.id for r in got}) == len(got)
        assert sorted((r.episode_name, r.verdict, r.query, r.status, r.report_count or 0, r.replacement or "", r.handled_action or "") for r in got) == merged(stored, reports)


def test_two_batches_are_one(spark):
    """A report that waits after the first batch is closed by the second; both together give the same rows."""
    episodes = spark.createDataFrame(EPISODES, "name string, verified boolean, archived boolean")
    first, second = [(1, "a", "stale", "", None), (2, "v", "stale", "", None)], [(3, "a", "stale", "", None), (4, "v", "stale", "", None), (5, "a", "stale", "", "new")]
    none = spark.createDataFrame([], STORED)
    waits = intake.folded(none, spark.createDataFrame(first, REPORTS), episodes, "canonical-")
    assert {(r.episode_name, r.status, r.report_count) for r in waits.collect()} == {("a", "pending", 1), ("v", "pending", 1)}
    numbered = waits.withColumn("id", F.xxhash64("id"))
    then = intake.folded(numbered, spark.createDataFrame(second, REPORTS), episodes, "canonical-")
    both = intake.folded(none, spark.createDataFrame(first + second, REPORTS), episodes, "canonical-")
    rows = lambda df: sorted((r.episode_name, r.status, r.report_count, r.handled_action or "", r.replacement or "") for r in df.collect())
    assert rows(then) == rows(both) == [("a", "auto_handled", 1, "auto_retire", "new"), ("a", "auto_handled", 2, "auto_retire", ""), ("v", "pending", 2, "", "")]
    assert intake.folded(none, spark.createDataFrame([], REPORTS), episodes, "canonical-").count() == 0


def test_delivery_invariants_and_noise(spark):
    items = [(1, "d", 5.0, "decision", False), (1, "b", 9.0, "bugfix", True), (1, "x", 4.0, "discovery", False), (2, "b", 9.0, "bugfix", False), (2, "d", 1.0, "decision", False)]
    df = spark.createDataFrame(items, "query_id int, name string, score double, type string, noise boolean")
    assert tuple(ranking.delivery_invariants(df, 1).first()) == (2, 1, 2, 0)
    top = ranking.tier_rerank(df, 3, noise=F.col("noise")).where("query_id = 1").collect()
    assert {r.name: r.tscore for r in top}["b"] == 1.8


def test_accuracy_of_empty_and_null_kinds(spark):
    counts = spark.createDataFrame([("a", "a", 3), ("a", "b", 1), (None, None, 1)], "gold string, got string, n long")
    assert tuple(evaluate.accuracy(counts).first()) == (5, 3, 0.6)
    assert tuple(evaluate.accuracy(counts.limit(0)).first()) == (0, 0, 0.0)


def test_payload_of_nulls(spark):
    row = spark.createDataFrame([(1, None, None, None, None, None, None, "", '["r"]', None, "s")], "id long, type string, title string, narrative string, facts string, concepts string, files_modified string, platform string, files_read string, project string, subtitle string")
    p = row.select(classify.payload("obs").alias("p")).first().p
    assert p.source_description == "obs id=1 project=? type=? platform=_default"
    assert p.episode_body == "[OBS] (untitled)\ns\n\nFiles read: r\nProject: ?"


def test_neighbours_with_facts_and_without_a_match(spark):
    e = spark.createDataFrame([("1", "ann"), ("2", "bob"), ("3", "ann")], "uuid string, name string")
    f = spark.createDataFrame([("1", "2", "knows", "ann knows bob"), ("2", "3", "likes", None)], "src string, dst string, name string, fact string")
    rows = lambda text: sorted(tuple(r) for r in graph.neighbours(e, f, text, rows_without=True).collect())
    assert rows("an") == [("ann", "bob", "knows", "out", "2", "ann knows bob"), ("ann", "bob", "likes", "in", "2", None)]
    assert rows("nobody") == [(None,) * 6]
    lone = e.where("name = 'bob'")
    assert graph.neighbours(lone, f.limit(0), "bob", rows_without=True).count() == 0


def test_waiting_feedback_of_names_with_several_episodes(spark):
    fb = spark.sql("select * from values (1, 'a', 'stale', 'pending', timestamp'2024-01-01', null), (2, 'b', 'stale', 'pending', timestamp'2024-01-02', null), (3, null, 'stale', 'pending', timestamp'2024-01-03', null), (4, 'a', 'stale', 'handled', timestamp'2024-01-04', null) as t(id, episode_name, verdict, status, created_at, updated_at)")
    ep = spark.createDataFrame([("u1", "a", "x" * 5000), ("u2", "a", None), ("u3", None, "n")], "uuid string, name string, content string")
    got = [(r.id, r.name, r.uuid, None if r.detail is None else len(r.detail)) for r in lifecycle.waiting_with_episodes(fb, ep).collect()]
    assert got == [(3, None, None, None), (2, "b", None, None), (1, "a", "u1", 4000), (1, "a", "u2", 0)]


def test_tool_light(spark):
    df = spark.createDataFrame([(None,), (0,), (14399,), (14400,)], "age int")
    assert [r[0] for r in df.select(windows.tool_light(F.col("age"))).collect()] == ["grey", "green", "green", "amber"]
