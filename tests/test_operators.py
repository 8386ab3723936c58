"""Unit tables for the operators: literal rows against expected values."""

import gzip
import hashlib
import json
from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from loomgraph import config, schemas
from loomgraph.config import GateConfig
from loomgraph.functions.columns import clamped, cpu_seconds, escaped, excerpt, humanised, in_hours, json_list, occurrences, path_keywords, short_age, snippet
from loomgraph.operators import classify, evaluate, gate, graph, lifecycle, ranking, retrieval, state, walks, windows
from loomgraph.sources import readers
from loomgraph.streaming import jobs
from loomgraph.tables import components, current_state, replace_state

NOISE = GateConfig(noise_enabled=True, noise_markers=("hub",), noise_keywords=("docker", "daemon", "watchdog"), noise_hits=2)
LONG = "x" * 100


def observation(i, type_="bugfix", narrative=LONG, facts='["a"]', model="m", title="t", platform="claude", relevance=0):
    return (i, "p", type_, title, narrative, facts, None, None, relevance, model, platform)


def observations(spark, rows):
    return spark.createDataFrame(rows, "id long, project string, type string, title string, narrative string, facts string, concepts string, files_modified string, relevance_count int, generated_by_model string, platform string")


@pytest.mark.parametrize(("row", "noise"), [
    (observation(1, title="hub docker daemon"), True),
    (observation(1, title="docker daemon"), False),
    (observation(1, title="hub docker"), False),
    (observation(1, type_="decision", title="hub docker daemon"), False),
    (observation(1, narrative="the HUB " + LONG, facts='["docker","watchdog"]'), True),
    (observation(1, narrative=None, title=None, facts=None), False),
])
def test_noise(spark, row, noise):
    assert observations(spark, [row]).select(gate.is_noise(NOISE).alias("x")).first().x is noise


def test_gate_layers(spark):
    rows = [
        observation(1, "note"), observation(2, narrative="short"), observation(3, "security_alert", narrative="short", facts=None), observation(4, facts="not json"), observation(5, facts=None, narrative="x" * 300),
        observation(6, model="Fallback-1"), observation(7, "discovery"), observation(8, "feature"), observation(9, "change", relevance=20), observation(10, "bugfix", title="hub docker daemon"), observation(11, "discovery", platform="cursor", relevance=9),
    ]
    got = {r.id: (r.layer, r.would_accept) for r in gate.decide(observations(spark, rows), NOISE).collect()}
    assert got == {1: ("hard_gate", False), 2: ("hard_gate", False), 3: ("override", True), 4: ("hard_gate", False), 5: ("override", True), 6: ("hard_gate", False), 7: ("score", False), 8: ("pass", True), 9: ("pass", True), 10: ("ops_noise", False), 11: ("score", False)}


def test_quota_admits_the_first_and_zero_is_no_limit(spark):
    rows = observations(spark, [observation(i, "feature") for i in range(1, 6)])
    assert [r.id for r in gate.decide(rows, quota=2).where("would_accept").orderBy("id").collect()] == [1, 2]
    assert gate.decide(rows, quota=0).where("would_accept").count() == 5


def test_shadow_accepts_all(spark):
    row = gate.decide(observations(spark, [observation(1, "note")]), GateConfig(shadow=True)).first()
    assert (row.accept, row.would_accept) == (True, False)


def test_columns(spark):
    row = spark.createDataFrame([("aXaXa", '["a","b"]', '{"a":1}', "<a&b>", " l1\nl2 long ")], "a string, j string, k string, h string, s string").select(
        occurrences(F.col("a"), "aXa").alias("n"), F.size(json_list("j")).alias("j"), F.size(json_list("k")).alias("k"), escaped(F.col("h")).alias("h"), snippet(F.col("s"), 5).alias("s"), humanised(F.lit(89)).alias("x"), humanised(F.lit(5400)).alias("y"), humanised(F.lit(172_800)).alias("z"),
        in_hours(F.expr("timestamp'2024-01-01 15:00:00'"), 22, 5).alias("w"), in_hours(F.expr("timestamp'2024-01-01 15:00:00'"), 4, 4).alias("v"),
    ).first()
    assert row.asDict() == {"n": 1, "j": 2, "k": 0, "h": "&lt;a&amp;b&gt;", "s": "l1 l2…", "x": "89s", "y": "1h", "z": "2d", "w": True, "v": False}
    assert [clamped(x, 1, 10, 3) for x in ("7", None, 99, -1, "x")] == [7, 3, 10, 1, 3]


@pytest.mark.parametrize(("content", "strict", "lenient"), [
    ("**来源**: 公众号文章《x》", "external-article", "external-article"),
    ("**来源**：公众号文章《x》", "firsthand", "external-article"),
    ("# t\n## 来源\n- 小红书 note\n- log\n# next", "external-community", "external-community"),
    ("## 数据来源\n- 文章《y》\n", "external-article", "external-article"),
    ("**来源**: team", "firsthand", "firsthand"),
    (None, "firsthand", "firsthand"),
    ("文章《z》 without a label", "firsthand", "firsthand"),
])
def test_provenance(spark, content, strict, lenient):
    row = spark.createDataFrame([(content,)], "content string").select(classify.provenance().alias("a"), classify.provenance(lenient=True).alias("b")).first()
    assert (row.a, row.b) == (strict, lenient)


def test_route_counts_bytes(spark):
    rows = [("capsule-a", "断" * 500, "split"), ("capsule-a", "x" * 500, None), ("other", "断" * 900, None), ("capsule-index 目录", "x", "catalog"), ("capsule-l", "\n".join(["- item"] * 20), "catalog"), ("capsule-l", "\n".join(["- 结论"] * 20), None)]
    got = spark.createDataFrame([(n, c) for n, c, _ in rows], "name string, content string").select(classify.route().alias("r")).collect()
    assert [r.r for r in got] == [r for _, _, r in rows]


def test_kind_chain(spark):
    rows = spark.createDataFrame([("canonical-a", "type=bugfix", None), ("x", "type=Decision", None), ("x", "none", None), ("x", "type=bugfix", "素材")], "name string, source_description string, o string")
    got = rows.select(classify.resolved_kind(classify.kind(), F.col("o")).alias("k")).collect()
    assert [tuple(r.k) for r in got] == [("手册", 0.9), ("决策", 0.85), ("unclassified", 0.0), ("素材", 1.0)]


def test_canonical_context_explores_the_least_used(spark):
    rows = [(f"e{i}", f"canonical-{i}", "the " * (5 - i), False, uses, "global") for i, uses in enumerate([9, 8, 7, 0, 5])] + [("a", "canonical-z", "the", True, 0, "global"), ("o", "obs", "the", False, 0, "global")]
    e = spark.createDataFrame(rows, "uuid string, name string, content string, archived boolean, usage_count long, scope string")
    assert [(r.uuid, r.reason) for r in ranking.canonical_context(e, "the", 3).orderBy("place").collect()] == [("e0", "relevance"), ("e1", "relevance"), ("e3", "explore")]
    assert ranking.canonical_context(e, "the", 9).count() == 5
    assert ranking.canonical_context(e.limit(0), "the", 3).count() == 0


def test_tiers_keep_one_operational(spark):
    items = [("q", "d1", 9.0, "decision"), ("q", "d2", 8.0, "decision"), ("q", "x", 7.0, "note"), ("q", "b1", 2.0, "bugfix"), ("q", "b2", 1.0, "bugfix")]
    df = spark.createDataFrame(items, "query_id string, name string, score double, type string")
    assert {r.name for r in ranking.tier_rerank(df, 3).collect()} == {"d1", "d2", "b1"}
    assert {r.name for r in ranking.tier_rerank(df, 2).collect()} == {"d1", "d2"}
    assert [r.name for r in ranking.tier_rerank(df, 1, enabled=False).collect()] == ["d1"]


def test_search_retires_facts_by_known_backing(spark):
    facts = spark.createDataFrame([(1, "f1", ["a"], [1.0, 0.0]), (2, "f2", ["b", "a"], [0.9, 0.1]), (3, "f3", ["gone"], [0.0, 1.0])], "edge_id long, fact string, backing array<string>, embedding array<double>")
    e = spark.createDataFrame([("a", True, None, None, None, 0, None, "p", "k"), ("b", False, "external-article", "time-bound", True, 3, None, "p", "k")], "uuid string, archived boolean, provenance string, durability string, verified boolean, usage_count long, created_at timestamp, project string, kind string")
    got = {r.fact: r for r in retrieval.hybrid(facts, e, [1.0, 0.0], "f2", F.expr("timestamp'2024-01-01 00:00:00'"), 5).collect()}
    assert set(got) == {"f2", "f3"}
    assert (got["f2"].external, got["f2"].stale, got["f2"].exact, got["f3"].external) == (True, True, True, False)
    assert [r.fact for r in retrieval.hybrid(facts, e, [1.0, 0.0], "f", F.expr("timestamp'2024-01-01 00:00:00'"), 5, {"projects": "p"}).collect()] == ["f2"]


def test_paths_are_simple_and_shortest_first(spark):
    n = spark.createDataFrame([(x, x, "Concept") for x in "abcde"], "uuid string, name string, label string")
    f = spark.createDataFrame([("a", "b", "r"), ("b", "c", "r"), ("c", "a", "r"), ("c", "d", "r"), ("a", "d", "r"), ("d", "d", "r")], "src string, dst string, name string")
    assert [(r.hops, r.names) for r in walks.paths(n, f, "a", "d", 4, 5).collect()] == [(1, "a>d"), (3, "a>b>c>d")]
    assert walks.paths(n, f, "a", "e", 4, 5).count() == 0
    assert {r.uuid: r.degree for r in graph.degrees(n, f).collect()} == {"a": 3, "b": 2, "c": 3, "d": 3, "e": 0}


def test_normalise_leaves_lone_spellings(spark):
    f = spark.createDataFrame([("a", "b", "X"), ("a", "c", "x"), ("a", "d", "LONE")], "src string, dst string, name string")
    assert sorted(r.name for r in graph.normalised(f).collect()) == ["LONE", "x", "x"]


def test_debounce_and_hold(spark):
    rows = spark.createDataFrame([("h", i, s) for i, s in enumerate(["red", "red", "green", "red", "red", "red", "red", "green"])], "host string, pos long, overall string")
    assert [r.pos for r in windows.debounced(rows, F.col("overall") == "red", "host", ["pos"], 3).collect()] == [5]
    assert [(r.pos, r.event) for r in windows.transitions(rows, F.col("overall") == "red", "host", ["pos"]).orderBy("pos").collect()] == [(0, "fire"), (2, "clear"), (3, "fire"), (7, "clear")]
    assert windows.contiguous_cursor(rows.select(F.col("pos").alias("id"), "overall"), F.col("overall") == "red").first().cursor == 1


def test_posteriors(spark):
    r = spark.createDataFrame([("t1", "c", "s", 1.0), ("t1", "c", "s", 1.0), ("t2", "c", "s", 1.0), ("t3", "c", "s", 0.0), ("t4", "c", "s", None)], "token string, capsule string, scenario string, reward double")
    row = evaluate.posteriors(r).first()
    assert (row.n, row.reward_sum, row.exposures, row.mean) == (3, 2.0, 4, 0.6)
    assert evaluate.posteriors(r.where("token = 't4'")).first().mean == 0.5
    assert evaluate.posteriors(r, r).count() == 0


def test_nearest_session_takes_the_earlier_of_a_tie(spark):
    i = spark.sql("select 1 as id, 'p' as project, timestamp'2024-01-01 10:00:00' as ts")
    s = spark.sql("select * from values (7, 'p', timestamp'2024-01-01 10:01:00'), (8, 'p', timestamp'2024-01-01 09:59:00'), (9, 'p', timestamp'2024-01-01 09:50:00'), (5, 'q', timestamp'2024-01-01 10:00:00') t(session_id, project, start_ts)")
    assert tuple(evaluate.nearest_session(i, s).first()) == (1, 8, -60)


def test_upsert_keeps_unlisted_columns(spark):
    t = spark.createDataFrame([(1, "a", "x"), (2, "b", "y")], "k long, v string, w string")
    c = spark.createDataFrame([(2, "B", "Y"), (3, "C", "Z")], "k long, v string, w string")
    assert sorted(map(tuple, state.upsert(t, c, ["k"], ["v"]).collect())) == [(1, "a", "x"), (2, "B", "y"), (3, "C", "Z")]


def test_logs_and_documents(spark, tmp_path):
    log = tmp_path / "hook.log"
    log.write_text("2024-01-01T10:00:00Z  START fmt=claude\n2024-01-01T10:00:01Z  OK fmt=claude kw=x picked=2 names=[canonical-a, obs-b] inj_chars=9 elapsed=0.31s\nnoise\n2024-01-01T10:00:02Z  no match kw=y\n")
    rows = readers.hook_log(spark, str(log)).orderBy("ts").collect()
    assert [(r.kind, r.fmt, r.kw, r.picked, r.names, r.elapsed) for r in rows] == [("start", "claude", None, None, [], None), ("ok", "claude", "x", 2, ["canonical-a", "obs-b"], 0.31), ("no_match", None, "y", None, [], None)]
    assert readers.injections(readers.hook_log(spark, str(log)), "canonical-").first().names == ["canonical-a"]
    (tmp_path / "docs").mkdir()
    (tmp_path / "docs" / "a.md").write_bytes(gzip.compress(("é" * 800).encode()))
    (tmp_path / "docs" / "b.md").write_text("short")
    (tmp_path / "docs" / "c.txt").write_text("x" * 2000)
    (tmp_path / "docs" / "bad.md").write_bytes(b"\xff" * 1600)
    (tmp_path / "docs" / "broken.md").write_bytes(b"\x1f\x8b" + b"x" * 2000)
    got = {r.name: r for r in readers.documents(spark, str(tmp_path / "docs")).collect()}
    assert set(got) == {"a", "bad"} and got["a"].text == "é" * 800 and got["a"].n_bytes == 1600
    assert got["a"].sha == hashlib.sha256(("é" * 800).encode()).hexdigest()
    assert got["bad"].n_bytes == 1600 and got["bad"].sha == hashlib.sha256(b"\xff" * 1600).hexdigest()
    (tmp_path / "d.jsonl").write_text(json.dumps({"ts": "2024-01-01T00:00:00Z", "layer": "score", "score": 1.5}) + "\n\nbroken {\n")
    assert [(r.layer, r.score) for r in readers.decision_log(spark, str(tmp_path / "d.jsonl")).collect()] == [("score", 1.5)]


def test_json_items_in_prose():
    assert readers.first_json_list('x [ bad ] then [{"a": 1}, "é"] [2]') == ['{"a": 1}', '"é"']
    assert readers.first_json_list(None) == [] and readers.first_json_list("[") == []


def test_window_specs(spark):
    rows = spark.createDataFrame([("2024-01-01T00:00:00Z",), ("bad",), (None,)], "ts string")
    now = F.expr("timestamp'2024-01-02 00:00:00'")
    assert readers.windowed(rows, "all", now).count() == 3
    assert readers.windowed(rows, "2d", now).count() == 1 and readers.windowed(rows, "3h", now).count() == 0
    with pytest.raises(ValueError, match="window"):
        readers.windowed(rows, "soon", now)


def test_defaults(spark):
    rows = spark.createDataFrame([("u", None, None)], "uuid string, archived boolean, usage_count long")
    assert tuple(schemas.with_defaults(rows).first()) == ("u", False, 0)


def test_stream_alerts_equal_their_batch_twin(spark, tmp_path):
    rows = spark.sql("select concat('h', id % 2) as host, timestamp_seconds(id) as received_at, id as pos, if(id % 7 < 5, 'red', 'green') as overall from range(60)")
    rows.write.parquet(str(tmp_path / "in"))
    stream = jobs.source(spark, str(tmp_path / "in"), rows.schema.simpleString()[7:-1].replace(":", " "))
    got = {(r.host, r.pos) for r in jobs.drained(jobs.alerts(stream, 2), "append", "a", str(tmp_path)).where("event = 'fire'").collect()}
    assert got == {(r.host, r.pos) for r in windows.debounced(rows, F.col("overall") == "red", "host", ["pos"], 2).collect()}


def test_stream_state_goes_on_over_batches(spark, tmp_path):
    """Runs that micro-batches cut: the same alerts as from all rows at once."""
    rows = spark.sql("select concat('h', id % 2) as host, timestamp_seconds(id) as received_at, id as pos, if(id % 11 < 7, 'red', 'green') as overall from range(90)")
    for k in range(6):
        rows.where(f"pos div 15 = {k}").coalesce(1).write.parquet(str(tmp_path / "in" / f"{k}"))
    stream = jobs.source(spark, str(tmp_path / "in"), rows.schema.simpleString()[7:-1].replace(":", " "), 1)
    got = {(r.host, r.pos, r.event) for r in jobs.drained(jobs.alerts(stream, 3), "append", "a", str(tmp_path)).collect()}
    want, run = set(), {"h0": 0, "h1": 0}
    for r in rows.orderBy("pos").collect():
        if r.overall == "red":
            run[r.host] += 1
            if run[r.host] == 3:
                want.add((r.host, r.pos, "fire"))
        else:
            if run[r.host] >= 3:
                want.add((r.host, r.pos, "clear"))
            run[r.host] = 0
    assert got == want and got


def test_replayed_gate_batches_are_written_once_and_share_their_quotas(spark, tmp_path):
    rows = observations(spark, [observation(i, "feature") for i in range(1, 9)]).withColumn("memory_session_id", F.lit("s")).drop("platform")
    for k in range(2):
        rows.where(f"(id - 1) div 4 = {k}").coalesce(1).write.parquet(str(tmp_path / "in" / f"{k}"))
    sessions = spark.createDataFrame([("s", "claude"), ("s", "claude")], "memory_session_id string, platform_source string")
    out = str(tmp_path / "out")

    def accept(decided, number):
        for _ in range(2):  # as if a failed batch ran again
            decided.select("id", "platform", "project", "type", "layer", "would_accept").write.mode("overwrite").parquet(f"{out}/batch-{number}")

    def earlier(number):
        return spark.read.parquet(*(f"{out}/batch-{i}" for i in range(number))) if number else None

    stream = jobs.source(spark, str(tmp_path / "in"), rows.schema.simpleString()[7:-1].replace(":", " "), 1)
    jobs.run_gate(stream, sessions, accept, str(tmp_path / "state"), earlier, GateConfig(quotas={}, default_quota=5)).awaitTermination()
    got = spark.read.parquet(f"{out}/batch-*").collect()
    assert sorted(r.id for r in got) == list(range(1, 9)) and sum(r.would_accept for r in got) == 5


def test_gated_stream_takes_each_id_once(spark, tmp_path):
    rows = observations(spark, [observation(i % 5, "feature") for i in range(10)]).withColumn("memory_session_id", F.lit("s")).withColumn("created_at_epoch", F.lit(1704067200000)).drop("platform")
    rows.write.parquet(str(tmp_path / "in"))
    stream = jobs.source(spark, str(tmp_path / "in"), rows.schema.simpleString()[7:-1].replace(":", " "))
    once = jobs.gated(stream, spark.createDataFrame([("s", "claude")], "memory_session_id string, platform_source string")).select("id", "layer")
    assert sorted(r.id for r in jobs.drained(once, "append", "g", str(tmp_path)).collect()) == list(range(5))


def test_state_versions_replace_each_other(spark, tmp_path):
    root, schema = f"file://{tmp_path}/state", "k long"
    assert current_state(spark, root, schema).count() == 0
    replace_state(spark.range(3).withColumnRenamed("id", "k"), root)
    replace_state(current_state(spark, root, schema).where("k > 0"), root)
    assert sorted(r.k for r in current_state(spark, root, schema).collect()) == [1, 2]
    assert len([p for p in (tmp_path / "state").iterdir() if p.is_dir()]) == 2  # the pointer and one version


def test_components_of_paths_stars_and_nothing(spark):
    links = [(i, i + 1) for i in range(20)] + [(100, 100 + i) for i in range(1, 30)] + [(7, 7)]
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(21)}, **{100 + i: 100 for i in range(30)}}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_terms_of_three_classes(spark):
    text = "see `code span` in src/app_main.py, the CamelCaseName or a.b `x` and USAGE_COUNT. docs/x-y, THE"
    row = spark.createDataFrame([(text,), (None,)], "t string").select(evaluate.terms(F.col("t"), ["usage_count"]).alias("x")).collect()
    assert sorted(row[0].x) == ["camelcasename", "code span", "docs/x-y", "src/app_main.py"] and row[1].x == []


def test_attribution_by_own_or_shared_terms(spark):
    caps = spark.createDataFrame([(1, "src/only.py in_all x_two"), (2, "in_all x_two"), (3, "in_all"), (4, None)], "capsule long, content string")
    talk = spark.createDataFrame([(7, "we used SRC/ONLY.PY"), (8, "in_all and x_two"), (9, "in_all"), (10, None)], "session long, text string")
    pairs = spark.createDataFrame([(c, t) for c in (1, 2, 3, 4, None) for t in (7, 8, 9, 10, None)], "capsule long, session long")
    got = {tuple(r) for r in evaluate.attributed(pairs, caps, talk).collect()}
    assert got == {(1, 7), (1, 8), (2, 8)}
    funnel = {r.capsule: (r.injected, r.matched, r.engaged) for r in evaluate.engagement(caps, pairs, talk).collect()}
    assert funnel[1] == (5, 4, 2) and funnel[4] == (5, 4, 0)
    assert evaluate.engagement(caps.limit(0), pairs.limit(0), talk.limit(0)).count() == 0


@pytest.mark.parametrize(("files", "types", "text", "want"), [
    ("a/b.py notes.md", ["note"], "", "coding"), ("", ["bugfix"], "", "coding"), ("conf.yaml", ["bugfix"], "deploy it", "ops"), ("Dockerfile", [], "", "ops"),
    ("", ["note"], "ROLLBACK now", "ops"), ("a.md", ["note"], "rollback", "writing"), (None, ["decision"], None, "planning"), ("x.png", ["note"], "research", "research"), ("", ["discovery"], "", "research"), ("", [], "", "unknown"),
])
def test_scenarios(spark, files, types, text, want):
    row = spark.createDataFrame([(files, types, text)], "f string, t array<string>, x string").select(evaluate.scenario(F.col("f"), F.col("t"), F.col("x"))[0].alias("s"))
    assert row.first().s == want


def test_reward_abstains_without_an_outcome(spark):
    row = spark.sql("select * from values (true, 1), (false, 1), (true, 0), (true, null) t(c, o)").select(evaluate.reward(F.col("c"), F.col("o")).alias("r"))
    assert [r.r for r in row.collect()] == [1.0, 0.0, 0.0, None]


def test_batch_search_equals_single_searches(spark):
    facts = spark.createDataFrame([(i, f"f{i % 7}", [float(i % 5) - 2, float(i % 3), 1.0 if i else 0.0]) for i in range(40)] + [(99, "none", None), (98, "zero", [0.0, 0.0, 0.0])], "edge_id long, fact string, embedding array<double>")
    queries = [(1, [1.0, 0.0, 0.0]), (2, [0.0, 1.0, 1.0])]
    got = retrieval.batch_vector_top(facts.repartition(3), queries, 6).collect()
    for i, v in queries:
        want = [(r.edge_id, r.similarity) for r in retrieval.vector_top(facts.where("embedding is not null"), v, 6).collect()]
        assert [(r.edge_id, r.similarity) for r in sorted(got, key=lambda r: r.place) if r.id == i] == want
    texts = retrieval.batch_substring_top(facts, [(1, "F1"), (2, "zzz"), (3, "f")], 3).collect()
    assert sorted((r.id, r.fact) for r in texts) == [(1, "f1"), (3, "f0"), (3, "f1"), (3, "f2")]


def test_carried_over_buckets(spark):
    rows = [(i, "a" if i in (3, 40) else "b" if i == 17 else None) for i in range(60)]
    e = spark.createDataFrame(rows, "pos long, fmt string")
    got = {r.pos: r.tool for r in windows.carried(e, "fmt", "pos", "first", "tool", size=4).collect()}
    assert got == {i: "first" if i < 3 else "a" if i < 17 else "b" if i < 40 else "a" for i in range(60)}
    assert windows.carried(e.limit(0), "fmt", "pos", "x", "tool").count() == 0


def test_excerpts_and_keywords(spark):
    long = "x" * 300 + "\n" + "y" * 300
    rows = spark.createDataFrame([(" short ", "/Users/mac/workspace_a/my-repo/"), (long, "/tmp"), ("z" * 500, "/a/b"), (None, None)], "t string, p string")
    got = rows.select(excerpt(F.col("t")).alias("e"), path_keywords(F.col("p"), config.SYSTEM_DIRS).alias("k"), cpu_seconds(F.lit("1:02:03")).alias("s"), short_age(F.lit(7300)).alias("a")).collect()
    assert [r.e for r in got] == ["short", "x" * 300 + "\n[…]", "z" * 400 + "\n[…]", ""]
    assert [r.k for r in got] == [["my-repo", "workspace_a"], [], [], []] and got[0].s == 3723 and got[0].a == "2h"


def test_requeue_outcomes(spark):
    held = spark.createDataFrame([(x,) for x in "abcde"], "source_obs_id string")
    keys = spark.createDataFrame([("s", "a", "ok"), ("s", "b", "pending"), ("s", "c", "error"), ("t", "d", "ok")], "source_description string, source_obs_id string, status string")
    asked = spark.createDataFrame([("a", "firsthand"), ("b", "firsthand"), ("c", "firsthand"), ("d", "firsthand"), ("e", None), ("e", "firsthand"), ("x", "firsthand"), ("b2", "rumour")], "source_obs_id string, provenance string")
    got = {r.source_obs_id: (r.outcome, r.leaves) for r in lifecycle.requeue(asked, held, keys, "s").collect()}
    assert got == {"a": ("already", True), "b": ("conflict", False), "c": ("queued", True), "d": ("queued", True), "e": ("discarded", True), "x": ("not_found", False), "b2": ("bad_request", False)}


def test_resolving_and_undoing_feedback(spark):
    f = spark.createDataFrame([(1, "n1", "pending", None), (2, "canonical-x", "pending", None), (3, "n3", "auto_handled", "auto_retire"), (4, "n4", "handled", "dismiss"), (5, "n5", "pending", None)], "id long, episode_name string, status string, handled_action string").withColumn("handled_at", F.lit(None).cast("timestamp"))
    actions = spark.createDataFrame([(1, "retire"), (2, "retire"), (3, "undo"), (4, "verified"), (9, "undo")], "id long, action string")
    done = lifecycle.resolve(f, actions, F.expr("timestamp'2024-01-01 00:00:00'"), "canonical-")
    assert {r.id: (r.status, r.handled_action, r.outcome) for r in done.collect()} == {1: ("handled", "retire", "done"), 2: ("pending", None, "canonical"), 3: ("pending", None, "done"), 4: ("handled", "dismiss", "not_found"), 5: ("pending", None, None)}
    e = spark.createDataFrame([("u1", "n1", None, None), ("u3", "n3", True, None), ("u5", "n5", None, True)], "uuid string, name string, archived boolean, verified boolean")
    assert {r.uuid: (r.archived, r.verified) for r in lifecycle.applied(e, done).collect()} == {"u1": (True, False), "u3": (False, False), "u5": (False, True)}


def test_observations_out_of_answers(spark):
    fence = '```json\n[{"type":"bugfix","title":" t ","facts":["a"," ",3],"narrative":"n","concepts":["c"]},{"title":"no facts","facts":"text"},"x",{"type":"?","title":"u","facts":["b"],"concepts":"none"}]\n```'
    got = readers.parsed_observations(spark.createDataFrame([(1, fence), (2, "nothing"), (3, None)], "id long, answer string"), ("bugfix",)).collect()
    assert [(r.id, r.place, r.type, r.title, r.facts, r.concepts) for r in got] == [(1, 1, "bugfix", "t", ["a", "3"], ["c"]), (1, 2, "discovery", "u", ["b"], [])]


def test_context_is_filled_by_full_text(spark):
    rows = [("c1", "canonical-1", "the key word", "global", "type=note"), ("d1", "obs-1", "word word", None, "type=decision"), ("b1", "obs-2", "word word word", None, "type=bugfix"), ("n", "obs-3", "nothing", None, "")]
    e = spark.createDataFrame([(*r, False, 0) for r in rows], "uuid string, name string, content string, scope string, source_description string, archived boolean, usage_count long")
    got = retrieval.context(e, "word", 3).orderBy("place").collect()
    assert [(r.uuid, r.place, r.source) for r in got] == [("c1", 1, "canonical"), ("d1", 2, "fulltext"), ("b1", 3, "fulltext")]
    assert retrieval.context(e.limit(0), "word", 3).count() == 0
    assert [r.uuid for r in retrieval.episode_search(e, "ey wo", 5).collect()] == ["c1"]


def test_reasons_of_decisions(spark):
    rows = [observation(1, "note"), observation(2, narrative="short"), observation(3, "security_alert", narrative="short", facts=None), observation(7, "discovery"), observation(10, "bugfix", title="hub docker daemon")]
    got = {r.id: r.why for r in gate.decide(observations(spark, rows), NOISE).select("id", gate.reasons(NOISE).alias("why")).collect()}
    assert got[1] == ["type 'note' isn't admitted"] and got[2] == ["narrative of 5 characters, least 80"]
    assert got[3] == ["narrative of 5 characters, least 80", "facts and files: 0, least 1", "type security_alert needs no threshold"]
    assert got[7] == ["score 28.00 < 60.00"] and got[10][0].startswith("ops noise") and got[10][1] == "score -2.00 < 120.00"


def test_upsert_dedupe_and_usage_of_empty_tables(spark):
    e = spark.createDataFrame([("u", "n", None, None, "type=x project=p", "c")], "uuid string, name string, usage_count long, retrieval_count long, source_description string, content string")
    none = spark.createDataFrame([], "name string, ts timestamp")
    assert tuple(ranking.usage_bump(e, none).first()) == ("u", "n", 0, 0, None)
    assert classify.keep_longest(e, F.lit("t")).count() == 0 and classify.keep_earliest(e, "name").count() == 1
    assert classify.first_bytes_dedupe(e.limit(0).withColumnRenamed("uuid", "path")).count() == 0


@pytest.mark.parametrize(("hour", "start", "end", "hottest", "want"), [(15, 22, 5, None, True), (13, 22, 5, None, False), (20, 22, 5, None, True), (21, 22, 5, None, False), (15, 22, 5, 61.0, False), (15, 22, 5, 59.0, True), (1, 4, 4, None, False), (2, 8, 12, None, True)])
def test_cycles_start_in_their_window(hour, start, end, hottest, want):
    assert jobs.may_start(datetime(2024, 1, 1, hour, tzinfo=timezone.utc), start, end, hottest) is want
