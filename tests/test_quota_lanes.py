"""Daily quotas by lanes against a day-by-day queue, over several batches, with a restart and one hot key."""

import random
import shutil
import tempfile
from datetime import date, timedelta

from pyspark.sql import functions as F

from loomgraph.operators import gate
from loomgraph.streaming import jobs

ROWS = "id long, platform string, project string, type string, day date"
START = date(2024, 1, 1)


def queue(batches, quota):
    """Day by day: a key's waiting rows in order, so many let in a day."""
    due, used = {}, {}
    for rows in batches:
        for i, *key, day in sorted(rows, key=lambda r: (r[4], r[0])):
            key = tuple(x or "" for x in key)
            at = day if quota == 0 else max(day, used.get(key, {}).get("last", day))
            while quota and used.setdefault(key, {}).get(at, 0) >= quota:
                at += timedelta(days=1)
            if quota:
                used[key][at] = used[key].get(at, 0) + 1
                used[key]["last"] = at
            due[i] = at
    return due


def made(draw, n, first, days):
    return [(first + i, draw.choice(["cursor", "codex", None]), "hot" if i % 3 else draw.choice("abc"), draw.choice(["bugfix", "feature"]), START + timedelta(days=days[0] + draw.randrange(days[1]))) for i in range(n)]


def test_days_of_admission_over_batches(spark):
    draw = random.Random(6)
    batches = [made(draw, 200, 0, (0, 3)), made(draw, 150, 1000, (3, 4)), [], made(draw, 120, 2000, (30, 2))]
    for quota in (0, 1, 3, 10):
        got, lanes = {}, None
        for rows in batches:
            decided = gate.scheduled(spark.createDataFrame(rows, ROWS).withColumns({c: F.lit("x") for c in ("last", "rows", "note")}), lanes, quota=quota)
            got |= {r.id: r.due for r in decided.select("id", "due").collect()}
            after = gate.lanes_after(decided, lanes).collect()
            lanes = spark.createDataFrame(after, gate.LANES)
        assert got == queue(batches, quota)
        assert len(after) <= quota * 3 * 4 * 2  # a row a lane, whatever has waited


def test_one_hot_key_goes_through_its_lanes(spark):
    rows = [(i, "cursor", "hot", "bugfix", START) for i in range(3000)]
    decided = gate.scheduled(spark.createDataFrame(rows, ROWS), quota=7)
    assert {r.id: r.due for r in decided.collect()} == queue([rows], 7)
    assert "lane" in decided._jdf.queryExecution().optimizedPlan().toString() and decided.select("lane").distinct().count() == 7


def observation(i, day, project="p"):
    return (i, project, "feature", f"title {i}", "narrative long enough to pass the gates of the filter " * 20, '["a","b","c"]', '["c1"]', '["f.py"]', 20, "m1", "en", int((START - date(1970, 1, 1)).days + day) * 86_400_000)


OBSERVATION = "id long, project string, type string, title string, narrative string, facts string, concepts string, files_modified string, relevance_count int, generated_by_model string, memory_session_id string, created_at_epoch long"


def test_stream_defers_to_the_next_days_and_restarts(spark):
    base = tempfile.mkdtemp(prefix="loomgraph-test-")
    sessions = spark.createDataFrame([("en", "cursor")], "memory_session_id string, platform_source string")
    seen = []

    def run():
        stream = jobs.source(spark, f"{base}/in", OBSERVATION, 1)
        jobs.run_quotas(stream, sessions, lambda d, n: seen.append((n, d.collect())), base, quota=2, offset_hours=0).awaitTermination()

    put = lambda name, rows: spark.createDataFrame(rows, OBSERVATION).coalesce(1).write.parquet(f"{base}/in/{name}")
    put("a", [observation(i, 0) for i in range(5)] + [observation(3, 0)])
    run()
    first = {r.id: (r.due - r.day).days for r in seen[0][1]}
    assert first == {0: 0, 1: 0, 2: 1, 3: 1, 4: 2}
    put("b", [observation(i, 1) for i in (2, 10, 11)])  # id 2 comes again
    run()
    # The first day's rows wait for days 1 and 2, so that the second day's come in after them.
    filled = [rows for _, rows in seen if rows]
    assert len(filled) == 2 and {r.id: (r.due - r.day).days for r in filled[1]} == {10: 1, 11: 2}
    run()
    assert len([n for n, rows in seen if rows]) == 2
    # A batch that runs again after a failure finds the lanes of the batch before and gives the same days.
    decided = lambda: sorted((r.id, r.due) for r in spark.read.option("recursiveFileLookup", "true").parquet(f"{base}/decided").collect())
    before = decided()
    assert len(before) == 7
    shutil.rmtree(f"{base}/state/commits")
    run()
    assert decided() == before
