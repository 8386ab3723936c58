"""The watch over hosts: silence without a row, lights held, late rows, and a restart from the checkpoint."""

from pyspark.sql import functions as F

from loomgraph.operators import evaluate, graph
from loomgraph.streaming import jobs

SCHEMA = "host string, received_at timestamp, pos long, overall string"


def rows_at(spark, rows):
    """(host, minute, pos, light) as snapshots of one day."""
    made = spark.createDataFrame(rows, "host string, minute long, pos long, overall string")
    return made.select("host", F.timestamp_seconds(F.lit(1704067200) + F.col("minute") * 60).alias("received_at"), "pos", "overall")


def run(spark, folder, name="w"):
    stream = jobs.source(spark, f"{folder}/in", SCHEMA, 1)
    with jobs.timers(spark):
        out = jobs.drained(jobs.watched(stream, 2, 30, "10 minutes"), "append", name, str(folder))
    return sorted((r.host, int((r.at - 1704067200_000) / 60_000), r.pos, r.event) for r in out.select("host", F.unix_millis("at").alias("at"), "pos", "event").collect())




def put(spark, folder, name, rows):
    rows_at(spark, rows).coalesce(1).write.parquet(f"{folder}/in/{name}")


def test_silence_fires_without_a_row_and_a_restart_repeats_nothing(spark, tmp_path):
    put(spark, tmp_path, "a", [("a", 0, 1, "red"), ("b", 0, 2, "green"), ("a", 5, 3, "grey")])  # grey holds red: the second of a run
    first = run(spark, tmp_path)
    assert first == [("a", 5, 3, "fire")]
    put(spark, tmp_path, "b", [("a", 20, 4, None), ("a", 40, 5, "green"), ("a", 60, 6, "red")])
    second = run(spark, tmp_path)
    assert second == sorted([*first, ("a", 40, 5, "clear"), ("b", 30, None, "stale")])  # b has sent nothing
    put(spark, tmp_path, "c", [("b", 61, 7, "red"), ("a", 62, 8, "red"), ("a", 63, 9, "red"), ("a", 59, 10, "green")])
    third = run(spark, tmp_path)
    assert third == sorted([*second, ("b", 61, 7, "back"), ("a", 62, 8, "fire"), ("a", 59, 10, "late")])
    assert run(spark, tmp_path) == third


def test_a_silence_between_two_rows_of_a_batch(spark, tmp_path):
    put(spark, tmp_path, "a", [("a", 0, 1, "red"), ("a", 31, 2, "red"), ("a", 61, 3, "green")])
    assert run(spark, tmp_path) == [("a", 30, None, "stale"), ("a", 31, 2, "back"), ("a", 31, 2, "fire"), ("a", 61, 3, "clear")]


def test_legal_edges_of_untyped_and_unknown_ends(spark):
    e = spark.createDataFrame([("i", "Issue"), ("f", "Fix"), ("x", None), ("y", "")], "uuid string, label string")
    f = spark.createDataFrame([("i", "f", "FIXED_BY"), ("f", "i", "fixed_by"), ("x", "y", "modified"), ("x", "y", "likes"), ("x", "i", "modified"), ("i", "gone", "fixed_by"), ("i", "f", None)], "src string, dst string, name string")
    got = {tuple(r) for r in graph.illegal(e, f).select("src_label", "dst_label", "edge", "n").collect()}
    assert got == {("Fix", "Issue", "fixed_by", 1), ("Entity", "Entity", "likes", 1), ("Entity", "Issue", "modified", 1), ("Issue", "Fix", None, 1)}


def test_nearest_sessions_of_two_streams_equal_the_batch(spark, tmp_path):
    """Ties, bounds, repeated injections and null projects, over several micro-batches."""
    at = lambda c: F.timestamp_seconds(F.lit(1704067200) + F.col(c))
    asked = [(1, "p", 1000), (2, "p", 5000), (3, "q", 5000), (4, None, 5000), (5, "p", 9000)]
    began = [(1, "p", 820), (2, "p", 1180), (3, "p", 4819), (4, "p", 8600), (5, "q", 8601), (6, None, 5000), (7, "p", 9100), (8, "p", 9100)]
    injections = spark.createDataFrame(asked, "id long, project string, t long").select("id", "project", at("t").alias("ts"))
    sessions = spark.createDataFrame(began, "session_id long, project string, t long").select("session_id", "project", at("t").alias("start_ts"))
    far = F.timestamp_seconds(F.lit(1704067200 + 900_000))
    parts = [("ts < timestamp'2024-01-01 01:00:00'", "start_ts < timestamp'2024-01-01 01:00:00'"), ("ts >= timestamp'2024-01-01 01:00:00'", "start_ts >= timestamp'2024-01-01 01:00:00'")]
    for k, (x, y) in enumerate(parts):
        rows = injections.where(x)
        rows.unionByName(rows.limit(1)).coalesce(1).write.parquet(f"{tmp_path}/i/{k}")
        sessions.where(y).coalesce(1).write.parquet(f"{tmp_path}/s/{k}")
    spark.range(1).select(F.lit(-1).cast("long").alias("id"), F.lit("end").alias("project"), far.alias("ts")).write.parquet(f"{tmp_path}/i/9")
    spark.range(1).select(F.lit(-1).cast("long").alias("session_id"), F.lit("end").alias("project"), far.alias("start_ts")).write.parquet(f"{tmp_path}/s/9")
    found = jobs.nearest_sessions(jobs.source(spark, f"{tmp_path}/i", injections.schema, 1), jobs.source(spark, f"{tmp_path}/s", sessions.schema, 1))
    got = sorted(tuple(r) for r in jobs.drained(found, "append", "n", str(tmp_path)).collect())
    want = sorted(tuple(r) for r in evaluate.nearest_session(injections, sessions).collect())
    assert got == want == [(1, 1, -180), (2, 4, 3600), (5, 7, 100)]
