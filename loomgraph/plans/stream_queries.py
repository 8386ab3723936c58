"""Queries that run a stream to its end, and their batch twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.config import GateConfig
from loomgraph.plans.gate_queries import _DECIDED, _OPEN
from loomgraph.plans.state_queries import ORACLES as _STATE_SQL
from loomgraph.sources.fixtures import view, with_views
from loomgraph.streaming import jobs
from loomgraph.tables import scratch

#: One quota for all platforms, as in the checking SQL.
QUOTA = GateConfig(quotas={}, default_quota=3)


def stream_gate(s: SparkSession, d: str) -> DataFrame:
    """Observations through the gate as a stream, decided with quotas in micro-batches; a batch has a folder by its number."""
    base = scratch(s, "stream")
    view(s, d, "f_observations").write.parquet(f"{base}/in")
    out = f"{base}/decisions"
    stream = s.readStream.schema(s.read.parquet(f"{base}/in").schema).parquet(f"{base}/in")

    columns = ("id", "platform", "project", "type", "layer", "score", "would_accept")

    def accept(rows: DataFrame, number: int) -> None:
        rows.select(*columns).write.mode("overwrite").parquet(f"{out}/batch-{number}")

    def decided(number: int) -> DataFrame | None:
        earlier = [f"{out}/batch-{i}" for i in range(number)]
        return s.read.parquet(*earlier) if earlier else None

    jobs.run_gate(stream, view(s, d, "f_sessions"), accept, f"{base}/state", decided, QUOTA).awaitTermination()
    return s.read.parquet(f"{out}/batch-*").select("id", "layer", "score", "would_accept")


def stream_quotas(s: SparkSession, d: str) -> DataFrame:
    """Daily quotas over a stream of three days, a batch each: what a day's quota defers comes in on a later day.

    Projects are taken together by the first four letters of their names, so that some are busy; one row a day is let in.
    """
    base = scratch(s, "stream")
    rows = view(s, d, "f_observations").withColumns({"project": F.substring("project", 1, 4), "created_at_epoch": F.lit(1704067200000) + F.col("id") % 3 * 86_400_000})
    for day in range(3):  # the stream is stopped between the days, so that a day is a batch of as many files as were written
        rows.where(F.col("id") % 3 == day).write.parquet(f"{base}/in/day-{day}")
        stream = jobs.source(s, f"{base}/in", s.read.parquet(f"{base}/in/day-0").schema, 1_000_000)
        jobs.run_quotas(stream, view(s, d, "f_sessions"), lambda decided, number: decided.write.mode("overwrite").parquet(f"{base}/out/batch-{number}"), base, quota=1).awaitTermination()
    out = s.read.option("recursiveFileLookup", "true").parquet(f"{base}/out")
    return out.select("id", "layer", F.date_format("day", "yyyy-MM-dd").alias("day"), F.datediff("due", "day").alias("waits"))


def stream_alerts(s: SparkSession, d: str) -> DataFrame:
    base = scratch(s, "stream")
    view(s, d, "f_snapshots").select("host", "received_at", "pos", "overall").write.parquet(f"{base}/in")
    stream = s.readStream.schema(s.read.parquet(f"{base}/in").schema).parquet(f"{base}/in")
    return jobs.drained(jobs.alerts(stream, 2), "append", "alerts", base)


#: Silence that the watch of the fixture's hosts tells of, and its watermark's delay, in hours.
SILENT, DELAY = 4, 1


def stream_watch(s: SparkSession, d: str) -> DataFrame:
    """Alerts and silences of all hosts from a stream of four files in the order of time; ends at the last watermark."""
    base = scratch(s, "stream")
    rows = view(s, d, "f_snapshots").select("host", "received_at", "pos", "overall")
    for k in range(4):
        rows.where(F.floor((F.dayofmonth("received_at") - 1) / 8) == k).coalesce(1).write.parquet(f"{base}/in/part-{k}")
    stream = jobs.source(s, f"{base}/in", rows.schema, 1)
    with jobs.timers(s):
        out = jobs.drained(jobs.watched(stream, 2, 60 * SILENT, f"{DELAY} hours"), "append", "watch", base)
    return out.select("host", F.date_format("at", "yyyy-MM-dd HH:mm:ss").alias("at"), "pos", "event")


def stream_sessions(s: SparkSession, d: str) -> DataFrame:
    """Sessions of all users from a stream of four files in the order of time, some events sent twice; those that idle time has closed."""
    base = scratch(s, "stream")
    e = s.read.parquet(f"{d}/events.parquet").select("event_id", "user_id", F.col("ts").cast("timestamp").alias("ts"))
    for k in range(4):
        part = e.where(F.floor((F.dayofmonth("ts") - 1) / 8) == k)
        part.unionByName(part.where("event_id % 5 = 0")).coalesce(1).write.parquet(f"{base}/in/part-{k}")
    once = jobs.source(s, f"{base}/in", e.schema, 1).withWatermark("ts", "1 hour").dropDuplicatesWithinWatermark(["event_id"])
    closed = jobs.drained(jobs.sessions(once, "6 hours", None), "append", "sessions", base)
    return closed.select("user_id", F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), F.date_format("end", "yyyy-MM-dd HH:mm:ss").alias("end"), "n")


def stream_nearest(s: SparkSession, d: str) -> DataFrame:
    """The nearest session of each injection from two streams in the order of time; a last row far ahead lets all come out."""
    base = scratch(s, "stream")

    def fed(name: str, at: str, key: str) -> DataFrame:
        rows = view(s, d, name).withColumn(at, F.col(at).cast("timestamp"))
        first, last = rows.agg(F.min(F.unix_micros(at)), F.max(F.unix_micros(at))).first()
        part = F.least(F.floor((F.unix_micros(at) - F.lit(first)) * 4 / F.lit(max((last or 0) - (first or 0), 1))), F.lit(3))  # quarters of their time, whatever months it spans
        for k in range(4):
            rows.where(part == k).coalesce(1).write.parquet(f"{base}/{name}/part-{k}")
        end = rows.agg((F.max(at) + F.expr("interval 30 days")).alias(at)).select(F.lit(-1).cast(rows.schema[key].dataType).alias(key), F.lit("end").alias("project"), at)
        end.select(*rows.columns).coalesce(1).write.parquet(f"{base}/{name}/part-9")
        return jobs.source(s, f"{base}/{name}", rows.schema, 1)

    found = jobs.nearest_sessions(fed("f_injections", "ts", "id"), fed("f_work_sessions", "start_ts", "session_id"))
    return jobs.drained(found, "append", "nearest", base)


QUERIES = {
    "stream_nearest": stream_nearest,
    "stream_sessions": stream_sessions,
    "stream_watch": stream_watch,
    "stream_gate": stream_gate,
    "stream_quotas": stream_quotas,
    "stream_alerts": stream_alerts,
    "tumbling_counts": lambda s, d: jobs.tumbling_counts(s.read.parquet(f"{d}/events.parquet")).select(F.date_format("start", "yyyy-MM-dd").alias("day"), "event_type", "n", F.round("total", 4).alias("total")),
    "sliding_counts": lambda s, d: jobs.sliding_counts(s.read.parquet(f"{d}/events.parquet"), "2 days", "1 day").select(F.date_format("start", "yyyy-MM-dd").alias("day"), "event_type", "n"),
    "session_windows": lambda s, d: jobs.sessions(s.read.parquet(f"{d}/events.parquet"), "6 hours").groupBy("user_id").agg(F.count(F.lit(1)).alias("sessions"), F.max("n").alias("longest")),
}
ORACLES = {
    "stream_nearest": _STATE_SQL["nearest_session"],
    "stream_sessions": "with g as (select user_id, ts, case when ts - lag(ts) over (partition by user_id order by ts) <= interval 6 hour then 0 else 1 end as fresh from events), i as (select user_id, ts, sum(fresh) over (partition by user_id order by ts rows between unbounded preceding and current row) as k from g), w as (select user_id, min(ts) as first, max(ts) + interval 6 hour as last, count(*) as n from i group by user_id, k) select user_id, strftime(first, '%Y-%m-%d %H:%M:%S') as start, strftime(last, '%Y-%m-%d %H:%M:%S') as \"end\", n from w where last < (select max(ts) from events) - interval 1 hour",
    "stream_watch": with_views("f_snapshots") + f""", h as (select host, pos, received_at as t, coalesce(last_value(case when overall <> 'grey' then overall end ignore nulls) over w, 'green') = 'red' as bad, lag(received_at) over w as before from f_snapshots window w as (partition by host order by received_at, pos)),
 b as (select *, sum((not bad)::int) over (partition by host order by t, pos) as island from h),
 r as (select *, sum(bad::int) over (partition by host, island order by t, pos) as run from b),
 l as (select *, lag(run, 1, 0) over (partition by host order by t, pos) as earlier from r),
 e as (select host, t, pos, case when bad then 'fire' else 'clear' end as event from l where (bad and run = 2) or (not bad and earlier >= 2)
  union all select host, t, pos, 'back' from h where t - before > interval {SILENT} hour
  union all select host, before + interval {SILENT} hour, null, 'stale' from h where t - before > interval {SILENT} hour
  union all select host, max(received_at) + interval {SILENT} hour, null, 'stale' from f_snapshots group by host having max(received_at) + interval {SILENT} hour < (select max(received_at) from f_snapshots) - interval {DELAY} hour)
select host, strftime(t, '%Y-%m-%d %H:%M:%S') as "at", pos, event from e""",
    "stream_gate": _DECIDED + "select id, layer, score, would_accept from v",
    # One row a day: the i-th row of a key can't come before the day of any earlier one plus the rows between.
    "stream_quotas": _OPEN.replace("source as project", "substring(source, 1, 4) as project").replace("1704067200000 + doc_id * 3600000 as created_at_epoch", "1704067200000 + (doc_id % 3) * 86400000 as created_at_epoch")
    + """, z as (select id, platform, coalesce(project, '') as p, type, layer0, (id % 3)::int as day from q),
 w as (select *, row_number() over (partition by platform, p, type order by day, id) - 1 as i from z where layer0 like '%?'),
 u as (select id, layer0, day, (max(day - i) over (partition by platform, p, type order by i) + i - day)::int as waits from w
  union all select id, layer0, day, case when layer0 in ('pass', 'override') then 0 end from z where layer0 not like '%?')
select id, replace(layer0, '?', '') as layer, strftime(date '2024-01-01' + day, '%Y-%m-%d') as day, waits from u""",
    "stream_alerts": with_views("f_snapshots") + ", b as (select host, pos, received_at, overall = 'red' as bad, sum((overall <> 'red')::int) over (partition by host order by received_at, pos rows between unbounded preceding and current row) as island from f_snapshots), r as (select *, sum(bad::int) over (partition by host, island order by received_at, pos rows between unbounded preceding and current row) as run from b), l as (select *, lag(run, 1, 0) over (partition by host order by received_at, pos) as before from r) select host, pos, case when bad then 'fire' else 'clear' end as event from l where (bad and run = 2) or (not bad and before >= 2)",
    "tumbling_counts": "select strftime(ts, '%Y-%m-%d') as day, event_type, count(*) as n, round(sum(value), 4) as total from events group by 1, 2",
    "sliding_counts": "select strftime(day, '%Y-%m-%d') as day, event_type, count(*) as n from (select event_type, unnest([date_trunc('day', ts), date_trunc('day', ts) - interval 1 day]) as day from events) group by 1, 2",
    "session_windows": "with g as (select user_id, ts, case when ts - lag(ts) over (partition by user_id order by ts) < interval 6 hour then 0 else 1 end as fresh from events), i as (select user_id, sum(fresh) over (partition by user_id order by ts rows between unbounded preceding and current row) as k from g), n as (select user_id, k, count(*) as n from i group by 1, 2) select user_id, count(*) as sessions, max(n) as longest from n group by 1",
}
