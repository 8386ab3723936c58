"""Structured Streaming twins of the polling loops: the gate, alerts, sessions, counts."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager
from datetime import datetime, timedelta, timezone

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from loomgraph.config import GateConfig
from loomgraph.operators import gate


def source(spark: SparkSession, path: str, schema: str, files_per_trigger: int = 1000) -> DataFrame:
    """A folder of parquet files as a stream; the files a trigger takes bound a micro-batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).option("recursiveFileLookup", "true").parquet(path)


def gated(stream: DataFrame, sessions: DataFrame, delay: str = "7 days", cfg: GateConfig = GateConfig()) -> DataFrame:
    """Observations once by id, with their decisions before quotas; quotas need order and run on each micro-batch."""
    once = stream.withColumn("at", F.timestamp_millis("created_at_epoch")).withWatermark("at", delay).dropDuplicatesWithinWatermark(["id"])
    return gate.layers(gate.with_platform(once, sessions), cfg)


def run_gate(stream: DataFrame, sessions: DataFrame, accept: Callable[[DataFrame, int], None], checkpoint: str, terminal: Callable[[int], DataFrame | None], cfg: GateConfig = GateConfig()) -> StreamingQuery:
    """The gate as micro-batches: ids already terminal are left out, the rest is decided with quotas and handed over.

    A row that a quota rejected isn't terminal: it is decided again when it comes again (``run_quotas`` gives such rows a day).

    ``terminal`` gives the decisions of the batches before a number (id, platform, project, type, layer), or None; what
    they admitted counts against the quotas. ``accept`` must replace what it has of the same number, so that a batch
    that is run again after a failure is written once.
    """

    def batch(rows: DataFrame, number: int) -> None:
        done = terminal(number)
        rows = rows.dropDuplicates(["id"])
        fresh = rows if done is None else rows.join(done.where("layer <> 'quota'").select("id"), "id", "left_anti")
        accept(gate.decide(gate.with_platform(fresh, sessions), cfg, before=done), number)

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def run_quotas(stream: DataFrame, sessions: DataFrame, accept: Callable[[DataFrame, int], None], root: str, delay: str = "7 days", cfg: GateConfig = GateConfig(), quota: int | None = None, offset_hours: int = 8) -> StreamingQuery:
    """The gate with daily quotas as a stream: each observation once by id, with its layer, score, local day and day of admission.

    A row above its day's quota is deferred to a named day (``due`` after ``day``), not rejected. A batch reads its own
    rows and the lanes that the batch before has left (LANES, a folder a batch below ``root``), never earlier rows; ids
    are remembered by the stream's state for ``delay``. ``accept`` must replace what it has of a batch's number, as a
    batch may run again after a failure: it then finds the same lanes and gives the same days.
    """
    spark = stream.sparkSession
    once = stream.withColumn("at", F.timestamp_millis("created_at_epoch")).withWatermark("at", delay).dropDuplicatesWithinWatermark(["id"])

    def batch(rows: DataFrame, number: int) -> None:
        before = spark.read.schema(gate.LANES).parquet(f"{root}/lanes/batch-{number - 1}") if number else None
        local = F.to_date(F.timestamp_millis(F.col("created_at_epoch") + offset_hours * 3_600_000))
        layered = gate.layers(gate.with_platform(rows, sessions), cfg).select("id", "platform", "project", "type", "layer", "score", local.alias("day"))
        asking = gate.scheduled(layered.where(F.col("layer").endswith("?")), before, cfg, quota).withColumn("layer", F.rtrim(F.translate("layer", "?", "")))
        rest = layered.where(~F.col("layer").endswith("?"))
        decided = asking.unionByName(rest.withColumns({"due": F.when(F.col("layer").isin("pass", "override"), F.col("day")), "lane": F.lit(None).cast("int"), "step": F.lit(None).cast("bigint")}))
        path = f"{root}/decided/batch-{number}"
        decided.write.mode("overwrite").parquet(path)  # the lanes and the caller read what was decided, once
        written = spark.read.schema(decided.schema).parquet(path)
        gate.lanes_after(written, before).write.mode("overwrite").parquet(f"{root}/lanes/batch-{number}")
        accept(written.drop("lane", "step"), number)

    return once.writeStream.foreachBatch(batch).option("checkpointLocation", f"{root}/state").trigger(availableNow=True).start()


def may_start(now: datetime, start: int, end: int, hottest: float | None = None, most: float = 60.0, offset_hours: int = 8) -> bool:
    """Whether a cycle may start: inside the local work window, which may wrap midnight, and no disk too hot.

    Equal bounds mean never; an unknown temperature doesn't hold a cycle back. ``now`` has a time zone.
    """
    hour = now.astimezone(timezone(timedelta(hours=offset_hours))).hour
    inside = start != end and (start <= hour < end if start < end else hour >= start or hour < end)
    return inside and (hottest is None or hottest < most)


def tumbling_counts(stream: DataFrame, size: str = "1 day", delay: str = "1 hour") -> DataFrame:
    """Events of each type in fixed windows of event time."""
    return stream.withWatermark("ts", delay).groupBy(F.window("ts", size), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", "total")


def sliding_counts(stream: DataFrame, size: str = "1 hour", step: str = "30 minutes", delay: str = "1 hour") -> DataFrame:
    return stream.withWatermark("ts", delay).groupBy(F.window("ts", size, step), "event_type").agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("start"), "event_type", "n")


def sessions(stream: DataFrame, idle: str = "30 minutes", delay: str | None = "1 hour") -> DataFrame:
    """Sessions of each user, closed by a time without events. Without a delay the stream has its watermark already."""
    marked = stream if delay is None else stream.withWatermark("ts", delay)
    return marked.groupBy(F.session_window("ts", idle), "user_id").agg(F.count(F.lit(1)).alias("n")).select("user_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def nearest_sessions(injections: DataFrame, sessions: DataFrame, before: int = 180, after: int = 3600, delay: str = "10 minutes") -> DataFrame:
    """Each injection's nearest session of its project (id, session_id, gap), from two streams; ``evaluate.nearest_session`` as a stream.

    injections: id, project, ts; sessions: session_id, project, start_ts. Both are joined in an interval of event time,
    so that state is dropped once no partner can come; an injection is given out when the watermark shows that its
    nearest is known. Ties take the earlier start, then the lesser id. An injection that is sent again within ``delay``
    counts once; null projects match none; rows later than ``delay`` are left out by Spark.
    """
    left = injections.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["id"])
    right = sessions.withColumnRenamed("project", "_project").withWatermark("start_ts", delay)
    # Gaps are of whole seconds: parts of a second may lie up to one second beyond the bounds.
    near = F.expr(f"project = _project and start_ts >= ts - interval {before + 1} seconds and start_ts <= ts + interval {after + 1} seconds")
    gap = F.unix_timestamp("start_ts") - F.unix_timestamp("ts")
    pairs = left.join(right, near).select("id", "ts", "session_id", "start_ts", gap.alias("gap")).where(F.col("gap").between(-before, after))
    best = pairs.groupBy("id", "ts").agg(F.min_by(F.struct("session_id", "gap"), F.struct(F.abs("gap"), "start_ts", "session_id")).alias("best"))
    return best.select("id", "best.*")


def alerts(stream: DataFrame, threshold: int = 3) -> DataFrame:
    """Edge-triggered alerts of each host: ``fire`` at the threshold-th bad state in a run, ``clear`` at the next good one.

    State is a count a host; a host's rows of a micro-batch are taken in the order of time and pos, their run lengths
    from running maxima.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        (held,) = state.get if state.exists else (0,)
        rows = pd.concat(list(batches)).sort_values(["received_at", "pos"])
        bad, at = (rows["overall"] == "red").to_numpy(), np.arange(len(rows))
        # Bad rows up to each row since the last good one; the run that the state holds goes on to the first good one.
        run = at - np.maximum.accumulate(np.where(bad, -1 - held, at))
        before = np.append(held, run[:-1])
        event = np.where(bad & (run == threshold), "fire", np.where(~bad & (before >= threshold), "clear", ""))
        state.update((int(run[-1]),))
        kept = event != ""
        yield pd.DataFrame({"host": key[0], "pos": rows["pos"].to_numpy()[kept], "event": event[kept]})

    return stream.groupBy("host").applyInPandasWithState(step, "host string, pos bigint, event string", "run int", "append", GroupStateTimeout.NoTimeout)


#: What a watch's state gives: the host, when (milliseconds), the snapshot's position (none for silence) and what happened.
_WATCHED = "host string, at_ms bigint, pos bigint, event string"


class _Watch(StatefulProcessor):
    """State of a host: its run of bad snapshots, its last known light, the time of its last snapshot, whether it is stale."""

    def __init__(self, threshold: int, silent_ms: int, first: str):
        self.threshold, self.silent_ms, self.first = threshold, silent_ms, first

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", "run int, light string, at_ms bigint, stale boolean")

    def _due(self, at_ms: int) -> None:
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(at_ms + self.silent_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        run, light, last, stale = tuple(self.held.get()) if self.held.exists() else (0, self.first, None, False)
        new = pd.concat(list(rows)).sort_values(["at_ms", "pos"])
        ms = new["at_ms"].to_numpy()
        late = ms < last if last is not None else np.zeros(len(ms), bool)
        out = [(ms[late], new["pos"].to_numpy()[late], np.full(late.sum(), "late"))]
        ms, new = ms[~late], new[~late]
        if len(ms):
            pos = new["pos"].to_numpy()
            lights = new["overall"].where(new["overall"] != "grey").ffill().fillna(light).to_numpy()
            bad, at = lights == "red", np.arange(len(ms))
            runs = at - np.maximum.accumulate(np.where(bad, -1 - run, at))
            event = np.where(bad & (runs == self.threshold), "fire", np.where(~bad & (np.append(run, runs[:-1]) >= self.threshold), "clear", ""))
            before = np.append(ms[0] if last is None else last, ms[:-1])
            back = ms - before > self.silent_ms
            gone = back & ~((at == 0) & stale)  # the timer has told of the first silence already
            out += [(before[gone] + self.silent_ms, None, np.full(gone.sum(), "stale")), (ms[back], pos[back], np.full(back.sum(), "back")), (ms[event != ""], pos[event != ""], event[event != ""])]
            self.held.update((int(runs[-1]), str(lights[-1]), int(ms[-1]), False))
            self._due(int(ms[-1]))
        for times, places, names in out:
            if len(times):
                yield pd.DataFrame({"host": key[0], "at_ms": times, "pos": pd.array([None] * len(times) if places is None else places, dtype="Int64"), "event": names})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        run, light, last, _ = self.held.get()
        self.held.update((run, light, last, True))
        yield pd.DataFrame({"host": key[0], "at_ms": [expiredTimerInfo.getExpiryTimeInMs()], "pos": pd.array([None], dtype="Int64"), "event": ["stale"]})

    def close(self) -> None:
        pass


def watched(stream: DataFrame, threshold: int = 3, silent_minutes: int = 30, delay: str = "10 minutes", first: str = "green") -> DataFrame:
    """Alerts on each host's snapshots and on their absence (host, at, pos, event), edge-triggered.

    ``fire`` at the ``threshold``-th red snapshot in a run and ``clear`` at the next that isn't red, where a grey or null
    light holds the last known one; ``stale`` when a host has been silent for longer than ``silent_minutes``, by an
    event-time timer, so that it needs no further row of that host; ``back`` at the host's next snapshot. A snapshot
    older than one its host's state has seen is given back as ``late`` and changes nothing; beyond ``delay`` Spark drops it.
    stream: host, received_at, pos, overall. Needs the state store of ``timers``.
    """
    slim = stream.select("host", F.col("received_at").cast("timestamp").alias("received_at"), "pos", "overall")
    slim = slim.withWatermark("received_at", delay).withColumn("at_ms", F.unix_millis("received_at"))
    out = slim.groupBy("host").transformWithStateInPandas(_Watch(threshold, silent_minutes * 60_000, first), _WATCHED, "append", "eventTime")
    return out.select("host", F.timestamp_millis("at_ms").alias("at"), "pos", "event")


@contextmanager
def timers(spark: SparkSession) -> Iterator[None]:
    """Streams that are started inside use the state store that keeps timers."""
    setting = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(setting)
    spark.conf.set(setting, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(setting, before)


def drained(stream: DataFrame, mode: str, name: str, checkpoint: str) -> DataFrame:
    """Everything available through the stream into a parquet table next to the checkpoint, as a batch DataFrame."""
    spark = stream.sparkSession
    out = f"{checkpoint}/{name}-out"
    query = stream.writeStream.outputMode(mode).format("parquet").option("path", out).option("checkpointLocation", f"{checkpoint}/{name}-state").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)
