"""Order-dependent operators over logs: carry-forward, transitions, debounce, hold-last, cursors, rollups."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.functions.columns import short_age
from loomgraph.tables import materialise


def carried(events: DataFrame, value: str, pos: str, first: str, name: str, size: int = 1 << 16) -> DataFrame:
    """``events`` with the last value so far of the whole log as column ``name``, ``first`` before any.

    The log is cut into buckets of ``size`` positions; each is filled on its own and starts with what the buckets before
    it ended with, a table of one row a bucket. So no task gets more than a bucket. Positions are unique and not null.
    """
    bucket = F.floor(F.col(pos) / size).cast("bigint")
    ends = events.groupBy(bucket.alias("bucket")).agg(F.max_by(value, F.when(F.col(value).isNotNull(), F.col(pos))).alias("end"))
    starts = ends.select("bucket", F.last("end", ignorenulls=True).over(Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)).alias("start"))
    w = Window.partitionBy("bucket").orderBy(pos).rowsBetween(Window.unboundedPreceding, 0)
    rows = events.withColumn("bucket", bucket).join(starts, "bucket")
    return rows.withColumn(name, F.coalesce(F.last(value, ignorenulls=True).over(w), "start", F.lit(first))).drop("bucket", "start")


def segmented(rows: DataFrame, by: list[str], order: list[str], parts: int | None = None) -> DataFrame:
    """``rows`` cut into ranges of (by, order), numbered in that order by the column ``_segment``; written once.

    A key with many rows lies in many segments, so no task gets a whole key. ``parts`` is the number of ranges
    (the session's shuffle partitions otherwise). The numbers are stored with the rows, so that what reads them
    twice, or again after a lost executor, finds the same cuts. ``order`` is ascending and unique within a key.
    """
    parts = parts or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return materialise(rows.repartitionByRange(parts, *by, *order).withColumn("_segment", F.spark_partition_id()), "segments")


def prefixed(cut: DataFrame, by: list[str], order: list[str], counts: Mapping[str, Column] | None = None, lasts: Mapping[str, Column] | None = None, upto: int = 0) -> DataFrame:
    """Rows of ``segmented`` with running values of their key: how often a condition held, and the last value that isn't null.

    Each segment is summed up by one aggregate (its counts and last values), the summaries before it are put together,
    and each segment is then worked on its own from there. ``upto`` is 0 for values up to the row, -1 for those before it.
    Null keys are one key. A key's first segment needs nothing from others, and at most one key of a segment began in an
    earlier one: so what is handed on has at most one row a segment, and is broadcast.
    """
    counts, lasts, keys = dict(counts or {}), dict(lasts or {}), [*by, "_segment"]
    ends = cut.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_rows"),
        *(F.count_if(c).alias(n) for n, c in counts.items()),
        *(F.max_by(c, F.when(c.isNotNull(), F.struct(*order))).alias(n) for n, c in lasts.items()),
    )
    earlier = Window.partitionBy(*by).orderBy("_segment").rowsBetween(Window.unboundedPreceding, -1)
    carry = ends.select(
        *(F.col(k).alias(f"_key{i}") for i, k in enumerate(keys)),
        F.sum("_rows").over(earlier).alias("_earlier"),
        *(F.sum(n).over(earlier).alias(f"_carry_{n}") for n in counts),
        *(F.last(n, ignorenulls=True).over(earlier).alias(f"_carry_{n}") for n in lasts),
    ).where("_earlier is not null")
    same = F.lit(True)
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_key{i}"))
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, upto)
    running = {n: F.coalesce(f"_carry_{n}", F.lit(0)) + F.count_if(c).over(w) for n, c in counts.items()}
    running |= {n: F.coalesce(F.last(c, ignorenulls=True).over(w), f"_carry_{n}") for n, c in lasts.items()}
    out = cut.join(F.broadcast(carry), same, "left").withColumns(running)
    return out.drop("_earlier", *(f"_key{i}" for i in range(len(keys))), *(f"_carry_{n}" for n in running))


def transitions(states: DataFrame, bad: Column, by: str, order: list[str], parts: int | None = None) -> DataFrame:
    """Rows where a key turns bad (fire) or well again (clear); the state before the first is well, as is a null state.

    Works by segments (``segmented``), so that a key with all rows is no single task.
    """
    cut = segmented(states.withColumn("_bad", F.coalesce(bad, F.lit(False))), [by], order, parts)
    rows = prefixed(cut, [by], order, lasts={"_before": F.col("_bad")}, upto=-1)
    turned = rows.where(F.col("_bad") != F.coalesce("_before", F.lit(False)))
    return turned.withColumn("event", F.when(F.col("_bad"), "fire").otherwise("clear")).drop("_bad", "_before", "_segment")


def debounced(states: DataFrame, bad: Column, by: str, order: list[str], threshold: int = 3, parts: int | None = None) -> DataFrame:
    """Alerts at the ``threshold``-th bad row in a run; a run alerts once. A null state is well.

    A row's place in its run is the number of bad rows so far less that at the last good row; both are running values
    by segments.
    """
    cut = segmented(states.withColumn("_bad", F.coalesce(bad, F.lit(False))), [by], order, parts)
    counted = prefixed(cut, [by], order, counts={"_n": F.col("_bad")})
    rows = prefixed(counted, [by], order, lasts={"_well": F.when(~F.col("_bad"), F.col("_n"))})
    return rows.where(F.col("_bad") & (F.col("_n") - F.coalesce("_well", F.lit(0)) == threshold)).withColumn("length", F.lit(threshold)).drop("_bad", "_n", "_well", "_segment")


def hold_last(metrics: DataFrame, verdict: Column, by: str, order: list[str], first: str, name: str = "held", parts: int | None = None) -> DataFrame:
    """Rows with the verdict of each as column ``name``, or the last known one where its metric is missing; by segments."""
    cut = segmented(metrics, [by], order, parts)
    return prefixed(cut, [by], order, lasts={name: verdict}).withColumn(name, F.coalesce(name, F.lit(first))).drop("_segment")


def latest(rows: DataFrame, by: str, at: list[str]) -> DataFrame:
    """The last row of each key by one aggregate, without a sort."""
    others = [c for c in rows.columns if c != by]
    return rows.groupBy(by).agg(F.max_by(F.struct(*others), F.struct(*at)).alias("row")).select(by, "row.*")


def contiguous_cursor(ids: DataFrame, terminal: Column) -> DataFrame:
    """The highest id up to which every id is terminal (null if the first isn't)."""
    stop = ids.agg(F.min(F.when(~terminal, F.col("id"))).alias("stop"))
    return ids.crossJoin(F.broadcast(stop)).where(F.col("stop").isNull() | (F.col("id") < F.col("stop"))).agg(F.max("id").alias("cursor"))


def worst(overall: Column) -> Column:
    """The worst light of a group: red, amber, green; grey counts as green."""
    rank = F.max(F.when(overall == "red", 3).when(overall == "amber", 2).otherwise(1))
    return F.when(rank == 3, "red").when(rank == 2, "amber").otherwise("green")


def snapshot_alerts(snapshots: DataFrame, now: Column, stale_minutes: int = 30) -> DataFrame:
    """host, alert and label: one stale alert of a host that is silent too long, else one for each of its blockers.

    snapshots: host, received_at, blockers (array of label, detail). Without any snapshot there is one alert without a
    host; lights other than those that block are silent.
    """
    stale = F.col("received_at") < now - F.make_interval(mins=F.lit(stale_minutes))
    silent = snapshots.where(stale).select("host", F.lit("stale").alias("alert"), F.lit(None).cast("string").alias("label"))
    blocked = snapshots.where(~stale).select("host", F.explode("blockers").alias("b")).select("host", F.lit("blocked").alias("alert"), F.concat_ws(": ", F.col("b.label"), F.col("b.detail")).alias("label"))
    none = snapshots.agg(F.count(F.lit(1)).alias("n")).where("n = 0").select(F.lit(None).cast("string").alias("host"), F.lit("no snapshot").alias("alert"), F.lit(None).cast("string").alias("label"))
    return silent.unionByName(blocked).unionByName(none)


def hook_health(events: DataFrame, now: Column, fresh_hours: int = 24, stale_hours: int = 72) -> DataFrame:
    """Counts by kind, the last success and error, and a light of each tool by the age of its last success."""
    is_ = lambda k: F.count_if(F.col("kind") == k)
    last = lambda c, k: F.max_by(c, F.when(F.col("kind") == k, F.struct("ts", "pos")))
    rows = events.groupBy("tool").agg(
        is_("start").alias("starts"), is_("ok").alias("ok"), is_("no_match").alias("no_match"), is_("empty").alias("empty"), is_("error").alias("errors"),
        F.max(F.when(F.col("kind") == "ok", F.col("ts"))).alias("last_ok"), last("kw", "ok").alias("last_kw"), last("pos", "error").alias("last_error_pos"),
    )
    age = F.unix_timestamp(now) - F.unix_timestamp("last_ok")
    light = F.when((F.col("errors") > 0) & (F.col("ok") == 0), "red").when(F.col("ok") == 0, F.when(F.col("no_match") > 0, "amber").otherwise("grey")).when(age <= 3600 * fresh_hours, "green").when(age <= 3600 * stale_hours, "amber").otherwise("red")
    return rows.withColumns({"light": light, "last_ok_age": short_age(age)})


def daily_increment(totals: DataFrame) -> DataFrame:
    """Each day's total minus the day before's; the first is a baseline."""
    w = Window.partitionBy("metric").orderBy("day")
    return totals.withColumn("increment", F.col("total") - F.lag("total").over(w)).withColumn("message", F.when(F.col("increment").isNull(), "baseline").when(F.col("increment") == 0, "no change").otherwise("changed"))


def tool_contribution(rows: DataFrame, text: Column, tools: list[str]) -> DataFrame:
    """Rows by the tool a text names (``project=<tool> `` with the space), the rest as unknown; empty tools are left out."""
    named = rows.agg(F.count(F.lit(1)).alias("total"), *(F.count_if(text.contains(f"project={t} ")).alias(t) for t in tools))
    listed = F.array(*(F.struct(F.lit(t).alias("tool"), F.col(t).alias("n")) for t in tools), F.struct(F.lit("unknown").alias("tool"), F.greatest(F.col("total") - sum((F.col(t) for t in tools), F.lit(0)), F.lit(0)).alias("n")))
    return named.select(F.explode(listed).alias("x")).select("x.*").where("n > 0")


def propagated(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges take the light of what they lead to unless it is green; grey if their own tool is grey."""
    near = nodes.select(F.col("id").alias("src"), F.col("light").alias("src_light"))
    far = nodes.select(F.col("id").alias("dst"), F.col("light").alias("dst_light"))
    rows = edges.join(near, "src", "left").join(far, "dst", "left")
    return rows.select("src", "dst", F.when(F.col("src_light") == "grey", "grey").when(F.col("dst_light") != "green", F.col("dst_light")).otherwise("green").alias("light"))


def probe_light(age_s: Column, lag: Column) -> Column:
    """The light of a sync probe: red by a large lag or an old one, amber by a small lag, grey without any sign of life."""
    return F.when(age_s.isNull(), "grey").when((lag >= 50) | ((age_s > 7200) & (lag > 0)), "red").when(lag > 5, "amber").otherwise("green")


def tool_light(age_s: Column, fresh_hours: int = 4) -> Column:
    """The light of a tool by the age of its last sign of life: green while it is fresh, amber after, grey without any."""
    return F.when(age_s.isNull(), "grey").when(age_s < 3600 * fresh_hours, "green").otherwise("amber")
