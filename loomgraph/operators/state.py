"""State machines as transitions from table to table: idempotent keys, quarantine, feedback, upserts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.functions.columns import blank


def stuck(keys: DataFrame, now: Column, pending_minutes: int = 30, error_hours: int = 24) -> Column:
    """Pending keys too old and errors too old; a null created_at counts as oldest."""
    at = F.coalesce("created_at", F.to_timestamp(F.lit("1970-01-01")))
    return ((F.col("status") == "pending") & (at < now - F.make_interval(mins=F.lit(pending_minutes)))) | ((F.col("status") == "error") & (at < now - F.make_interval(hours=F.lit(error_hours))))


def without_stuck(keys: DataFrame, now: Column) -> DataFrame:
    return keys.where(~F.coalesce(stuck(keys, now), F.lit(False)))


def claim(requests: DataFrame, keys: DataFrame, on: Sequence[str]) -> DataFrame:
    """One outcome a key: the first request of a new key claims it; an existing key answers by its status."""
    first = requests.groupBy(*on).agg(F.min("request_id").alias("request_id"), F.count(F.lit(1)).alias("requests"))
    rows = first.join(keys.select(*on, "status"), list(on), "left")
    return rows.withColumn("outcome", F.when(F.col("status").isNull(), "created").when(F.col("status") == "ok", "skipped").when(F.col("status") == "pending", "in_progress").otherwise("conflict"))


def queue_stats(keys: DataFrame, now: Column) -> DataFrame:
    """Counts by status, the oldest pending age in seconds, and what ended in the last hour: one aggregate."""
    recent = F.coalesce("updated_at", "created_at") > now - F.expr("interval 1 hour")
    is_ = lambda s: F.col("status") == s
    return keys.agg(
        F.count_if(is_("pending")).alias("pending"), F.count_if(is_("ok")).alias("ok"), F.count_if(is_("error")).alias("errors"),
        F.min(F.when(is_("pending"), F.unix_timestamp(now) - F.unix_timestamp("created_at"))).alias("newest_pending_s"), F.max(F.when(is_("pending"), F.unix_timestamp(now) - F.unix_timestamp("created_at"))).alias("oldest_pending_s"),
        F.count_if(is_("ok") & recent).alias("ok_last_hour"), F.count_if(is_("error") & recent).alias("errors_last_hour"),
    )


def error_samples(keys: DataFrame, n: int = 5, size: int = 200) -> DataFrame:
    """The newest errors with their messages cut. keys: source_obs_id, status, error_message, updated_at, created_at."""
    at = F.coalesce("updated_at", "created_at")
    return keys.where("status = 'error'").orderBy(F.desc(at), "source_obs_id").limit(n).select("source_obs_id", F.substring(blank("error_message"), 1, size).alias("message"))


def parents(planned: DataFrame, existing: DataFrame) -> DataFrame:
    """Per parent how many of its planned observations exist, as ``n/m``, and whether all do. planned: name, observations; existing: name."""
    rows = planned.select("name", F.size(F.coalesce("observations", F.array())).alias("m"))
    made = existing.select(F.regexp_extract("name", r"^(.*)--obs-\d+$", 1).alias("name")).where("name <> ''").groupBy("name").agg(F.count(F.lit(1)).cast("int").alias("made"))
    out = rows.join(made, "name", "left").withColumn("made", F.least(F.coalesce("made", F.lit(0)), "m"))
    return out.select("name", F.concat_ws("/", F.col("made").cast("string"), F.col("m").cast("string")).alias("status"), (F.col("made") == F.col("m")).alias("complete"))


def upsert(table: DataFrame, changes: DataFrame, on: Sequence[str], on_match: Sequence[str]) -> DataFrame:
    """``table`` after a merge: matched rows take the columns ``on_match`` where the change has a value, new keys are added.

    ``changes`` has one row a key. The result is written as a new version by the caller; nothing is updated in place.
    """
    columns = [c for c in table.columns if c not in on]
    new = changes.select(*on, F.lit(True).alias("_changed"), *(F.col(c).alias(f"_{c}") for c in columns if c in changes.columns))
    rows = table.withColumn("_known", F.lit(True)).join(new, list(on), "full")

    def value(c: str) -> Column:
        if c not in changes.columns:
            return F.col(c)
        return F.when(F.col("_known").isNull(), F.col(f"_{c}")).when(F.col("_changed") & F.lit(c in on_match), F.coalesce(f"_{c}", c)).otherwise(F.col(c)).alias(c)

    return rows.select(*on, *(value(c).alias(c) for c in columns))


def hash_alias(files: DataFrame, known: DataFrame) -> DataFrame:
    """skip a path already known with the same hash, update a changed one, alias known content at a new path, else new.

    files: path, sha; known: path, sha.
    """
    by_path = known.select("path", F.col("sha").alias("known_sha"))
    by_sha = known.groupBy("sha").agg(F.min("path").alias("alias_of"))
    rows = files.join(by_path, "path", "left").join(by_sha, "sha", "left")
    return rows.select("path", F.when(F.col("known_sha") == F.col("sha"), "skip").when(F.col("known_sha").isNotNull(), "update").when(F.col("alias_of").isNotNull(), "alias").otherwise("new").alias("action"), F.when(F.col("known_sha").isNull(), F.col("alias_of")).alias("alias_of"))


def quarantine(capsules: DataFrame, has_source: Column, known: DataFrame, prefix: str, most: int = 20_000) -> DataFrame:
    """Capsules without a recognisable source and without a key: name and cut content with a marker."""
    text = blank("content")
    bad = capsules.where(F.col("name").startswith(prefix) & ~has_source).join(known.select("name"), "name", "left_anti")
    return bad.select("uuid", "name", F.when(F.char_length(text) > most, F.concat(F.substring(text, 1, most), F.lit("[cut]"))).otherwise(text).alias("content"), F.lit("no source").alias("reason"))


VERDICTS = ("stale", "conflict", "supplement", "inaccurate", "irrelevant", "missed")


def feedback(reports: DataFrame, episodes: DataFrame, canonical_prefix: str) -> DataFrame:
    """Reports by (name, verdict) with the action they lead to.

    irrelevant and missed are diagnostics; a repeated or replaced stale or inaccurate report retires an episode that is
    neither canonical nor verified; a supplement with a replacement is noted; all else waits. Unknown verdicts and
    names that no episode has are refused.
    """
    counts = reports.where(F.col("verdict").isin(*VERDICTS)).groupBy("name", "verdict").agg(F.count(F.lit(1)).alias("report_count"), F.max("replacement").alias("replacement"))
    flags = episodes.groupBy("name").agg(F.max(F.coalesce("verified", F.lit(False))).alias("verified"))
    live = episodes.where(~F.coalesce("archived", F.lit(False))).select(F.col("name").alias("replacement")).distinct().withColumn("live", F.lit(True))
    rows = counts.join(flags, "name").join(live, "replacement", "left")
    replaced = F.coalesce("live", F.lit(False))
    retire = F.col("verdict").isin("stale", "inaccurate") & ~F.col("name").startswith(canonical_prefix) & ~F.col("verified") & (replaced | (F.col("report_count") >= 2))
    action = F.when(F.col("verdict").isin("irrelevant", "missed"), "diagnostic").when(retire, "auto_retire").when((F.col("verdict") == "supplement") & F.col("replacement").isNotNull(), "auto_noted").otherwise("pending")
    return rows.select("name", "verdict", "report_count", action.alias("action"))


def archive(episodes: DataFrame, manifest: DataFrame) -> DataFrame:
    """Episodes after a reversible soft delete of the manifest's live rows (uuid)."""
    rows = episodes.join(manifest.select("uuid", F.lit(True).alias("_listed")), "uuid", "left")
    return rows.withColumn("archived", F.coalesce("archived", F.lit(False)) | F.coalesce("_listed", F.lit(False))).drop("_listed")


def restore(episodes: DataFrame, manifest: DataFrame) -> DataFrame:
    rows = episodes.join(manifest.select("uuid", F.lit(True).alias("_listed")), "uuid", "left")
    return rows.withColumn("archived", F.col("archived") & ~F.coalesce("_listed", F.lit(False))).drop("_listed")


def keep_counters(fresh: DataFrame, old: DataFrame, on: str, counters: Sequence[str]) -> DataFrame:
    """Re-ingested rows with the counters of the rows they replace."""
    before = old.groupBy(on).agg(*(F.max(c).alias(f"_{c}") for c in counters))
    rows = fresh.join(before, on, "left")
    return rows.withColumns({c: F.coalesce(f"_{c}", c) for c in counters}).drop(*(f"_{c}" for c in counters))


def case_pack(episodes: DataFrame, most: int = 12, each: int = 1600, total: int = 9000) -> DataFrame:
    """One text a pack: its first episodes by uuid, each cut, joined and cut. episodes: pack, uuid, name, content."""
    rows = episodes.withColumn("place", F.row_number().over(Window.partitionBy("pack").orderBy("uuid"))).where(F.col("place") <= most)
    parts = rows.groupBy("pack").agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list(F.struct("place", F.concat_ws("\n", "name", F.substring(blank("content"), 1, each)).alias("part")))).alias("parts"))
    return parts.select("pack", "n", F.substring(F.array_join(F.transform("parts", lambda p: p["part"]), "\n\n"), 1, total).alias("body"))


def children(parents: DataFrame, existing: DataFrame) -> DataFrame:
    """Rows of a parent's observations named ``<parent>--obs-NN`` that don't exist yet, with n of m."""
    rows = parents.select("name", F.size("observations").alias("m"), F.posexplode("observations").alias("pos", "observation"))
    rows = rows.withColumn("child", F.concat("name", F.lit("--obs-"), F.lpad((F.col("pos") + 1).cast("string"), F.greatest(F.lit(2), F.length((F.col("pos") + 1).cast("string"))), F.lit("0"))))
    return rows.join(existing.select(F.col("name").alias("child")), "child", "left_anti").select("child", "name", "m", "observation")
