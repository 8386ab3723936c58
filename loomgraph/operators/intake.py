"""Intake of usage reports into stored feedback, and how fresh the intake is."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.functions.columns import blank
from loomgraph.operators.state import VERDICTS
from loomgraph.operators.windows import prefixed, segmented
from loomgraph.tables import materialise

#: Verdicts on a search rather than on an episode. Fixed values.
ON_SEARCH = ("irrelevant", "missed")
_KEY = ["episode_name", "verdict", "query"]


def checked(reports: DataFrame, episodes: DataFrame) -> DataFrame:
    """Reports (report_id, episode_name, verdict, query, replacement, ts) with ``refusal``, null where they are taken.

    A name or a verdict that is missing or unknown is a bad request; then an episode that doesn't exist; then a verdict
    on a search without the query. Names are trimmed, queries trimmed and cut at 200 characters. Adds ``verified``.
    """
    flags = episodes.groupBy(F.col("name").alias("episode_name")).agg(F.max(F.coalesce("verified", F.lit(False))).alias("verified"))
    rows = reports.withColumns({"episode_name": F.trim(blank("episode_name")), "query": F.substring(F.trim(blank("query")), 1, 200)}).join(flags, "episode_name", "left")
    known = F.coalesce(F.col("verdict").isin(*VERDICTS), F.lit(False))
    refusal = F.when((F.col("episode_name") == "") | ~known, "bad request").when(F.col("verified").isNull(), "unknown episode").when(F.col("verdict").isin(*ON_SEARCH) & (F.col("query") == ""), "no query")
    return rows.withColumn("refusal", refusal)


def folded(stored: DataFrame, reports: DataFrame, episodes: DataFrame, canonical_prefix: str) -> DataFrame:
    """Stored feedback after a batch of reports, as if each had been merged in the order of ``report_id``.

    A report joins the waiting row of its episode and verdict (of a search: episode, verdict and query) and raises its
    ``report_count``, or begins a row. A stale or inaccurate row of an episode that is neither canonical nor verified is
    closed as ``auto_retire`` by a replacement that is live, or by its second report; a supplement is closed as
    ``auto_noted`` by a live replacement; all else goes on waiting. What comes after a closing begins a new row.
    Replacements count as live by the episodes given. Refused reports (``checked``) change nothing. Of several waiting
    rows of a key the one of least id takes the reports. stored: id (bigint), episode_name, verdict, query, status,
    report_count, replacement, handled_action; the result has the id as a string, new rows one of a hash.

    Within a key, whether a report closes depends on how many came since the last replacement, which a running count
    by segments gives: a key that is reported millions of times is worked in many tasks.
    """
    live = episodes.where(~F.coalesce("archived", F.lit(False))).select(F.col("name").alias("replacement")).distinct().withColumn("_live", F.lit(True))
    taken = checked(reports, episodes).where("refusal is null").join(live, "replacement", "left")
    own = F.when(F.col("verdict").isin(*ON_SEARCH), F.col("query")).otherwise("")
    retire = F.col("verdict").isin("stale", "inaccurate") & ~F.col("episode_name").startswith(canonical_prefix) & ~F.col("verified")
    slim = taken.select("episode_name", "verdict", own.alias("query"), "report_id", "replacement", F.coalesce("_live", F.lit(False)).alias("_live"), retire.alias("_retire"))
    search = F.col("verdict").isin(*ON_SEARCH)
    waiting = stored.where(F.col("status") == F.when(search, "diagnostic").otherwise("pending"))
    waiting = waiting.groupBy("episode_name", "verdict", F.when(search, blank("query")).otherwise("").alias("query")).agg(F.min_by(F.struct("id", F.coalesce("report_count", F.lit(1)).alias("report_count"), "replacement"), "id").alias("_open"))

    order = ["report_id"]
    counted = prefixed(segmented(slim, _KEY, order), _KEY, order, counts={"_n": ~F.col("_live")})
    rows = prefixed(counted, _KEY, order, lasts={"_at": F.when(F.col("_live"), F.col("_n"))}).join(waiting, _KEY, "left")
    since = F.col("_n") - F.coalesce("_at", F.lit(0)) + (F.col("_at").isNull() & F.col("_open").isNotNull()).cast("int")
    closes = F.when(F.col("_retire"), F.col("_live") | (since % 2 == 0)).otherwise((F.col("verdict") == "supplement") & F.col("_live"))
    # Written: the rounds below read it twice.
    closing = materialise(rows.withColumn("_closes", closes).drop("_n", "_at", "_open"), "closing")
    rounds = prefixed(closing, _KEY, order, counts={"_round": F.col("_closes")}, upto=-1)
    merged = rounds.groupBy(*_KEY, "_round").agg(
        F.count(F.lit(1)).alias("_reports"),
        F.min("report_id").alias("_first"),
        F.max_by("replacement", F.when(F.col("_live"), F.col("report_id"))).alias("_replacement"),
        F.bool_or("_closes").alias("_closed"),
        F.bool_or("_retire").alias("_retire"),
    )
    merged = merged.join(waiting.withColumn("_round", F.lit(0).cast("bigint")), [*_KEY, "_round"], "left")
    made = F.substring(F.sha2(F.concat_ws("|", *_KEY, F.col("_first").cast("string")), 256), 1, 12)
    changed = merged.select(
        F.coalesce(F.col("_open.id").cast("string"), made).alias("id"),
        *_KEY,
        F.when(search, "diagnostic").when(F.col("_closed"), "auto_handled").otherwise("pending").alias("status"),
        (F.col("_reports") + F.coalesce("_open.report_count", F.lit(0))).alias("report_count"),
        F.coalesce("_replacement", "_open.replacement").alias("replacement"),
        F.when(F.col("_closed"), F.when(F.col("_retire"), "auto_retire").otherwise("auto_noted")).alias("handled_action"),
    )
    touched = merged.where("_open is not null").select(F.col("_open.id").alias("id"))
    rest = stored.join(touched, "id", "left_anti").select(F.col("id").cast("string").alias("id"), "episode_name", "verdict", blank("query").alias("query"), "status", F.col("report_count").cast("bigint").alias("report_count"), "replacement", "handled_action")
    return rest.unionByName(changed)


def freshness(episodes: DataFrame, quarantine: DataFrame, now: Column, prefix: str) -> DataFrame:
    """One row: the age of the newest capsule in hours to one place (null without any), and how many wait in quarantine."""
    newest = episodes.where(F.col("name").startswith(prefix)).agg(F.max("created_at").alias("at"))
    age = F.round((F.unix_timestamp(now) - F.unix_timestamp("at")) / 3600, 1)
    return newest.select(age.alias("capsule_age_hours")).crossJoin(quarantine.agg(F.count(F.lit(1)).alias("quarantined")))  # one row each
