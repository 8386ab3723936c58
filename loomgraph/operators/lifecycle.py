"""Transitions of capsules, feedback and observations after their intake: requeue, resolve, digest, backfill, lanes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.functions.columns import blank

PROVENANCES = ("firsthand", "external-article", "external-community")


def requeue(requests: DataFrame, quarantine: DataFrame, keys: DataFrame, source_description: str) -> DataFrame:
    """What becomes of requests to take capsules out of quarantine, and whether the capsule leaves it.

    requests: source_obs_id, provenance (null discards). A capsule whose key is ok is in already and leaves; one that is
    pending conflicts and stays; without a key, or with one in error, it is queued again. Several requests for one
    capsule count as the one of least provenance, a discard first. Bad provenances and unknown capsules change nothing.
    """
    one = requests.groupBy("source_obs_id").agg(F.min(F.struct("provenance")).alias("r")).select("source_obs_id", "r.provenance")
    held = quarantine.select("source_obs_id").distinct().withColumn("held", F.lit(True))
    status = keys.where(F.col("source_description") == source_description).groupBy("source_obs_id").agg(F.max("status").alias("status"))
    rows = one.join(held, "source_obs_id", "left").join(status, "source_obs_id", "left")
    outcome = (
        F.when(F.col("provenance").isNotNull() & ~F.col("provenance").isin(*PROVENANCES), "bad_request")
        .when(F.col("held").isNull(), "not_found")
        .when(F.col("provenance").isNull(), "discarded")
        .when(F.col("status") == "ok", "already")
        .when(F.col("status") == "pending", "conflict")
        .otherwise("queued")
    )
    return rows.select("source_obs_id", "provenance", outcome.alias("outcome")).withColumn("leaves", F.col("outcome").isin("discarded", "already", "queued"))


def routed(requests: DataFrame, keys: DataFrame, on: Sequence[str], refused: Column) -> DataFrame:
    """Ingest requests by outcome: quarantined before any claim, created, skipped, in progress, or a conflict with an error.

    Each key's first request (by request_id) claims it; its later ones find it in progress.
    """
    rows = requests.withColumn("refused", refused)
    claims = rows.where(~F.coalesce("refused", F.lit(False))).groupBy(*on).agg(F.min("request_id").alias("claimer"))
    known = keys.select(*on, "status").dropDuplicates(list(on))
    rows = rows.join(claims, list(on), "left").join(known, list(on), "left")
    outcome = (
        F.when(F.col("refused"), "quarantined")
        .when(F.col("status") == "ok", "skipped")
        .when(F.col("status") == "pending", "in_progress")
        .when(F.col("status").isNotNull(), "conflict")
        .when(F.col("request_id") == F.col("claimer"), "created")
        .otherwise("in_progress")
    )
    return rows.select(*on, "request_id", outcome.alias("outcome"))


def resolve(feedback: DataFrame, actions: DataFrame, now: Column, canonical_prefix: str) -> DataFrame:
    """Feedback after decisions on it (id, action): pending rows become handled, handled ones undone wait again.

    Actions are verified, retire, dismiss and undo; a canonical episode can't be retired. ``outcome`` is null for rows
    without an action. Several actions on a row count as the first by name.
    """
    rows = feedback.join(actions.groupBy("id").agg(F.min("action").alias("action")), "id", "left")
    pending, done = F.col("status") == "pending", F.col("status").isin("auto_handled", "handled")
    undo = F.col("action") == "undo"
    outcome = (
        F.when(F.col("action").isNull(), None)
        .when(~F.col("action").isin("verified", "retire", "dismiss", "undo"), "bad_request")
        .when(F.when(undo, done).otherwise(pending), F.when((F.col("action") == "retire") & F.col("episode_name").startswith(canonical_prefix), "canonical").otherwise("done"))
        .otherwise("not_found")
    )
    rows = rows.withColumn("outcome", outcome).withColumn("restores", (F.col("outcome") == "done") & undo & F.col("handled_action").isin("retire", "auto_retire"))
    changed = F.col("outcome") == "done"
    return rows.withColumns(
        {
            "status": F.when(changed, F.when(undo, "pending").otherwise("handled")).otherwise(F.col("status")),
            "handled_action": F.when(changed, F.when(~undo, F.col("action"))).otherwise(F.col("handled_action")),
            "handled_at": F.when(changed, F.when(~undo, now)).otherwise(F.col("handled_at")),
        }
    )


def applied(episodes: DataFrame, resolved: DataFrame) -> DataFrame:
    """Episodes after resolved feedback: verified and retired ones by name, then those that an undo restores."""
    done = resolved.where("outcome = 'done'").groupBy(F.col("episode_name").alias("name")).agg(
        F.max(F.col("action") == "verified").alias("_verified"), F.max(F.col("action") == "retire").alias("_retired"), F.max("restores").alias("_restored")
    )
    rows = episodes.join(done, "name", "left")
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    return rows.withColumns({"verified": F.coalesce("verified", F.lit(False)) | yes("_verified"), "archived": (F.coalesce("archived", F.lit(False)) & ~yes("_restored")) | yes("_retired")}).drop("_verified", "_retired", "_restored")


def digest(feedback: DataFrame, now: Column) -> DataFrame:
    """The day's digest: what was handled in 24 hours (20), the oldest that wait (10), the most reported diagnostics of the day (5)."""
    at = F.coalesce("updated_at", "created_at")
    recent = now - F.expr("interval 24 hours")

    def part(name: str, rows: DataFrame, n: int, order: list[Column]) -> DataFrame:
        return rows.orderBy(*order, "id").limit(n).select(F.lit(name).alias("section"), "id", "episode_name", "verdict")

    handled = feedback.where(F.col("status").isin("auto_handled", "handled") & (F.col("handled_at") >= recent))
    asked = feedback.where((F.col("status") == "diagnostic") & (at >= recent))
    return (
        part("handled", handled, 20, [F.desc("handled_at")])
        .unionByName(part("pending", feedback.where("status = 'pending'"), 10, [at.asc()]))
        .unionByName(part("diagnostic", asked, 5, [F.desc(F.coalesce("report_count", F.lit(1)))]))
    )


def inbox_feedback(feedback: DataFrame, episodes: DataFrame, now: Column) -> DataFrame:
    """Feedback for the inbox: the newest that wait (30) with what their episodes say, and a week's automatic ones (12) and diagnostics (15)."""
    at = F.coalesce("updated_at", "created_at")
    week = now - F.expr("interval 7 days")
    said = episodes.groupBy("name").agg(F.min_by(F.substring(blank("content"), 1, 4000), "uuid").alias("detail"))

    def part(name: str, rows: DataFrame, n: int, order: Column) -> DataFrame:
        return rows.orderBy(order.desc(), "id").limit(n).select(F.lit(name).alias("section"), "id", F.col("episode_name").alias("name"), "verdict")

    waiting = part("pending", feedback.where("status = 'pending'"), 30, at)
    auto = part("auto", feedback.where((F.col("status") == "auto_handled") & (F.col("handled_at") >= week)), 12, F.col("handled_at"))
    asked = part("diagnostic", feedback.where((F.col("status") == "diagnostic") & (at >= week)), 15, at)
    # Feedback on a name that no episode has stays, without detail.
    return waiting.unionByName(auto).unionByName(asked).join(said, "name", "left")


def waiting_with_episodes(feedback: DataFrame, episodes: DataFrame, n: int = 30, size: int = 4000) -> DataFrame:
    """Feedback that waits with every episode of its name, newest first: a name of several episodes gives a row each,
    one of none a row without detail. The first n rows of that list; null names match none."""
    at = F.coalesce("updated_at", "created_at")
    said = episodes.select(F.col("name").alias("episode_name"), "uuid", F.substring(blank("content"), 1, size).alias("detail"))
    rows = feedback.where("status = 'pending'").select("id", "episode_name", "verdict", at.alias("at")).join(said, "episode_name", "left")
    return rows.orderBy(F.desc("at"), "id", "uuid").limit(n).select("id", F.col("episode_name").alias("name"), "verdict", "uuid", "detail")


def unanswered(episodes: DataFrame, articles: DataFrame, order: str, n: int = 50) -> DataFrame:
    """Of the newest n published stories those that no article's feedback is linked to. Empty and null links match none."""
    newest = episodes.where("visibility = 'public-story'").orderBy(F.desc(order), "uuid").limit(n)
    linked = articles.where(F.coalesce("linked_casepack", F.lit("")) != "").select(F.col("linked_casepack").alias("name")).distinct()
    return newest.join(linked, "name", "left_anti")


def backfill(episodes: DataFrame, results: DataFrame, route: Column, prefix: str, created: str, n: int) -> DataFrame:
    """The n newest live episodes still to be split into observations, with what a run marks on them.

    results: name, made, planned (made -1: the model failed). Catalogues are marked and become kind ``registry`` unless
    they have a kind; short ones are marked; of those that are split only complete and empty ones are, so that failed
    and partial ones come again.
    """
    todo = episodes.where(F.col("name").startswith(prefix) & ~F.coalesce("archived", F.lit(False)) & F.col("predigested").isNull() & ~F.col("name").contains("--obs-"))
    rows = todo.orderBy(F.desc(created), "uuid").limit(n).join(results.dropDuplicates(["name"]), "name", "left").withColumn("route", route)
    made, planned = F.coalesce("made", F.lit(-1)), F.coalesce("planned", F.lit(0))
    state = (
        F.when(F.col("route") == "catalog", "catalog")
        .when(F.col("route").isNull(), "short")
        .when(made == -1, "failed")
        .when(planned == 0, "empty")
        .when(made == planned, "complete")
        .otherwise("partial")
    )
    rows = rows.withColumn("state", state)
    return rows.withColumns(
        {
            "predigested": F.when(F.col("state").isin("catalog", "short", "empty", "complete"), True),
            "predigest_empty": F.when(F.col("state") == "empty", True),
            "kind": F.when((F.col("state") == "catalog") & (F.col("kind").isNull() | (F.col("kind") == "unclassified")), "registry").otherwise(F.col("kind")),
        }
    )


def due(observations: DataFrame, terminal: DataFrame, boundary: int, cursor: int, live: int = 200, backlog: int = 15) -> DataFrame:
    """What a cycle takes: up to ``live`` new ids after the cursor and up to ``backlog`` old ones up to the boundary, none of them terminal."""
    open_ = observations.join(terminal.select("id"), "id", "left_anti")

    def lane(name: str, rows: DataFrame, n: int) -> DataFrame:
        return rows.orderBy("id").limit(n).select("id", F.lit(name).alias("lane"))

    return lane("live", open_.where(F.col("id") > cursor), live).unionByName(lane("backlog", open_.where(F.col("id") <= boundary), backlog))


def settled(decisions: DataFrame) -> DataFrame:
    """Decisions by what they leave behind: ingested and rejected are terminal, a full quota only defers to another day."""
    status = F.when(F.col("accept"), "ingested").when(F.col("layer") == "quota", "deferred").otherwise("rejected")
    return decisions.withColumn("status", status).withColumn("terminal", F.col("status") != "deferred")


def ids_of_names(names: DataFrame, prefix: str) -> DataFrame:
    """(id) parsed from names ``<prefix><digits>``; other names give none."""
    found = F.regexp_extract("name", rf"^{prefix}(\d+)", 1)
    return names.where(found != "").select(found.cast("bigint").alias("id")).distinct()


def markdown(rows: DataFrame, order: Sequence[str]) -> DataFrame:
    """A short table as markdown lines (place, line): head, rule, rows in order. Nulls are dashes."""
    columns = rows.columns
    cells = F.concat(F.lit("| "), F.array_join(F.array(*(F.coalesce(F.col(c).cast("string"), F.lit("—")) for c in columns)), " | "), F.lit(" |"))
    place = F.row_number().over(Window.orderBy(*order)) + 1  # a report is short
    body = rows.select(place.alias("place"), cells.alias("line"))
    head = rows.sparkSession.createDataFrame([(0, "| " + " | ".join(columns) + " |"), (1, "|" + "---|" * len(columns))], "place int, line string")
    return head.unionByName(body)

