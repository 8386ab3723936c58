"""Evaluation, replay and learning: recall, confusion, nearest sessions, engagement, posteriors."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph import config
from loomgraph.functions.columns import contains_any, occurrences
from loomgraph.operators import patterns
from loomgraph.tables import materialise


def recall_at_k(golden: DataFrame, gold: DataFrame, recalled: DataFrame) -> DataFrame:
    """Mean recall and hit rate by mode with a total (null mode). golden: id, mode; gold, recalled: id, uuid."""
    hits = gold.join(recalled.select("id", "uuid").distinct(), ["id", "uuid"], "left_semi").groupBy("id").agg(F.count(F.lit(1)).alias("hits"))
    sizes = gold.groupBy("id").agg(F.count(F.lit(1)).alias("gold"))
    rows = golden.join(sizes, "id", "left").join(hits, "id", "left").withColumns({"gold": F.coalesce("gold", F.lit(0)), "hits": F.coalesce("hits", F.lit(0))})
    recall = F.when(F.col("gold") > 0, F.col("hits") / F.col("gold")).otherwise(0.0)
    return rows.rollup("mode").agg(F.count(F.lit(1)).alias("queries"), F.round(F.avg(recall), 6).alias("recall"), F.round(F.avg((F.col("hits") > 0).cast("double")), 6).alias("hit_rate"))


def gold(episodes: DataFrame, queries: Sequence[tuple[int, str]], cap: int = 60) -> DataFrame:
    """(id, uuid): up to ``cap`` episodes by uuid whose content holds each of a stated set of texts in any case; one pass over the contents."""
    asked = episodes.sparkSession.createDataFrame([(i, t.lower()) for i, t in queries], "id bigint, pattern string")
    low = episodes.select("uuid", F.lower(F.coalesce("content", F.lit(""))).alias("low"))
    hits = patterns.occurring(low, ["uuid"], "low", asked).join(F.broadcast(asked), "pattern").select("id", "uuid")
    return hits.withColumn("place", F.row_number().over(Window.partitionBy("id").orderBy("uuid"))).where(F.col("place") <= cap).drop("place")


def keyword_gate(questions: DataFrame, least: float) -> DataFrame:
    """The questions' rows and one with a null id: how many are right, the recall and whether it is enough."""
    total = questions.agg(F.count_if("ok").alias("matched"), F.round(F.count_if("ok") / F.greatest(F.count(F.lit(1)), F.lit(1)), 6).alias("recall"))
    return questions.withColumn("recall", F.lit(None).cast("double")).unionByName(total.select(F.lit(None).cast("bigint").alias("id"), "matched", F.lit(None).cast("int").alias("threshold"), (F.col("recall") >= least).alias("ok"), "recall"))


def keyword_recall(questions: DataFrame, results: DataFrame) -> DataFrame:
    """Questions by how many of their keywords the joined result text has, against a threshold."""
    rows = questions.join(results, "id", "left").withColumn("text", F.lower(F.coalesce("text", F.lit(""))))
    return rows.select("id", F.size(F.filter("keywords", lambda k: F.col("text").contains(F.lower(k)))).alias("matched"), "threshold").withColumn("ok", F.col("matched") >= F.col("threshold"))


def confusion(gold: DataFrame, got: DataFrame) -> DataFrame:
    return gold.join(got, "uuid").groupBy("gold", "got").agg(F.count(F.lit(1)).alias("n"))


def accuracy(counts: DataFrame) -> DataFrame:
    """All rows of a confusion table, those on its diagonal and their share (0 without rows). A null kind is never right."""
    hit = F.coalesce(F.col("gold") == F.col("got"), F.lit(False))
    c = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum(F.when(hit, F.col("n"))), F.lit(0)).alias("correct"))
    return c.withColumn("accuracy", F.round(F.col("correct") / F.greatest("n", F.lit(1)), 6))


def nearest_session(injections: DataFrame, sessions: DataFrame, before: int = 180, after: int = 3600) -> DataFrame:
    """Each injection's nearest session of the same project by start, within bounds in seconds; ties take the earlier.

    Both sides are cut into buckets of the window's width, so that a busy project's pairs stay those that lie near.
    """
    width = before + after
    bucket = lambda c: F.floor(F.unix_timestamp(c) / width)
    left = injections.withColumn("bucket", F.explode(F.array(bucket("ts") - 1, bucket("ts"), bucket("ts") + 1)))
    right = sessions.withColumn("bucket", bucket("start_ts"))
    gap = F.unix_timestamp("start_ts") - F.unix_timestamp("ts")
    pairs = left.join(right, ["project", "bucket"]).withColumn("gap", gap).where(F.col("gap").between(-before, after))
    best = pairs.groupBy("id").agg(F.min_by(F.struct("session_id", "gap"), F.struct(F.abs("gap"), "start_ts", "session_id")).alias("best"))
    return best.select("id", "best.*")


#: Terms that tell a text from prose: code spans, dotted, snake or path names, CamelCase. Fixed values.
TERM_CLASSES = (r"`([^`\n]{3,40})`", r"\b([A-Za-z][A-Za-z0-9]*[_./-][A-Za-z0-9_./-]{2,})\b", r"\b([A-Z][a-z]+(?:[A-Z][a-z0-9]+)+)\b")


def terms(text: Column, generic: Sequence[str] = ()) -> Column:
    """Distinct terms of the three classes, lowered and trimmed, of four characters or more, without generic ones. Null gives none."""
    text = F.coalesce(text, F.lit(""))
    found = F.concat(*(F.regexp_extract_all(text, F.lit(p), F.lit(1)) for p in TERM_CLASSES))
    trimmed = F.array_distinct(F.transform(found, lambda t: F.btrim(F.lower(t), F.lit(" .,:;`"))))
    return F.filter(trimmed, lambda t: (F.char_length(t) >= 4) & ~t.isin(*generic) if generic else F.char_length(t) >= 4)


def capsule_terms(capsules: DataFrame, generic: Sequence[str] = ()) -> DataFrame:
    """(capsule, term, own): the terms of each capsule, and whether no other one has the term. capsules: capsule (unique), content."""
    # Written, so that texts are searched once and a frequent term's rows meet its count in a join of two plain exchanges.
    rows = materialise(capsules.select("capsule", F.explode(terms(F.col("content"), generic)).alias("term")), "terms")
    alone = materialise(rows.groupBy("term").agg(F.count(F.lit(1)).alias("df")).where("df = 1").select("term", F.lit(True).alias("own")), "own_terms")
    return rows.join(alone, "term", "left").select("capsule", "term", F.coalesce("own", F.lit(False)).alias("own"))


def attributed(pairs: DataFrame, capsules: DataFrame, sessions: DataFrame, least_shared: int = 2, generic: Sequence[str] = ()) -> DataFrame:
    """The distinct (capsule, session) pairs whose session text holds one of the capsule's own terms or enough of all.

    Texts are compared in lower case; a session has one text. Each session of a pair is read once, by an automaton over
    all terms of the pairs' capsules; the terms it holds then meet those of its pairs. Pairs of unknown capsules or
    sessions are not attributed.
    """
    rows = pairs.where("capsule is not null and session is not null").select("capsule", "session").distinct()
    known = materialise(capsule_terms(capsules, generic).join(rows.select("capsule").distinct(), "capsule", "left_semi"), "capsule_terms")
    low = sessions.join(rows.select("session").distinct(), "session", "left_semi").select("session", F.lower("text").alias("low"))
    held = patterns.occurring(low, ["session"], "low", known.select(F.col("term").alias("pattern"))).select("session", F.col("pattern").alias("term"))
    shared = rows.join(known, "capsule").join(held, ["session", "term"]).groupBy("capsule", "session")
    return shared.agg(F.count_if("own").alias("own"), F.count(F.lit(1)).alias("n")).where((F.col("own") >= 1) | (F.col("n") >= least_shared)).select("capsule", "session")


def engagement(capsules: DataFrame, matches: DataFrame, sessions: DataFrame, least_shared: int = 2) -> DataFrame:
    """Per capsule: injections, those matched to a session, those whose session used it, and the rate. matches: capsule, session."""
    used = attributed(matches, capsules, sessions, least_shared).withColumn("used", F.lit(1))
    rows = matches.join(used, ["capsule", "session"], "left").groupBy("capsule")
    out = rows.agg(F.count(F.lit(1)).alias("injected"), F.count("session").alias("matched"), F.count("used").alias("engaged"))
    return out.withColumn("rate", F.when(F.col("matched") > 0, F.round(F.col("engaged") / F.col("matched"), 6)))


#: A path with an extension. Fixed value.
FILE_PATH = r"[\w./\-]+\.([A-Za-z0-9]{1,6})\b"


def file_buckets(files: Column) -> dict[str, Column]:
    """Numbers of code, doc, config, asset and other files named in a text; a well-known config file adds one to config."""
    text = F.coalesce(files, F.lit(""))
    found = F.transform(F.regexp_extract_all(text, F.lit(FILE_PATH), F.lit(1)), lambda e: F.lower(e))
    count = lambda kinds: F.size(F.filter(found, lambda e: e.isin(*kinds)))
    out = {name: count(kinds) for name, kinds in config.EXTENSIONS.items()}
    out["other"] = F.size(found) - sum(out.values(), F.lit(0))
    out["config"] = out["config"] + text.rlike(config.CONFIG_NAMES).cast("int")
    return out


def scenario(files: Column, types: Column, text: Column) -> tuple[Column, Column]:
    """(scenario, reason) of a session by ordered rules on its files, the types of its observations and its lowered text."""
    n = file_buckets(files)
    text = F.lower(F.coalesce(text, F.lit("")))
    ops, research = contains_any(text, config.OPS_MARKERS), contains_any(text, config.RESEARCH_MARKERS)
    typed = lambda *kinds: F.exists(types, lambda t: t.isin(*kinds))
    none = (n["code"] == 0) & (n["doc"] == 0) & (n["config"] == 0)
    rules = (
        (n["code"] > 0, "coding", "code files"),
        (typed(*config.CODE_TYPES) & ~((n["config"] > 0) & ops), "coding", "types of code changes"),
        (n["config"] > 0, "ops", "config files"),
        (ops & (n["doc"] == 0), "ops", "words of operation"),
        ((n["doc"] > 0), "writing", "documents only"),
        (none & typed("decision"), "planning", "decisions without files"),
        (none & research, "research", "words of research"),
        (none & typed("discovery"), "research", "discoveries without files"),
    )
    first, reason = None, None
    for when, name, why in rules:
        first = F.when(when, name) if first is None else first.when(when, name)
        reason = F.when(when, why) if reason is None else reason.when(when, why)
    return first.otherwise("unknown"), reason.otherwise("no rule")


def outcome(text: Column, good: Sequence[str], bad: Sequence[str]) -> Column:
    """1, 0 or null (none or a tie) by counts of marker words."""
    low = F.lower(text)
    plus, minus = (sum((occurrences(low, w) for w in words), F.lit(0)) for words in (good, bad))
    return F.when(plus > minus, 1).when(plus < minus, 0)


def reward(credited: Column, result: Column) -> Column:
    """1 for a success that the capsule can be credited with, 0 for any other known outcome, null without one."""
    return F.when(result.isNotNull(), F.when((result == 1) & credited, 1.0).otherwise(0.0))


def contribution(scores: DataFrame) -> DataFrame:
    """Per capsule: judged pairs, their sum, those of 1 or more, those of 2, and the mean. scores: capsule, score; nulls count as 0."""
    s = F.coalesce("score", F.lit(0))
    rows = scores.groupBy("capsule").agg(F.count(F.lit(1)).alias("pairs"), F.sum(s).cast("bigint").alias("total"), F.count_if(s >= 1).alias("useful"), F.count_if(s == 2).alias("direct"))
    return rows.withColumn("mean", F.round(F.col("total") / F.col("pairs"), 6))


def posteriors(rewards: DataFrame, seen: DataFrame | None = None) -> DataFrame:
    """Beta posterior of each (capsule, scenario); each token counts once, also across runs; null rewards abstain."""
    rows = rewards.dropDuplicates(["token", "capsule", "scenario"])
    if seen is not None:
        rows = rows.join(seen.select("token", "capsule", "scenario"), ["token", "capsule", "scenario"], "left_anti")
    r = F.least(F.greatest("reward", F.lit(0.0)), F.lit(1.0))
    out = rows.groupBy("capsule", "scenario").agg(F.count("reward").alias("n"), F.coalesce(F.sum(r), F.lit(0.0)).alias("reward_sum"), F.count(F.lit(1)).alias("exposures"))
    return out.withColumn("mean", F.round((1 + F.col("reward_sum")) / (2 + F.col("n")), 6))


def watch(before: DataFrame, now: DataFrame) -> DataFrame:
    """Counts of two snapshots side by side: recovered, lost, changed or same."""
    rows = before.select("name", F.col("n").alias("n0")).join(now.select("name", F.col("n").alias("n1")), "name", "full").withColumns({"n0": F.coalesce("n0", F.lit(0)), "n1": F.coalesce("n1", F.lit(0))})
    return rows.withColumns({"delta": F.col("n1") - F.col("n0"), "state": F.when((F.col("n0") == 0) & (F.col("n1") > 0), "recovered").when((F.col("n0") > 0) & (F.col("n1") == 0), "lost").when(F.col("n0") != F.col("n1"), "changed").otherwise("same")})


def metric_diff(base: DataFrame, current: DataFrame) -> DataFrame:
    """Metrics (metric, value) against a baseline with an arrow."""
    rows = base.select("metric", F.col("value").alias("base")).join(current.select("metric", F.col("value").alias("current")), "metric", "full")
    return rows.withColumn("direction", F.when(F.col("base").isNull() | F.col("current").isNull(), "?").when(F.col("current") > F.col("base"), "up").when(F.col("current") < F.col("base"), "down").otherwise("="))


def kpi(value: Column, good: tuple[float, float], warn: tuple[float, float]) -> Column:
    return F.when(value.between(*good), "OK").when(value.between(*warn), "WARN").otherwise("BAD")


def observation_rollup(observations: DataFrame) -> DataFrame:
    """One row a session and project: start, observations, types, named files and the joined text by id. Nulls are left out of the lists."""
    listed = F.array_sort(F.collect_list(F.struct("id", F.coalesce("narrative", F.lit("")).alias("text"))))
    rows = observations.groupBy("memory_session_id", "project").agg(
        F.min("created_at_epoch").alias("start"), F.count(F.lit(1)).alias("n"), F.array_join(F.array_sort(F.collect_set("type")), ",").alias("types"),
        F.array_join(F.array_sort(F.collect_set("files_modified")), " ").alias("files"), listed.alias("texts"),
    )
    return rows.withColumn("text", F.array_join(F.transform("texts", lambda x: x["text"]), "\n")).drop("texts")


def session_rollup(turns: DataFrame) -> DataFrame:
    """One row a conversation: turns, characters, joined text in the order of turns."""
    return turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("turns"), F.sum(F.char_length(F.coalesce("text", F.lit("")))).alias("chars"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", F.coalesce("text", F.lit("")).alias("text")))), lambda x: x["text"]), "\n").alias("text"))
