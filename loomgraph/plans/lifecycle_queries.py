"""Queries of logs on disk, decision records, lanes, feedback, requeue, backfill and reports with their checking SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph import config
from loomgraph.config import GateConfig
from loomgraph.functions.columns import SPACES, excerpt, path_keywords
from loomgraph.operators import classify, gate, lifecycle, ranking
from loomgraph.plans.episode_queries import deliveries
from loomgraph.plans.gate_queries import _DECIDED, _OPEN, _gate_sql, observed
from loomgraph.sources import readers
from loomgraph.sources.fixtures import view, with_views
from loomgraph.tables import current_state, replace_state, scratch

NOW = "timestamp'2024-01-20 12:00:00'"
_NOW = "timestamp '2024-01-20 12:00:00'"


def feedback(s: SparkSession, d: str) -> DataFrame:
    return view(s, d, "f_feedback")


def jsonl_scan(s: SparkSession, d: str) -> DataFrame:
    """A decision log on disk with blank and broken lines among its own, read back."""
    path = scratch(s, "log")
    o = view(s, d, "f_observations").select("id", F.to_json(F.struct(F.col("id").alias("obs_id"), F.col("type").alias("obs_type"), F.lit("score").alias("layer"), (F.col("relevance_count") / 2).alias("score"))).alias("value"))
    broken = o.where("id % 3 = 0").select(F.when(F.col("id") % 2 == 0, "").otherwise("{broken").alias("value"))
    o.select("value").unionByName(broken).write.text(path)
    return readers.decision_log(s, path).select("obs_id", "obs_type", "layer", "score")


def hook_scan(s: SparkSession, d: str) -> DataFrame:
    """A hook log on disk: events as lines with noise lines among them, read back."""
    path = scratch(s, "log")
    e = view(s, d, "f_hook_events")
    stamp = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    body = F.when(F.col("kind") == "start", F.concat(F.lit("START fmt="), F.col("fmt"))).when(F.col("kind") == "ok", F.concat(F.lit("OK fmt=claude kw="), F.col("kw"), F.lit(" picked=2 names=[canonical-"), F.col("pos").cast("string"), F.lit(", obs-1] inj_chars=9 elapsed=0.25s"))).when(F.col("kind") == "no_match", F.concat(F.lit("no match kw="), F.col("kw"))).when(F.col("kind") == "usage", "bumped usage of 2").otherwise("failed: timeout")
    e.select(F.concat(stamp, F.lit("  "), body).alias("value")).unionByName(e.where("pos % 9 = 0").select(F.lit("noise without a time").alias("value"))).write.text(path)
    return readers.hook_log(s, path)


def delivery_scan(s: SparkSession, d: str) -> DataFrame:
    """A delivery log on disk, read back: deliveries and picks by endpoint and tiering."""
    path = scratch(s, "log")
    deliveries(s, d).withColumn("ts", F.lit("2024-01-01T00:00:00Z")).write.json(path)
    return readers.delivery_log(s, path).groupBy("endpoint", "tiering").agg(F.count(F.lit(1)).alias("n"), F.sum(F.size("picked")).alias("picks"))


def injections(s: SparkSession, d: str) -> DataFrame:
    return readers.injections(hook_scan(s, d), "canonical-").groupBy("kw").agg(F.count(F.lit(1)).alias("n"), F.min(F.element_at("names", 1)).alias("first"), F.max(F.size("names")).alias("most_names"))


def json_sets(s: SparkSession, d: str) -> DataFrame:
    """The golden set written as one JSON document and read back."""
    path = scratch(s, "golden")
    g = view(s, d, "f_golden")
    g.agg(F.to_json(F.struct(F.array_sort(F.collect_list(F.struct("id", "mode", "gold_kw"))).alias("queries"))).alias("value")).coalesce(1).write.text(path)  # a short list
    return readers.json_fixture(s, path, "id bigint, mode string, gold_kw string", "queries")


def state_versions(s: SparkSession, d: str) -> DataFrame:
    """A state replaced twice, the second time from what was current; then read."""
    root, schema = scratch(s, "state"), "id bigint, status string"
    o = view(s, d, "f_observations").select(F.col("id"), F.lit("pending").alias("status"))
    replace_state(o, root)
    replace_state(current_state(s, root, schema).withColumn("status", F.when(F.col("id") % 3 == 0, "ok").otherwise(F.col("status"))), root)
    return current_state(s, root, schema)


def backup_rotation(s: SparkSession, d: str) -> DataFrame:
    """Ingest requests appended to a dated JSON log twice, then rotated by age."""
    path = scratch(s, "backup")
    e = s.read.parquet(f"{d}/events.parquet").select("event_id", "ts", "event_type", F.to_date("ts").cast("string").alias("day"))
    readers.append_json(e.where("event_type <> 'view'"), path, "day")
    readers.append_json(e.where("event_type = 'view'"), path, "day")
    log = s.read.schema("event_id bigint, ts timestamp, event_type string, day string").json(path)
    return readers.retained(log, F.expr(NOW), 7).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.min("event_id").alias("first"))


def categories(s: SparkSession, d: str) -> DataFrame:
    files = s.read.parquet(f"{d}/pages.parquet").select(F.col("url").alias("path"))
    return readers.categorised(files, [(r"\d{3}", "numbered"), (r"a", "with_a"), (r"\.html$", "html")]).groupBy("category").agg(F.count(F.lit(1)).alias("n"))


def registry(s: SparkSession, d: str) -> DataFrame:
    files = s.read.parquet(f"{d}/documents.parquet").select(F.concat(F.lit("docs/"), F.col("doc_id").cast("string"), F.lit(".md")).alias("path"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("sha"), "doc_id")
    stored = files.select("path", F.when(F.col("doc_id") % 4 == 0, "old").otherwise(F.col("sha")).alias("sha"))
    return readers.registry_changes(files, stored).select("path", readers.slug(F.col("path")).alias("slug"))


CFG = GateConfig(quotas={}, default_quota=3)


def records(s: SparkSession, d: str) -> DataFrame:
    cfg = GateConfig()
    return gate.decide(observed(s, d), cfg, quota=3).select("id", "layer", "accept", F.array_join(gate.reasons(cfg), "; ").alias("reasons"), *(gate.breakdown(cfg)[k].alias(f"part_{k}") for k in ("type", "narrative", "facts", "concepts", "files", "relevance")))


def daily_quota(s: SparkSession, d: str) -> DataFrame:
    """Quotas by local day: what they reject is deferred, not rejected."""
    day = F.to_date(F.from_utc_timestamp(F.timestamp_millis("created_at_epoch"), "+08:00"))
    rows = observed(s, d).withColumn("project", F.lit("p"))
    return lifecycle.settled(gate.decide(rows, GateConfig(), quota=1, day=day)).select("id", "layer", "status", "terminal")


def lanes(s: SparkSession, d: str) -> DataFrame:
    o = view(s, d, "f_observations")
    return lifecycle.due(o.select("id"), o.where("id % 3 <> 0").select("id"), 120, 150)


def dry_run(s: SparkSession, d: str) -> DataFrame:
    """Observations already taken in, decided again without quotas: what would be rejected, with what hangs on it in the graph."""
    from loomgraph.operators import graph
    from loomgraph.plans.graph_queries import mentions

    rejects = gate.decide(observed(s, d), quota=0).where("not would_accept").select("id", "score", "layer", F.concat(F.lit("obs-"), F.col("id").cast("string")).alias("name"))
    return rejects.join(graph.impact(rejects, view(s, d, "f_episodes"), mentions(s, d)), "name").select("id", "score", "layer", "exists", "mentions")


def held_capsules(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Requests, quarantine and keys: every order is a capsule; keys of other orders than every fifth exist."""
    k = view(s, d, "f_ingest_keys").select("source_obs_id", "status", "n")
    keys = k.where("n % 5 <> 0").select(F.lit("capsules").alias("source_description"), "source_obs_id", "status")
    requests = k.where("n % 2 = 0").select("source_obs_id", F.when(F.col("n") % 14 == 0, None).when(F.col("n") % 22 == 0, "rumour").otherwise("firsthand").alias("provenance"))
    return requests, k.where("n % 6 <> 0").select("source_obs_id"), keys


def requeued(s: SparkSession, d: str) -> DataFrame:
    return lifecycle.requeue(*held_capsules(s, d), "capsules")


def left_in_quarantine(s: SparkSession, d: str) -> DataFrame:
    gone = requeued(s, d).where("leaves").select("source_obs_id")
    return held_capsules(s, d)[1].join(gone, "source_obs_id", "left_anti")


def routing(s: SparkSession, d: str) -> DataFrame:
    line = s.read.parquet(f"{d}/lineitem.parquet").select(F.lit("capsules").alias("source_description"), F.col("l_orderkey").cast("string").alias("source_obs_id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("request_id"), F.col("l_orderkey").alias("n"))
    return lifecycle.routed(line, held_capsules(s, d)[2], ["source_description", "source_obs_id"], F.col("n") % 9 == 0).groupBy("outcome").agg(F.count(F.lit(1)).alias("n"), F.min("request_id").alias("first"))


def decided_feedback(s: SparkSession, d: str) -> DataFrame:
    f = feedback(s, d).withColumn("episode_name", F.when(F.col("id") % 4 == 0, F.regexp_replace("episode_name", "capsule", "canonical")).otherwise(F.col("episode_name")))
    action = F.when(F.col("id") % 7 == 0, "verified").when(F.col("id") % 7 == 1, "retire").when(F.col("id") % 7 == 2, "dismiss").when(F.col("id") % 7 == 3, "undo").otherwise("burn")
    return lifecycle.resolve(f, f.where("id % 7 < 5").select("id", action.alias("action")), F.expr(NOW), "canonical-")


def feedback_effects(s: SparkSession, d: str) -> DataFrame:
    e = view(s, d, "f_episodes")
    return lifecycle.applied(e, decided_feedback(s, d)).groupBy("verified", "archived").agg(F.count(F.lit(1)).alias("n"), F.min("uuid").alias("first"))


def backfilled(s: SparkSession, d: str) -> DataFrame:
    e = view(s, d, "f_sourced").withColumnRenamed("old_kind", "kind").withColumn("predigested", F.when(F.col("n") % 8 == 0, True))
    results = e.select("name", F.when(F.col("n") % 4 == 0, -1).when(F.col("n") % 4 == 1, 2).otherwise(1).alias("made"), F.when(F.col("n") % 4 == 3, 0).otherwise(2).alias("planned"))
    return lifecycle.backfill(e, results.groupBy("name").agg(F.max("made").alias("made"), F.max("planned").alias("planned")), classify.route(), config.CAPSULE_PREFIX, "n", 60).select("uuid", "route", "state", "predigested", "predigest_empty", "kind")


def answers(s: SparkSession, d: str) -> DataFrame:
    """Answers of a model: prose, a fence, and a JSON list of three observations of which some are unfit."""
    o = view(s, d, "f_observations").select("id", "type", F.col("narrative").alias("body"), F.col("project"))
    item = lambda t, title, facts: F.struct(t.alias("type"), title.alias("title"), facts.alias("facts"), F.col("body").alias("narrative"), F.array("project", F.lit("b"), F.lit("c"), F.lit("d"), F.lit("e"), F.lit("f")).alias("concepts"))
    fact = F.concat(F.lit("fact "), F.col("id").cast("string"))
    none = F.array().cast("array<string>")
    listed = F.to_json(F.array(item(F.col("type"), F.concat(F.lit("title "), F.col("id").cast("string")), F.array(fact, F.lit(" "), F.lit("two"))), item(F.lit("rumour"), F.lit(""), F.array(fact)), item(F.lit("change"), F.repeat(F.lit("long "), 20), F.when(F.col("id") % 2 == 0, F.transform(F.sequence(F.lit(1), F.lit(9)), lambda i: i.cast("string"))).otherwise(none))))
    return o.select("id", F.when(F.col("id") % 5 == 0, "no list here [").otherwise(F.concat(F.lit("```json\nSure [ here: "), listed, F.lit(" [1]\n```"))).alias("answer"))


def parsed(s: SparkSession, d: str) -> DataFrame:
    types = GateConfig().types
    return readers.parsed_observations(answers(s, d), types).select("id", "place", "type", "title", F.array_join("facts", "/").alias("facts"), F.char_length("narrative").alias("narrative_chars"), F.array_join("concepts", "/").alias("concepts"))


def injected(s: SparkSession, d: str) -> DataFrame:
    """The canonical context of a keyword as one text of at most 1500 characters."""
    e = view(s, d, "f_episodes").withColumns({"scope": F.lit("global"), "start": excerpt(F.col("content"))})
    picks = ranking.canonical_context(e, "the", 3, carry=["start"])
    parts = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", F.concat(F.lit("### "), "name", F.lit("\n"), "start").alias("part")))), lambda p: p["part"]), "\n\n")
    text = picks.agg(parts.alias("text"))  # three rows
    return text.select(F.when(F.char_length("text") > 1500, F.concat(F.rtrim(F.substring("text", 1, 1450), F.lit(SPACES)), F.lit("\n\n[…]"))).otherwise(F.col("text")).alias("text"))


def keywords(s: SparkSession, d: str) -> DataFrame:
    o = view(s, d, "f_observations")
    path = F.concat(F.when(F.col("id") % 3 == 0, "/Users/").when(F.col("id") % 3 == 1, "/tmp/").otherwise(F.concat(F.lit("/w/workspace_"), F.col("project"), F.lit("/"))), F.when(F.col("id") % 4 == 0, "var/").when(F.col("id") % 4 == 1, F.coalesce("memory_session_id", F.lit("x"))).otherwise(F.concat(F.lit("repo-"), F.col("project"))))
    return o.select("id", F.array_join(path_keywords(path, config.SYSTEM_DIRS), ",").alias("keywords"))


QUERIES = {
    "jsonl_scan": jsonl_scan,
    "hook_log_scan": lambda s, d: hook_scan(s, d).select("ts", "kind", "fmt", "kw", "picked", F.array_join("names", ",").alias("names"), "elapsed"),
    "injection_scan": injections,
    "delivery_log_scan": delivery_scan,
    "json_fixture": json_sets,
    "state_versions": state_versions,
    "backup_rotation": backup_rotation,
    "document_categories": categories,
    "registry_changes": registry,
    "decision_records": records,
    "daily_quota": daily_quota,
    "due_lanes": lanes,
    "backfill_dry_run": dry_run,
    "requeue": requeued,
    "quarantine_left": left_in_quarantine,
    "ingest_routing": routing,
    "removed_keys": lambda s, d: view(s, d, "f_ingest_keys").where("status <> 'ok'").groupBy("source_description").agg(F.count(F.lit(1)).alias("n"), F.min("source_obs_id").alias("first")),
    "feedback_resolve": lambda s, d: decided_feedback(s, d).select("id", "status", "handled_action", "handled_at", "outcome", "restores"),
    "feedback_effects": feedback_effects,
    "feedback_digest": lambda s, d: lifecycle.digest(feedback(s, d), F.expr(NOW)),
    "inbox_feedback": lambda s, d: lifecycle.inbox_feedback(feedback(s, d), view(s, d, "f_episodes"), F.expr(NOW)),
    "unanswered_stories": lambda s, d: lifecycle.unanswered(view(s, d, "f_episodes"), view(s, d, "f_articles"), "n").select("uuid", "name", F.substring("content", 1, 160).alias("snippet")),
    "inbox_quarantine": lambda s, d: view(s, d, "f_ingest_keys").where("status = 'error'").orderBy(F.desc("created_at"), "source_obs_id").limit(20).select("source_obs_id", "created_at"),
    "recent_packs": lambda s, d: view(s, d, "f_episodes").where("visibility = 'internal-note'").orderBy(F.desc("n"), "uuid").limit(50).select("uuid", F.substring("content", 1, 160).alias("snippet")),
    "recent_articles": lambda s, d: view(s, d, "f_articles").where("linked_casepack <> ''").groupBy("linked_casepack").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("linked_casepack")).limit(50),
    "predigest_backfill": backfilled,
    "observation_parse": parsed,
    "observations_in_graph": lambda s, d: view(s, d, "f_observations").join(lifecycle.ids_of_names(view(s, d, "f_episodes"), "obs-"), "id", "left_semi").select("id", "type"),
    "observations_with_session": lambda s, d: view(s, d, "f_observations").join(view(s, d, "f_sessions"), "memory_session_id").groupBy("platform_source").agg(F.count(F.lit(1)).alias("n"), F.max("created_at_epoch").alias("newest")),
    "injection_text": injected,
    "path_keywords": keywords,
    "decision_report": lambda s, d: lifecycle.markdown(gate.decide(observed(s, d), quota=3).groupBy("layer").agg(F.count(F.lit(1)).alias("n"), F.count_if("would_accept").alias("accepted")), ["layer"]),
}

_O, _E, _F, _K = with_views("f_observations"), with_views("f_episodes"), with_views("f_feedback"), with_views("f_ingest_keys")
_SOURCED = with_views("f_sourced")
_NUM = "({0})::decimal(18,2)::varchar"
_HELD = ", k as (select source_obs_id, status, n from f_ingest_keys), q as (select source_obs_id from k where n % 6 <> 0), r as (select source_obs_id, n, status, case when n % 14 = 0 then null when n % 22 = 0 then 'rumour' else 'firsthand' end as provenance, n % 6 <> 0 as held, case when n % 5 <> 0 then status end as st from k where n % 2 = 0), x as (select source_obs_id, provenance, case when provenance = 'rumour' then 'bad_request' when not held then 'not_found' when provenance is null then 'discarded' when st = 'ok' then 'already' when st = 'pending' then 'conflict' else 'queued' end as outcome from r)"
_FB = _F + f""", f as (select * replace (case when id % 4 = 0 then replace(episode_name, 'capsule', 'canonical') else episode_name end as episode_name), case id % 7 when 0 then 'verified' when 1 then 'retire' when 2 then 'dismiss' when 3 then 'undo' when 4 then 'burn' end as action from f_feedback),
 o as (select *, case when action is null then null when action = 'burn' then 'bad_request' when case when action = 'undo' then status in ('auto_handled', 'handled') else status = 'pending' end then case when action = 'retire' and episode_name like 'canonical-%' then 'canonical' else 'done' end else 'not_found' end as outcome from f),
 z as (select id, episode_name, action, case when outcome = 'done' then case when action = 'undo' then 'pending' else 'handled' end else status end as status, case when outcome = 'done' then case when action <> 'undo' then action end else handled_action end as handled_action,
  case when outcome = 'done' then case when action <> 'undo' then {_NOW} end else handled_at end as handled_at, outcome, outcome = 'done' and action = 'undo' and handled_action in ('retire', 'auto_retire') as restores from o)"""
_AT = "coalesce(updated_at, created_at)"
_ROUTE = "l as (select *, regexp_split_to_array(content, '\\r\\n|[\\n\\x0B\\f\\r]') as ls from f_sourced), c as (select *, case when name like 'capsule-%' then case when regexp_matches(name, '" + config.CATALOG + "') or regexp_matches(coalesce(list_filter(ls, lambda x: ltrim(x)[1] = '#')[1], ''), '" + config.CATALOG + "') or (len(ls) >= 20 and 10 * len(list_filter(ls, lambda x: ltrim(x)[1] = '|' or regexp_matches(x, '^\\s*[-*•]\\s'))) > 6 * len(ls) and not regexp_matches(content, '" + config.CONCLUSION + "')) then 'catalog' when strlen(content) >= 1500 then 'split' end end as route from l)"
_EXCERPT = "case when length({0}) > 400 then rtrim(case when position(chr(10) in substring({0}, 1, 400)) > 0 and 400 - position(chr(10) in reverse(substring({0}, 1, 400))) > 240 then substring({0}, 1, (400 - position(chr(10) in reverse(substring({0}, 1, 400))))::int) else substring({0}, 1, 400) end) || chr(10) || '[…]' else {0} end".format("trim(content)")
_THIN = "nf + nm < 1 and length(coalesce(narrative, '')) < 300"
ORACLES = {
    "jsonl_scan": _O + " select id as obs_id, type as obs_type, 'score' as layer, (relevance_count / 2)::double as score from f_observations",
    "hook_log_scan": with_views("f_hook_events") + " select date_trunc('second', ts) as ts, kind, case kind when 'start' then fmt when 'ok' then 'claude' end as fmt, case when kind in ('ok', 'no_match') then kw end as kw, case when kind = 'ok' then 2 end as picked, case when kind = 'ok' then 'canonical-' || pos || ',obs-1' else '' end as names, case when kind = 'ok' then 0.25 end::double as elapsed from f_hook_events",
    "injection_scan": with_views("f_hook_events") + " select kw, count(*) as n, min('canonical-' || pos) as first, 1 as most_names from f_hook_events where kind = 'ok' group by 1",
    "delivery_log_scan": _E + ", p as (select n % 150 as id, count(*) as k from f_episodes group by 1) select case when id % 2 = 0 then 'context' else 'search' end as endpoint, id % 3 = 0 as tiering, count(*) as n, sum(k)::bigint as picks from p group by 1, 2",
    "json_fixture": with_views("f_golden") + " select id, mode, gold_kw from f_golden",
    "state_versions": _O + " select id, case when id % 3 = 0 then 'ok' else 'pending' end as status from f_observations",
    "backup_rotation": f"select event_type, count(*) as n, min(event_id) as first from events where ts >= {_NOW} - interval 7 day group by 1",
    "document_categories": "select case when regexp_matches(url, '\\d{3}') then 'numbered' when contains(url, 'a') then 'with_a' else 'html' end as category, count(*) as n from pages where regexp_matches(url, '\\d{3}|a|\\.html$') group by 1",
    "registry_changes": "select 'docs/' || doc_id || '.md' as path, 'docs-' || doc_id as slug from documents where doc_id % 4 = 0",
    "decision_records": _DECIDED + f"""select v.id, v.layer, v.would_accept as accept, concat_ws('; ',
 case when v.gate = 'type' then 'type ''' || v.type || ''' isn''t admitted' end,
 case when v.gate is distinct from 'type' and length(coalesce(v.narrative, '')) < 80 then 'narrative of ' || length(coalesce(v.narrative, '')) || ' characters, least 80' end,
 case when v.gate is distinct from 'type' and v.{_THIN.replace('nf + nm', 'nf + v.nm').replace('coalesce(narrative', 'coalesce(v.narrative')} and (length(coalesce(v.narrative, '')) >= 80 or v.type = 'security_alert') then 'facts and files: ' || (v.nf + v.nm) || ', least 1' end,
 case when v.gate = 'model' then 'model ' || lower(o.generated_by_model) || ' is refused' end,
 case when v.gate is null and v.type in ('decision', 'bugfix', 'security_alert', 'security_note') then 'type ' || v.type || ' needs no threshold' end,
 case when v.layer = 'quota' then 'quota used up' end,
 case when v.layer = 'score' then 'score ' || {_NUM.format('v.score')} || ' < ' || {_NUM.format('v.threshold')} when v.layer = 'pass' then 'score ' || {_NUM.format('v.score')} || ' >= ' || {_NUM.format('v.threshold')} end) as reasons,
 case v.type {' '.join(f"when '{k}' then {w}" for k, w in GateConfig().type_weight.items())} else 0 end::double as part_type, least(length(coalesce(v.narrative, '')), 800) / 20.0::double as part_narrative, least(v.nf, 10) * 3.0::double as part_facts, least(case when json_valid(coalesce(o.concepts, '')) then json_array_length(o.concepts) else 0 end, 8) * 2.0::double as part_concepts, v.nm::double as part_files, least(coalesce(o.relevance_count, 0), 20) * 5.0::double as part_relevance
 from v join f_observations o using (id)""",
    "daily_quota": _gate_sql(GateConfig(), 1).replace("select doc_id as id, source as project,", "select doc_id as id, 'p' as project,").replace("partition by platform, project, type, layer0 like '%?' order by id", "partition by platform, type, strftime(make_timestamp(created_at_epoch * 1000) + interval 8 hour, '%Y-%m-%d'), layer0 like '%?' order by id") + "select id, layer, case when would_accept then 'ingested' when layer = 'quota' then 'deferred' else 'rejected' end as status, would_accept or layer <> 'quota' as terminal from v",
    "due_lanes": _O + " (select id, 'live' as lane from f_observations where id % 3 = 0 and id > 150 order by id limit 200) union all (select id, 'backlog' from f_observations where id % 3 = 0 and id <= 120 order by id limit 15)",
    "backfill_dry_run": _OPEN + ", e as (" + _E + " select * from f_episodes), m as (select 'ep-' || o_orderkey as uuid, count(*) as n from orders group by 1), k as (select name, coalesce(sum(m.n), 0)::bigint as mentions from e left join m using (uuid) group by 1) select v.id, v.score, v.layer, k.name is not null as exists, coalesce(mentions, 0) as mentions from v left join k on k.name = 'obs-' || v.id where not would_accept",
    "requeue": _K + _HELD + " select source_obs_id, provenance, outcome, outcome in ('discarded', 'already', 'queued') as leaves from x",
    "quarantine_left": _K + _HELD + " select source_obs_id from q where source_obs_id not in (select source_obs_id from x where outcome in ('discarded', 'already', 'queued'))",
    "ingest_routing": _K + ", k as (select source_obs_id, status from f_ingest_keys where n % 5 <> 0), r as (select l_orderkey, l_orderkey * 10 + l_linenumber as request_id, status, min(l_orderkey * 10 + l_linenumber) over (partition by l_orderkey) as claimer from lineitem left join k on k.source_obs_id = l_orderkey::varchar) select case when l_orderkey % 9 = 0 then 'quarantined' when status = 'ok' then 'skipped' when status = 'pending' then 'in_progress' when status is not null then 'conflict' when request_id = claimer then 'created' else 'in_progress' end as outcome, count(*) as n, min(request_id) as first from r group by 1",
    "removed_keys": _K + " select source_description, count(*) as n, min(source_obs_id) as first from f_ingest_keys where status <> 'ok' group by 1",
    "feedback_resolve": _FB + " select id, status, handled_action, handled_at, outcome, restores from z",
    "feedback_effects": _FB + ", a as (select episode_name as name, bool_or(action = 'verified') as v, bool_or(action = 'retire') as r, bool_or(restores) as u from z where outcome = 'done' group by 1), e as (" + _E + " select * from f_episodes) select coalesce(e.verified, false) or coalesce(a.v, false) as verified, (coalesce(e.archived, false) and not coalesce(a.u, false)) or coalesce(a.r, false) as archived, count(*) as n, min(e.uuid) as first from e left join a using (name) group by 1, 2",
    "feedback_digest": _F + f" (select 'handled' as section, id, episode_name, verdict from f_feedback where status in ('auto_handled', 'handled') and handled_at >= {_NOW} - interval 24 hour order by handled_at desc, id limit 20) union all (select 'pending', id, episode_name, verdict from f_feedback where status = 'pending' order by {_AT}, id limit 10) union all (select 'diagnostic', id, episode_name, verdict from f_feedback where status = 'diagnostic' and {_AT} >= {_NOW} - interval 24 hour order by report_count desc, id limit 5)",
    "inbox_feedback": _F + ", e as (" + _E + f" select name, min_by(substring(content, 1, 4000), uuid) as detail from f_episodes group by 1), i as ((select 'pending' as section, id, episode_name as name, verdict from f_feedback where status = 'pending' order by {_AT} desc, id limit 30) union all (select 'auto', id, episode_name, verdict from f_feedback where status = 'auto_handled' and handled_at >= {_NOW} - interval 7 day order by handled_at desc, id limit 12) union all (select 'diagnostic', id, episode_name, verdict from f_feedback where status = 'diagnostic' and {_AT} >= {_NOW} - interval 7 day order by {_AT} desc, id limit 15)) select i.*, detail from i left join e using (name)",
    "unanswered_stories": with_views("f_episodes", "f_articles") + ", p as (select * from f_episodes where visibility = 'public-story' order by n desc, uuid limit 50) select uuid, name, substring(content, 1, 160) as snippet from p where name not in (select linked_casepack from f_articles where coalesce(linked_casepack, '') <> '')",
    "inbox_quarantine": _K + " select source_obs_id, created_at from f_ingest_keys where status = 'error' order by created_at desc, source_obs_id limit 20",
    "recent_packs": _E + " select uuid, substring(content, 1, 160) as snippet from f_episodes where visibility = 'internal-note' order by n desc, uuid limit 50",
    "recent_articles": with_views("f_articles") + " select linked_casepack, count(*) as n from f_articles where linked_casepack <> '' group by 1 order by 1 desc limit 50",
    "predigest_backfill": _SOURCED + ", " + _ROUTE + ", r as (select name, max(case when n % 4 = 0 then -1 when n % 4 = 1 then 2 else 1 end) as made, max(case when n % 4 = 3 then 0 else 2 end) as planned from f_sourced group by 1), t as (select * from c where name like 'capsule-%' and not archived and n % 8 <> 0 order by n desc, uuid limit 60), z as (select t.*, case when route = 'catalog' then 'catalog' when route is null then 'short' when made = -1 then 'failed' when planned = 0 then 'empty' when made = planned then 'complete' else 'partial' end as state from t join r using (name)) select uuid, route, state, case when state in ('catalog', 'short', 'empty', 'complete') then true end as predigested, case when state = 'empty' then true end as predigest_empty, case when state = 'catalog' and (old_kind is null or old_kind = 'unclassified') then 'registry' else old_kind end as kind from z",
    "observation_parse": _O + ", a as (select id, type, trim(narrative) as body, project from f_observations where id % 5 <> 0), x as (select id, 1 as place, case when type = 'note' then 'discovery' else type end as type, 'title ' || id as title, 'fact ' || id || '/two' as facts, body, project from a union all select id, 2, 'change', trim(substring(repeat('long ', 20), 1, 60)) || '', '1/2/3/4/5/6', body, project from a where id % 2 = 0) select id, place, type, case when place = 2 then substring(trim(repeat('long ', 20)), 1, 60) else title end as title, facts, least(length(body), 600)::int as narrative_chars, project || '/b/c/d/e' as concepts from x",
    "observations_in_graph": _O + ", e as (" + _E + " select distinct regexp_extract(name, '^obs-(\\d+)', 1) as i from f_episodes) select id, type from f_observations where id::varchar in (select i from e where i <> '')",
    "observations_with_session": with_views("f_observations", "f_sessions") + " select platform_source, count(*) as n, max(created_at_epoch) as newest from f_observations join f_sessions using (memory_session_id) group by 1",
    "injection_text": _E + f", c as (select uuid, name, content, usage_count as uc, round(ln(1 + ((length(lower(content)) - length(replace(lower(content), 'the', ''))) // 3)), 6) as score from f_episodes where name like 'canonical%' and not archived), r as (select *, row_number() over (order by score desc, uc, name, uuid) as rn from c), x as (select * replace (3 as rn) from r where rn >= 3 order by uc, rn limit 1), p as (select * from r where rn < 3 union all select * from x), t as (select string_agg('### ' || name || chr(10) || {_EXCERPT}, chr(10) || chr(10) order by rn) as text from p) select case when length(text) > 1500 then rtrim(substring(text, 1, 1450)) || chr(10) || chr(10) || '[…]' else text end as text from t",
    "path_keywords": _O + ", p as (select id, case id % 3 when 0 then 'Users' when 1 then 'tmp' else 'workspace_' || project end as up, case id % 4 when 0 then 'var' when 1 then coalesce(memory_session_id, 'x') else 'repo-' || project end as base from f_observations) select id, array_to_string(list_filter([base, up], lambda x: length(x) >= 5 and x not in (" + ", ".join(f"'{x}'" for x in config.SYSTEM_DIRS) + ")), ',') as keywords from p",
    "decision_report": _DECIDED + ", t as (select layer, count(*) as n, count(*) filter (would_accept) as accepted from v group by 1) select 0 as place, '| layer | n | accepted |' as line union all select 1, '|---|---|---|' union all select (1 + row_number() over (order by layer))::int, '| ' || layer || ' | ' || n || ' | ' || accepted || ' |' from t",
}
