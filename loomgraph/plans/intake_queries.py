"""Queries of the intake of usage reports, of replayed deliveries, of payloads and of kinds, with their checking SQL."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph import config
from loomgraph.config import GateConfig
from loomgraph.functions.columns import declared
from loomgraph.operators import classify, evaluate, gate, graph, hooks, intake, lifecycle, ranking, state, windows
from loomgraph.plans import episode_queries as ep
from loomgraph.plans.gate_queries import observed
from loomgraph.sources.fixtures import view, with_views
from loomgraph.tables import scratch

NOW = "timestamp '2024-03-01 00:00:00'"
#: Noise of the replay: bug fixes with these syllables stand for those about the system's own running.
NOISE = replace(GateConfig(), noise_enabled=True, noise_markers=("the", "la"), noise_keywords=("th", "en", "er"))


def stored(s: SparkSession, d: str) -> DataFrame:
    return view(s, d, "f_feedback").withColumn("replacement", F.lit(None).cast("string"))


def feedback_fold(s: SparkSession, d: str) -> DataFrame:
    return intake.folded(stored(s, d), view(s, d, "f_reports"), view(s, d, "f_episodes"), config.CANONICAL_PREFIX)


def replayed(s: SparkSession, d: str) -> DataFrame:
    """Deliveries replayed over all typed episodes as twenty queries: what the tiers keep and what they break."""
    text = F.col("content")
    items = view(s, d, "f_episodes").withColumns({"type": F.coalesce(declared("source_description", "type"), F.lit("?")), "title": F.lit(""), "narrative": text, "facts": F.lit("")})
    items = items.select((F.col("n") % 20).alias("query_id"), F.col("uuid").alias("name"), ((F.col("n") * 37 % 1000) / 100.0).alias("score"), "type", gate.is_noise(NOISE).alias("noise"))
    return ranking.delivery_invariants(items, 5)


def freshness(s: SparkSession, d: str) -> DataFrame:
    sourced = view(s, d, "f_sourced")
    held = state.quarantine(sourced, classify.has_source(), sourced.limit(0).select("name"), config.CAPSULE_PREFIX)
    return intake.freshness(view(s, d, "f_episodes").withColumn("created_at", F.timestamp_seconds(F.lit(1704067200) + F.col("n") * 60)), held, F.expr(NOW), config.CAPSULE_PREFIX)


def payloads(s: SparkSession, d: str) -> DataFrame:
    rows = observed(s, d).withColumns({"subtitle": F.when(F.col("id") % 2 == 0, F.concat(F.lit("about "), "type")), "files_read": F.when(F.col("id") % 3 == 1, '["r1.py","r2.py"]').when(F.col("id") % 3 == 2, "[]")})
    return rows.select("id", classify.payload("obs").alias("p")).select("id", "p.*")


def kind_accuracy(s: SparkSession, d: str) -> DataFrame:
    sourced = view(s, d, "f_sourced")
    gold = sourced.select("uuid", F.coalesce("override", F.lit("项目事实")).alias("gold"))
    return evaluate.accuracy(evaluate.confusion(gold, sourced.select("uuid", classify.kind()["kind"].alias("got"))))


def tool_lights(s: SparkSession, d: str) -> DataFrame:
    """Every source of the hook log by its last success at the time of the log's last event."""
    e = view(s, d, "f_hook_events")
    last = e.groupBy("kw").agg(F.max(F.when(F.col("kind") == "ok", F.col("ts"))).alias("ok")).crossJoin(e.agg(F.max("ts").alias("now")))  # one row
    return last.select("kw", windows.tool_light(F.unix_timestamp(F.col("now").cast("timestamp")) - F.unix_timestamp(F.col("ok").cast("timestamp"))).alias("light"))


def knowledge_stats(s: SparkSession, d: str) -> DataFrame:
    episodes = view(s, d, "f_episodes").withColumn("name", F.when(F.col("n") % 3 == 0, F.concat("name", F.lit("--obs-"), F.col("n").cast("string"))).otherwise(F.col("name")))
    return graph.knowledge_stats(view(s, d, "f_fact_texts"), episodes, s.read.parquet(f"{d}/documents.parquet"), view(s, d, "f_ingest_keys"))


def by_words(prompts: list[str]) -> list[str]:
    """A hook without a model: a tag by words of the text, or an answer that is none."""
    return ["public-story" if " the " in p else "professional-guide" if " de " in p else "unsure" for p in prompts]


def suggested_tags(s: SparkSession, d: str) -> DataFrame:
    """Tags of all untagged episodes by a hook that is asked in two runs: the second asks for what the first hasn't seen."""
    waiting = view(s, d, "f_episodes").where("visibility is null").select("uuid", "archived", hooks.tag_prompt(F.col("content")).alias("prompt"))
    ledger = hooks.AnswerLedger(s, scratch(s, "answers"), by_words)
    ledger.ask(waiting.where("not archived"))
    return ledger.ask(waiting).select("uuid", "status", hooks.suggested_tag(F.col("answer")).alias("tag"))


QUERIES = {
    "suggested_tags": suggested_tags,
    "feedback_episodes": lambda s, d: lifecycle.waiting_with_episodes(view(s, d, "f_feedback"), view(s, d, "f_episodes")),
    "tool_lights": tool_lights,
    "knowledge_stats": knowledge_stats,
    "feedback_fold": feedback_fold,
    "feedback_refusals": lambda s, d: intake.checked(view(s, d, "f_reports"), view(s, d, "f_episodes")).groupBy("verdict", "refusal").agg(F.count(F.lit(1)).alias("n")),
    "delivery_invariants": replayed,
    "intake_freshness": freshness,
    "observation_payloads": payloads,
    "kind_accuracy": kind_accuracy,
}

_CHECKED = with_views("f_reports", "f_episodes", "f_feedback") + """,
 fl as (select name, bool_or(coalesce(verified, false)) as verified from f_episodes group by 1),
 ck as (select r.report_id, r.episode_name, r.verdict, r.query, r.replacement, fl.verified, case when verdict not in ('stale','conflict','supplement','inaccurate','irrelevant','missed') then 'bad request' when fl.name is null then 'unknown episode' when verdict in ('irrelevant','missed') and query = '' then 'no query' end as refusal
  from f_reports r left join fl on fl.name = r.episode_name)"""
_KIND = "case when name like 'canonical-%' then '手册' else case lower(nullif(regexp_extract(source_description, 'type=(\\S+)', 1), '')) when 'decision' then '决策' when 'bugfix' then '事故' when 'feature' then '项目事实' when 'discovery' then '项目事实' else 'unclassified' end end"
_HAS = "n % 6 in (0, 1, 3)"
_TEXT = "lower(' ' || content || ' ')"
_NOISY = f"(type = 'bugfix' and (contains({_TEXT}, 'the') or contains({_TEXT}, 'la')) and contains({_TEXT}, 'th')::int + contains({_TEXT}, 'en')::int + contains({_TEXT}, 'er')::int >= 2)"
ORACLES = {
    "suggested_tags": with_views("f_episodes") + """, p as (select uuid, substring(replace(trim(substring(coalesce(content, ''), 1, 300), chr(32) || chr(9) || chr(13) || chr(10)), chr(10), ' '), 1, 200) as prompt from f_episodes where visibility is null)
select uuid, case when prompt = '' then 'empty' else 'ok' end as status, case when prompt = '' then null when contains(prompt, ' the ') then 'public-story' when contains(prompt, ' de ') then 'professional-guide' else 'internal-note' end as tag from p""",
    "feedback_episodes": with_views("f_feedback", "f_episodes") + " select f.id, f.episode_name as name, f.verdict, e.uuid, substring(e.content, 1, 4000) as detail from f_feedback f left join f_episodes e on e.name = f.episode_name where f.status = 'pending' order by coalesce(f.updated_at, f.created_at) desc, f.id, e.uuid limit 30",
    "tool_lights": with_views("f_hook_events") + ", l as (select kw, max(ts) filter (kind = 'ok') as ok from f_hook_events group by 1) select kw, case when ok is null then 'grey' when floor(epoch((select max(ts) from f_hook_events))) - floor(epoch(ok)) < 14400 then 'green' else 'amber' end as light from l",
    "knowledge_stats": with_views("f_fact_texts", "f_ingest_keys") + """, q as (select count(*) as total, count(*) filter (contains(fact, ' belongs to the ') or contains(fact, ' references the ')) as metadata_like from f_fact_texts)
select total, metadata_like, round(100.0 * metadata_like / greatest(total, 1), 1)::double as percent, (select count(*) filter (doc_id % 3 = 0) from documents) as children, (select count(*) from documents) as registered,
 (select count(*) from f_ingest_keys where status = 'ok') as keys_ok, (select count(*) from f_ingest_keys where status = 'pending') as keys_pending, (select count(*) from f_ingest_keys where status = 'error') as keys_error from q""",
    # The first report after a closing begins a row; one that isn't a replacement closes if an odd number came since.
    "feedback_fold": _CHECKED + """,
 lv as (select distinct name from f_episodes where not coalesce(archived, false)),
 t as (select episode_name, verdict, case when verdict in ('irrelevant','missed') then query else '' end as query, report_id, replacement, lv.name is not null as live,
   verdict in ('stale','inaccurate') and episode_name not like 'canonical-%' and not verified as retire from ck left join lv on lv.name = replacement where refusal is null),
 fb as (select *, case when verdict in ('irrelevant','missed') then coalesce(query, '') else '' end as q from f_feedback),
 op as (select episode_name, verdict, q as query, min(id) as id, arg_min(report_count, id) as rc from fb where status = case when verdict in ('irrelevant','missed') then 'diagnostic' else 'pending' end group by 1, 2, 3),
 a as (select t.*, op.id as open_id, op.rc as rc, sum((not live)::int) over w as n from t left join op using (episode_name, verdict, query) window w as (partition by episode_name, verdict, query order by report_id)),
 b as (select *, max(case when live then n end) over (partition by episode_name, verdict, query order by report_id) as at_live from a),
 c as (select *, case when retire then live or (n - coalesce(at_live, 0) + (at_live is null and open_id is not null)::int) % 2 = 0 else verdict = 'supplement' and live end as closes from b),
 g as (select *, coalesce(sum(closes::int) over (partition by episode_name, verdict, query order by report_id rows between unbounded preceding and 1 preceding), 0) as round from c),
 m as (select episode_name, verdict, query, round, count(*) as reports, min(report_id) as first, arg_max(replacement, report_id) filter (live) as replacement, bool_or(closes) as closed, bool_or(retire) as retire, case when round = 0 then any_value(open_id) end as open_id, case when round = 0 then coalesce(any_value(rc), 0) else 0 end as rc from g group by 1, 2, 3, 4)
select coalesce(open_id::varchar, substring(sha256(concat_ws('|', episode_name, verdict, query, first::varchar)), 1, 12)) as id, episode_name, verdict, query,
 case when verdict in ('irrelevant','missed') then 'diagnostic' when closed then 'auto_handled' else 'pending' end as status, reports + rc as report_count, replacement, case when closed then case when retire then 'auto_retire' else 'auto_noted' end end as handled_action from m
union all select id::varchar, episode_name, verdict, coalesce(query, ''), status, report_count, null, handled_action from f_feedback where id not in (select open_id from m where open_id is not null)""",
    "feedback_refusals": _CHECKED + " select verdict, refusal, count(*) as n from ck group by 1, 2",
    "delivery_invariants": ep._TIERS.replace(" / 100.0 as score, coalesce(", f" / 100.0 as score, {_NOISY.replace('type =', ep._TYPE + ' =')} as noise, coalesce(").replace(f"round(score * {ep._WEIGHT}, 6)", f"round(score * case when noise then 0.2 else {ep._WEIGHT} end, 6)")
    + """, c as (select query_id, count(*) filter (plain <= 5 and type in ('decision','security_note','security_alert')) as before, count(*) filter (kept and type in ('decision','security_note','security_alert')) as after, count(*) filter (kept) as picked, count(*) filter (kept and type in ('bugfix','change','feature','refactor')) as operational, count(*) filter (type in ('bugfix','change','feature','refactor')) as candidates from k group by 1)
select count(*) as queries, count(*) filter (after > before) as knowledge_rose, count(*) filter (after >= before) as knowledge_preserved, count(*) filter (candidates > 0 and after < picked and operational < 1) as floor_violations from c""",
    "intake_freshness": with_views("f_episodes", "f_sourced") + f" select (select round((epoch({NOW}) - (1704067200 + max(n) * 60)) / 3600, 1) from f_episodes where name like 'capsule-%')::double as capsule_age_hours, (select count(*) from f_sourced where name like 'capsule-%' and not {_HAS}) as quarantined",
    "observation_payloads": with_views("f_observations", "f_sessions") + """, o as (select f_observations.*, coalesce(nullif(platform_source, ''), '_default') as platform from f_observations left join f_sessions using (memory_session_id))
select id, 'obs-' || id as name, 'obs id=' || id || ' project=' || coalesce(project, '?') || ' type=' || coalesce(type, '?') || ' platform=' || platform as source_description, 'obs-id-' || id as source_obs_id,
 '[' || upper(type) || '] ' || coalesce(nullif(title, ''), '(untitled)') || chr(10) || case when id % 2 = 0 then 'about ' || type || chr(10) else '' end
 || case when coalesce(narrative, '') <> '' then chr(10) || 'Narrative:' || chr(10) || narrative || chr(10) else '' end || case id % 4 when 1 then chr(10) || 'Key facts:' || chr(10) || '- a' || chr(10) when 2 then chr(10) || 'Key facts:' || chr(10) || '- a' || chr(10) || '- b' || chr(10) else '' end
 || case id % 3 when 1 then chr(10) || 'Concepts: c1' when 2 then chr(10) || 'Concepts: c1, c2' else '' end || case id % 3 when 1 then chr(10) || 'Files modified: f1.py' when 2 then chr(10) || 'Files modified: f1.py, f2.md' else '' end
 || case id % 3 when 1 then chr(10) || 'Files read: r1.py, r2.py' else '' end || chr(10) || 'Project: ' || coalesce(project, '?') as episode_body from o""",
    "kind_accuracy": with_views("f_sourced") + f", k as (select coalesce(override, '项目事实') = {_KIND} as hit from f_sourced) select count(*) as n, count(*) filter (hit) as correct, round(count(*) filter (hit) / greatest(count(*), 1), 6)::double as accuracy from k",
}
