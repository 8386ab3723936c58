"""Queries of state machines, logs, monitoring and evaluation with their checking SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph import config
from loomgraph.functions.columns import cpu_seconds, days_between, humanised, in_hours
from loomgraph.operators import classify, evaluate, retrieval, state, windows
from loomgraph.sources.fixtures import view, with_views

NOW = "timestamp'1998-08-02 12:00:00'"
EVENT_NOW = "timestamp'2024-01-31 00:00:00'"
KEY = ("source_description", "source_obs_id")


def keys(s: SparkSession, d: str) -> DataFrame:
    return view(s, d, "f_ingest_keys").withColumn("updated_at", F.when(F.col("n") % 4 == 0, F.expr(NOW) - F.expr("interval 20 minutes")))


def hooks(s: SparkSession, d: str) -> DataFrame:
    """Hook events with the tool carried forward over the log."""
    return windows.carried(view(s, d, "f_hook_events"), "fmt", "pos", "claude", "tool")


def snapshots(s: SparkSession, d: str) -> DataFrame:
    return view(s, d, "f_snapshots")


def last_snapshots(s: SparkSession, d: str) -> DataFrame:
    """The last snapshot of each host; red ones name two blockers."""
    rows = windows.latest(snapshots(s, d).select("host", "received_at", "pos", "overall"), "host", ["received_at", "pos"])
    blocker = lambda label, detail: F.struct(F.lit(label).alias("label"), F.lit(detail).alias("detail"))
    return rows.withColumn("blockers", F.when(F.col("overall") == "red", F.array(blocker("disk", "full"), blocker("net", "down"))).otherwise(F.array().cast("array<struct<label:string,detail:string>>")))


def claims(s: SparkSession, d: str) -> DataFrame:
    requests = s.read.parquet(f"{d}/lineitem.parquet").select(F.concat(F.lit("src-"), F.lit("1-URGENT")).alias("source_description"), F.col("l_orderkey").cast("string").alias("source_obs_id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("request_id"))
    return state.claim(requests, view(s, d, "f_ingest_keys"), KEY)


def feedback(s: SparkSession, d: str) -> DataFrame:
    e = view(s, d, "f_episodes")
    reports = e.where("n % 3 = 0").select("name", F.element_at(F.array(*map(F.lit, (*state.VERDICTS, "nonsense"))), (F.col("n") % 7 + 1).cast("int")).alias("verdict"), F.when(F.col("n") % 2 == 0, F.concat(F.lit("capsule-"), (F.col("n") + 1).cast("string"))).alias("replacement"))
    return state.feedback(reports.unionByName(reports.where("name like 'capsule-%6'")), e, "canonical-")


def upserted(s: SparkSession, d: str) -> DataFrame:
    table = view(s, d, "f_ingest_keys").where("n % 100 < 50").select(*KEY, "status", "created_at")
    changes = view(s, d, "f_ingest_keys").where("n % 100 >= 40").select(*KEY, F.lit("ok").alias("status"), F.expr(NOW).alias("created_at"))
    return state.upsert(table, changes, KEY, ["status"])


def aliases(s: SparkSession, d: str) -> DataFrame:
    files = s.read.parquet(f"{d}/documents.parquet").select(F.concat(F.lit("/f/"), F.col("doc_id").cast("string")).alias("path"), F.sha2("text", 256).alias("sha"), "doc_id")
    known = files.where("doc_id % 2 = 0").select("path", F.when(F.col("doc_id") % 10 == 0, "changed").otherwise(F.col("sha")).alias("sha"))
    return state.hash_alias(files.select("path", "sha"), known)


def metrics(s: SparkSession, d: str, where: str) -> DataFrame:
    c = s.read.parquet(f"{d}/events.parquet").where(where).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))
    return c.select(F.col("event_type").alias("metric"), F.col("n").alias("value"))


#: Facts a recall query gets back.
K = 10


def recall(s: SparkSession, d: str) -> DataFrame:
    """Recall of the golden queries by both batch searches: a query's vector is the embedding of its number."""
    g = view(s, d, "f_golden")
    facts = view(s, d, "f_search").select("edge_id", "fact", F.array_distinct(F.array("ep1", "ep2")).alias("backing"), "embedding")
    asked = [(r.id, r.gold_kw, r.embedding) for r in g.join(view(s, d, "f_search"), F.col("id") == F.col("edge_id")).select("id", "gold_kw", "embedding").orderBy("id").collect()]  # the golden set is a short list
    texts = [(i, t) for i, t, _ in asked]
    gold = evaluate.gold(view(s, d, "f_episodes"), texts, 60)
    backing = facts.select("fact", F.explode("backing").alias("uuid"))
    found = {
        "semantic": retrieval.batch_vector_top(facts, [(i, v) for i, _, v in asked], K),
        "substring": retrieval.batch_substring_top(facts, texts, K),
    }
    out = None
    for name, rows in found.items():
        recalled = rows.select("id", "fact").join(backing, "fact").select("id", "uuid")
        part = evaluate.recall_at_k(g.join(gold.select("id").distinct(), "id", "left").select("id", "mode"), gold, recalled).withColumn("search", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out


def keyword_recall(s: SparkSession, d: str) -> DataFrame:
    """Questions by keywords in the facts that a vector search gives back, and the gate over all of them (null id)."""
    facts = view(s, d, "f_search").select("edge_id", "fact", "embedding")
    b = s.read.parquet(f"{d}/benchmark.parquet").select(F.col("item_id").alias("edge_id")).join(facts, "edge_id")
    asked = [(r.edge_id, r.embedding, r.fact) for r in b.orderBy("edge_id").collect()]  # a short list of questions
    questions = s.createDataFrame([(i, f.split(" ")[:2], 2) for i, _, f in asked], "id long, keywords array<string>, threshold int")
    found = retrieval.batch_vector_top(facts, [(i, v) for i, v, _ in asked], K)
    results = found.groupBy("id").agg(F.array_join(F.array_sort(F.collect_list("fact")), "\n").alias("text"))  # K facts a question
    return evaluate.keyword_gate(evaluate.keyword_recall(questions, results), 0.7)


def talks(s: SparkSession, d: str) -> DataFrame:
    return s.read.parquet(f"{d}/conversations.parquet")


GOOD, BAD = ("the", "que"), ("of", "der")


def capsules(s: SparkSession, d: str) -> DataFrame:
    return s.read.parquet(f"{d}/documents.parquet").select(F.col("doc_id").alias("capsule"), F.col("text").alias("content"))


def sessions(s: SparkSession, d: str) -> DataFrame:
    """Documents as sessions: number and text."""
    return s.read.parquet(f"{d}/documents.parquet").select(F.col("doc_id").alias("session"), "text")


def usage(s: SparkSession, d: str) -> DataFrame:
    """Which capsule was injected into which session; a third of the injections match none."""
    e = s.read.parquet(f"{d}/events.parquet")
    return e.select((F.col("event_id") % 1200).alias("capsule"), F.when(F.col("event_id") % 3 != 0, (F.col("event_id") % 1200 + F.col("user_id") % 3) % 1100).alias("session"))


def coding_reward(s: SparkSession, d: str) -> DataFrame:
    """The reward of every matched pair of capsule and session."""
    pairs = usage(s, d).where("session is not null").distinct().join(capsules(s, d).select("capsule"), "capsule").join(sessions(s, d), "session")
    credited = evaluate.attributed(pairs, capsules(s, d), sessions(s, d)).withColumn("credited", F.lit(True))
    rows = pairs.join(credited, ["capsule", "session"], "left")
    result = evaluate.outcome(F.col("text"), GOOD, BAD)
    return rows.select("capsule", "session", result.alias("outcome"), evaluate.reward(F.coalesce("credited", F.lit(False)), result).alias("reward"))


def scenario_rows(s: SparkSession, d: str) -> DataFrame:
    """Every observation as a session with the files it names."""
    files = F.when(F.col("id") % 6 == 0, "src/a.py docs/b.md").when(F.col("id") % 6 == 1, "notes/b.md").when(F.col("id") % 6 == 2, "conf/app.yaml x.PNG").when(F.col("id") % 6 == 3, "Dockerfile").when(F.col("id") % 6 == 4, "x.bin")
    name, why = evaluate.scenario(files, F.array("type"), F.col("narrative"))
    return view(s, d, "f_observations").select("id", "project", name.alias("scenario"), why.alias("reason"))


def scenario_matrix(s: SparkSession, d: str) -> DataFrame:
    return scenario_rows(s, d).groupBy("project").pivot("scenario", list(config.SCENARIOS)).agg(F.count(F.lit(1))).na.fill(0)


def engagement(s: SparkSession, d: str) -> DataFrame:
    return evaluate.engagement(capsules(s, d), usage(s, d), sessions(s, d))


def rewards(s: SparkSession, d: str) -> DataFrame:
    return s.read.parquet(f"{d}/events.parquet").select((F.col("event_id") % 3000).alias("token"), (F.col("user_id") % 20).alias("capsule"), F.when(F.col("event_type") == "view", "coding").otherwise("ops").alias("scenario"), F.when(F.col("event_type") != "error", (F.col("user_id") % 3 - 0.5).cast("double")).alias("reward")).withColumn("reward", F.when(F.col("capsule") % 2 == 0, F.lit(None).cast("double")).otherwise((F.col("token") % 3).cast("double")))


def seen(s: SparkSession, d: str) -> DataFrame:
    return rewards(s, d).where("token < 500").select("token", "capsule", "scenario")


QUERIES = {
    "queue_stats": lambda s, d: state.queue_stats(keys(s, d), F.expr(NOW)),
    "stuck_cleanup": lambda s, d: state.without_stuck(keys(s, d), F.expr(NOW)).groupBy("status").agg(F.count(F.lit(1)).alias("n"), F.min("n").alias("first")),
    "idempotent_claim": lambda s, d: claims(s, d).select("source_obs_id", "request_id", "requests", "outcome"),
    "quarantine": lambda s, d: state.quarantine(view(s, d, "f_sourced"), classify.has_source(), view(s, d, "f_sourced").where("n % 7 = 3").select("name"), "capsule-").select("uuid", "content", "reason"),
    "feedback_rules": feedback,
    "upsert": upserted,
    "hash_alias": aliases,
    "archive_manifest": lambda s, d: state.archive(view(s, d, "f_episodes"), view(s, d, "f_episodes").where("n % 9 = 0").select("uuid")).groupBy("archived").agg(F.count(F.lit(1)).alias("n")),
    "restore_manifest": lambda s, d: state.restore(view(s, d, "f_episodes"), view(s, d, "f_episodes").where("n % 2 = 0").select("uuid")).groupBy("archived").agg(F.count(F.lit(1)).alias("n")),
    "keep_counters": lambda s, d: state.keep_counters(view(s, d, "f_episodes").select("uuid", F.lit(0).cast("bigint").alias("usage_count")), view(s, d, "f_episodes").where("n % 2 = 0"), "uuid", ["usage_count"]),
    "case_pack": lambda s, d: state.case_pack(view(s, d, "f_episodes").select((F.col("n") % 12).alias("pack"), "uuid", "name", "content")),
    "observation_children": lambda s, d: state.children(view(s, d, "f_episodes").select("name", F.split("content", "\n").alias("observations")), view(s, d, "f_episodes").select(F.concat("name", F.lit("--obs-02")).alias("name"))).select("child", "m"),
    "no_downgrade": lambda s, d: view(s, d, "f_sourced").select("uuid", classify.without_downgrade(F.col("old_kind"), F.lit("unclassified")).alias("kind")),
    "hook_health": lambda s, d: windows.hook_health(hooks(s, d), F.expr(EVENT_NOW)),
    "carry_forward": lambda s, d: hooks(s, d).select("pos", "tool"),
    "latest_snapshot": lambda s, d: windows.latest(snapshots(s, d).select("host", "received_at", "pos", "overall"), "host", ["received_at", "pos"]),
    "snapshot_alerts": lambda s, d: windows.snapshot_alerts(last_snapshots(s, d), F.expr(EVENT_NOW)),
    "error_samples": lambda s, d: state.error_samples(keys(s, d).withColumn("error_message", F.concat(F.lit("failed "), F.repeat(F.col("source_obs_id"), 60)))),
    "predigest_parents": lambda s, d: state.parents(view(s, d, "f_episodes").select("uuid", F.concat("uuid", F.lit("")).alias("name"), F.split("content", "\n").alias("observations")).drop("uuid"), view(s, d, "f_episodes").where("n % 3 = 0").select(F.concat("uuid", F.lit("--obs-01")).alias("name"))),
    "observation_rollup": lambda s, d: evaluate.observation_rollup(view(s, d, "f_observations")).select("memory_session_id", "project", "start", "n", "types", "files", F.char_length("text").alias("chars")),
    "edge_alerts": lambda s, d: windows.transitions(snapshots(s, d), F.col("overall") == "red", "host", ["received_at", "pos"]).select("host", "pos", "event"),
    "debounce": lambda s, d: windows.debounced(snapshots(s, d), F.col("overall") != "green", "host", ["received_at", "pos"], 3).select("host", "pos"),
    "hold_last": lambda s, d: windows.hold_last(snapshots(s, d), F.when(F.col("overall") != "grey", F.col("overall")), "host", ["received_at", "pos"], "green").select("host", "pos", "held"),
    "status_rollup": lambda s, d: snapshots(s, d).groupBy("host", F.to_date("received_at").cast("string").alias("day")).agg(windows.worst(F.col("overall")).alias("overall")),
    "state_propagation": lambda s, d: windows.propagated(windows.latest(snapshots(s, d).select("host", "received_at", "pos", "overall"), "host", ["received_at", "pos"]).select(F.col("host").alias("id"), F.col("overall").alias("light")), snapshots(s, d).select(F.col("host").alias("src"), F.concat(F.lit("host"), (F.col("user_id") % 7).cast("string")).alias("dst")).distinct()),
    "contiguous_cursor": lambda s, d: windows.contiguous_cursor(view(s, d, "f_ingest_keys").select(F.col("n").alias("id"), "status"), (F.col("status") != "pending") | (F.col("id") < 100)),
    "tool_contribution": lambda s, d: windows.tool_contribution(view(s, d, "f_episodes"), F.col("source_description"), [f"src{i}" for i in range(1, 12)]),
    "daily_increment": lambda s, d: windows.daily_increment(s.read.parquet(f"{d}/events.parquet").groupBy(F.col("event_type").alias("metric"), F.to_date("ts").cast("string").alias("day")).agg(F.count(F.lit(1)).alias("total"))),
    "probe_light": lambda s, d: view(s, d, "f_hook_events").select("pos", windows.probe_light(F.when(F.col("pos") % 13 != 0, F.col("pos") % 9000), F.col("pos") % 60).alias("light"), humanised(F.col("pos") * 17).alias("age")),
    "work_window": lambda s, d: view(s, d, "f_hook_events").groupBy(in_hours(F.col("ts"), 22, 5).alias("night"), in_hours(F.col("ts"), 1, 8).alias("morning")).agg(F.count(F.lit(1)).alias("n")),
    "recall_at_k": recall,
    "keyword_recall": keyword_recall,
    "kind_confusion": lambda s, d: evaluate.confusion(view(s, d, "f_sourced").select("uuid", F.coalesce("override", F.lit("项目事实")).alias("gold")), view(s, d, "f_sourced").select("uuid", classify.kind()["kind"].alias("got"))),
    "nearest_session": lambda s, d: evaluate.nearest_session(view(s, d, "f_injections"), view(s, d, "f_work_sessions"), 180, 3600),
    "engagement": engagement,
    "scenario": scenario_rows,
    "contribution": lambda s, d: evaluate.contribution(s.read.parquet(f"{d}/events.parquet").select((F.col("user_id") % 20).alias("capsule"), (F.col("event_id") % 3).cast("int").alias("score"))),
    "tool_usage": lambda s, d: hooks(s, d).where("kind = 'ok'").groupBy("tool").agg(F.count(F.lit(1)).alias("injections"), F.max("ts").alias("last_at")).orderBy(F.desc("injections"), "tool"),
    "runaway_processes": lambda s, d: view(s, d, "f_hook_events").select("pos", F.concat_ws(":", F.when(F.col("pos") % 5 == 0, (F.col("pos") % 3).cast("string")), (F.col("pos") % 7).cast("string"), (F.col("pos") % 60).cast("string")).alias("cpu")).where(cpu_seconds(F.col("cpu")) > 120),
    "scenario_matrix": scenario_matrix,
    "coding_reward": coding_reward,
    "session_rollup": lambda s, d: evaluate.session_rollup(talks(s, d)),
    "beta_scores": lambda s, d: evaluate.posteriors(rewards(s, d), seen(s, d)),
    "capsule_watch": lambda s, d: evaluate.watch(metrics(s, d, "user_id < 40 and event_type <> 'signup'").select(F.col("metric").alias("name"), F.col("value").alias("n")), metrics(s, d, "user_id >= 40 and event_type <> 'error'").select(F.col("metric").alias("name"), F.col("value").alias("n"))),
    "metric_diff": lambda s, d: evaluate.metric_diff(metrics(s, d, "user_id < 75"), metrics(s, d, "user_id >= 75")),
    "kpi_verdict": lambda s, d: metrics(s, d, "true").select("metric", "value", evaluate.kpi(F.col("value"), (100, 1500), (50, 3000)).alias("verdict")),
    "age_days": lambda s, d: s.read.parquet(f"{d}/orders.parquet").groupBy(days_between(F.expr(NOW), F.col("o_orderdate")).alias("age")).agg(F.count(F.lit(1)).alias("n")),
}
_K, _H, _SN, _EP, _SO = with_views("f_ingest_keys"), with_views("f_hook_events"), with_views("f_snapshots"), with_views("f_episodes"), with_views("f_sourced")
_NOW, _ENOW = "timestamp '1998-08-02 12:00:00'", "timestamp '2024-01-31 00:00:00'"
_KEYS = _K + f", k as (select *, case when n % 4 = 0 then {_NOW} - interval 20 minute end as updated_at from f_ingest_keys)"
_CARRY = _H + ", t as (select *, coalesce(last_value(fmt ignore nulls) over (order by pos rows between unbounded preceding and current row), 'claude') as tool from f_hook_events)"
_LAST = _SN + ", l as (select host, arg_max(overall, struct_pack(a := received_at, b := pos)) as overall, max(received_at) as received_at from f_snapshots group by host)"
_LASTROW = _SN + ", l as (select * exclude (rn) from (select host, received_at, pos, overall, row_number() over (partition by host order by received_at desc, pos desc) as rn from f_snapshots) where rn = 1)"
_HAS = "n % 6 in (0, 1, 3)"
_OCC = "((length(lower(text)) - length(replace(lower(text), '{0}', ''))) // length('{0}'))"
_TALK = "with c as (select conv_id, count(*) as turns, sum(length(coalesce(text, '')))::bigint as chars, string_agg(coalesce(text, ''), chr(10) order by turn, coalesce(text, '')) as text from conversations group by 1)"
_OUT = f"case when {_OCC.format('the')} + {_OCC.format('que')} > {_OCC.format('of')} + {_OCC.format('der')} then 1 when {_OCC.format('the')} + {_OCC.format('que')} < {_OCC.format('of')} + {_OCC.format('der')} then 0 end"
_WORDS = r"""list_distinct(list_transform(list_concat(list_concat(regexp_extract_all({T}, '`([^`\n]{3,40})`', 1), regexp_extract_all({T}, '\b([A-Za-z][A-Za-z0-9]*[_./-][A-Za-z0-9_./-]{2,})\b', 1)), regexp_extract_all({T}, '\b([A-Z][a-z]+(?:[A-Z][a-z0-9]+)+)\b', 1)), lambda x: trim(lower(x), ' .,:;`')))"""
_TERMS = "with t as (select doc_id as capsule, unnest(" + _WORDS.replace("{T}", "text") + ") as term from documents), l as (select * from t where length(term) >= 4), f as (select term, count(*) as df from l group by 1)" + """,
 m as (select event_id % 1200 as capsule, case when event_id % 3 <> 0 then (event_id % 1200 + user_id % 3) % 1100 end as session from events),
 u as (select distinct capsule, session from m where session is not null),
 a as (select u.capsule, u.session, 1 as used from u join documents d on d.doc_id = u.session join l using (capsule) join f using (term) where contains(lower(d.text), l.term) group by 1, 2 having count(*) filter (df = 1) >= 1 or count(*) >= 2)"""
_SIM = "round(list_dot_product(embedding::double[], qe::double[]) / (sqrt(list_dot_product(embedding::double[], embedding::double[])) * sqrt(list_dot_product(qe::double[], qe::double[]))), 6)"
_RECALL = f""", q as (select g.id, g.mode, g.gold_kw, s.embedding as qe from f_golden g join f_search s on s.edge_id = g.id),
 p as (select q.id, e.uuid, row_number() over (partition by q.id order by e.uuid) as place from q join f_episodes e on contains(lower(e.content), q.gold_kw)), gold as (select id, uuid from p where place <= 60),
 b as (select distinct fact, unnest([ep1, ep2]) as uuid from f_search),
 n as (select id, fact, row_number() over (partition by id order by {_SIM} desc, edge_id) as place from q cross join f_search),
 t as (select id, fact, row_number() over (partition by id order by fact) as place from q join (select distinct fact from f_search) on contains(lower(fact), gold_kw)),
 f as (select 'semantic' as search, id, fact from n where place <= 10 union all select 'substring', id, fact from t where place <= 10),
 r as (select search, id, count(distinct uuid) as hits from f join b using (fact) join gold using (id, uuid) group by 1, 2),
 z as (select k.search, g.id, g.mode, coalesce(r.hits, 0) as hits, (select count(*) from gold where gold.id = g.id) as gold from f_golden g cross join (values ('semantic'), ('substring')) k(search) left join r on r.id = g.id and r.search = k.search)
select search, mode, count(*) as queries, round(avg(case when gold > 0 then hits / gold else 0 end), 6)::double as recall, round(avg((hits > 0)::int), 6)::double as hit_rate from z group by grouping sets ((search, mode), (search))"""
_MARK = lambda words: "(" + " or ".join(f"contains(lower(narrative), '{w}')" for w in words) + ")"
_SCENARIO = with_views("f_observations") + f""", c as (select *, case when id % 6 = 0 then 1 else 0 end as code, case when id % 6 in (0, 1) then 1 else 0 end as doc, case when id % 6 in (2, 3) then 1 else 0 end as conf, {_MARK(config.OPS_MARKERS)} as ops, {_MARK(config.RESEARCH_MARKERS)} as res from f_observations),
 w as (select *, case when code > 0 then 'coding/code files' when type in ('feature', 'bugfix', 'refactor', 'change') and not (conf > 0 and ops) then 'coding/types of code changes' when conf > 0 then 'ops/config files' when ops and doc = 0 then 'ops/words of operation' when doc > 0 then 'writing/documents only' when type = 'decision' then 'planning/decisions without files' when res then 'research/words of research' when type = 'discovery' then 'research/discoveries without files' else 'unknown/no rule' end as rule from c),
 x as (select id, project, split_part(rule, '/', 1) as s, split_part(rule, '/', 2) as why from w)"""
ORACLES = {
    "queue_stats": _KEYS + f" select count(*) filter (status = 'pending') as pending, count(*) filter (status = 'ok') as ok, count(*) filter (status = 'error') as errors, min(epoch({_NOW})::bigint - epoch(created_at)::bigint) filter (status = 'pending') as newest_pending_s, max(epoch({_NOW})::bigint - epoch(created_at)::bigint) filter (status = 'pending') as oldest_pending_s, count(*) filter (status = 'ok' and coalesce(updated_at, created_at) > {_NOW} - interval 1 hour) as ok_last_hour, count(*) filter (status = 'error' and coalesce(updated_at, created_at) > {_NOW} - interval 1 hour) as errors_last_hour from k",
    "stuck_cleanup": _K + f" select status, count(*) as n, min(n) as first from f_ingest_keys where not ((status = 'pending' and created_at < {_NOW} - interval 30 minute) or (status = 'error' and created_at < {_NOW} - interval 24 hour)) group by 1",
    "idempotent_claim": _K + ", r as (select l_orderkey::varchar as source_obs_id, min(l_orderkey * 10 + l_linenumber) as request_id, count(*) as requests from lineitem group by 1) select r.*, case when status is null then 'created' when status = 'ok' then 'skipped' when status = 'pending' then 'in_progress' else 'conflict' end as outcome from r left join f_ingest_keys k on k.source_obs_id = r.source_obs_id and k.source_description = 'src-1-URGENT'",
    "quarantine": _SO + f" select uuid, case when length(content) > 20000 then substring(content, 1, 20000) || '[cut]' else content end as content, 'no source' as reason from f_sourced where name like 'capsule-%' and not {_HAS} and name not in (select name from f_sourced where n % 7 = 3)",
    "feedback_rules": _EP + ", p as (select name, ['stale','conflict','supplement','inaccurate','irrelevant','missed','nonsense'][(n % 7 + 1)::int] as verdict, case when n % 2 = 0 then 'capsule-' || (n + 1) end as replacement from f_episodes where n % 3 = 0), r as (select * from p union all select * from p where name like 'capsule-%6'), c as (select name, verdict, count(*) as report_count, max(replacement) as replacement from r where verdict <> 'nonsense' group by 1, 2), f as (select name, bool_or(coalesce(verified, false)) as verified from f_episodes group by 1) select c.name, verdict, report_count, case when verdict in ('irrelevant','missed') then 'diagnostic' when verdict in ('stale','inaccurate') and c.name not like 'canonical-%' and not f.verified and (replacement in (select name from f_episodes where not archived) or report_count >= 2) then 'auto_retire' when verdict = 'supplement' and replacement is not null then 'auto_noted' else 'pending' end as action from c join f using (name)",
    "upsert": _K + f" select source_description, source_obs_id, case when n % 100 >= 40 then 'ok' else status end as status, case when n % 100 >= 50 then {_NOW} else created_at end as created_at from f_ingest_keys",
    "hash_alias": "with f as (select '/f/' || doc_id as path, sha256(text) as sha, doc_id from documents), k as (select path, case when doc_id % 10 = 0 then 'changed' else sha end as sha from f where doc_id % 2 = 0), a as (select sha, min(path) as alias_of from k group by 1) select f.path, case when k.sha = f.sha then 'skip' when k.sha is not null then 'update' when a.alias_of is not null then 'alias' else 'new' end as action, case when k.sha is null then a.alias_of end as alias_of from f left join k using (path) left join a on a.sha = f.sha",
    "archive_manifest": _EP + " select archived or n % 9 = 0 as archived, count(*) as n from f_episodes group by 1",
    "restore_manifest": _EP + " select archived and n % 2 <> 0 as archived, count(*) as n from f_episodes group by 1",
    "keep_counters": _EP + " select uuid, case when n % 2 = 0 then usage_count else 0 end::bigint as usage_count from f_episodes",
    "case_pack": _EP + ", r as (select n % 12 as pack, uuid, name, content, row_number() over (partition by n % 12 order by uuid) as place from f_episodes) select pack, count(*) as n, substring(string_agg(name || chr(10) || substring(content, 1, 1600), chr(10) || chr(10) order by place), 1, 9000) as body from r where place <= 12 group by 1",
    "observation_children": _EP + ", o as (select name, string_split(content, chr(10)) as obs from f_episodes), x as (select name, len(obs) as m, unnest(range(1, len(obs) + 1)) as i from o) select name || '--obs-' || lpad(i::varchar, greatest(2, length(i::varchar))::int, '0') as child, m from x where i <> 2",
    "no_downgrade": _SO + " select uuid, coalesce(case when old_kind <> 'unclassified' then old_kind end, 'unclassified') as kind from f_sourced",
    "hook_health": _CARRY + f", h as (select tool, count(*) filter (kind = 'start') as starts, count(*) filter (kind = 'ok') as ok, count(*) filter (kind = 'no_match') as no_match, count(*) filter (kind = 'empty') as empty, count(*) filter (kind = 'error') as errors, max(ts) filter (kind = 'ok') as last_ok, (list(kw order by ts desc, pos desc) filter (kind = 'ok'))[1] as last_kw, (list(pos order by ts desc, pos desc) filter (kind = 'error'))[1] as last_error_pos from t group by tool) select * exclude (age), case when errors > 0 and ok = 0 then 'red' when ok = 0 then case when no_match > 0 then 'amber' else 'grey' end when age <= 86400 then 'green' when age <= 259200 then 'amber' else 'red' end as light, case when age < 3600 then (age // 60) || 'm' when age < 86400 then (age // 3600) || 'h' else (age // 86400) || 'd' end as last_ok_age from (select *, floor(epoch({_ENOW}))::bigint - floor(epoch(last_ok))::bigint as age from h)",
    "carry_forward": _CARRY + " select pos, tool from t",
    "latest_snapshot": _LASTROW + " select * from l",
    "snapshot_alerts": _LASTROW + f" select host, 'stale' as alert, null as label from l where received_at < {_ENOW} - interval 30 minute union all select host, 'blocked', unnest(['disk: full', 'net: down']) from l where received_at >= {_ENOW} - interval 30 minute and overall = 'red'",
    "error_samples": _KEYS + " select source_obs_id, substring('failed ' || repeat(source_obs_id, 60), 1, 200) as message from k where status = 'error' order by coalesce(updated_at, created_at) desc, source_obs_id limit 5",
    "predigest_parents": _EP + ", p as (select uuid as name, len(string_split(content, chr(10))) as m, case when n % 3 = 0 then 1 else 0 end as made from f_episodes) select name, made || '/' || m as status, made = m as complete from p",
    "observation_rollup": with_views("f_observations") + " select memory_session_id, project, min(created_at_epoch) as start, count(*) as n, array_to_string(list_sort(list(distinct type)), ',') as types, coalesce(array_to_string(list_sort(list(distinct files_modified) filter (files_modified is not null)), ' '), '') as files, (sum(length(coalesce(narrative, ''))) + count(*) - 1)::int as chars from f_observations group by 1, 2",
    "edge_alerts": _SN + ", b as (select host, pos, overall = 'red' as bad, coalesce(lag(overall = 'red') over (partition by host order by received_at, pos), false) as before from f_snapshots) select host, pos, case when bad then 'fire' else 'clear' end as event from b where bad <> before",
    "debounce": _SN + ", b as (select host, pos, received_at, overall <> 'green' as bad, sum((overall = 'green')::int) over (partition by host order by received_at, pos rows between unbounded preceding and current row) as island from f_snapshots), r as (select host, pos, row_number() over (partition by host, island order by received_at, pos) as k from b where bad) select host, pos from r where k = 3",
    "hold_last": _SN + " select host, pos, coalesce(last_value(case when overall <> 'grey' then overall end ignore nulls) over (partition by host order by received_at, pos rows between unbounded preceding and current row), 'green') as held from f_snapshots",
    "status_rollup": _SN + " select host, strftime(received_at, '%Y-%m-%d') as day, case max(case overall when 'red' then 3 when 'amber' then 2 else 1 end) when 3 then 'red' when 2 then 'amber' else 'green' end as overall from f_snapshots group by 1, 2",
    "state_propagation": _LASTROW + ", e as (select distinct host as src, 'host' || (user_id % 7) as dst from f_snapshots) select src, dst, case when a.overall = 'grey' then 'grey' when b.overall <> 'green' then b.overall else 'green' end as light from e left join l a on a.host = src left join l b on b.host = dst",
    "contiguous_cursor": _K + ", s as (select min(n) as stop from f_ingest_keys where status = 'pending' and n >= 100) select max(n) as cursor from f_ingest_keys, s where stop is null or n < stop",
    "tool_contribution": _EP + ", t as (select unnest(range(1, 12)) as i), c as (select 'src' || i as tool, count(*) as n from f_episodes, t where contains(source_description, 'project=src' || i || ' ') group by 1) select * from c union all select 'unknown', (select count(*) from f_episodes) - (select sum(n) from c)::bigint",
    "daily_increment": "with t as (select event_type as metric, strftime(ts, '%Y-%m-%d') as day, count(*) as total from events group by 1, 2), i as (select *, total - lag(total) over (partition by metric order by day) as increment from t) select *, case when increment is null then 'baseline' when increment = 0 then 'no change' else 'changed' end as message from i",
    "probe_light": "select event_id as pos, case when event_id % 13 = 0 then 'grey' when event_id % 60 >= 50 or (event_id % 9000 > 7200 and event_id % 60 > 0) then 'red' when event_id % 60 > 5 then 'amber' else 'green' end as light, case when event_id * 17 < 90 then (event_id * 17) || 's' when event_id * 17 < 5400 then (event_id * 17 // 60) || 'min' when event_id * 17 < 172800 then (event_id * 17 // 3600) || 'h' else (event_id * 17 // 86400) || 'd' end as age from events",
    "work_window": "with h as (select (hour(ts) + 8) % 24 as h from events) select h >= 22 or h < 5 as night, h >= 1 and h < 8 as morning, count(*) as n from h group by 1, 2",
    "recall_at_k": with_views("f_golden", "f_search", "f_episodes") + _RECALL,
    "keyword_recall": with_views("f_search") + f""", q as (select item_id as id, string_split(fact, ' ')[1:2] as keywords, embedding as qe from benchmark join f_search on edge_id = item_id),
 n as (select id, fact, row_number() over (partition by id order by {_SIM} desc, edge_id) as place from q cross join f_search),
 t as (select id, lower(string_agg(fact, chr(10))) as text from n where place <= 10 group by 1),
 r as (select q.id, len(list_filter(keywords, lambda k: contains(coalesce(text, ''), lower(k)))) as matched from q left join t using (id)),
 o as (select id, matched, 2 as threshold, matched >= 2 as ok, null::double as recall from r)
select * from o union all select null, (count(*) filter (ok))::bigint, null, round((count(*) filter (ok)) / greatest(count(*), 1), 6) >= 0.7, round((count(*) filter (ok)) / greatest(count(*), 1), 6)::double from o""",
    "kind_confusion": _SO + " select coalesce(override, '项目事实') as gold, case when name like 'canonical-%' then '手册' else case lower(nullif(regexp_extract(source_description, 'type=(\\S+)', 1), '')) when 'decision' then '决策' when 'bugfix' then '事故' when 'feature' then '项目事实' when 'discovery' then '项目事实' else 'unclassified' end end as got, count(*) as n from f_sourced group by 1, 2",
    "nearest_session": with_views("f_injections", "f_work_sessions") + ", p as (select i.id, s.session_id, floor(epoch(s.start_ts))::bigint - floor(epoch(i.ts))::bigint as gap, s.start_ts from f_injections i join f_work_sessions s using (project)), r as (select *, row_number() over (partition by id order by abs(gap), start_ts, session_id) as rn from p where gap between -180 and 3600) select id, session_id, gap from r where rn = 1",
    "engagement": _TERMS + """ select capsule, count(*) as injected, count(session) as matched, count(used) as engaged, case when count(session) > 0 then round(count(used) / count(session), 6)::double end as rate from m left join a using (capsule, session) group by 1""",
    "scenario": _SCENARIO + " select id, project, s as scenario, why as reason from x",
    "scenario_matrix": _SCENARIO + " select project, " + ", ".join(f"count(*) filter (s = '{k}') as {k}" for k in config.SCENARIOS) + " from x group by 1",
    "coding_reward": _TERMS + f", p as (select distinct m.capsule, m.session, d.text from m join documents c on c.doc_id = m.capsule join documents d on d.doc_id = m.session), o as (select p.*, {_OUT} as outcome, used from p left join a using (capsule, session)) select capsule, session, outcome, case when outcome is not null then case when outcome = 1 and used is not null then 1.0 else 0.0 end end::double as reward from o",
    "contribution": "select user_id % 20 as capsule, count(*) as pairs, sum(event_id % 3)::bigint as total, count(*) filter (event_id % 3 >= 1) as useful, count(*) filter (event_id % 3 = 2) as direct, round(sum(event_id % 3) / count(*), 6)::double as mean from events group by 1",
    "tool_usage": _CARRY + " select tool, count(*) as injections, max(ts) as last_at from t where kind = 'ok' group by 1",
    "runaway_processes": "select event_id as pos, concat_ws(':', case when event_id % 5 = 0 then event_id % 3 end, event_id % 7, event_id % 60) as cpu from events where case when event_id % 5 = 0 then event_id % 3 else 0 end * 3600 + (event_id % 7) * 60 + event_id % 60 > 120",
    "session_rollup": _TALK + " select * from c",
    "beta_scores": "with r as (select distinct event_id % 3000 as token, user_id % 20 as capsule, case when event_type = 'view' then 'coding' else 'ops' end as scenario from events), f as (select *, case when capsule % 2 = 0 then null else least(greatest(token % 3, 0), 1)::double end as reward from r where token >= 500), g as (select capsule, scenario, count(reward) as n, coalesce(sum(reward), 0)::double as reward_sum, count(*) as exposures from f group by 1, 2) select *, round((1 + reward_sum) / (2 + n), 6)::double as mean from g",
    "capsule_watch": "with a as (select event_type as name, count(*) as n from events where user_id < 40 and event_type <> 'signup' group by 1), b as (select event_type as name, count(*) as n from events where user_id >= 40 and event_type <> 'error' group by 1), j as (select coalesce(a.name, b.name) as name, coalesce(a.n, 0) as n0, coalesce(b.n, 0) as n1 from a full join b on a.name = b.name) select *, n1 - n0 as delta, case when n0 = 0 and n1 > 0 then 'recovered' when n0 > 0 and n1 = 0 then 'lost' when n0 <> n1 then 'changed' else 'same' end as state from j",
    "metric_diff": "with a as (select event_type as metric, count(*) as base from events where user_id < 75 group by 1), b as (select event_type as metric, count(*) as current from events where user_id >= 75 group by 1) select metric, base, current, case when base is null or current is null then '?' when current > base then 'up' when current < base then 'down' else '=' end as direction from a full join b using (metric)",
    "kpi_verdict": "select event_type as metric, count(*) as value, case when count(*) between 100 and 1500 then 'OK' when count(*) between 50 and 3000 then 'WARN' else 'BAD' end as verdict from events group by 1",
    "age_days": f"select floor((epoch({_NOW})::bigint - epoch(o_orderdate)::bigint) / 86400.0)::bigint as age, count(*) as n from orders group by 1",
}
