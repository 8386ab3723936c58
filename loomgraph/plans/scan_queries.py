"""Queries of scans, set operations, request checks and term statistics with their checking SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph import config
from loomgraph.functions.columns import blank, declared, escaped, snippet
from loomgraph.operators import classify, evaluate
from loomgraph.plans import state_queries
from loomgraph.sources import readers
from loomgraph.sources.fixtures import view, with_views


def observations(s: SparkSession, d: str) -> DataFrame:
    return view(s, d, "f_observations")


def terminal(s: SparkSession, d: str) -> DataFrame:
    """Terminal ids: ingested, rejected and failed ones, each a set of its own."""
    o = observations(s, d).select("id")
    return o.where("id % 3 = 0").union(o.where("id % 5 = 0")).union(o.where("id % 7 = 0")).distinct()


def requests(s: SparkSession, d: str) -> DataFrame:
    """Ingest requests with a reason for each that is refused; the first failing check names it."""
    e = view(s, d, "f_episodes")
    raw = e.select("uuid", F.when(F.col("n") % 9 != 0, F.col("name")).alias("name"), F.when(F.col("n") % 8 == 0, "not a time").when(F.col("n") % 8 == 1, "2024-01-05T10:00:00+08:00").otherwise("2024-01-05T10:00:00Z").alias("reference_time"), F.when(F.col("n") % 11 == 0, "rumour").otherwise(F.col("provenance")).alias("provenance"), F.when(F.col("n") % 13 == 0, "forever").otherwise(F.col("durability")).alias("durability"))
    at = F.try_to_timestamp("reference_time")
    reason = F.when(blank("name") == "", "name").when(at.isNull(), "reference_time").when(F.col("provenance").isNotNull() & ~F.col("provenance").isin("firsthand", "external-article", "external-community"), "provenance").when(~F.col("durability").isin("evergreen", "time-bound"), "durability")
    return raw.select("uuid", at.alias("at"), reason.alias("refused"))


def kind_answers(s: SparkSession, d: str) -> DataFrame:
    """Kinds out of prose with a JSON object; unknown kinds and bad JSON are unclassified."""
    raw = observations(s, d).select("id", F.when(F.col("id") % 4 == 0, 'Sure: {"kind":"决策","confidence":0.82} done').when(F.col("id") % 4 == 1, '{"kind":"poem","confidence":0.9}').when(F.col("id") % 4 == 2, "no object").otherwise('{"kind":"手册","confidence":7}').alias("answer"))
    parsed = F.from_json(F.regexp_extract("answer", r"(?s)\{.*\}", 0), "kind string, confidence double")
    ok = F.coalesce(parsed["kind"].isin("方法论", "手册", "决策", "事故", "项目事实", "生命周期事件", "素材", "公开故事", "registry"), F.lit(False))
    return raw.select("id", F.when(ok, parsed["kind"]).otherwise(config.UNCLASSIFIED).alias("kind"), F.when(ok, F.least(F.greatest(parsed["confidence"], F.lit(0.0)), F.lit(1.0))).otherwise(0.0).alias("confidence"))


def document_frequency(s: SparkSession, d: str) -> DataFrame:
    rows = s.read.parquet(f"{d}/documents.parquet").select("doc_id", F.explode(evaluate.terms(F.col("text"))).alias("term"))
    return rows.groupBy("term").agg(F.count(F.lit(1)).alias("df")).orderBy(F.desc("df"), "term").limit(50)


QUERIES = {
    "scan_id_range": lambda s, d: readers.id_range(observations(s, d), 100, 400, 50).select("id", "type"),
    "scan_ids": lambda s, d: observations(s, d).select("id"),
    "scan_by_ids": lambda s, d: readers.by_ids(observations(s, d), s.read.parquet(f"{d}/labels.parquet").select(F.col("doc_id").alias("id"))).select("id", "project"),
    "scan_newest": lambda s, d: readers.newest(observations(s, d), 30).select("id"),
    "scan_watermark": lambda s, d: readers.watermark(observations(s, d)),
    "label_scan": lambda s, d: view(s, d, "f_entities").where("label = 'Concept'").select("uuid", "name"),
    "terminal_union": lambda s, d: terminal(s, d),
    "pending_ids": lambda s, d: observations(s, d).select("id").join(terminal(s, d), "id", "left_anti"),
    "approved_difference": lambda s, d: observations(s, d).select("project").where("id % 4 < 2").exceptAll(observations(s, d).select("project").where("id % 4 >= 2")).groupBy("project").agg(F.count(F.lit(1)).alias("n")),
    "source_intersection": lambda s, d: observations(s, d).where("type = 'decision'").select("project").intersect(observations(s, d).where("type = 'bugfix'").select("project")),
    "request_validation": requests,
    "kind_answers": kind_answers,
    "provenance_parse": lambda s, d: view(s, d, "f_episodes").groupBy(F.element_at(F.split("source_description", " "), 1).alias("source"), F.coalesce(declared("source_description", "type"), F.lit("?")).alias("type")).agg(F.count(F.lit(1)).alias("n")),
    "document_frequency": document_frequency,
    "html_previews": lambda s, d: view(s, d, "f_episodes").select("uuid", escaped(snippet(F.col("content"), 80)).alias("preview")),
    "observation_text": lambda s, d: observations(s, d).select("id", classify.observation_body().alias("body")),
    "recent_decisions": lambda s, d: readers.windowed(s.read.parquet(f"{d}/events.parquet"), "7d", F.expr("timestamp'2024-01-30 00:00:00'")).groupBy("event_type").agg(F.count(F.lit(1)).alias("n")),
}
_O, _E = with_views("f_observations"), with_views("f_episodes")
_TERMINAL = ", t as (select id from f_observations where id % 3 = 0 or id % 5 = 0 or id % 7 = 0)"
_FLAT = "replace(trim(content), chr(10), ' ')"
ORACLES = {
    "scan_id_range": _O + "select id, type from f_observations where id > 100 and id <= 400 order by id limit 50",
    "scan_ids": _O + "select id from f_observations",
    "scan_by_ids": _O + "select id, project from f_observations where id in (select doc_id from labels)",
    "scan_newest": _O + "select id from f_observations order by created_at_epoch desc, id desc limit 30",
    "scan_watermark": _O + "select coalesce(max(id), 0) as watermark from f_observations",
    "label_scan": with_views("f_entities") + "select uuid, name from f_entities where label = 'Concept'",
    "terminal_union": _O + _TERMINAL + "select id from t",
    "pending_ids": _O + _TERMINAL + "select id from f_observations where id not in (select id from t)",
    "approved_difference": _O + "select project, count(*) as n from (select project from f_observations where id % 4 < 2 except all select project from f_observations where id % 4 >= 2) group by 1",
    "source_intersection": _O + "select project from f_observations where type = 'decision' intersect select project from f_observations where type = 'bugfix'",
    "request_validation": _E + "select uuid, case when n % 8 = 0 then null when n % 8 = 1 then timestamp '2024-01-05 02:00:00' else timestamp '2024-01-05 10:00:00' end as \"at\", case when n % 9 = 0 then 'name' when n % 8 = 0 then 'reference_time' when n % 11 = 0 then 'provenance' when n % 13 = 0 then 'durability' end as refused from f_episodes",
    "kind_answers": _O + "select id, case id % 4 when 0 then '决策' when 3 then '手册' else 'unclassified' end as kind, case id % 4 when 0 then 0.82 when 3 then 1.0 else 0.0 end::double as confidence from f_observations",
    "provenance_parse": _E + "select string_split(source_description, ' ')[1] as source, coalesce(nullif(regexp_extract(source_description, 'type=(\\S+)', 1), ''), '?') as type, count(*) as n from f_episodes group by 1, 2",
    "document_frequency": "with t as (select unnest(" + state_queries._WORDS.replace("{T}", "text") + ") as term from documents) select term, count(*) as df from t where length(term) >= 4 group by 1 order by df desc, term limit 50",
    "html_previews": _E + f"select uuid, replace(replace(replace(case when length({_FLAT}) > 80 then substring({_FLAT}, 1, 80) || '…' else {_FLAT} end, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') as preview from f_episodes",
    "observation_text": _O + "select id, '[' || upper(type) || '] ' || coalesce(nullif(title, ''), '(untitled)') || chr(10) || case when coalesce(narrative, '') <> '' then chr(10) || 'Narrative:' || chr(10) || narrative || chr(10) else '' end || case id % 4 when 1 then chr(10) || 'Key facts:' || chr(10) || '- a' || chr(10) when 2 then chr(10) || 'Key facts:' || chr(10) || '- a' || chr(10) || '- b' || chr(10) else '' end || case id % 3 when 1 then chr(10) || 'Concepts: c1' when 2 then chr(10) || 'Concepts: c1, c2' else '' end || case id % 3 when 1 then chr(10) || 'Files modified: f1.py' when 2 then chr(10) || 'Files modified: f1.py, f2.md' else '' end as body from f_observations",
    "recent_decisions": "select event_type, count(*) as n from events where ts >= timestamp '2024-01-23' group by 1",
}
