"""Model tables derived from the driver's tables: one portable SELECT each, used by Spark and by the checking SQL."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

_ID = "cast({} as varchar(20))".format
VIEWS = {
    "f_observations": """select doc_id as id, source as project,
 case doc_id % 9 when 0 then 'decision' when 1 then 'bugfix' when 2 then 'feature' when 3 then 'refactor' when 4 then 'discovery' when 5 then 'change' when 6 then 'security_alert' when 7 then 'security_note' else 'note' end as type,
 split_part(text, chr(10), 1) as title, text as narrative,
 case doc_id % 4 when 0 then null when 1 then '["a"]' when 2 then '["a","b"]' else 'not json' end as facts,
 case doc_id % 3 when 0 then '[]' when 1 then '["c1"]' else '["c1","c2"]' end as concepts,
 case doc_id % 3 when 0 then null when 1 then '["f1.py"]' else '["f1.py","f2.md"]' end as files_modified,
 doc_id % 25 as relevance_count,
 case doc_id % 17 when 0 then 'template-x' when 1 then '' else 'm1' end as generated_by_model,
 case when doc_id % 11 = 0 then null else lang end as memory_session_id,
 1704067200000 + doc_id * 3600000 as created_at_epoch from {documents}""",
    "f_sessions": "select * from (values ('de','cursor'),('fr','codex'),('en','claude')) as t(memory_session_id, platform_source)",
    "f_episodes": """select concat('ep-', cast(d.doc_id as varchar(20))) as uuid,
 concat(case when d.doc_id % 10 = 0 then 'canonical-' when d.doc_id % 10 < 4 then 'capsule-' else 'obs-' end, cast(case when d.doc_id % 50 = 7 then d.doc_id - 1 else d.doc_id end as varchar(20))) as name,
 d.text as content,
 case when d.doc_id % 5 = 0 then concat('doc ', d.source) else concat('obs id=', cast(d.doc_id as varchar(20)), ' project=', d.source, ' type=', case d.doc_id % 4 when 0 then 'bugfix' when 1 then 'decision' when 2 then 'discovery' else 'feature' end) end as source_description,
 coalesce(l.toxic,0) = 1 as archived, case when l.quality is null then null else l.quality = 1 end as verified,
 case d.doc_id % 6 when 0 then 'external-article' when 1 then 'external-community' when 2 then null else 'firsthand' end as provenance,
 case when d.doc_id % 7 = 0 then 'time-bound' else 'evergreen' end as durability,
 cast(d.doc_id % 13 as bigint) as usage_count, cast(d.doc_id % 5 as bigint) as retrieval_count, d.lang as scope, case d.doc_id % 8 when 0 then 'public-story' when 1 then 'internal-note' end as visibility, d.doc_id as n
 from {documents} d left join {labels} l on d.doc_id = l.doc_id""",
    "f_entities": """select concat('C',cast(c_custkey as varchar(20))) as uuid, c_name as name, 'Person' as label from {customer}
 union all select concat('P',cast(p_partkey as varchar(20))), concat(p_name,' ',cast(p_partkey as varchar(20))), 'Tool' from {part}
 union all select concat('S',cast(s_suppkey as varchar(20))), s_name, 'Project' from {supplier}
 union all select concat('N',cast(n_nationkey as varchar(20))), n_name, 'Concept' from {nation}
 union all select concat('R',cast(r_regionkey as varchar(20))), r_name, 'Concept' from {region}""",
    "f_facts": """select concat('C',cast(c_custkey as varchar(20))) as src, concat('N',cast(c_nationkey as varchar(20))) as dst, case when c_custkey % 3 = 0 then 'BELONGS_TO' else 'belongs_to' end as name from {customer}
 union all select concat('S',cast(s_suppkey as varchar(20))), concat('N',cast(s_nationkey as varchar(20))), 'belongs_to' from {supplier}
 union all select concat('N',cast(n_nationkey as varchar(20))), concat('R',cast(n_regionkey as varchar(20))), 'occurred_in' from {nation}
 union all select concat('N',cast(n_nationkey as varchar(20))), concat('N',cast((n_nationkey+1) % 25 as varchar(20))), 'relates_to' from {nation}
 union all select distinct concat('P',cast(l_partkey as varchar(20))), concat('S',cast(l_suppkey as varchar(20))), 'depends_on' from {lineitem}
 union all select distinct concat('C',cast(o_custkey as varchar(20))), concat('P',cast(l_partkey as varchar(20))), 'REFERENCES' from {orders} join {lineitem} on o_orderkey = l_orderkey""",
    "f_ingest_keys": """select concat('src-', o_orderpriority) as source_description, cast(o_orderkey as varchar(20)) as source_obs_id, case o_orderstatus when 'F' then 'ok' when 'O' then 'pending' else 'error' end as status, o_orderdate as created_at, o_orderkey as n from {orders}""",
    "f_hook_events": """select event_id as pos, ts, case event_type when 'signup' then 'start' when 'purchase' then 'ok' when 'view' then 'no_match' when 'click' then 'usage' else 'error' end as kind, case when event_type = 'signup' then concat('tool', cast(user_id % 5 as varchar(20))) end as fmt, concat('src', cast(user_id % 20 as varchar(20))) as kw, value as elapsed from {events}""",
    "f_snapshots": """select concat('host', cast(user_id % 12 as varchar(20))) as host, ts as received_at, event_id as pos, user_id, case event_type when 'error' then 'red' when 'view' then 'amber' when 'click' then 'grey' else 'green' end as overall from {events}""",
    "f_golden": "select item_id as id, case when item_id % 2 = 0 then 'literal' else 'nl' end as mode, lower(substring(text,1,12)) as gold_kw from {benchmark}",
    # Episodes whose names and contents exercise the classifiers.
    "f_sourced": """select e.uuid, concat(e.name, case e.n % 7 when 0 then ' 日报' when 1 then ' registry' when 2 then ' gold-market' else '' end) as name, e.source_description,
 concat(case e.n % 6 when 0 then '- **来源**: 公众号文章《x》' when 1 then '**数据来源**: Reddit thread' when 2 then '**来源**：公众号文章《x》' when 3 then '**来源**: team log' else '# plain' end, chr(10), e.content) as content, e.n as n, e.archived as archived,
 case e.n % 4 when 0 then '决策' when 1 then 'unclassified' end as old_kind, case when e.n % 10 = 3 then '素材' end as override
 from ({f_episodes}) e""",
    # Facts as text: some are phrased like metadata.
    "f_fact_texts": """select src, dst, name, concat(src, case lower(name) when 'belongs_to' then ' belongs to the ' when 'references' then ' references the ' when 'depends_on' then ' was built on ' else ' relates to ' end, dst) as fact from ({f_facts}) f""",
    # Reports on the use of episodes, one a usage event, and the feedback on published articles.
    "f_feedback": """select event_id as id, concat('capsule-', cast(user_id % 90 as varchar(20))) as episode_name, case event_id % 6 when 0 then 'stale' when 1 then 'conflict' when 2 then 'supplement' when 3 then 'inaccurate' when 4 then 'irrelevant' else 'missed' end as verdict,
 case when event_id % 6 >= 4 then 'diagnostic' when event_id % 5 = 0 then 'auto_handled' when event_id % 5 = 1 then 'handled' else 'pending' end as status, event_id % 7 + 1 as report_count, concat('q', cast(event_id % 50 as varchar(20))) as query,
 case when event_id % 6 < 4 and event_id % 5 = 0 then 'auto_retire' when event_id % 6 < 4 and event_id % 5 = 1 then case when event_id % 2 = 0 then 'retire' else 'verified' end end as handled_action,
 ts as created_at, case when event_id % 3 = 0 then ts end as updated_at, case when event_id % 6 < 4 and event_id % 5 < 2 then ts end as handled_at from {events}""",
    # Reports that come in after that feedback: some name no episode, no known verdict or no query.
    "f_reports": """select event_id as report_id, concat('capsule-', cast((user_id * 7 + event_id) % 90 as varchar(20))) as episode_name,
 case event_id % 7 when 0 then 'stale' when 1 then 'conflict' when 2 then 'supplement' when 3 then 'inaccurate' when 4 then 'irrelevant' when 5 then 'missed' else 'nonsense' end as verdict,
 case when event_id % 4 = 0 then '' else concat('q', cast(event_id % 50 as varchar(20))) end as query,
 case when event_id % 3 = 0 then concat('capsule-', cast(event_id % 97 as varchar(20))) end as replacement, ts from {events}""",
    "f_articles": "select concat('canonical-', cast(doc_id * 10 as varchar(20))) as linked_casepack from {labels} union all select '' from {region} union all select cast(null as varchar(20)) from {region}",
    # A fact of the search tests: text, backing episodes and an embedding.
    "f_search": """select v.vec_id as edge_id, concat(d.source, ' ', d.lang, ' ', cast(v.label as varchar(20)), ' ', cast(v.vec_id % 400 as varchar(20))) as fact,
 concat('ep-', cast(v.vec_id as varchar(20))) as ep1, concat('ep-', cast(v.vec_id * 7 % 1200 as varchar(20))) as ep2, v.embedding as embedding
 from {embeddings} v join {documents} d on v.vec_id = d.doc_id""",
    # Sessions of users and deliveries to them, for the nearest-in-time join.
    "f_injections": "select event_id as id, concat('user', cast(user_id as varchar(20))) as project, ts from {events} where event_type = 'purchase'",
    "f_work_sessions": "select event_id as session_id, concat('user', cast(user_id as varchar(20))) as project, ts as start_ts from {events} where event_type = 'signup'",
}


def _whole(name: str) -> str:
    """The SELECT of a view with the views it builds on written out."""
    return re.sub(r"{(f_\w+)}", lambda m: _whole(m[1]), VIEWS[name])


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One model table as a DataFrame over the driver's parquet files."""
    sql = _whole(name)
    frames = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in set(re.findall(r"{(\w+)}", sql))}
    return spark.sql(sql, **frames)


def with_views(*names: str) -> str:
    """The WITH clause that gives DuckDB the same model tables."""
    return "with " + ",\n".join(f"{n} as ({re.sub(r'{(\w+)}', r'\1', _whole(n))})" for n in names)
