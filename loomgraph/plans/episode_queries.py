"""Queries over episodes: classifiers, rankings, lists, state changes; with their checking SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph import config
from loomgraph.functions.columns import blank, contains_any, declared, days_between, snippet
from loomgraph.operators import classify, gate, graph, ranking
from loomgraph.sources.fixtures import view, with_views

KEYWORD, GRID = "the", ["the", "de", "en"]
#: Workspaces of the fixture's tools.
WORKSPACES = {"src1": "editor", "src2": "terminal"}
NOW = "timestamp'2024-02-01 00:00:00'"


def episodes(s: SparkSession, d: str) -> DataFrame:
    return view(s, d, "f_episodes")


def sourced(s: SparkSession, d: str) -> DataFrame:
    return view(s, d, "f_sourced")


def tier_items(s: SparkSession, d: str) -> DataFrame:
    """Search items: twenty queries over all typed episodes with a made-up score."""
    return episodes(s, d).select((F.col("n") % 20).alias("query_id"), "name", "uuid", ((F.col("n") * 37 % 1000) / 100.0).alias("score"), F.coalesce(declared("source_description", "type"), F.lit("?")).alias("type")).withColumn("name", F.col("uuid"))


def deliveries(s: SparkSession, d: str) -> DataFrame:
    e = episodes(s, d).select("n", "name", F.coalesce(declared("source_description", "type"), F.lit("?")).alias("type"))
    return e.groupBy((F.col("n") % 150).alias("id")).agg(F.collect_list(F.struct("name", "type")).alias("picked")).select(F.when(F.col("id") % 2 == 0, "context").otherwise("search").alias("endpoint"), (F.col("id") % 3 == 0).alias("tiering"), "picked")


def delivery_replay(s: SparkSession, d: str) -> DataFrame:
    """Knowledge and operational picks of each query with and without tiers."""
    items = tier_items(s, d)
    count = lambda rows, name: rows.groupBy("query_id").agg(F.count_if(F.col("type").isin(*config.KNOWLEDGE_TYPES)).alias(f"{name}_knowledge"), F.count_if(F.col("type").isin(*config.OPERATIONAL_TYPES)).alias(f"{name}_operational"))
    return count(ranking.tier_rerank(items, 5, enabled=False), "plain").join(count(ranking.tier_rerank(items, 5), "tiered"), "query_id")


def kinds(s: SparkSession, d: str) -> DataFrame:
    derived = classify.kind()
    return sourced(s, d).select("uuid", classify.resolved_kind(derived, F.col("override")).alias("k"), classify.without_downgrade(F.col("old_kind"), derived["kind"]).alias("backfilled")).select("uuid", "k.kind", "k.kind_confidence", "backfilled")


def untyped_profile(s: SparkSession, d: str) -> DataFrame:
    """Untyped episodes by name prefix with up to three samples each."""
    rows = episodes(s, d).where(declared("source_description", "type").isNull())
    prefix = F.when(F.col("name").startswith("canonical-"), "canonical").when(F.col("name").startswith("capsule-"), "capsule").otherwise("other")
    counts = rows.groupBy(prefix.alias("prefix")).agg(F.count(F.lit(1)).alias("n"))
    some = None  # three rows of each of three prefixes, by top-k sorts
    for name in ("canonical", "capsule", "other"):
        part = rows.where(prefix == name).orderBy("uuid").limit(3).select(F.lit(name).alias("prefix"), "uuid")
        some = part if some is None else some.unionByName(part)
    samples = some.groupBy("prefix").agg(F.array_join(F.array_sort(F.collect_list("uuid")), ",").alias("samples"))
    return counts.join(samples, "prefix")


def curate_manifest(s: SparkSession, d: str) -> DataFrame:
    """Archive candidates: noise (class A) and untyped leftovers (class C); duplicates (class B) are left out."""
    e = episodes(s, d).where("not archived")
    extra = classify.keep_longest(e, classify.first_line("content", 72)).select("uuid")
    noise = e.where((declared("source_description", "type") == "bugfix") & F.lower(blank("content")).contains("the")).select("uuid", F.lit("A").alias("class"))
    bare = e.where(declared("source_description", "type").isNull() & (F.coalesce("usage_count", F.lit(0)) == 0)).select("uuid", F.lit("C").alias("class"))
    return noise.unionByName(bare).join(extra, "uuid", "left_anti")


def top(s: SparkSession, d: str, where: str, order: list, n: int, *columns: str) -> DataFrame:
    return episodes(s, d).where(where).orderBy(*order).limit(n).select(*columns)


_CANON = "name like 'canonical-%'"
QUERIES = {
    "canonical_context": lambda s, d: ranking.canonical_context(episodes(s, d).withColumn("scope", F.when(F.col("n") % 40 == 0, F.concat(F.lit("project:"), F.col("scope"))).otherwise("global")), KEYWORD, 3).select("uuid", "name", "hits", "relscore", "place", "reason"),
    "canonical_grid": lambda s, d: ranking.canonical_grid(episodes(s, d).withColumn("scope", F.concat(F.lit("project:"), F.col("scope"))), GRID).select("keyword", "uuid", "hits", "relscore", "place", "injected"),
    "origin": lambda s, d: episodes(s, d).select("uuid", classify.origin(workspaces=WORKSPACES).alias("o")).select("uuid", "o.*"),
    "durability": lambda s, d: sourced(s, d).select("uuid", classify.durability().alias("durability")),
    "kind": kinds,
    "provenance": lambda s, d: sourced(s, d).select("uuid", classify.provenance().alias("provenance"), classify.provenance(lenient=True).alias("lenient"), classify.has_source().alias("has_source")),
    "provenance_counts": lambda s, d: sourced(s, d).groupBy(classify.provenance().alias("provenance")).agg(F.count(F.lit(1)).alias("n")),
    "route": lambda s, d: sourced(s, d).select("uuid", classify.is_catalog().alias("is_catalog"), classify.route().alias("route")),
    "duplicates_title": lambda s, d: classify.duplicate_clusters(episodes(s, d), F.substring("content", 1, 12)),
    "duplicates_active": lambda s, d: classify.duplicate_clusters(episodes(s, d), classify.first_line(), active_only=True),
    "duplicates_curate": lambda s, d: classify.duplicate_clusters(episodes(s, d), classify.first_line("content", 72)),
    "keep_longest": lambda s, d: classify.keep_longest(episodes(s, d), classify.first_line("content", 72)).select("uuid", "project", "kept"),
    "keep_earliest": lambda s, d: classify.keep_earliest(episodes(s, d), "n").select("uuid"),
    "first_bytes_dedupe": lambda s, d: classify.first_bytes_dedupe(episodes(s, d).withColumn("path", F.concat(F.lit("/"), F.col("uuid")))).select("path"),
    "curate_manifest": curate_manifest,
    "untyped_profile": untyped_profile,
    "usage_ranking_top": lambda s, d: top(s, d, _CANON, [F.desc("usage_count"), "name", "uuid"], 10, "uuid", "name", "usage_count"),
    "usage_ranking_promote": lambda s, d: episodes(s, d).where("usage_count > 0").where(~F.col("name").startswith("canonical-")).orderBy(F.desc("usage_count"), "name", "uuid").limit(10).select("uuid", "usage_count", F.substring("content", 1, 160).alias("preview")),
    "usage_ranking_demote": lambda s, d: top(s, d, _CANON + " and usage_count = 0", ["n", "name", "uuid"], 10, "uuid", "name"),
    "usage_stats": lambda s, d: ranking.usage_stats(episodes(s, d)),
    "utilization": lambda s, d: ranking.utilisation(episodes(s, d)),
    "used_knowledge": lambda s, d: top(s, d, "usage_count > 0 and not archived", [F.desc("usage_count"), "name", "uuid"], 40, "uuid", "usage_count"),
    "recent_knowledge": lambda s, d: episodes(s, d).where("not archived").orderBy(F.desc("n"), "uuid").limit(25).select("uuid", snippet(F.col("content"), 120).alias("snippet")),
    "retire_candidates": lambda s, d: episodes(s, d).withColumn("created_at", F.timestamp_seconds(F.lit(1704067200) + F.col("n") * 3600)).where("durability = 'time-bound' and not archived").where(~F.col("name").startswith("canonical-")).where(days_between(F.expr(NOW), F.col("created_at")) > 10).orderBy("created_at", "uuid").limit(40).select("uuid", "name", days_between(F.expr(NOW), F.col("created_at")).alias("age_days")),
    "untagged": lambda s, d: episodes(s, d).where("visibility is null").where(~F.col("name").startswith("canonical-") & contains_any(F.col("source_description"), ("type=feature", "type=bugfix", "type=decision", "type=refactor"))).orderBy(F.desc("n"), "uuid").limit(15).select("uuid", "name"),
    "unclassified_count": lambda s, d: sourced(s, d).agg(F.count_if((F.col("old_kind").isNull() | (F.col("old_kind") == "unclassified")) & ~F.col("archived") & ~F.col("name").startswith("canonical-")).alias("n")),
    "tier_rerank": lambda s, d: ranking.tier_rerank(tier_items(s, d), 5).select("query_id", "name", "type", "score", "tscore", "place"),
    "delivery_replay": delivery_replay,
    "delivery_mix": lambda s, d: ranking.delivery_mix(deliveries(s, d), gate.type_bucket(F.col("type"))),
    "usage_bump": lambda s, d: ranking.usage_bump(episodes(s, d), s.read.parquet(f"{d}/events.parquet").where("event_type = 'view'").select(F.concat(F.lit("capsule-"), (F.col("event_id") % 700).cast("string")).alias("name"), "ts")),
    "health_metrics": lambda s, d: health_metrics(s, d),
    "source_values": lambda s, d: classify.source_values(episodes(s, d)),
    "tag_update": lambda s, d: tag_update(s, d),
}


def health_metrics(s: SparkSession, d: str) -> DataFrame:
    noise = (declared("source_description", "type") == "bugfix") & F.lower(blank("content")).contains("the")
    degrees = graph.degrees(view(s, d, "f_entities"), view(s, d, "f_facts"))
    orphans = degrees.agg(F.round(100.0 * F.count_if(F.col("degree") == 0) / F.greatest(F.count(F.lit(1)), F.lit(1)), 2).alias("orphan_percent"))
    return classify.health(episodes(s, d), F.coalesce(noise, F.lit(False)), classify.first_line()).crossJoin(F.broadcast(orphans))  # one row each


def tag_update(s: SparkSession, d: str) -> DataFrame:
    """Tags by name: whitelisted kinds override with full confidence, others are refused; unmatched rows stay."""
    tags = sourced(s, d).where("n % 50 = 6").select("uuid", F.when(F.col("n") % 100 == 6, "决策").otherwise("no such kind").alias("tag"))
    rows = sourced(s, d).join(tags, "uuid", "left")
    ok = F.col("tag").isin("方法论", "手册", "决策", "事故", "项目事实", "生命周期事件", "素材", "公开故事", "registry", "unclassified")
    return rows.select("uuid", F.when(F.coalesce(ok, F.lit(False)), F.col("tag")).otherwise(F.col("old_kind")).alias("kind"), F.when(F.coalesce(ok, F.lit(False)), 1.0).alias("kind_confidence"), F.coalesce(~ok, F.lit(False)).alias("refused"))


_E, _S = with_views("f_episodes"), with_views("f_sourced")
_TYPE, _PROJECT = "nullif(regexp_extract(source_description, 'type=(\\S+)', 1), '')", "coalesce(nullif(regexp_extract(source_description, 'project=(\\S+)', 1), ''), 'unknown')"
_NOISE = f"{_TYPE} is not null and {_TYPE} = 'bugfix' and contains(lower(content), 'the')"
_COUNT = "((length(lower(content)) - length(replace(lower(content), {0}, ''))) // length({0}))::bigint"
_KIND = "case when name like 'canonical-%' then '手册' else case lower(" + _TYPE + ") " + " ".join(f"when '{k}' then '{v[0]}'" for k, v in config.TYPE_KIND.items()) + " else 'unclassified' end end"
_CONF = "case when name like 'canonical-%' then 0.9 else case lower(" + _TYPE + ") " + " ".join(f"when '{k}' then {v[1]}" for k, v in config.TYPE_KIND.items()) + " else 0.0 end end"
_LINES = "regexp_split_to_array(content, '\\r\\n|[\\n\\x0B\\f\\r]')"
_FIRST = _LINES + "[1]"
_PROV = "case when n % 6 = 0 {lenient} then 'external-article' when n % 6 = 1 then 'external-community' else 'firsthand' end"
_BUCKET = "case when {0} is null or {0} = '?' then '?' when {0} in ('decision','security_note','security_alert') then 'knowledge' when {0} in ('bugfix','change','feature','refactor') then 'operational' when {0} = 'discovery' then 'discovery' else 'other' end"
_WEIGHT = "case type " + " ".join(f"when '{k}' then {v}" for k, v in config.TIER_WEIGHTS.items()) + " else 1.0 end"
_TIERS = _E + f""",
 i as (select n % 20 as query_id, uuid as name, (n * 37 % 1000) / 100.0 as score, coalesce({_TYPE}, '?') as type from f_episodes),
 w as (select *, round(score * {_WEIGHT}, 6) as tscore from i),
 r as (select *, row_number() over (partition by query_id order by tscore desc, name) as place from w),
 p as (select *, row_number() over (partition by query_id order by score desc, name) as plain from r),
 x as (select query_id, count(*) filter (place <= 5 and type in ('bugfix','change','feature','refactor')) as held, min(place) filter (place > 5 and type in ('bugfix','change','feature','refactor')) as spare, max(place) filter (place <= 5 and type not in ('decision','security_note','security_alert')) as lowest from r group by 1),
 k as (select p.*, case when held = 0 and spare is not null and lowest is not null then (place <= 5 and place <> lowest) or place = spare else place <= 5 end as kept from p join x using (query_id))
"""


def _grid(keyword: str, scope: str) -> str:
    own = f"project:{keyword}"
    return f"""select '{keyword}' as keyword, uuid, name, uc, hits, round(ln(1 + hits) + case when scope = '{own}' then 0.5 when scope like 'project:%' then -0.3 else 0 end, 6) as relscore
 from (select uuid, name, coalesce(usage_count, 0) as uc, {scope} as scope, {_COUNT.format(f"'{keyword}'")} as hits from f_episodes where name like 'canonical%' and not archived) where scope = 'global' or hits > 0 or scope = '{own}'"""


ORACLES = {
    "canonical_context": _E + f", c as ({_grid(KEYWORD, 'case when n % 40 = 0 then ' + chr(39) + 'project:' + chr(39) + ' || scope else ' + chr(39) + 'global' + chr(39) + ' end')}), r as (select *, row_number() over (order by relscore desc, uc, name, uuid) as rn, count(*) over () as cnt from c), x as (select * from r where rn >= 3 order by uc, rn limit 1) select uuid, name, hits, relscore, rn::int as place, 'relevance' as reason from r where rn < 3 union all select uuid, name, hits, relscore, 3::int, case when cnt > 3 then 'explore' else 'relevance' end from x",
    "canonical_grid": _E + ", c as (" + " union all ".join(_grid(k, "'project:' || scope") for k in GRID) + "), r as (select *, row_number() over (partition by keyword order by relscore desc, uc, name, uuid)::int as place from c) select keyword, uuid, hits, relscore, place, place <= 3 as injected from r",
    "origin": _E + f", t as (select *, case when name like 'capsule-%' then 'capsule' when name like 'canonical-%' or lower(source_description) like 'canonical-%' or lower(source_description) like 'case-pack%' then 'hub' when lower(source_description) like 'doc%' then 'docs' when lower(source_description) like 'obs%' then case lower(nullif(regexp_extract(source_description, 'project=(\\S+)', 1), '')) when 'src1' then 'editor' when 'src2' then 'terminal' else 'observer' end else 'unknown' end as origin_tool from f_episodes) select uuid, case when name like 'capsule-%' then 'remote' else 'local' end as origin_device, origin_tool, coalesce(nullif(regexp_extract(source_description, 'project=(\\S+)', 1), ''), case origin_tool when 'capsule' then 'capsule' when 'hub' then 'hub' else 'unknown' end) as origin_project from t",
    "durability": _S + f"select uuid, case when regexp_matches(name, '{config.TIME_BOUND}') then 'time-bound' else 'evergreen' end as durability from f_sourced",
    "kind": _S + f", d as (select uuid, old_kind, override, {_KIND} as k, ({_CONF})::double as c from f_sourced) select uuid, case when override is not null then override when c >= 0.7 then k else 'unclassified' end as kind, case when override is not null then 1.0 when c >= 0.7 then c else 0.0 end::double as kind_confidence, case when k = 'unclassified' and old_kind is not null and old_kind <> 'unclassified' then old_kind else k end as backfilled from d",
    "provenance": _S + f"select uuid, {_PROV.format(lenient='')} as provenance, {_PROV.format(lenient='or n % 6 = 2')} as lenient, n % 6 in (0, 1, 3) as has_source from f_sourced",
    "provenance_counts": _S + f"select {_PROV.format(lenient='')} as provenance, count(*) as n from f_sourced group by 1",
    "route": _S + f", l as (select *, {_LINES} as ls from f_sourced), c as (select *, regexp_matches(name, '{config.CATALOG}') or regexp_matches(coalesce(list_filter(ls, lambda x: ltrim(x)[1] = '#')[1], ''), '{config.CATALOG}') or (len(ls) >= 20 and 10 * len(list_filter(ls, lambda x: ltrim(x)[1] = '|' or regexp_matches(x, '^\\s*[-*•]\\s'))) > 6 * len(ls) and not regexp_matches(content, '{config.CONCLUSION}')) as is_catalog from l) select uuid, is_catalog, case when name like 'capsule-%' then case when is_catalog then 'catalog' when strlen(content) >= 1500 then 'split' end end as route from c",
    "duplicates_title": _E + f"select {_PROJECT} as project, substring(content, 1, 12) as title, count(*) as n from f_episodes group by 1, 2 having count(*) > 1",
    "duplicates_active": _E + f"select {_PROJECT} as project, {_FIRST} as title, count(*) as n from f_episodes where not archived group by 1, 2 having count(*) > 1",
    "duplicates_curate": _E + f"select {_PROJECT} as project, substring({_FIRST}, 1, 72) as title, count(*) as n from f_episodes group by 1, 2 having count(*) > 1",
    "keep_longest": _E + f"select uuid, project, kept from (select uuid, {_PROJECT} as project, first_value(uuid) over (partition by {_PROJECT}, substring({_FIRST}, 1, 72) order by length(content) desc, uuid) as kept from f_episodes) where uuid <> kept",
    "keep_earliest": _E + "select uuid from (select uuid, row_number() over (partition by content order by n, uuid) as place from f_episodes) where place = 1",
    "first_bytes_dedupe": _E + "select path from (select '/' || uuid as path, row_number() over (partition by substring(hex(encode(content)), 1, 400) order by '/' || uuid) as place from f_episodes) where place = 1",
    "curate_manifest": _E + f", e as (select *, row_number() over (partition by {_PROJECT}, substring({_FIRST}, 1, 72) order by length(content) desc, uuid) as place, {_TYPE} as type from f_episodes where not archived) select uuid, case when type = 'bugfix' then 'A' else 'C' end as class from e where place = 1 and ((type = 'bugfix' and contains(lower(content), 'the')) or (type is null and usage_count = 0))",
    "untyped_profile": _E + f", u as (select uuid, case when name like 'canonical-%' then 'canonical' when name like 'capsule-%' then 'capsule' else 'other' end as prefix from f_episodes where {_TYPE} is null), r as (select *, row_number() over (partition by prefix order by uuid) as k from u) select prefix, count(*) as n, string_agg(uuid, ',' order by uuid) filter (k <= 3) as samples from r group by 1",
    "usage_ranking_top": _E + "select uuid, name, usage_count from f_episodes where name like 'canonical-%' order by usage_count desc, name, uuid limit 10",
    "usage_ranking_promote": _E + "select uuid, usage_count, substring(content, 1, 160) as preview from f_episodes where usage_count > 0 and name not like 'canonical-%' order by usage_count desc, name, uuid limit 10",
    "usage_ranking_demote": _E + "select uuid, name from f_episodes where name like 'canonical-%' and usage_count = 0 order by n, name, uuid limit 10",
    "usage_stats": _E + "select count(*) as total, sum(usage_count)::bigint as uses, count(*) filter (usage_count > 0) as used, count(*) filter (name like 'canonical-%') as canonical, (sum(usage_count) filter (name like 'canonical-%'))::bigint as canonical_uses, count(*) filter (name like 'canonical-%' and usage_count > 0) as canonical_used from f_episodes",
    "utilization": _E + f"select project, total, used, total - used as never, round(100.0 * used / greatest(total, 1), 6)::double as percent from (select {_PROJECT} as project, count(*) as total, count(*) filter (usage_count > 0) as used from f_episodes group by 1)",
    "used_knowledge": _E + "select uuid, usage_count from f_episodes where usage_count > 0 and not archived order by usage_count desc, name, uuid limit 40",
    "recent_knowledge": _E + "select uuid, case when length(replace(trim(content), chr(10), ' ')) > 120 then substring(replace(trim(content), chr(10), ' '), 1, 120) || '…' else replace(trim(content), chr(10), ' ') end as snippet from f_episodes where not archived order by n desc, uuid limit 25",
    "retire_candidates": _E + ", c as (select *, floor((1706745600 - (1704067200 + n * 3600)) / 86400.0)::bigint as age_days from f_episodes) select uuid, name, age_days from c where durability = 'time-bound' and not archived and name not like 'canonical-%' and age_days > 10 order by n, uuid limit 40",
    "untagged": _E + "select uuid, name from f_episodes where visibility is null and name not like 'canonical-%' and regexp_matches(source_description, 'type=(feature|bugfix|decision|refactor)') order by n desc, uuid limit 15",
    "unclassified_count": _S + "select count(*) filter ((old_kind is null or old_kind = 'unclassified') and not archived and name not like 'canonical-%') as n from f_sourced",
    "tier_rerank": _TIERS + "select query_id, name, type, score::double as score, tscore::double as tscore, place::int as place from k where kept",
    "delivery_replay": _TIERS + "select query_id, count(*) filter (plain <= 5 and type in ('decision','security_note','security_alert')) as plain_knowledge, count(*) filter (plain <= 5 and type in ('bugfix','change','feature','refactor')) as plain_operational, count(*) filter (kept and type in ('decision','security_note','security_alert')) as tiered_knowledge, count(*) filter (kept and type in ('bugfix','change','feature','refactor')) as tiered_operational from k group by 1",
    "delivery_mix": _E + f", p as (select n % 150 as id, coalesce({_TYPE}, '?') as type from f_episodes), h as (select case when id % 2 = 0 then 'context' else 'search' end as endpoint, count(distinct id) as hits, count(distinct id) filter (id % 3 = 0) as tiered from p group by 1) select endpoint, hits, tiered, {_BUCKET.format('type')} as bucket, count(*) as picks from p join h on h.endpoint = case when id % 2 = 0 then 'context' else 'search' end group by all",
    "usage_bump": _E + ", v as (select 'capsule-' || (event_id % 700) as name, count(*) as more, max(ts) as last_used_at from events where event_type = 'view' group by 1) select uuid, name, (usage_count + coalesce(more, 0))::bigint as usage_count, (retrieval_count + coalesce(more, 0))::bigint as retrieval_count, last_used_at from f_episodes left join v using (name)",
    "health_metrics": with_views("f_episodes", "f_entities", "f_facts") + f", c as (select count(*) as total, count(*) filter (not archived) as active, count(*) filter (archived) as archived, round(100.0 * count(*) filter (usage_count > 0 and not archived) / greatest(count(*) filter (not archived), 1), 2)::double as injected_percent, round(100.0 * count(*) filter (name like 'canonical-%' and not archived and usage_count = 0) / greatest(count(*) filter (name like 'canonical-%' and not archived), 1), 2)::double as dormant_percent, count(*) filter ({_NOISE} and not archived) as noise_active, count(*) filter ({_NOISE} and archived) as noise_archived from f_episodes), k as (select count(*) as duplicate_clusters from (select 1 from f_episodes where not archived group by {_PROJECT}, {_FIRST} having count(*) > 1)), t as (select distinct unnest([src, dst]) as uuid from f_facts), o as (select round(100.0 * count(*) filter (t.uuid is null) / greatest(count(*), 1), 2)::double as orphan_percent from f_entities e left join t using (uuid)) select * from c, k, o",
    "source_values": _E + ", t as (select string_split(source_description, ' ')[1] as source, nullif(regexp_extract(source_description, 'type=(\\S+)', 1), '') as type, nullif(regexp_extract(source_description, 'project=(\\S+)', 1), '') as project from f_episodes) select source, count(*) as n, count(type) as typed, count(project) as with_project, round(100.0 * count(*) filter (type in ('decision','security_note','security_alert')) / count(*), 2)::double as high_percent, round(100.0 * count(*) filter (type in ('bugfix','change','feature','refactor')) / count(*), 2)::double as low_percent from t group by 1",
    "tag_update": _S + "select uuid, case when n % 100 = 6 then '决策' else old_kind end as kind, case when n % 100 = 6 then 1.0 end::double as kind_confidence, n % 100 = 56 as refused from f_sourced",
}
