"""Queries of search and graph with their checking SQL."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph import config
from loomgraph.functions.columns import declared
from loomgraph.operators import classify, graph, resolution, retrieval, walks
from loomgraph.plans.index_queries import episode_index
from loomgraph.sources.fixtures import view, with_views

NOW = "timestamp'2024-02-10 00:00:00'"
TEXT = "src1"
#: A fixed query vector: sin of the position.
VECTOR = [round(math.sin(i + 1), 6) for i in range(64)]


def facts(s: SparkSession, d: str) -> DataFrame:
    return view(s, d, "f_search").select("edge_id", "fact", F.array_distinct(F.array("ep1", "ep2")).alias("backing"), "embedding")


def episodes(s: SparkSession, d: str) -> DataFrame:
    e = view(s, d, "f_episodes")
    return e.withColumns({"created_at": F.timestamp_seconds(F.lit(1704067200) + (F.col("n") % 60) * 86_400), "project": F.coalesce(declared("source_description", "project"), F.lit("unknown")), "kind": classify.kind()["kind"]})


def hybrid(s: SparkSession, d: str, facets: dict[str, str] | None = None) -> DataFrame:
    return retrieval.hybrid(facts(s, d), episodes(s, d), VECTOR, TEXT, F.expr(NOW), 15, facets).select("fact", "sem", "exact", "external", "stale", "verified", "usage", "score")


def graph_of(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return view(s, d, "f_entities"), view(s, d, "f_facts")


def backing_detail(s: SparkSession, d: str) -> DataFrame:
    """Live backing of the facts that a search text hits."""
    hits = facts(s, d).where(F.lower("fact").contains(TEXT)).select("fact", F.explode("backing").alias("uuid")).distinct()
    live = hits.join(episodes(s, d).where("not archived"), "uuid")
    return live.groupBy("fact").agg(F.count(F.lit(1)).alias("n"), F.array_join(F.array_sort(F.collect_list(F.concat_ws("/", "uuid", "name", "durability"))), ";").alias("backing"))


def timed(s: SparkSession, d: str) -> DataFrame:
    o = s.read.parquet(f"{d}/orders.parquet")
    return o.select("o_orderkey", F.col("o_orderdate").alias("valid_at"), F.when(F.col("o_orderkey") % 3 == 0, F.col("o_orderdate") + F.expr("interval 200 days")).alias("invalid_at"), F.col("o_orderdate").alias("created_at"), F.when(F.col("o_orderkey") % 7 == 0, F.col("o_orderdate") + F.expr("interval 400 days")).alias("expired_at"))


#: Legal edges of the fixture graph's four kinds.
FIXTURE_EDGES = {("Person", "Concept"): ("belongs_to",), ("Project", "Concept"): ("belongs_to",), ("Concept", "Concept"): ("occurred_in",), ("Tool", "Project"): ("depends_on",), ("Person", "Tool"): ("references",)}
#: Kinds that stand for the fixture's, so that legal and illegal combinations of the full table come up; a tenth is untyped.
KINDS = {"Person": "Observation", "Tool": "File", "Project": "Project", "Concept": "Session"}


def typed_entities(s: SparkSession, d: str) -> DataFrame:
    kind = F.element_at(F.create_map(*(F.lit(x) for pair in KINDS.items() for x in pair)), F.col("label"))
    return view(s, d, "f_entities").withColumn("label", F.when(~F.col("uuid").endswith("7"), kind))


#: Of the drawn chains.
SEED = 7
#: Least cosine of entities that count as one.
NEAR_ENOUGH = 0.92


def respelt(s: SparkSession, d: str) -> DataFrame:
    """Every embedding as four entities of its label: itself, an equal copy, and two with some of their numbers changed."""
    v = s.read.parquet(f"{d}/embeddings.parquet").select("vec_id", "label", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("k"), "embedding")
    changed = F.transform("embedding", lambda x, i: x.cast("double") * F.when((F.col("k") > 1) & (i % 8 == F.col("k")), 0.5).otherwise(1.0))
    return v.select((F.col("vec_id") * 4 + F.col("k")).alias("uuid"), "label", changed.alias("embedding"))


QUERIES = {
    "vector_topk": lambda s, d: retrieval.vector_top(facts(s, d), VECTOR, 20).select("edge_id", "similarity"),
    "substring_search": lambda s, d: retrieval.substring_leg(facts(s, d), TEXT.upper(), 60).select("fact"),
    "hybrid_search": hybrid,
    "facet_search": lambda s, d: hybrid(s, d, {"durabilities": "evergreen", "kinds": "项目事实"}),
    "retired_facts": lambda s, d: retrieval.backed(facts(s, d).select("fact").distinct(), facts(s, d), episodes(s, d)).groupBy("external", "stale", "verified").agg(F.count(F.lit(1)).alias("n"), F.sum("usage").cast("bigint").alias("usage")),
    "fulltext_bm25": lambda s, d: episode_index(s, d).bm25(["the", "of", "que"], 25),
    "episode_search": lambda s, d: retrieval.episode_search(view(s, d, "f_episodes"), "the que", 8, tiered=True, index=episode_index(s, d)),
    "episode_search_fallback": lambda s, d: retrieval.episode_search(view(s, d, "f_episodes"), "capsule-1", 15, index=episode_index(s, d)),
    "browse_text": lambda s, d: retrieval.browse(view(s, d, "f_episodes"), "der", index=episode_index(s, d)),
    "browse_recent": lambda s, d: retrieval.browse(view(s, d, "f_episodes"), None, created="n").drop("score"),
    "context_fill": lambda s, d: context_fill(s, d),
    "context_full": lambda s, d: retrieval.context(view(s, d, "f_episodes").withColumn("scope", F.lit("global")), "the", 3),
    "fact_quality": lambda s, d: graph.fact_quality(view(s, d, "f_fact_texts")),
    "entity_components": lambda s, d: graph.resolved(vectors(s, d), graph.connecting(vectors(s, d), F.col("label"), "embedding", 0.35)),
    "merged_facts": lambda s, d: graph.merged(vectors(s, d).select(F.col("uuid").alias("src"), (F.col("uuid") * 7 % 400).alias("dst"), F.lit("near").alias("name")), graph.resolved(vectors(s, d), graph.connecting(vectors(s, d), F.col("label"), "embedding", 0.35))),
    "blast_radius": lambda s, d: graph.impact(view(s, d, "f_episodes").select(F.concat(F.lit("obs-"), F.col("n").cast("string")).alias("name")), view(s, d, "f_episodes"), mentions(s, d)),
    "verbose_backing": backing_detail,
    "graph_stats": lambda s, d: graph.totals(*graph_of(s, d), view(s, d, "f_episodes")),
    "node_types": lambda s, d: graph.node_types(graph_of(s, d)[0]),
    "edge_types": lambda s, d: graph.edge_types(graph_of(s, d)[1]),
    "edge_case_variants": lambda s, d: graph.case_variants(graph_of(s, d)[1]),
    "edge_names_normalised": lambda s, d: graph.normalised(graph_of(s, d)[1]).groupBy("name").agg(F.count(F.lit(1)).alias("n")),
    "degree_buckets": lambda s, d: graph.degrees(*graph_of(s, d)).groupBy(graph.degree_bucket(F.col("degree")).alias("bucket")).agg(F.count(F.lit(1)).alias("n")),
    "orphans": lambda s, d: graph.degrees(graph_of(s, d)[0], graph_of(s, d)[1], mentions(s, d)).agg(F.count(F.lit(1)).alias("entities"), F.count_if(F.col("degree") == 0).alias("orphans"), F.count_if(F.col("degree") == 1).alias("singletons")),
    "hubs": lambda s, d: graph.degrees(*graph_of(s, d)).orderBy(F.desc("degree"), "name", "uuid").limit(15),
    "neighbors": lambda s, d: graph.neighbours(*graph_of(s, d), "Supplier#000000001", 20),
    "paths": lambda s, d: walks.paths(*graph_of(s, d), source_name(s, d), region_name(s, d), 4, 10),
    "paths_long": lambda s, d: walks.paths(*graph_of(s, d), source_name(s, d), region_name(s, d), 6, 3000),
    "chains": lambda s, d: walks.chains(graph_of(s, d)[1], 4, 6, 40),
    "chains_drawn": lambda s, d: walks.drawn_chains(graph_of(s, d)[1], 4, 6, 20, SEED),
    "legal_pairs": lambda s, d: graph.illegal(*graph_of(s, d), FIXTURE_EDGES),
    "neighbor_facts": lambda s, d: graph.neighbours(view(s, d, "f_entities"), view(s, d, "f_fact_texts"), "Supplier#000000001", 20, rows_without=True),
    "neighbor_none": lambda s, d: graph.neighbours(view(s, d, "f_entities"), view(s, d, "f_fact_texts"), "no such name", 20, rows_without=True),
    "entity_hashing": lambda s, d: graph.resolved(respelt(s, d), resolution.hashed_links(respelt(s, d), F.col("label"), "embedding", NEAR_ENOUGH)),
    "legal_edges": lambda s, d: graph.illegal(typed_entities(s, d), view(s, d, "f_facts")),
    "as_of": lambda s, d: graph.as_of(timed(s, d), F.expr("timestamp'1995-06-01 00:00:00'")).agg(F.count(F.lit(1)).alias("n"), F.min("o_orderkey").alias("first"), F.sum("o_orderkey").alias("keys")),
    "remove_episode": lambda s, d: graph.without_episode(facts(s, d), view(s, d, "f_episodes").where("n % 3 = 0").select("uuid")),
    "mentions_left": lambda s, d: graph.without_mentions(mentions(s, d), view(s, d, "f_episodes").where("n % 3 = 0").select("uuid")).groupBy("dst").agg(F.count(F.lit(1)).alias("n")),
    "entity_resolution": lambda s, d: graph.resolve_entities(s.read.parquet(f"{d}/embeddings.parquet").select(F.col("vec_id").alias("uuid"), "label", "embedding"), F.col("label"), "embedding", 0.3),
}


def vectors(s: SparkSession, d: str) -> DataFrame:
    return s.read.parquet(f"{d}/embeddings.parquet").select(F.col("vec_id").alias("uuid"), "label", "embedding")


def context_fill(s: SparkSession, d: str) -> DataFrame:
    """A context of which the first pass fills two places: all other canonical episodes belong to other projects."""
    e = view(s, d, "f_episodes").withColumn("scope", F.when(F.col("n").isin(10, 20), "global").otherwise("project:other"))
    e = e.withColumn("name", F.when(F.col("n").isin(10, 20) | ~F.col("name").startswith("canonical"), F.col("name")).otherwise(F.concat(F.lit("note-"), F.col("n").cast("string"))))
    return retrieval.context(e, "que", 5)


def mentions(s: SparkSession, d: str) -> DataFrame:
    return s.read.parquet(f"{d}/orders.parquet").select(F.concat(F.lit("ep-"), F.col("o_orderkey").cast("string")).alias("src"), F.concat(F.lit("C"), F.col("o_custkey").cast("string")).alias("dst"))


def source_name(s: SparkSession, d: str) -> str:
    return "Customer#00000001"


def region_name(s: SparkSession, d: str) -> str:
    return "ASIA"


_F, _G, _E = with_views("f_search"), with_views("f_entities", "f_facts"), with_views("f_episodes")
_FE = with_views("f_search", "f_episodes")
_COS = "round(list_dot_product(embedding::double[], {v}) / (sqrt(list_dot_product(embedding::double[], embedding::double[])) * {n}), 6)".format(v="[" + ", ".join(map(repr, VECTOR)) + "]::double[]", n=repr(sum(x * x for x in VECTOR) ** 0.5))
_KIND = "case when name like 'canonical-%' then '手册' else case lower(nullif(regexp_extract(source_description, 'type=(\\S+)', 1), '')) when 'decision' then '决策' when 'bugfix' then '事故' when 'feature' then '项目事实' when 'discovery' then '项目事实' else 'unclassified' end end"


def _hybrid(where: str) -> str:
    return _FE + f""",
 near as (select edge_id, fact, {_COS} as similarity from f_search order by similarity desc, edge_id limit 60),
 sem as (select fact, round(1 - max(rank) / greatest(any_value(n), 1), 6) as sem from (select fact, row_number() over (order by similarity desc, edge_id) - 1 as rank, count(*) over () as n from near) group by fact),
 sub as (select distinct fact from f_search where contains(lower(fact), '{TEXT}') order by fact limit 60),
 c as (select coalesce(sem.fact, sub.fact) as fact, coalesce(sem, 0) as sem, sub.fact is not null as exact from sem full join sub on sem.fact = sub.fact),
 e as (select uuid, archived, coalesce(provenance like 'external%', false) as ext, durability, coalesce(verified, false) as verified, usage_count, n % 60 as day, {_KIND} as kind from f_episodes),
 p as (select distinct fact, unnest([ep1, ep2]) as uuid from f_search),
 k as (select fact, count(*) as known, count(*) filter (not archived) as live, count(*) filter (not archived and ext) as ne, count(*) filter (not archived and durability = 'time-bound') as ns, coalesce(bool_or(verified) filter (not archived), false) as verified, max(usage_count) filter (not archived) as usage, max(day) filter (not archived) as day,
  coalesce(bool_or(durability = 'evergreen') filter (not archived), false) as f1, coalesce(bool_or(kind = '项目事实') filter (not archived), false) as f2 from p join e using (uuid) group by fact),
 r as (select c.fact, sem, exact, coalesce(live, 0) > 0 and ne = live as external, coalesce(live, 0) > 0 and ns = live as stale, coalesce(verified, false) as verified, coalesce(usage, 0)::bigint as usage, 40 - day as age, coalesce(f1, false) as f1, coalesce(f2, false) as f2 from c left join k using (fact) where not (coalesce(known, 0) > 0 and coalesce(live, 0) = 0)),
 z as (select *, round(sem + case when exact then 0.15 else 0 end - case when external then 0.12 else 0 end - case when stale then 0.08 else 0 end + case when verified then 0.08 else 0 end + 0.01 * least(usage, 10) + case when age <= 30 then 0.05 when age > 365 then -0.03 else 0 end, 6) as score from r)
select fact, sem::double as sem, exact, external, stale, verified, usage, score::double as score from z {where} order by score desc, fact limit 15"""


def _paths(hops: int, most: int) -> str:
    return _G.replace("with ", "with recursive ", 1) + f", g as (select distinct src, dst from f_facts where src <> dst), w as (select uuid as at_node, [uuid] as path, 0 as hops from f_entities where contains(name, 'Customer#00000001') union all select g.dst, list_append(path, g.dst), hops + 1 from w join g on g.src = w.at_node where hops < {hops} and not list_contains(path, g.dst)) select hops, array_to_string(path, '>') as names from w where hops > 0 and at_node in (select uuid from f_entities where contains(name, 'ASIA')) order by hops, names limit {most}"


def _race(weight: str, *of: str) -> str:
    key = " || '|' || ".join((f"'{SEED}'", *of))
    return f"-ln((('0x' || substr(md5({key}), 1, 13))::bigint + 0.5) / 4503599627370496.0::double) / ({weight})::double"


def _drawn(least: int, most: int, k: int) -> str:
    """The same draws in plain SQL: walk counts hop by hop, then one edge a step by the same races."""
    out = _G + ", g as materialized (select distinct src, dst from f_facts where src <> dst), c1 as materialized (select src as uuid, 1 as hops, count(*)::hugeint as walks from g group by 1)"
    for j in range(2, most + 1):
        out += f", c{j} as materialized (select g.src as uuid, {j} as hops, sum(walks)::hugeint as walks from g join c{j - 1} on uuid = dst group by 1)"
    out += ", c as materialized (" + " union all ".join(f"select * from c{j}" for j in range(1, most + 1)) + " union all select distinct dst, 0, 1::hugeint from g)"
    out += f", d0 as materialized (select uuid as first, hops, {_race('walks', 'uuid', 'hops')} as race, [uuid] as path from c where hops >= {least} order by race, uuid, hops limit {8 * k})"
    for i in range(1, most + 1):
        r = _race("c.walks", "first", "d.hops", f"'{i}'", "g.dst")
        out += f", d{i} as materialized (select first, hops, any_value(race) as race, list_append(any_value(path), arg_min(dst, (r, dst))) as path from (select first, d.hops, race, path, g.dst, {r} as r from d{i - 1} d join g on g.src = d.path[-1] join c on c.uuid = g.dst and c.hops = d.hops - {i} where d.hops >= {i} and not list_contains(path, g.dst)) group by 1, 2 union all select * from d{i - 1} where hops < {i})"
    return out + f", z as (select first, path[-1] as last, hops, array_to_string(path, '>') as names, race, row_number() over (partition by first, path[-1] order by race, hops) as n from d{most}) select first, last, hops, names from z where n = 1 order by race, first, last limit {k}"


_BM = ", ".join(f"len(list_filter(t, lambda x: x = '{w}')) as tf{i}" for i, w in enumerate(("the", "of", "que")))
_LIVE = ", l as (select uuid, name, list_filter(regexp_split_to_array(lower(content), '[^\\p{L}\\p{N}_]+'), lambda x: x <> '') as t from f_episodes where not archived)"


def _bm25(words: tuple[str, ...], k: int) -> str:
    n = range(len(words))
    tf = ", ".join(f"len(list_filter(t, lambda x: x = '{w}')) as tf{i}" for i, w in enumerate(words))
    score = " + ".join(f"ln(1 + (n - df{i} + 0.5) / (df{i} + 0.5)) * tf{i} * 2.2 / (tf{i} + 1.2 * (0.25 + 0.75 * dl / mean))" for i in n)
    return _E + _LIVE + f", s as (select uuid, name, len(t) as dl, {tf} from l), g as (select count(*) as n, avg(dl) as mean, {', '.join(f'count(*) filter (tf{i} > 0) as df{i}' for i in n)} from s), b as (select uuid, name, round({score}, 6)::double as score from s, g where {' or '.join(f'tf{i} > 0' for i in n)} order by score desc, uuid limit {k})"


_DEG = ", d as (select uuid, name, (select 0) as z from f_entities), t as (select unnest(case when src = dst then [src] else [src, dst] end) as uuid from f_facts), g as (select uuid, count(*) as degree from t group by 1), x as (select e.uuid, e.name, coalesce(degree, 0) as degree from f_entities e left join g using (uuid))"
_DECLARED = "coalesce(nullif(regexp_extract(source_description, 'type=(\\S+)', 1), ''), '?')"
_WEIGHT = "case type " + " ".join(f"when '{k}' then {v}" for k, v in config.TIER_WEIGHTS.items()) + " else 1.0 end"
_OPS, _KNOW = "type in ('bugfix','change','feature','refactor')", "type in ('decision','security_note','security_alert')"
#: The best n of w by tscore with one place for an operational one.
_FLOOR = "r as (select *, row_number() over (order by tscore desc, uuid)::int as place from w), x as (select count(*) filter (place <= {n} and " + _OPS + ") as held, min(place) filter (place > {n} and " + _OPS + ") as spare, max(place) filter (place <= {n} and not " + _KNOW + ") as lowest from r), k as (select r.*, case when held = 0 and spare is not null and lowest is not null then (place <= {n} and place <> lowest) or place = spare else place <= {n} end as kept from r, x)"
_LINE = "replace(trim(substring(e.content, 1, 4000)), chr(10), ' ')"
_BADGES = f"case when e.name like 'capsule-%' then 'capsule' else coalesce(nullif(regexp_extract(source_description, 'type=(\\S+)', 1), ''), 'obs') end as type, coalesce(nullif(regexp_extract(source_description, 'project=(\\S+)', 1), ''), '—') as project, replace(replace(replace(substring({_LINE}, 1, 400), '&', '&amp;'), '<', '&lt;'), '>', '&gt;') || case when length({_LINE}) > 400 then '…' else '' end as snippet"
_CONTEXT = _bm25(("que",), 9).removeprefix(_E).replace("from f_episodes where not archived)", "from f_episodes where not archived and name not in (select name from c))").replace(", l as", """,
 c as (select uuid, name, usage_count as uc, round(ln(1 + ((length(lower(content)) - length(replace(lower(content), 'que', ''))) // 3)), 6) as score from f_episodes where name like 'canonical%' and not archived),
 c2 as (select *, row_number() over (order by score desc, uc, name, uuid)::int as place from c), l as""", 1) + f""",
 i as (select b.uuid, b.name, {_DECLARED} as type, score from b join f_episodes e using (uuid)), w as (select *, round(score * {_WEIGHT}, 6) as tscore from i), {_FLOOR.format(n=3)}
select uuid, name, score::double as score, place, 'canonical' as source from c2 union all select uuid, name, score, (2 + row_number() over (order by place))::int, 'fulltext' from k where kept"""
_ROOTS = "with recursive v as (select vec_id as uuid, label, embedding::double[] as v from embeddings), l as (select x.uuid as a, y.uuid as b from v x join v y on x.label = y.label and x.uuid <> y.uuid where list_dot_product(x.v, y.v) >= 0.35 * sqrt(list_dot_product(x.v, x.v)) * sqrt(list_dot_product(y.v, y.v))), c as (select uuid, uuid as root from v union select l.b, c.root from c join l on l.a = c.uuid), roots as (select uuid, min(root) as root from c group by 1)"
_TYPED = ", k as (select uuid, case when uuid like '%7' then 'Entity' else case label " + " ".join(f"when '{a}' then '{b}'" for a, b in KINDS.items()) + " end end as label from f_entities)"
_RULES = ", ".join(f"('{a}', '{b}', '{e}')" for (a, b), names in config.LEGAL_EDGES.items() for e in names)

_NEAR = with_views("f_entities", "f_fact_texts").replace("{", "{{").replace("}", "}}") + """,
 m as (select name from f_entities where contains(name, '{0}') order by name = '{0}' desc, length(name), name, uuid limit 1), n as (select uuid, name from f_entities where name in (select name from m)),
 r as ((select n.name as node, e.name as neighbour, f.name as edge, 'out' as direction, e.uuid, f.fact from f_fact_texts f join n on f.src = n.uuid join f_entities e on e.uuid = f.dst order by e.name, f.name, e.uuid limit 20)
  union all (select n.name, e.name, f.name, 'in', e.uuid, f.fact from f_fact_texts f join n on f.dst = n.uuid join f_entities e on e.uuid = f.src order by e.name, f.name, e.uuid limit 20))
select * from r union all select null, null, null, null, null, null where not exists (from m)"""

ORACLES = {
    "vector_topk": _F + f"select edge_id, {_COS}::double as similarity from f_search order by similarity desc, edge_id limit 20",
    "substring_search": _F + f"select distinct fact from f_search where contains(lower(fact), '{TEXT}') order by fact limit 60",
    "hybrid_search": _hybrid(""),
    "facet_search": _hybrid("where f1 and f2"),
    "retired_facts": _FE + ", p as (select distinct fact, unnest([ep1, ep2]) as uuid from f_search), k as (select fact, count(e.uuid) as known, count(*) filter (not archived) as live, count(*) filter (not archived and provenance like 'external%') as ne, count(*) filter (not archived and durability = 'time-bound') as ns, coalesce(bool_or(verified) filter (not archived), false) as verified, coalesce(max(usage_count) filter (not archived), 0) as usage from p left join f_episodes e using (uuid) group by fact) select live > 0 and ne = live as external, live > 0 and ns = live as stale, verified, count(*) as n, sum(usage)::bigint as usage from k where not (known > 0 and live = 0) group by 1, 2, 3",
    "fulltext_bm25": _bm25(("the", "of", "que"), 25) + " select uuid, score from b",
    "episode_search": _bm25(("the", "que"), 24) + f", i as (select b.uuid, b.name, {_DECLARED} as type, score, substring(e.content, 1, 600) as preview from b join f_episodes e using (uuid)), w as (select *, round(score * {_WEIGHT}, 6) as tscore from i), {_FLOOR.format(n=8)} select uuid, name, type, score, preview, place from k where kept",
    "episode_search_fallback": _bm25(("capsule-1",), 15) + f", i as (select uuid, name, score from b union all (select uuid, name, 0.0::double from f_episodes where not archived and (contains(content, 'capsule-1') or contains(name, 'capsule-1')) and not exists (select 1 from b) order by uuid limit 15)) select i.uuid, i.name, {_DECLARED} as type, i.score, substring(e.content, 1, 600) as preview, row_number() over (order by i.score desc, i.uuid)::int as place from i join f_episodes e using (uuid)",
    "browse_text": _bm25(("der",), 30) + f" select b.uuid, b.name, {_BADGES}, b.score from b join f_episodes e using (uuid)",
    "browse_recent": _E + f", e as (select * from f_episodes where not archived and name not like 'canonical-%' order by n desc, uuid limit 25) select uuid, name, {_BADGES} from e",
    "context_fill": _E.replace("f_episodes as", "f_all as", 1) + ", f_episodes as (select * replace (case when n in (10, 20) or name not like 'canonical%' then name else 'note-' || n end as name) from f_all)" + _CONTEXT,
    "context_full": _E + ", c as (select uuid, name, usage_count as uc, round(ln(1 + ((length(lower(content)) - length(replace(lower(content), 'the', ''))) // 3)), 6) as score from f_episodes where name like 'canonical%' and not archived), r as (select *, row_number() over (order by score desc, uc, name, uuid) as rn from c), x as (select * from r where rn >= 3 order by uc, rn limit 1) select uuid, name, score::double as score, rn::int as place, 'canonical' as source from r where rn < 3 union all select uuid, name, score::double, 3, 'canonical' from x",
    "fact_quality": with_views("f_fact_texts") + ", c as (select count(*) as total, count(*) filter (contains(fact, 'belongs to the') or contains(fact, 'references the') or contains(fact, 'documents that') or contains(fact, 'was extracted from')) as metadata_like from f_fact_texts) select *, round(100.0 * metadata_like / greatest(total, 1), 1)::double as percent from c",
    "entity_components": _ROOTS + " select * from roots",
    "merged_facts": _ROOTS + ", f as (select distinct a.root as src, b.root as dst, 'near' as name from embeddings e join roots a on a.uuid = e.vec_id join roots b on b.uuid = e.vec_id * 7 % 400) select * from f where src <> dst",
    "blast_radius": _E + ", m as (select 'ep-' || o_orderkey as uuid, count(*) as n from orders group by 1), k as (select name, coalesce(sum(m.n), 0)::bigint as mentions from f_episodes left join m using (uuid) group by 1) select 'obs-' || e.n as name, k.name is not null as exists, coalesce(mentions, 0) as mentions from f_episodes e left join k on k.name = 'obs-' || e.n",
    "verbose_backing": _FE + f", p as (select distinct fact, unnest([ep1, ep2]) as uuid from f_search where contains(lower(fact), '{TEXT}')) select fact, count(*) as n, string_agg(uuid || '/' || name || '/' || durability, ';' order by uuid || '/' || name || '/' || durability) as backing from p join f_episodes using (uuid) where not archived group by 1",
    "graph_stats": with_views("f_entities", "f_facts", "f_episodes") + ", c as (select (select count(*) from f_entities) as entities, (select count(*) from f_facts) as facts, (select count(*) from f_episodes) as episodes) select *, round(facts / greatest(entities, 1), 6) as facts_per_entity, round(facts / greatest(episodes, 1), 6) as facts_per_episode, round(entities / greatest(episodes, 1), 6) as entities_per_episode from c",
    "node_types": _G + "select label, count(*) as n from f_entities group by 1",
    "edge_types": _G + ", t as (select name, count(*) as n, lower(name) in ('references','depends_on','occurred_in','belongs_to','relates_to') as canonical from f_facts group by 1) select *, (select round(100.0 * coalesce(sum(n) filter (canonical), 0) / greatest(sum(n), 1), 6)::double from t) as aligned_percent from t",
    "edge_case_variants": _G + "select lower(name) as lowered, count(distinct name) as spellings, count(*) as n, array_to_string(list_sort(list(distinct name)), ',') as names from f_facts group by 1 having count(distinct name) > 1",
    "edge_names_normalised": _G + ", v as (select lower(name) as l from f_facts group by 1 having count(distinct name) > 1) select case when l is not null then l else name end as name, count(*) as n from f_facts left join v on v.l = lower(name) group by 1",
    "degree_buckets": _G + _DEG + "select case when degree = 0 then '0' when degree = 1 then '1' when degree <= 3 then '2-3' when degree <= 7 then '4-7' when degree <= 15 then '8-15' when degree <= 31 then '16-31' else '32+' end as bucket, count(*) as n from x group by 1",
    "orphans": _G + ", t as (select unnest(case when src = dst then [src] else [src, dst] end) as uuid from f_facts union all select 'C' || o_custkey from orders), g as (select uuid, count(*) as degree from t group by 1), x as (select coalesce(degree, 0) as degree from f_entities left join g using (uuid)) select count(*) as entities, count(*) filter (degree = 0) as orphans, count(*) filter (degree = 1) as singletons from x",
    "hubs": _G + _DEG + "select uuid, name, degree from x order by degree desc, name, uuid limit 15",
    "neighbors": _G + ", n as (select uuid, name from f_entities where name = (select name from f_entities where contains(name, 'Supplier#000000001') order by name = 'Supplier#000000001' desc, length(name), name, uuid limit 1)) (select n.name as node, e.name as neighbour, f.name as edge, 'out' as direction, e.uuid from f_facts f join n on f.src = n.uuid join f_entities e on e.uuid = f.dst order by e.name, f.name, e.uuid limit 20) union all (select n.name, e.name, f.name, 'in', e.uuid from f_facts f join n on f.dst = n.uuid join f_entities e on e.uuid = f.src order by e.name, f.name, e.uuid limit 20)",
    "paths": _paths(4, 10),
    "paths_long": _paths(6, 3000),
    "chains_drawn": _drawn(4, 6, 20),
    "chains": _G.replace("with ", "with recursive ", 1) + ", g as (select distinct src, dst from f_facts where src <> dst), w as (select dst as at_node, [src, dst] as path, 1 as hops from g union all select g.dst, list_append(path, g.dst), hops + 1 from w join g on g.src = w.at_node where hops < 6 and not list_contains(path, g.dst)) select path[1] as first, at_node as last, min(hops) as hops from w where hops >= 4 group by 1, 2 order by first, last limit 40",
    "legal_pairs": _G + "select s.label as src_label, t.label as dst_label, lower(f.name) as edge, count(*) as n from f_facts f join f_entities s on s.uuid = f.src join f_entities t on t.uuid = f.dst where (s.label, t.label, lower(f.name)) not in (('Person','Concept','belongs_to'), ('Project','Concept','belongs_to'), ('Concept','Concept','occurred_in'), ('Tool','Project','depends_on'), ('Person','Tool','references')) group by 1, 2, 3",
    "neighbor_facts": _NEAR.format("Supplier#000000001"),
    "neighbor_none": _NEAR.format("no such name"),
    # Entities of one embedding are near each other; pairs of others are looked for among all of the label.
    "entity_hashing": f"""with recursive e as (select vec_id * 4 + k as uuid, label, list_transform(embedding::double[], lambda x, i: x * case when k > 1 and (i - 1) % 8 = k then 0.5 else 1.0 end) as v from embeddings, (select unnest([0, 1, 2, 3]) as k)),
 n as (select uuid, label, v, sqrt(list_dot_product(v, v)) as l from e),
 p as (select x.uuid as a, y.uuid as b from n x join n y on x.label = y.label and x.uuid <> y.uuid where list_dot_product(x.v, y.v) >= {NEAR_ENOUGH} * x.l * y.l),
 r(uuid, root) as (select uuid, uuid from e union select p.b, r.root from r join p on p.a = r.uuid)
select uuid, min(root) as root from r group by 1""",
    "legal_edges": _G + f"""{_TYPED} select s.label as src_label, t.label as dst_label, lower(f.name) as edge, count(*) as n from f_facts f join k s on s.uuid = f.src join k t on t.uuid = f.dst
 where not exists (from (values {_RULES}) as r(a, b, e) where r.a = s.label and r.b = t.label and r.e = lower(f.name)) group by 1, 2, 3""",
    "as_of": "select count(*) as n, min(o_orderkey) as first, sum(o_orderkey)::bigint as keys from orders where o_orderdate <= timestamp '1995-06-01' and (o_orderkey % 3 <> 0 or o_orderdate + interval 200 day > timestamp '1995-06-01') and (o_orderkey % 7 <> 0 or o_orderdate + interval 400 day > timestamp '1995-06-01')",
    "remove_episode": _F + ", p as (select distinct edge_id, unnest([ep1, ep2]) as uuid from f_search), g as (select 'ep-' || doc_id as uuid from documents where doc_id % 3 = 0) select edge_id, string_agg(uuid, ',' order by uuid) as backing from p where uuid not in (select uuid from g) group by 1",
    "mentions_left": _E + " select 'C' || o_custkey as dst, count(*) as n from orders where 'ep-' || o_orderkey not in (select uuid from f_episodes where n % 3 = 0) group by 1",
    "entity_resolution": "with v as (select vec_id as uuid, label, embedding::double[] as v from embeddings) select x.uuid as a, y.uuid as b from v x join v y on x.label = y.label and x.uuid < y.uuid where list_dot_product(x.v, y.v) >= 0.3 * sqrt(list_dot_product(x.v, x.v)) * sqrt(list_dot_product(y.v, y.v))",
}
