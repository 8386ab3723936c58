"""Queries of the gate with their checking SQL."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.config import GateConfig
from loomgraph.operators import gate
from loomgraph.sources.fixtures import view, with_views

#: Fixture texts never name docker and the like, so the noise words of the tests are common syllables.
NOISY = GateConfig(noise_enabled=True, noise_markers=("the", "la"), noise_keywords=("th", "en", "er"), noise_hits=2)


def observed(spark: SparkSession, d: str) -> DataFrame:
    return gate.with_platform(view(spark, d, "f_observations"), view(spark, d, "f_sessions"))


def decided(spark: SparkSession, d: str) -> DataFrame:
    return gate.decide(observed(spark, d), quota=3)


def _gate_sql(cfg: GateConfig, quota: int) -> str:
    def table(values: dict, default: object) -> str:
        return "case {} " + " ".join(f"when '{k}' then {v}" for k, v in values.items()) + f" else {default} end"

    def listed(values: tuple[str, ...]) -> str:
        return "(" + ", ".join(f"'{v}'" for v in values) + ")"

    size = "(case when json_valid({0}) and json_type({0}) = 'ARRAY' then json_array_length({0}) else 0 end)"
    nf, nm, nc = size.format("coalesce(facts, '')"), size.format("coalesce(files_modified, '')"), size.format("coalesce(concepts, '')")
    text = "lower(coalesce(title, '') || ' ' || coalesce(narrative, '') || ' ' || coalesce(facts, ''))"
    noise = f"type = 'bugfix' and ({' or '.join(f'contains({text}, {m!r})' for m in cfg.noise_markers)}) and ({' + '.join(f'contains({text}, {k!r})::int' for k in cfg.noise_keywords)}) >= {cfg.noise_hits}" if cfg.noise_enabled else "false"
    return with_views("f_observations", "f_sessions") + f""",
 o as (select f_observations.*, coalesce(platform_source, '_default') as platform, length(coalesce(narrative, '')) as ln, {nf} as nf, {nm} as nm, {nc} as nc from f_observations left join f_sessions using (memory_session_id)),
 s as (select *, ({table(cfg.type_weight, 0).format('type')} + least(ln, 800) / 20.0 + least(nf, 10) * 3 + least(nc, 8) * 2 + nm + least(coalesce(relevance_count, 0), 20) * 5)::double as raw,
  ({table(cfg.thresholds, cfg.default_threshold).format('platform')})::double as lim, {noise} as noise,
  case when type not in {listed(cfg.types)} then 'type' when ln < {cfg.least_narrative} and type <> 'security_alert' then 'narrative'
   when nf + nm < {cfg.least_facts_or_files} and ln < {cfg.substantive_narrative} and type <> 'security_alert' then 'facts'
   when {' or '.join(f"contains(lower(coalesce(generated_by_model, '')), '{m}')" for m in cfg.rejected_models)} then 'model' end as gate from o),
 l as (select *, case when gate is not null then 'hard_gate' when noise then 'ops_noise' when type in {listed(cfg.skip_threshold)} and type in {listed(cfg.skip_quota)} then 'override'
   when type in {listed(cfg.skip_threshold)} then 'override?' when raw < lim then 'score' when type in {listed(cfg.skip_quota)} then 'pass' else 'pass?' end as layer0 from s),
 q as (select *, row_number() over (partition by platform, project, type, layer0 like '%?' order by id) as used from l),
 d as (select id, project, type, platform, narrative, facts, files_modified, nf, nm, gate,
  case when layer0 like '%?' and {quota} > 0 and used > {quota} then 'quota' else replace(layer0, '?', '') end as layer,
  case when gate is not null then 0 when noise then raw - {float(cfg.noise_penalty)} else raw end::double as score,
  case when gate is not null then 0 when noise then greatest(lim, {float(cfg.noise_least_score)}) else lim end::double as threshold, raw from q),
 v as (select *, case when layer in ('override', 'pass') then true when layer = 'ops_noise' then score >= threshold else false end as would_accept from d)
"""


def filter_replay(spark: SparkSession, d: str) -> DataFrame:
    return gate.replay(observed(spark, d), replace(NOISY, noise_enabled=False), NOISY)


def quality_profile(spark: SparkSession, d: str) -> DataFrame:
    """Counts by bucket, rejects, thin rows, and the narrative's length with its quartiles (inclusive interpolation)."""
    rows = observed(spark, d)
    both = gate.decide(rows, NOISY, quota=0).select("id", "type", "narrative", "facts", "files_modified", "would_accept")
    sizes = F.char_length(F.coalesce("narrative", F.lit("")))
    return both.groupBy(gate.type_bucket(F.col("type")).alias("bucket")).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(~F.col("would_accept")).alias("rejected"),
        F.count_if(gate.is_thin()).alias("thin"),
        F.sum(sizes).cast("bigint").alias("narrative_chars"),
        F.percentile(sizes, 0.25).alias("p25_chars"),
        F.percentile(sizes, 0.5).alias("median_chars"),
        F.percentile(sizes, 0.75).alias("p75_chars"),
    )


QUERIES = {
    "gate_score": lambda s, d: observed(s, d).select("id", "platform", gate.score(GateConfig()).alias("score")),
    "gate_decisions": lambda s, d: gate.decide(observed(s, d), quota=0).select("id", "gate", "layer", "score", "threshold", "would_accept", "accept"),
    "gate_quota": lambda s, d: decided(s, d).select("id", "platform", "project", "type", "layer", "would_accept"),
    "ops_noise": lambda s, d: gate.decide(observed(s, d), NOISY, quota=0).where("layer = 'ops_noise'").select("id", "score", "threshold", "would_accept"),
    "decision_summary": lambda s, d: gate.summary(decided(s, d)),
    "decision_verdict": lambda s, d: gate.readiness(decided(s, d)),
    "decision_crosstab": lambda s, d: decided(s, d).groupBy("type").pivot("layer", ["hard_gate", "override", "score", "pass", "quota"]).agg(F.count(F.lit(1))).na.fill(0),
    "reject_counts": lambda s, d: decided(s, d).where("not would_accept").groupingSets([[F.col("layer")], [F.col("type")], [F.col("platform")], [F.col("project")]], "layer", "type", "platform", "project").agg(F.count(F.lit(1)).alias("n")),
    "score_histogram": lambda s, d: gate.histogram(decided(s, d)),
    "quality_profile": quality_profile,
    "thin_content": lambda s, d: observed(s, d).where(gate.is_thin()).select("id", "type", "project"),
    "filter_replay": filter_replay,
    "borderline": lambda s, d: decided(s, d).where("layer = 'score' and score >= 50 and score < 60").orderBy(F.desc("score"), "id").limit(10).select("id", "score"),
    "borderline_accepts": lambda s, d: decided(s, d).where("would_accept and score >= 60 and score < 70").orderBy("score", "id").limit(10).select("id", "score"),
    "lowest_rejects": lambda s, d: decided(s, d).where("not would_accept").orderBy("score", "id").limit(20).select("id", "layer", "score"),
    "type_bucket": lambda s, d: view(s, d, "f_observations").groupBy(gate.type_bucket(F.col("type")).alias("bucket")).agg(F.count(F.lit(1)).alias("n")),
    "density": lambda s, d: view(s, d, "f_observations").groupBy("project").agg(F.avg(F.char_length("narrative")).alias("mean_chars"), F.count_if((F.coalesce("facts", F.lit("")) != "") & (F.col("facts") != "[]")).alias("with_facts"), F.count(F.lit(1)).alias("n")),
    "source_profile": lambda s, d: observed(s, d).cube("platform", "type").agg(F.count(F.lit(1)).alias("n")),
    "daily_source_counts": lambda s, d: view(s, d, "f_observations").where(F.col("created_at_epoch") >= 1704067200000 + 14 * 86_400_000).groupBy(F.date_format(F.timestamp_millis("created_at_epoch"), "yyyy-MM-dd").alias("day")).agg(F.count(F.lit(1)).alias("n")),
    "capacity": lambda s, d: capacity(s, d),
}


def capacity(s: SparkSession, d: str) -> DataFrame:
    """The mean of the seven most recent days, scaled, against a capacity of 960 a day."""
    days = view(s, d, "f_observations").groupBy(F.to_date(F.timestamp_millis("created_at_epoch")).alias("day")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("day")).limit(7)
    mean = days.agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("days"))
    return mean.select("total", "days", F.explode(F.array(*(F.lit(float(x)) for x in (1, 3, 6, 10)))).alias("scale")).select("scale", (F.col("scale") * F.col("total") / F.col("days")).alias("per_day"), (F.col("scale") * F.col("total") / F.col("days") > 0.8 * 960).alias("over"))


_DECIDED, _OPEN = _gate_sql(GateConfig(), 3), _gate_sql(GateConfig(), 0)
_BAND = "case " + " ".join(f"when score < {top} then '{name}'" for name, top in gate.BANDS) + " else '150+' end"
_BUCKET = "case when type is null or type = '?' then '?' when type in ('decision','security_note','security_alert') then 'knowledge' when type in ('bugfix','change','feature','refactor') then 'operational' when type = 'discovery' then 'discovery' else 'other' end"
_OBS, _DAY = with_views("f_observations"), "strftime(make_timestamp(created_at_epoch * 1000), '%Y-%m-%d')"
ORACLES = {
    "gate_score": _OPEN + "select id, platform, raw as score from v",
    "gate_decisions": _OPEN + "select id, gate, layer, score, threshold, would_accept, would_accept as accept from v",
    "gate_quota": _DECIDED + "select id, platform, project, type, layer, would_accept from v",
    "ops_noise": _gate_sql(NOISY, 0) + "select id, score, threshold, would_accept from v where layer = 'ops_noise'",
    "decision_summary": _DECIDED + "select platform, layer, count(*) filter (would_accept) as accepted, count(*) filter (not would_accept) as rejected from v group by rollup (platform, layer)",
    "decision_verdict": _DECIDED + "select n, rejected, high_value_rejects, case when n >= 500 and 100 * rejected >= 20 * n and 100 * rejected <= 50 * n and high_value_rejects = 0 then 'READY' else 'NOT_READY' end as verdict from (select count(*) as n, count(*) filter (not would_accept) as rejected, count(*) filter (type in ('decision','security_note','security_alert') and layer = 'score') as high_value_rejects from v)",
    "decision_crosstab": _DECIDED + "select type, " + ", ".join(f"count(*) filter (layer = '{x}') as {x}" for x in ("hard_gate", "override", "score", "pass", "quota")) + " from v group by type",
    "reject_counts": _DECIDED + "select layer, type, platform, project, count(*) as n from v where not would_accept group by grouping sets ((layer), (type), (platform), (project))",
    "score_histogram": _DECIDED + ", b as (select unnest(['0-19','20-39','40-59','60-79','80-99','100-149','150+']) as band) select b.band, count(v.id) as n from b left join v on b.band = " + _BAND + " group by 1",
    "quality_profile": _gate_sql(NOISY, 0) + f"select {_BUCKET} as bucket, count(*) as n, count(*) filter (not would_accept) as rejected, count(*) filter (length(coalesce(narrative,'')) < 120 and nf + nm <= 1) as thin, sum(length(coalesce(narrative,'')))::bigint as narrative_chars, quantile_cont(length(coalesce(narrative,'')), 0.25)::double as p25_chars, quantile_cont(length(coalesce(narrative,'')), 0.5)::double as median_chars, quantile_cont(length(coalesce(narrative,'')), 0.75)::double as p75_chars from v group by 1",
    "thin_content": _OPEN + "select id, type, project from v where length(coalesce(narrative,'')) < 120 and nf + nm <= 1",
    "filter_replay": _gate_sql(replace(NOISY, noise_enabled=False), 0) + ", x as (" + _gate_sql(NOISY, 0) + "select id, would_accept as after, layer as layer_after from v) select v.id, v.type, v.would_accept as before, v.layer as layer_before, x.after, x.layer_after, case when x.after then 'newly_accepted' else 'newly_rejected' end as change from v join x using (id) where v.would_accept <> x.after",
    "borderline": _DECIDED + "select id, score from v where layer = 'score' and score >= 50 and score < 60 order by score desc, id limit 10",
    "borderline_accepts": _DECIDED + "select id, score from v where would_accept and score >= 60 and score < 70 order by score, id limit 10",
    "lowest_rejects": _DECIDED + "select id, layer, score from v where not would_accept order by score, id limit 20",
    "type_bucket": _OBS + f"select {_BUCKET} as bucket, count(*) as n from f_observations group by 1",
    "density": _OBS + "select project, avg(length(narrative)) as mean_chars, count(*) filter (coalesce(facts,'') not in ('', '[]')) as with_facts, count(*) as n from f_observations group by project",
    "source_profile": _OPEN + "select platform, type, count(*) as n from v group by cube (platform, type)",
    "daily_source_counts": _OBS + f"select {_DAY} as day, count(*) as n from f_observations where created_at_epoch >= 1704067200000 + 14 * 86400000 group by 1",
    "capacity": _OBS + f", t as (select sum(n) as total, count(*) as days from (select {_DAY} as day, count(*) as n from f_observations group by 1 order by day desc limit 7)) select scale::double as scale, (scale * total / days)::double as per_day, scale * total / days > 768 as over from t, (select unnest([1, 3, 6, 10]) as scale)",
}
