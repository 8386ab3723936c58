"""The admission gate: hard gates, score, overrides, quota, and the decision records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.config import DISCOVERY_TYPES, KNOWLEDGE_TYPES, OPERATIONAL_TYPES, GateConfig
from loomgraph.functions.columns import blank, json_list, looked_up


def with_platform(observations: DataFrame, sessions: DataFrame) -> DataFrame:
    """Observations with their session's platform; no session or no platform is ``_default``.

    A session that comes several times counts once; null sessions match none.
    """
    known = sessions.groupBy("memory_session_id").agg(F.max("platform_source").alias("platform_source"))
    return observations.join(known, "memory_session_id", "left").withColumn("platform", F.coalesce(F.nullif("platform_source", F.lit("")), F.lit("_default")))


def score_parts(cfg: GateConfig) -> dict[str, Column]:
    return {
        "type": looked_up(blank("type"), {k: float(v) for k, v in cfg.type_weight.items()}, F.lit(0.0)),
        "narrative": F.least(F.char_length(blank("narrative")), F.lit(800)) / 20.0,
        "facts": F.least(F.size(json_list("facts")), F.lit(10)) * 3.0,
        "concepts": F.least(F.size(json_list("concepts")), F.lit(8)) * 2.0,
        "files": F.size(json_list("files_modified")) * 1.0,
        "relevance": F.least(F.coalesce("relevance_count", F.lit(0)), F.lit(20)) * 5.0,
    }


def score(cfg: GateConfig) -> Column:
    """Weighted substance of an observation."""
    first, *others = score_parts(cfg).values()
    return sum(others, first)


def is_noise(cfg: GateConfig) -> Column:
    """A bug fix about the system's own running: a marker and enough keywords in title, narrative and facts.

    Without markers or without keywords nothing is noise.
    """
    text = F.lower(F.concat_ws(" ", blank("title"), blank("narrative"), blank("facts")))
    marked, hits = F.lit(False), F.lit(0)
    for m in cfg.noise_markers:
        marked = marked | text.contains(m.lower())
    for k in cfg.noise_keywords:
        hits = hits + text.contains(k.lower()).cast("int")
    return (blank("type") == "bugfix") & marked & (hits >= cfg.noise_hits) if cfg.noise_keywords and cfg.noise_markers else F.lit(False)


def _number(c: Column) -> Column:
    return c.cast("decimal(18,2)").cast("string")


def reasons(cfg: GateConfig) -> Column:
    """Why a decided row has its verdict, in the order of the checks; a security alert lists the gates it passed by."""
    narrative, listed = F.char_length(blank("narrative")), F.size(json_list("facts")) + F.size(json_list("files_modified"))
    layer, t = F.col("layer"), blank("type")
    known = t.isin(*cfg.types)
    thin = (listed < cfg.least_facts_or_files) & (narrative < cfg.substantive_narrative)
    open_ = F.col("gate").isNull()
    compared = lambda sign: F.concat(F.lit("score "), _number(F.col("score")), F.lit(f" {sign} "), _number(F.col("threshold")))
    parts = (
        F.when(~known, F.concat(F.lit("type '"), t, F.lit("' isn't admitted"))),
        F.when(known & (narrative < cfg.least_narrative), F.concat(F.lit("narrative of "), narrative.cast("string"), F.lit(f" characters, least {cfg.least_narrative}"))),
        F.when(known & thin & ((narrative >= cfg.least_narrative) | (t == "security_alert")), F.concat(F.lit("facts and files: "), listed.cast("string"), F.lit(f", least {cfg.least_facts_or_files}"))),
        F.when(F.col("gate") == "model", F.concat(F.lit("model "), F.lower(blank("generated_by_model")), F.lit(" is refused"))),
        F.when(open_ & (layer == "ops_noise"), F.lit("ops noise: penalised, no override")),
        F.when(open_ & (layer == "ops_noise"), F.when(F.col("score") >= F.col("threshold"), compared(">=")).otherwise(compared("<"))),
        F.when(open_ & t.isin(*cfg.skip_threshold) & (layer != "ops_noise"), F.concat(F.lit("type "), t, F.lit(" needs no threshold"))),
        F.when(layer == "quota", F.lit("quota used up")),
        F.when(layer == "score", compared("<")),
        F.when(layer == "pass", compared(">=")),
    )
    return F.array_compact(F.array(*parts))


def breakdown(cfg: GateConfig) -> Column:
    """The parts of the score by name."""
    return F.create_map(*(x for name, c in score_parts(cfg).items() for x in (F.lit(name), c.cast("double"))))


def hard_gate(cfg: GateConfig) -> Column:
    """The name of the first hard gate that rejects, or null."""
    narrative = F.char_length(blank("narrative"))
    alert = blank("type") == "security_alert"
    model = F.lower(blank("generated_by_model"))
    bad = F.lit(False)
    for m in cfg.rejected_models:
        bad = bad | model.contains(m)
    thin = (F.size(json_list("facts")) + F.size(json_list("files_modified")) < cfg.least_facts_or_files) & (narrative < cfg.substantive_narrative)
    return F.when(~blank("type").isin(*cfg.types), "type").when((narrative < cfg.least_narrative) & ~alert, "narrative").when(thin & ~alert, "facts").when(bad, "model")


def layers(observations: DataFrame, cfg: GateConfig) -> DataFrame:
    """Score, threshold and layer of every observation before quotas; layer ``quota?`` still needs one."""
    gate, s = F.col("gate"), F.col("raw_score")
    threshold = looked_up(F.col("platform"), {k: float(v) for k, v in cfg.thresholds.items()}, F.lit(float(cfg.default_threshold)))
    noise = is_noise(cfg) if cfg.noise_enabled else F.lit(False)
    t = blank("type")
    rows = observations.withColumns({"gate": hard_gate(cfg), "raw_score": score(cfg), "limit": threshold, "noise": noise})
    noise_limit = F.greatest(F.col("limit"), F.lit(float(cfg.noise_least_score)))
    layer = (
        F.when(gate.isNotNull(), "hard_gate")
        .when(F.col("noise"), "ops_noise")
        .when(t.isin(*cfg.skip_threshold) & t.isin(*cfg.skip_quota), "override")
        .when(t.isin(*cfg.skip_threshold), "override?")
        .when(s < F.col("limit"), "score")
        .when(t.isin(*cfg.skip_quota), "pass")
        .otherwise("pass?")
    )
    return rows.withColumns(
        {
            "layer": layer,
            "score": F.when(gate.isNotNull(), 0.0).when(F.col("noise"), s - float(cfg.noise_penalty)).otherwise(s),
            "threshold": F.when(gate.isNotNull(), 0.0).when(F.col("noise"), noise_limit).otherwise(F.col("limit")),
        }
    )


def decide(observations: DataFrame, cfg: GateConfig = GateConfig(), quota: int | None = None, day: Column | None = None, before: DataFrame | None = None) -> DataFrame:
    """One decision a row. Quotas admit the first rows by id of each (platform, project, type, day).

    ``quota`` replaces the configured quotas. Only rows that reach the quota layer count; 0 is no limit. ``before`` are
    decisions already made: what they admitted in that layer counts first. A rejection by quota isn't final.
    Rows of one id and key count once and share their verdict.
    """
    limit = F.lit(quota) if quota is not None else looked_up(F.col("platform"), cfg.quotas, F.lit(cfg.default_quota))
    most = quota if quota is not None else max((cfg.default_quota, *cfg.quotas.values()))
    keys = {"_k0": F.col("platform"), "_k1": F.coalesce(F.nullif("project", F.lit("")), F.lit("(unknown)")), "_k2": F.col("type"), "_k3": day if day is not None else F.lit(0)}
    rows = layers(observations, cfg)
    asking = rows.where(F.col("layer").endswith("?"))
    settled = F.rtrim(F.translate("layer", "?", ""))
    if most > 0:
        # Ranked without their texts, and cut at the largest quota before the shuffle: a hot key sends that many rows a task.
        ids = asking.select("id", limit.cast("bigint").alias("_limit"), F.coalesce("project", F.lit("")).alias("_project"), *(c.alias(k) for k, c in keys.items())).where("_limit > 0").distinct()
        first = ids.withColumn("_used", F.row_number().over(Window.partitionBy(*keys).orderBy("id"))).where(F.col("_used") <= most)
        if before is not None:
            took = F.col("layer").isin("pass", "override") & ~F.col("type").isin(*cfg.skip_quota)
            held = before.where(took).groupBy(F.col("platform").alias("_k0"), F.coalesce("project", F.lit("")).alias("_project"), F.col("type").alias("_k2")).agg(F.count(F.lit(1)).alias("_held"))
            first = first.join(held, ["_k0", "_project", "_k2"], "left").withColumn("_used", F.col("_used") + F.coalesce("_held", F.lit(0)))
        let_in = first.where("_used <= _limit").select(F.col("id").alias("_id"), *(F.col(k).alias(f"{k}_") for k in keys), F.lit(True).alias("_in"))
        same = F.col("id").eqNullSafe(F.col("_id"))
        for k, c in keys.items():
            same = same & c.eqNullSafe(F.col(f"{k}_"))
        waiting = asking.join(let_in, same, "left").withColumn("layer", F.when((limit > 0) & F.col("_in").isNull(), "quota").otherwise(settled)).select(*rows.columns)
    else:
        waiting = asking.withColumn("layer", settled)
    out = waiting.unionByName(rows.where(~F.col("layer").endswith("?")))
    would = F.when(F.col("layer").isin("override", "pass"), True).when(F.col("layer") == "ops_noise", F.col("score") >= F.col("threshold")).otherwise(False)
    return out.withColumn("would_accept", would).withColumn("accept", F.lit(True) if cfg.shadow else F.col("would_accept"))


#: What is kept of a quota between batches: rows so far and the day of the last one, by lane.
LANES = "platform string, project string, type string, lane int, rows bigint, last int"
_COUNTED = ("platform", "project", "type")


def scheduled(rows: DataFrame, lanes: DataFrame | None = None, cfg: GateConfig = GateConfig(), quota: int | None = None) -> DataFrame:
    """Rows with the day on which their quota lets them in: ``due`` is ``day`` or, while a day is full, a later one.

    rows: id, platform, project, type, day (date). A quota of q a day is q lanes of one row a day each: the rows of a
    key go through its lanes in turn, by day and id, and a row's day is the later of its own and the day after the one
    before it in its lane. So what a key has deferred needs no list: a lane's number of rows and last day (``lanes``,
    see LANES) say it all, and lanes of one hot key are worked in parallel. Null keys are the empty string; a quota of 0
    is none. Adds lane and step.
    """
    slim = rows.withColumns({c: F.coalesce(F.col(c), F.lit("")) for c in _COUNTED})
    limit = F.lit(quota) if quota is not None else looked_up(F.col("platform"), cfg.quotas, F.lit(cfg.default_quota))
    slim = slim.withColumns({"_limit": limit.cast("bigint"), "_day": F.datediff("day", F.lit("1970-01-01").cast("date"))})
    lanes = rows.sparkSession.createDataFrame([], LANES) if lanes is None else lanes
    before = lanes.groupBy(*_COUNTED).agg(F.sum("rows").alias("_n"))
    number = F.coalesce("_n", F.lit(0)) + F.row_number().over(Window.partitionBy(*_COUNTED).orderBy("day", "id")) - 1
    free = F.col("_limit") <= 0
    placed = slim.join(before, list(_COUNTED), "left").withColumn("_i", number)
    placed = placed.withColumns({"lane": F.when(~free, F.col("_i") % F.col("_limit")).cast("int"), "step": F.when(~free, F.floor(F.col("_i") / F.col("_limit")))}).drop("_n")
    held = lanes.select(*_COUNTED, "lane", F.col("rows").alias("_rows"), F.col("last").alias("_last"))
    own = F.max(F.col("_day") - F.col("step")).over(Window.partitionBy(*_COUNTED, "lane").orderBy("_i"))
    due = F.when(F.col("lane").isNull(), F.col("_day")).otherwise(F.greatest(own, F.col("_last") + 1 - F.col("_rows")) + F.col("step"))
    out = placed.join(held, [*_COUNTED, "lane"], "left").withColumn("_due", due.cast("int"))
    return out.withColumn("due", F.date_add(F.lit("1970-01-01").cast("date"), F.col("_due"))).drop("_i", "_limit", "_day", "_rows", "_last", "_due")


def lanes_after(decided: DataFrame, lanes: DataFrame | None = None) -> DataFrame:
    """The lanes after the rows of ``scheduled``."""
    taken = decided.where("lane is not null").select(*_COUNTED, "lane", F.lit(1).cast("bigint").alias("rows"), F.datediff("due", F.lit("1970-01-01").cast("date")).alias("last"))
    every = taken if lanes is None else taken.unionByName(lanes)
    return every.groupBy(*_COUNTED, "lane").agg(F.sum("rows").alias("rows"), F.max("last").alias("last"))


def type_bucket(t: Column) -> Column:
    """knowledge, operational, discovery, ``?`` without a type, or other."""
    return F.when(t.isNull() | (t == "?"), "?").when(t.isin(*KNOWLEDGE_TYPES), "knowledge").when(t.isin(*OPERATIONAL_TYPES), "operational").when(t.isin(*DISCOVERY_TYPES), "discovery").otherwise("other")


def is_thin(narrative: str = "narrative") -> Column:
    return (F.char_length(blank(narrative)) < 120) & (F.size(json_list("facts")) + F.size(json_list("files_modified")) <= 1)


#: Half-open score bands; negatives fall in the first.
BANDS = (("0-19", 20), ("20-39", 40), ("40-59", 60), ("60-79", 80), ("80-99", 100), ("100-149", 150))


def band(s: Column) -> Column:
    out = None
    for name, top in BANDS:
        out = F.when(s < top, name) if out is None else out.when(s < top, name)
    return out.otherwise("150+")


def histogram(decisions: DataFrame) -> DataFrame:
    """Decisions by score band, bands without any included."""
    names = decisions.sparkSession.createDataFrame([(n,) for n, _ in BANDS] + [("150+",)], "band string")
    counts = decisions.groupBy(band(F.col("score")).alias("band")).agg(F.count(F.lit(1)).alias("n"))
    return F.broadcast(names).join(counts, "band", "left").select("band", F.coalesce("n", F.lit(0)).cast("bigint").alias("n"))


def summary(decisions: DataFrame) -> DataFrame:
    """Accepts and rejects by platform and layer, with subtotals (null) from one rollup."""
    return decisions.rollup("platform", "layer").agg(F.count_if("would_accept").alias("accepted"), F.count_if(~F.col("would_accept")).alias("rejected"))


def readiness(decisions: DataFrame) -> DataFrame:
    """READY if there are 500 decisions, 20 to 50 percent rejects and no high-value rejects by score."""
    high = F.col("type").isin(*KNOWLEDGE_TYPES)
    c = decisions.agg(F.count(F.lit(1)).alias("n"), F.count_if(~F.col("would_accept")).alias("rejected"), F.count_if(high & (F.col("layer") == "score")).alias("high_value_rejects"))
    ready = (F.col("n") >= 500) & (100 * F.col("rejected") >= 20 * F.col("n")) & (100 * F.col("rejected") <= 50 * F.col("n")) & (F.col("high_value_rejects") == 0)
    return c.withColumn("verdict", F.when(ready, "READY").otherwise("NOT_READY"))


def replay(observations: DataFrame, current: GateConfig, candidate: GateConfig) -> DataFrame:
    """Both configurations over one scan: rows whose verdict changes, without quotas."""
    now = decide(observations, current, quota=0).select("id", "type", F.col("would_accept").alias("before"), F.col("layer").alias("layer_before"))
    then = decide(observations, candidate, quota=0).select("id", F.col("would_accept").alias("after"), F.col("layer").alias("layer_after"))
    return now.join(then, "id").where("before <> after").withColumn("change", F.when(F.col("after"), "newly_accepted").otherwise("newly_rejected"))
