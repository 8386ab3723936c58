"""Canonical context, tiers, usage lists: what is shown first."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph import config
from loomgraph.functions.columns import blank, declared, looked_up, occurrences
from loomgraph.operators.windows import prefixed, segmented


def scored_canonical(episodes: DataFrame, keyword: str, scopes: Mapping[str, str] | None = None, carry: Sequence[str] = ()) -> DataFrame:
    """Live canonical episodes eligible for a keyword, with hits and relevance.

    Global scope, a mention, or the keyword's own project make one eligible; its own project adds, another's subtracts.
    """
    own = f"project:{keyword}"
    scope = F.coalesce(F.nullif("scope", F.lit("")), looked_up(F.col("name"), dict(scopes)) if scopes else F.lit(None).cast("string"), F.lit("global"))
    hits = occurrences(F.lower(blank("content")), keyword.lower())
    rows = episodes.where(F.col("name").startswith(config.CANONICAL_PREFIX.rstrip("-")) & ~F.coalesce("archived", F.lit(False)))
    rows = rows.select("uuid", "name", F.coalesce("usage_count", F.lit(0)).alias("uc"), scope.alias("scope"), hits.alias("hits"), *carry)
    rows = rows.where((F.col("scope") == "global") | (F.col("hits") > 0) | (F.col("scope") == own))
    bonus = F.when(F.col("scope") == own, config.SCOPE_BONUS).when(F.col("scope").startswith("project:"), config.SCOPE_PENALTY).otherwise(0.0)
    return rows.withColumn("relscore", F.round(F.log1p("hits") + bonus, 6))


def canonical_context(episodes: DataFrame, keyword: str, top: int = 3, scopes: Mapping[str, str] | None = None, carry: Sequence[str] = ()) -> DataFrame:
    """The best ``top`` canonical episodes; the last place goes to the least used of the rest (upper confidence bound).

    The candidates are counted in one aggregate and ranked by top-k sorts; no window over all rows is needed. Rows of
    one uuid are taken as they are ranked, each for itself. Columns to ``carry`` come along.
    """
    rows = scored_canonical(episodes, keyword, scopes, carry)
    total = rows.agg(F.count(F.lit(1)).alias("candidates"), F.sum("uc").alias("used"))
    ranked = rows.orderBy(F.desc("relscore"), "uc", "name", "uuid")
    head = ranked.limit(top).select("*", F.row_number().over(Window.orderBy(F.desc("relscore"), "uc", "name", "uuid")).alias("place")).withColumn("reason", F.lit("relevance"))
    if top < 2:
        return head
    # Beyond the relevance places the bound falls with use alone: its maximum is the least used, first in rank order.
    fixed = head.where(F.col("place") < top)
    unused = ["uc", F.desc("relscore"), "name", "uuid"]
    # Of the ``top`` least used ones at least one isn't fixed.
    rest = rows.orderBy(*unused).limit(top).exceptAll(fixed.select(*rows.columns)).orderBy(*unused).limit(1)
    explored = rest.crossJoin(F.broadcast(total)).withColumns({"place": F.lit(top), "reason": F.when(F.col("candidates") > top, "explore").otherwise("relevance")}).drop("candidates", "used")
    return fixed.unionByName(explored)


def canonical_grid(episodes: DataFrame, keywords: list[str], scopes: Mapping[str, str] | None = None) -> DataFrame:
    """Relevance ranks of all eligible canonical episodes for some fixed keywords; the first three are injected.

    Ranks are running counts by segments, so that a keyword's rows are ranked in many tasks.
    """
    out = None
    for k in keywords:
        rows = scored_canonical(episodes, k, scopes).withColumn("keyword", F.lit(k))
        out = rows if out is None else out.unionByName(rows)
    order = ["_down", "uc", "name", "uuid"]
    cut = segmented(out.withColumn("_down", -F.col("relscore")), ["keyword"], order)
    ranked = prefixed(cut, ["keyword"], order, counts={"place": F.lit(True)}).drop("_down", "_segment")
    return ranked.withColumn("injected", F.col("place") <= 3)


def tier_rerank(items: DataFrame, n: int, weights: Mapping[str, float] = config.TIER_WEIGHTS, enabled: bool = True, by: str = "query_id", noise: Column | None = None, noise_weight: float = config.NOISE_WEIGHT) -> DataFrame:
    """The top n items of each query by score times type weight, with one place kept for operational knowledge.

    items: query_id, name, score, type. Items that ``noise`` marks take ``noise_weight`` instead of their type's. If none of the top n is operational, the best operational one below them takes
    the place of the lowest of the top n that isn't knowledge; without such a one nothing changes.
    """
    if not enabled:
        order = Window.partitionBy(by).orderBy(F.desc("score"), "name")
        return items.withColumn("tscore", F.col("score")).withColumn("place", F.row_number().over(order)).where(F.col("place") <= n)
    weight = looked_up(F.col("type"), dict(weights), F.lit(1.0))
    if noise is not None:
        weight = F.when(noise, F.lit(noise_weight)).otherwise(weight)
    weighed = items.withColumn("tscore", F.round(F.col("score") * weight, 6))
    operational, knowledge = F.col("type").isin(*config.OPERATIONAL_TYPES), F.col("type").isin(*config.KNOWLEDGE_TYPES)
    every = Window.partitionBy(by)
    ranked = weighed.withColumn("place", F.row_number().over(every.orderBy(F.desc("tscore"), "name")))
    inside = F.col("place") <= n
    facts = ranked.withColumns(
        {
            "held": F.max((inside & operational).cast("int")).over(every),
            "spare": F.min(F.when(~inside & operational, F.col("place"))).over(every),
            "lowest": F.max(F.when(inside & ~knowledge, F.col("place"))).over(every),
        }
    )
    swap = (F.col("held") == 0) & F.col("spare").isNotNull() & F.col("lowest").isNotNull()
    kept = (inside & ~(F.coalesce(swap, F.lit(False)) & (F.col("place") == F.col("lowest")))) | (F.coalesce(swap, F.lit(False)) & (F.col("place") == F.col("spare")))
    return facts.where(kept).drop("held", "spare", "lowest")


def delivery_invariants(items: DataFrame, n: int, weights: Mapping[str, float] = config.TIER_WEIGHTS) -> DataFrame:
    """What tiers do to the top n of all queries: how many queries there are, in how many knowledge rose, in how many it
    didn't fall, and how many break the rule of one operational place.

    items: query_id, name, score, type, noise. The rule is broken where a query has operational items, its picks aren't
    all knowledge, and none of them is operational.
    """
    operational, knowledge = F.col("type").isin(*config.OPERATIONAL_TYPES), F.col("type").isin(*config.KNOWLEDGE_TYPES)
    plain = tier_rerank(items, n, enabled=False).groupBy("query_id").agg(F.count_if(knowledge).alias("before"))
    tiered = tier_rerank(items, n, weights, noise=F.col("noise")).groupBy("query_id").agg(F.count_if(knowledge).alias("after"), F.count(F.lit(1)).alias("picked"), F.count_if(operational).alias("operational"))
    asked = items.groupBy("query_id").agg(F.count_if(operational).alias("candidates"))
    rows = plain.join(tiered, "query_id").join(asked, "query_id")
    return rows.agg(
        F.count(F.lit(1)).alias("queries"),
        F.count_if(F.col("after") > F.col("before")).alias("knowledge_rose"),
        F.count_if(F.col("after") >= F.col("before")).alias("knowledge_preserved"),
        F.count_if((F.col("candidates") > 0) & (F.col("after") < F.col("picked")) & (F.col("operational") < 1)).alias("floor_violations"),
    )


def usage_stats(episodes: DataFrame) -> DataFrame:
    canonical = F.col("name").startswith(config.CANONICAL_PREFIX)
    used = F.coalesce("usage_count", F.lit(0))
    return episodes.agg(
        F.count(F.lit(1)).alias("total"), F.sum(used).alias("uses"), F.count_if(used > 0).alias("used"),
        F.count_if(canonical).alias("canonical"), F.sum(F.when(canonical, used)).alias("canonical_uses"), F.count_if(canonical & (used > 0)).alias("canonical_used"),
    )


def utilisation(episodes: DataFrame) -> DataFrame:
    """Share of used episodes by declared project, as counts and an unrounded percentage."""
    used = F.coalesce("usage_count", F.lit(0)) > 0
    rows = episodes.groupBy(F.coalesce(declared("source_description", "project"), F.lit("unknown")).alias("project")).agg(F.count(F.lit(1)).alias("total"), F.count_if(used).alias("used"))
    return rows.withColumns({"never": F.col("total") - F.col("used"), "percent": F.round(100.0 * F.col("used") / F.greatest("total", F.lit(1)), 6)})


def usage_bump(episodes: DataFrame, events: DataFrame) -> DataFrame:
    """All episodes with their counters after the events (name, ts): usage and retrieval rise by one an event, on every episode of that name.

    Episodes without events keep their counters and have no last_used_at of these events; null counters count as 0.
    """
    counts = events.groupBy("name").agg(F.count(F.lit(1)).alias("more"), F.max("ts").alias("last_used_at"))
    rows = episodes.join(counts, "name", "left")
    raised = lambda c: (F.coalesce(c, F.lit(0)) + F.coalesce("more", F.lit(0))).alias(c)
    return rows.select("uuid", "name", raised("usage_count"), raised("retrieval_count"), "last_used_at")


def delivery_mix(deliveries: DataFrame, bucket: Column) -> DataFrame:
    """Hits, picks and picks by bucket of each endpoint; hits are counted before the picks are unnested."""
    hits = deliveries.groupBy("endpoint").agg(F.count(F.lit(1)).alias("hits"), F.count_if("tiering").alias("tiered"))
    picks = deliveries.select("endpoint", F.explode("picked").alias("p")).select("endpoint", F.col("p.type").alias("type")).groupBy("endpoint", bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("picks"))
    return hits.join(picks, "endpoint", "left")
