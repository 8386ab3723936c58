"""Graph operators over entities (uuid, name, label) and facts (src, dst, name)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph import config
from loomgraph.functions.columns import clamped, contains_any
from loomgraph.operators import pairs
from loomgraph.tables import components, materialise


#: Entities of one name that are looked for by a filter.
MOST_STARTS = 1000


def totals(entities: DataFrame, facts: DataFrame, episodes: DataFrame) -> DataFrame:
    """Counts of nodes and edges with their ratios."""
    one = lambda df, name: df.agg(F.count(F.lit(1)).alias(name))
    rows = one(entities, "entities").join(one(facts, "facts"), how="cross").join(one(episodes, "episodes"), how="cross")
    ratio = lambda a, b: F.round(F.col(a) / F.greatest(b, F.lit(1)), 6)
    return rows.withColumns({"facts_per_entity": ratio("facts", "entities"), "facts_per_episode": ratio("facts", "episodes"), "entities_per_episode": ratio("entities", "episodes")})


def node_types(entities: DataFrame) -> DataFrame:
    return entities.groupBy(F.coalesce("label", F.lit("Entity (unclassified)")).alias("label")).agg(F.count(F.lit(1)).alias("n"))


def edge_types(facts: DataFrame, canonical: Sequence[str] = config.CANONICAL_EDGES) -> DataFrame:
    """Edges by name, with whether the name is a canonical one in any case, and the percentage of all edges that are."""
    rows = facts.groupBy("name").agg(F.count(F.lit(1)).alias("n")).withColumn("canonical", F.lower("name").isin(*canonical))
    share = rows.agg(F.round(100.0 * F.sum(F.when(F.col("canonical"), F.col("n")).otherwise(0)) / F.greatest(F.sum("n"), F.lit(1)), 6).alias("aligned_percent"))
    return rows.crossJoin(F.broadcast(share))  # one row


def case_variants(facts: DataFrame) -> DataFrame:
    """Edge names with several spellings; all become lower case. A lone spelling stays as it is."""
    names = facts.groupBy("name").agg(F.count(F.lit(1)).alias("n"))
    return names.groupBy(F.lower("name").alias("lowered")).agg(F.count(F.lit(1)).alias("spellings"), F.sum("n").alias("n"), F.array_join(F.array_sort(F.collect_list("name")), ",").alias("names")).where("spellings > 1")


def normalised(facts: DataFrame) -> DataFrame:
    """Facts with names of several spellings in lower case. The list of such names is as short as the vocabulary."""
    variants = case_variants(facts).select("lowered")
    return facts.withColumn("lowered", F.lower("name")).join(variants.withColumn("many", F.lit(True)), "lowered", "left").select("src", "dst", F.when(F.col("many"), F.col("lowered")).otherwise(F.col("name")).alias("name"))


def degrees(entities: DataFrame, *edges: DataFrame) -> DataFrame:
    """(uuid, name, degree) of every entity over all edge tables; a self-loop counts once."""
    ends = None
    for e in edges:
        both = e.select(F.explode(F.array_distinct(F.array("src", "dst"))).alias("uuid"))
        ends = both if ends is None else ends.unionByName(both)
    return entities.join(ends.groupBy("uuid").agg(F.count(F.lit(1)).alias("degree")), "uuid", "left").select("uuid", "name", F.coalesce("degree", F.lit(0)).alias("degree"))


def degree_bucket(degree: Column) -> Column:
    out = F.when(degree == 0, "0").when(degree == 1, "1")
    for low, high in ((2, 3), (4, 7), (8, 15), (16, 31)):
        out = out.when(degree <= high, f"{low}-{high}")
    return out.otherwise("32+")


def lookup(entities: DataFrame, text: str) -> DataFrame:
    """The one entity a text names: equal name first, then the shortest containing it."""
    rows = entities.where(F.col("name").contains(text))
    return rows.orderBy(F.desc(F.col("name") == text), F.length("name"), "name", "uuid").limit(1)


def neighbours(entities: DataFrame, facts: DataFrame, text: str, limit: int = 20, rows_without: bool = False) -> DataFrame:
    """Direct neighbours out and in of the entity that a text names, each side limited (1 to 100, 20 otherwise).

    Entities of the same name count as one. Facts with a text (column ``fact``) give it too. A text that names nothing
    gives no rows, or with ``rows_without`` one row of nulls, so that it differs from an entity without neighbours.
    """
    said = ["fact"] if "fact" in facts.columns else []
    limit = clamped(limit, 1, 100, 20)
    named = lookup(entities, text).select(F.col("name").alias("node"))
    start = materialise(entities.join(named, entities["name"] == named["node"]).select(F.col("uuid").alias("start"), "node"), "start")
    # A short list of uuids is a filter that Spark pushes below what the facts are made of; a long one stays a join.
    wanted = [r.start for r in start.select("start").distinct().limit(MOST_STARTS + 1).collect()]

    def side(here: str, there: str, direction: str) -> DataFrame:
        rows = facts.where(F.col(here).isin(wanted)) if len(wanted) <= MOST_STARTS else facts
        rows = rows.join(start, F.col(here) == F.col("start")).select("node", F.col(there).alias("uuid"), F.col("name").alias("edge"), *said)
        return rows.join(entities.select("uuid", F.col("name").alias("neighbour")), "uuid").select("node", "neighbour", "edge", F.lit(direction).alias("direction"), "uuid", *said).orderBy("neighbour", "edge", "uuid").limit(limit)

    found = side("src", "dst", "out").unionByName(side("dst", "src", "in"))
    if not rows_without:
        return found
    nothing = named.agg(F.count(F.lit(1)).alias("n")).where("n = 0")
    return found.unionByName(nothing.select(*(F.lit(None).cast(f.dataType).alias(f.name) for f in found.schema)))


def illegal(entities: DataFrame, facts: DataFrame, legal: Mapping[tuple[str, str], Sequence[str]] = config.LEGAL_EDGES) -> DataFrame:
    """Facts whose (source label, target label, name) isn't a legal combination, counted.

    An entity without a label is an ``Entity``, the kind of those that nothing has narrowed yet. Names are compared in
    lower case. A fact whose ends aren't both known isn't judged.
    """
    labels = entities.select("uuid", F.coalesce(F.nullif("label", F.lit("")), F.lit("Entity")).alias("label"))
    rows = facts.join(labels.select(F.col("uuid").alias("src"), F.col("label").alias("src_label")), "src").join(labels.select(F.col("uuid").alias("dst"), F.col("label").alias("dst_label")), "dst")
    counts = rows.groupBy("src_label", "dst_label", F.lower("name").alias("edge")).agg(F.count(F.lit(1)).alias("n"))
    rules = facts.sparkSession.createDataFrame([(a, b, e) for (a, b), names in legal.items() for e in names], "src_label string, dst_label string, edge string")
    return counts.join(F.broadcast(rules), ["src_label", "dst_label", "edge"], "left_anti")  # a stated table of rules


def as_of(facts: DataFrame, at: Column) -> DataFrame:
    """Facts that are valid and known at a time: four optional timestamps bound them."""
    before = lambda c: F.col(c).isNull() | (F.col(c) <= at)
    after = lambda c: F.col(c).isNull() | (F.col(c) > at)
    return facts.where(before("valid_at") & after("invalid_at") & before("created_at") & after("expired_at"))


def without_episode(facts: DataFrame, uuids: DataFrame) -> DataFrame:
    """Facts (edge_id, backing) after some episodes are removed: their uuids leave the backing, facts that lose all of it go.

    Facts that never had any backing stay with none.
    """
    gone = uuids.select(F.col("uuid").alias("backing_uuid"))
    left = facts.select("edge_id", F.explode("backing").alias("backing_uuid")).join(gone, "backing_uuid", "left_anti")
    kept = left.groupBy("edge_id").agg(F.array_join(F.array_sort(F.collect_set("backing_uuid")), ",").alias("backing"))
    return kept.unionByName(facts.where(F.size(F.coalesce("backing", F.array())) == 0).select("edge_id", F.lit("").alias("backing")))


def without_mentions(mentions: DataFrame, uuids: DataFrame) -> DataFrame:
    """Mentions (src, dst) without those of removed episodes; the entities stay."""
    return mentions.join(uuids.select(F.col("uuid").alias("src")), "src", "left_anti")


def resolved(entities: DataFrame, links: DataFrame) -> DataFrame:
    """(uuid, root) of every entity: the least uuid of those that similar pairs (a, b) connect, itself without any."""
    roots = components(links)
    return entities.select("uuid").join(roots.withColumnRenamed("node", "uuid"), "uuid", "left").select("uuid", F.coalesce("root", "uuid").alias("root"))


def merged(facts: DataFrame, roots: DataFrame) -> DataFrame:
    """Facts between resolved entities, equal ones once, without those that now lead from an entity to itself."""
    near, far = (roots.select(F.col("uuid").alias(k), F.col("root").alias(f"{k}_root")) for k in ("src", "dst"))
    rows = facts.join(near, "src").join(far, "dst").select(F.col("src_root").alias("src"), F.col("dst_root").alias("dst"), "name")
    return rows.where("src <> dst").distinct()


def knowledge_stats(facts: DataFrame, episodes: DataFrame, registry: DataFrame, keys: DataFrame) -> DataFrame:
    """``fact_quality`` with what stands beside it: predigested children, registered documents, keys by status.

    A child is an episode named ``<parent>--obs-<number>``. Each part is one aggregate of one row.
    """
    is_ = lambda s: F.count_if(F.col("status") == s)
    children = episodes.agg(F.count_if(F.coalesce(F.col("name").rlike(r"--obs-\d+$"), F.lit(False))).alias("children"))
    counted = keys.agg(is_("ok").alias("keys_ok"), is_("pending").alias("keys_pending"), is_("error").alias("keys_error"))
    return fact_quality(facts).crossJoin(children).crossJoin(registry.agg(F.count(F.lit(1)).alias("registered"))).crossJoin(counted)


def impact(names: DataFrame, episodes: DataFrame, mentions: DataFrame) -> DataFrame:
    """Per name: whether an episode has it and how many mentions its episodes have. names: name; mentions: src (episode), dst."""
    counts = mentions.groupBy(F.col("src").alias("uuid")).agg(F.count(F.lit(1)).alias("n"))
    known = episodes.select("name", "uuid").join(counts, "uuid", "left").groupBy("name").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("mentions"))
    return names.select("name").distinct().join(known, "name", "left").select("name", F.col("mentions").isNotNull().alias("exists"), F.coalesce("mentions", F.lit(0)).alias("mentions"))


def fact_quality(facts: DataFrame) -> DataFrame:
    """All facts, those phrased like metadata and their percentage. A null fact isn't."""
    c = facts.agg(F.count(F.lit(1)).alias("total"), F.count_if(contains_any(F.col("fact"), config.METADATA_PHRASES)).alias("metadata_like"))
    return c.withColumn("percent", F.round(100.0 * F.col("metadata_like") / F.greatest("total", F.lit(1)), 1))


def resolve_entities(entities: DataFrame, block: Column, vector: str, least: float) -> DataFrame:
    """(a, b) pairs of the same block whose vectors have at least a cosine: exact, all pairs of a block are compared.

    A block is cut into parts, and each two parts are compared by a product of matrices (``pairs.similar``). Null blocks
    and vectors match nothing.
    """
    return pairs.similar(entities.select("uuid", block.alias("block"), *pairs.packed(vector)), ["block"], least)


def connecting(entities: DataFrame, block: Column, vector: str, least: float) -> DataFrame:
    """Pairs (a, b) of ``resolve_entities`` that connect the same components as all of them.

    Equal vectors of a block are one class, compared once, and hang on its least member; of the pairs of two parts those
    stay that connect them without a cycle.
    """
    rows = entities.select("uuid", block.alias("block"), *pairs.packed(vector)).dropna()
    if least > 1 - 1e-9:  # rounding may keep a vector from being similar to itself
        return pairs.similar(rows, ["block"], least, forest=True)
    classes = materialise(rows.groupBy("block", "dim", "v").agg(F.min("uuid").alias("uuid"), F.count(F.lit(1)).alias("n")), "classes")
    copies = rows.join(classes.where("n > 1").withColumnRenamed("uuid", "a"), ["block", "dim", "v"]).select("a", F.col("uuid").alias("b")).where("a <> b")
    return pairs.similar(classes, ["block"], least, forest=True).unionByName(copies).distinct()
