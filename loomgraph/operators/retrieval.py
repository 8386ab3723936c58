"""Search over facts and episodes: vector, substring, hybrid scoring, facets, full text."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph import config
from loomgraph.functions.columns import blank, clamped, days_between, declared, escaped
from loomgraph.operators import patterns, ranking
from loomgraph.operators.fulltext import FullText, tokens
from loomgraph.tables import materialise


#: Similarities that a worker holds at a time, out of an Arrow batch.
BLOCK_CELLS = 1 << 18


def cosine(vector: Column, query: Sequence[float]) -> Column:
    """Cosine similarity to a fixed vector: one pass of built-in array functions, the query as a literal."""
    q = F.array(*(F.lit(float(x)) for x in query))
    length = sum(float(x) ** 2 for x in query) ** 0.5
    dot = F.aggregate(F.zip_with(vector, q, lambda a, b: a.cast("double") * b), F.lit(0.0), lambda acc, x: acc + x)
    norm = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double")))
    return F.when((norm > 0) & F.lit(length > 0), dot / (norm * F.lit(length)))


def vector_top(facts: DataFrame, query: Sequence[float], k: int) -> DataFrame:
    """The k nearest facts; a top-k sort keeps k rows a partition, so nothing else moves."""
    return facts.withColumn("similarity", F.round(cosine(F.col("embedding"), query), 6)).orderBy(F.desc_nulls_last("similarity"), "edge_id").limit(k)


def batch_vector_top(facts: DataFrame, queries: Sequence[tuple[int, Sequence[float]]], k: int) -> DataFrame:
    """(id, edge_id, fact, similarity): the k nearest facts of each of a stated set of query vectors.

    Each task multiplies its batches with all query vectors and keeps k rows a query; only these are shuffled. Zero and
    null vectors come last, as with ``vector_top``; ties take the lesser edge_id.
    """
    ids = np.array([i for i, _ in queries], np.int64)
    q = np.array([v for _, v in queries], float)
    length = np.sqrt((q**2).sum(axis=1))
    step = max(1, BLOCK_CELLS // max(1, len(ids)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: pa.Table | None = None
        for batch in (b.slice(i, step) for b in batches for i in range(0, b.num_rows, step)):
            rows = batch.filter(pc.fill_null(pc.equal(pc.list_value_length(batch.column("embedding")), q.shape[1]), False))
            if not rows.num_rows:
                continue
            x = rows.column("embedding").flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, q.shape[1])
            norm = np.sqrt((x**2).sum(axis=1))
            with np.errstate(invalid="ignore", divide="ignore"):
                sim = np.round((x @ q.T) / (norm[:, None] * length), 6)
            edge = rows.column("edge_id").to_numpy(zero_copy_only=False)
            i, j = top_of_block(sim, edge, k)
            value = sim[i, j]
            part = pa.table({"id": ids[j], "edge_id": edge[i], "fact": rows.column("fact").take(pa.array(i)), "similarity": pa.array(value, mask=np.isnan(value))})
            best = part if best is None else pa.concat_tables([best, part])
            if best.num_rows > 4 * k * len(ids):
                best = _best(best, k)
        if best is not None:
            yield from _best(best, k).combine_chunks().to_batches()

    near = facts.select(F.col("edge_id").cast("bigint").alias("edge_id"), F.col("fact").cast("string").alias("fact"), F.col("embedding").cast("array<float>").alias("embedding")).mapInArrow(run, "id bigint, edge_id bigint, fact string, similarity double")
    order = Window.partitionBy("id").orderBy(F.desc_nulls_last("similarity"), "edge_id")
    return near.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)


def top_of_block(sim: np.ndarray, keys: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the k largest values of each column; ties take the lesser key, missing values come last."""
    value = np.where(np.isnan(sim), -np.inf, sim)
    if len(sim) > k:
        i, j = np.nonzero(value >= np.partition(value, len(sim) - k, axis=0)[len(sim) - k])
    else:
        i, j = (x.ravel() for x in np.indices(sim.shape))
    order = np.lexsort((keys[i], -value[i, j], j))
    i, j = i[order], j[order]
    start = np.flatnonzero(np.diff(j, prepend=-1))
    kept = np.arange(len(j)) - np.repeat(start, np.diff(np.append(start, len(j)))) < k
    return i[kept], j[kept]


def _best(rows: pa.Table, k: int) -> pa.Table:
    """The first k rows of each id by similarity."""
    rows = rows.sort_by([("id", "ascending"), ("similarity", "descending"), ("edge_id", "ascending")])
    ids = rows.column("id").to_numpy()
    start = np.flatnonzero(np.diff(ids, prepend=ids[0] - 1))
    place = np.arange(len(ids)) - np.repeat(start, np.diff(np.append(start, len(ids))))
    return rows.filter(pa.array(place < k))


def batch_substring_top(facts: DataFrame, queries: Sequence[tuple[int, str]], k: int) -> DataFrame:
    """(id, fact): up to k facts by their order that contain each of a stated set of texts in any case; one pass over the facts."""
    asked = facts.sparkSession.createDataFrame([(i, t.lower()) for i, t in queries], "id bigint, pattern string")
    hits = patterns.occurring(facts.select("fact").distinct().withColumn("low", F.lower("fact")), ["fact"], "low", asked).join(F.broadcast(asked), "pattern")
    return hits.select("id", "fact").withColumn("place", F.row_number().over(Window.partitionBy("id").orderBy("fact"))).where(F.col("place") <= k).drop("place")


def semantic_leg(facts: DataFrame, query: Sequence[float], pool: int) -> DataFrame:
    """fact, sem = 1 - rank / n over the pool. Facts of equal text collapse to the last of them in rank."""
    near = vector_top(facts, query, pool)
    ranked = near.withColumns({"rank": F.row_number().over(Window.orderBy(F.desc("similarity"), "edge_id")) - 1, "n": F.count(F.lit(1)).over(Window.partitionBy())})
    return ranked.groupBy("fact").agg(F.max("rank").alias("rank"), F.first("n").alias("n")).select("fact", F.round(1 - F.col("rank") / F.greatest("n", F.lit(1)), 6).alias("sem"))


def substring_leg(facts: DataFrame, text: str, pool: int) -> DataFrame:
    """Facts that contain the text in any case; the pool's order is by fact."""
    return facts.where(F.lower("fact").contains(text.lower())).select("fact").distinct().orderBy("fact").limit(pool).withColumn("exact", F.lit(True))


def merged(semantic: DataFrame, substring: DataFrame) -> DataFrame:
    """Both legs by fact; a substring hit marks the fact exact."""
    return semantic.join(substring, "fact", "full").select("fact", F.coalesce("sem", F.lit(0.0)).alias("sem"), F.coalesce("exact", F.lit(False)).alias("exact"))


def backed(candidates: DataFrame, facts: DataFrame, episodes: DataFrame) -> DataFrame:
    """Candidates with their backing episodes' flags. A fact whose known backing is all archived is retired.

    facts: fact, backing array<string>. Unknown episodes are ignored. Flags are over live backing only.
    """
    pairs = facts.join(candidates.select("fact"), "fact", "left_semi").select("fact", F.explode("backing").alias("uuid")).distinct()
    known = pairs.join(episodes.select("uuid", "archived", "provenance", "durability", "verified", "usage_count", "created_at", "project", "kind"), "uuid")
    live = ~F.coalesce("archived", F.lit(False))
    external = F.coalesce(F.col("provenance").startswith("external"), F.lit(False))
    flags = known.groupBy("fact").agg(
        F.count(F.lit(1)).alias("known"), F.count_if(live).alias("live"), F.count_if(live & external).alias("n_external"), F.count_if(live & (F.coalesce("durability", F.lit("")) == "time-bound")).alias("n_stale"),
        F.max(live & F.coalesce("verified", F.lit(False))).alias("verified"), F.max(F.when(live, F.coalesce("usage_count", F.lit(0)))).alias("usage"), F.max(F.when(live, F.col("created_at"))).alias("newest"),
        F.collect_set(F.when(live, F.col("project"))).alias("projects"), F.collect_set(F.when(live, F.col("kind"))).alias("kinds"), F.collect_set(F.when(live, F.col("durability"))).alias("durabilities"),
    )
    rows = candidates.join(flags, "fact", "left")
    kept = ~((F.coalesce("known", F.lit(0)) > 0) & (F.coalesce("live", F.lit(0)) == 0))
    some = F.coalesce("live", F.lit(0)) > 0
    return rows.where(kept).withColumns({"external": some & (F.col("n_external") == F.col("live")), "stale": some & (F.col("n_stale") == F.col("live")), "verified": F.coalesce("verified", F.lit(False)), "usage": F.coalesce("usage", F.lit(0))}).drop("n_external", "n_stale")


def facet(rows: DataFrame, column: str, value: str) -> DataFrame:
    """Facts of which some live backing episode has the value."""
    return rows.where(F.coalesce(F.array_contains(column, value), F.lit(False)))


def search_score(now: Column) -> Column:
    """Similarity with bonuses and penalties of the backing."""
    age = days_between(now, F.col("newest"))
    flag = lambda c, v: F.when(F.col(c), v).otherwise(0.0)
    return F.round(
        F.col("sem") + flag("exact", config.EXACT_BONUS) - flag("external", config.EXTERNAL_PENALTY) - flag("stale", config.STALE_PENALTY) + flag("verified", config.VERIFIED_BONUS)
        + config.USAGE_STEP * F.least("usage", F.lit(config.USAGE_CAP)) + F.when(age <= config.FRESH_DAYS, config.FRESH_BONUS).when(age > config.OLD_DAYS, -config.OLD_PENALTY).otherwise(0.0),
        6,
    )


def hybrid(facts: DataFrame, episodes: DataFrame, query: Sequence[float], text: str, now: Column, k: int = 10, facets: dict[str, str] | None = None) -> DataFrame:
    """Hybrid search: both legs over a pool of min(4k, 60), merged, backed, filtered by facets, scored, cut to k."""
    pool = min(4 * k, 60)
    rows = backed(merged(semantic_leg(facts, query, pool), substring_leg(facts, text, pool)), facts, episodes)
    for column, value in (facets or {}).items():
        rows = facet(rows, column, value)
    return rows.withColumn("score", search_score(now)).orderBy(F.desc("score"), "fact").limit(k)


def bm25(episodes: DataFrame, words: Sequence[str], k: int) -> DataFrame:
    """Live episodes by BM25 over the query's words: only rows with one of them are scored, sizes come from one aggregate.

    Texts are split once: uuid, name, length and the words' counts are written and read for both. No words find nothing.
    """
    if not words:
        return episodes.select("uuid", "name", F.lit(0.0).alias("score")).limit(0)
    live = episodes.where(~F.coalesce("archived", F.lit(False))).select("uuid", "name", tokens(blank("content")).alias("t"))
    counts = {w: F.size(F.filter("t", _equals(w))).alias(f"tf{i}") for i, w in enumerate(words)}
    sized = materialise(live.select("uuid", "name", F.size("t").alias("dl"), *counts.values()), "sized")
    stats = sized.agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("mean"), *(F.count_if(F.col(f"tf{i}") > 0).alias(f"df{i}") for i in range(len(words))))
    score = F.lit(0.0)
    for i in range(len(words)):
        idf = F.ln(1 + (F.col("n") - F.col(f"df{i}") + 0.5) / (F.col(f"df{i}") + 0.5))
        tf = F.col(f"tf{i}")
        score = score + idf * tf * (config.K1 + 1) / (tf + config.K1 * (1 - config.B + config.B * F.col("dl") / F.col("mean")))
    hit = F.lit(False)
    for i in range(len(words)):
        hit = hit | (F.col(f"tf{i}") > 0)
    return sized.where(hit).crossJoin(F.broadcast(stats)).select("uuid", "name", F.round(score, 6).alias("score")).orderBy(F.desc("score"), "uuid").limit(k)


def _equals(word: str):
    return lambda t: t == word


def matching(episodes: DataFrame, text: str, k: int, index: FullText | None = None) -> DataFrame:
    """uuid, name and score by full text; where it finds nothing, a substring (of this case) of name or content with score 0.

    With an index of these episodes only its postings of the words are read; else all texts are split.
    """
    words = [w for w in text.lower().split() if w]
    if index is None:
        found = bm25(episodes, words, k)
    else:
        found = materialise(index.bm25(words, k), "found")
        found = episodes.select("uuid", "name").join(F.broadcast(found), "uuid").select("uuid", "name", "score")  # k rows
    plain = episodes.where(~F.coalesce("archived", F.lit(False)) & (blank("content").contains(text) | blank("name").contains(text))).select("uuid", "name", F.lit(0.0).alias("score")).orderBy("uuid").limit(k)
    none = found.agg(F.count(F.lit(1)).alias("n")).where("n = 0")
    return found.unionByName(plain.join(F.broadcast(none), how="cross").drop("n"))


def _typed(episodes: DataFrame) -> Column:
    return F.coalesce(declared("source_description", "type"), F.lit("?")).alias("type")


def episode_search(episodes: DataFrame, text: str, k: int = 5, tiered: bool = False, index: FullText | None = None) -> DataFrame:
    """The k (1 to 15) best episodes for a text with a preview of 600 characters; a larger pool is re-ranked by type if ``tiered``."""
    k = clamped(k, 1, 15, 5)
    found = matching(episodes, text, min(3 * k, 45) if tiered else k, index)
    rows = episodes.select("uuid", _typed(episodes), F.substring(blank("content"), 1, 600).alias("preview")).join(F.broadcast(found), "uuid")
    ranked = ranking.tier_rerank(rows.withColumn("query_id", F.lit(0)).withColumn("label", F.col("name")).withColumn("name", F.col("uuid")), k, enabled=tiered)
    return ranked.select("uuid", F.col("label").alias("name"), "type", "score", "preview", "place")


def browse(episodes: DataFrame, text: str | None, k: int = 30, recent: int = 25, created: str = "created_at", index: FullText | None = None) -> DataFrame:
    """What a reader browses: matches of a text, or without one the newest live episodes that aren't canonical; with badges and snippet."""
    if text:
        found = matching(episodes, text, k, index).select("uuid", "score")
        rows = episodes.join(F.broadcast(found), "uuid")
    else:
        rows = episodes.where(~F.coalesce("archived", F.lit(False)) & ~F.col("name").startswith(config.CANONICAL_PREFIX)).orderBy(F.desc(created), "uuid").limit(recent).withColumn("score", F.lit(None).cast("double"))
    line = F.replace(F.trim(F.substring(blank("content"), 1, 4000)), F.lit("\n"), F.lit(" "))
    cut = F.concat(escaped(F.substring(line, 1, 400)), F.when(F.char_length(line) > 400, "…").otherwise(""))
    kind = F.when(F.col("name").startswith(config.CAPSULE_PREFIX), "capsule").otherwise(F.coalesce(declared("source_description", "type"), F.lit("obs")))
    return rows.select("uuid", "name", kind.alias("type"), F.coalesce(declared("source_description", "project"), F.lit("—")).alias("project"), cut.alias("snippet"), "score")


def context(episodes: DataFrame, keyword: str, top: int = 3, scopes: dict[str, str] | None = None, tiered: bool = True) -> DataFrame:
    """The canonical context of a keyword, its free places filled by full text.

    Canonical episodes come first, those of the first pass before those that full text finds; the others follow by
    score, re-ranked by type if ``tiered``. Without any match there are no rows. ``top`` is from 1 to 10.
    """
    top = clamped(top, 1, 10, 3)
    first = materialise(ranking.canonical_context(episodes, keyword, top, scopes).select("uuid", "name", F.col("relscore").cast("double").alias("score"), F.col("place").cast("int").alias("place"), F.lit("canonical").alias("source")), "context")
    missing = top - first.count()  # a handful of rows
    if missing <= 0:
        return first
    others = episodes.join(F.broadcast(first.select("name")), "name", "left_anti")
    found = bm25(others, [w for w in keyword.lower().split() if w], 3 * missing)
    rows = materialise(others.select("uuid", _typed(others)).join(F.broadcast(found), "uuid"), "fill")
    canonical = F.col("name").startswith(config.CANONICAL_PREFIX)
    more = rows.where(canonical).orderBy(F.desc("score"), "uuid").limit(missing)
    free = missing - more.count()
    ranked = ranking.tier_rerank(rows.where(~canonical).withColumn("query_id", F.lit(0)).withColumn("label", F.col("name")).withColumn("name", F.col("uuid")), free, enabled=tiered)
    place = lambda order, start: (F.row_number().over(Window.orderBy(*order)) + start).cast("int").alias("place")  # noqa: E731  # a handful of rows
    return (
        first.unionByName(more.select("uuid", "name", "score", place([F.desc("score"), "uuid"], top - missing), F.lit("fulltext").alias("source")))
        .unionByName(ranked.select("uuid", F.col("label").alias("name"), "score", place(["place"], top - free), F.lit("fulltext").alias("source")))
    )
