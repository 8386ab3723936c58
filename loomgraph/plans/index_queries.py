"""Queries of the written indexes: full text with an update and a compaction, nearest vectors, multi-pattern hits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.operators import merging, patterns
from loomgraph.operators.fulltext import FullText
from loomgraph.operators.vectors import VectorIndex
from loomgraph.sources.fixtures import view, with_views
from loomgraph.tables import materialise, scratch

#: The index of each session and folder of tables: it is written once and read by all searches.
_WRITTEN: dict[tuple[str, str], FullText] = {}


def episode_index(s: SparkSession, d: str) -> FullText:
    """The full-text index of the episodes of a folder, written at its first use in a session."""
    key = (s.sparkContext.applicationId, d)
    if key not in _WRITTEN:
        made = FullText(s, scratch(s, "fulltext"))
        made.add(view(s, d, "f_episodes"))
        _WRITTEN[key] = made
    return _WRITTEN[key]


def fulltext_update(s: SparkSession, d: str) -> DataFrame:
    """Search after an update: some episodes get another content, some are archived, some come back; then after compaction."""
    e = view(s, d, "f_episodes").select("uuid", "n", "content", "archived")
    index = FullText(s, scratch(s, "fulltext"))
    index.add(e)
    index.add(e.where("n % 100 = 3").withColumn("content", F.concat(F.coalesce("content", F.lit("")), F.lit(" the freshly added que que"))))
    index.remove(e.where("n % 50 = 4"))
    index.add(e.where("n % 100 = 54"))
    words, out = ["the", "que", "freshly", "the"], None
    for state in ("segments", "compacted"):
        if state == "compacted":
            found = out
            found = s.createDataFrame(found.collect(), found.schema)  # 40 rows; compaction deletes what they were read from
            index.compact()
            out = found.unionByName(index.bm25(words, 40).withColumn("state", F.lit(state)))
        else:
            out = index.bm25(words, 40).withColumn("state", F.lit(state))
    return out


def vector_index(s: SparkSession, d: str) -> DataFrame:
    """The ten nearest rows of every row whose id is divisible by 50, exactly, by cells and their bounds."""
    rows = s.read.parquet(f"{d}/embeddings.parquet").select(F.col("vec_id").alias("id"), "embedding")
    return VectorIndex.build(rows, scratch(s, "vectors")).search(rows.where("id % 50 = 0"), 10, exact=True)


def pattern_hits(s: SparkSession, d: str) -> DataFrame:
    """In how many documents and of which least number each passage of the benchmark occurs, cut to its first 30 characters, in any case."""
    asked = s.read.parquet(f"{d}/benchmark.parquet").select(F.lower(F.substring("text", 1, 30)).alias("pattern"))
    texts = s.read.parquet(f"{d}/documents.parquet").select("doc_id", F.lower("text").alias("low"))
    return patterns.occurring(texts, ["doc_id"], "low", asked).groupBy("pattern").agg(F.count(F.lit(1)).alias("documents"), F.min("doc_id").alias("first"))


EPISODE = "uuid string, name string, archived boolean, usage_count bigint, retrieval_count bigint"


def merge_updates(s: SparkSession, d: str) -> DataFrame:
    """Episodes through usage bumps, archiving, deletes and new rows as deltas, read merged, then after compaction."""
    e = view(s, d, "f_episodes").select("uuid", "name", "archived", "usage_count", "retrieval_count", "n")
    t = merging.MergeTable(s, scratch(s, "episodes"), "uuid", EPISODE)
    t.upsert(e)
    merging.changed(t, e.where("n % 100 = 3"), {"usage_count": F.col("usage_count") + 5})
    merging.changed(t, e.where("n % 60 = 3"), {"usage_count": F.col("usage_count") + 1, "archived": F.lit(True)})
    t.delete(e.where("n % 150 = 4"))
    t.upsert(e.where("n % 300 = 4").withColumn("name", F.lit("again")))
    merged = materialise(t.read().withColumn("state", F.lit("deltas")), "merged")  # compaction deletes what it is read from
    t.compact()
    return merged.unionByName(t.read().withColumn("state", F.lit("compacted")))


QUERIES = {"merge_updates": merge_updates, "fulltext_update": fulltext_update, "vector_index": vector_index, "pattern_hits": pattern_hits}

ORACLES = {
    "merge_updates": with_views("f_episodes") + """,
 r as (select uuid, case when n % 300 = 4 then 'again' else name end as name, case when n % 60 = 3 then true else archived end as archived,
 usage_count + case when n % 100 = 3 then 5 else 0 end + case when n % 60 = 3 then 1 else 0 end as usage_count, retrieval_count from f_episodes where n % 150 <> 4 or n % 300 = 4)
select r.*, state from r, (values ('deltas'), ('compacted')) as s(state)""",
    "fulltext_update": with_views("f_episodes") + """,
 e as (select uuid, case when n % 100 = 3 then coalesce(content, '') || ' the freshly added que que' else content end as content, archived or (n % 50 = 4 and n % 100 <> 54) as archived from f_episodes),
 t as (select uuid, list_filter(string_split_regex(lower(coalesce(content, '')), '[^\\p{L}\\p{N}_]+'), lambda x: x <> '') as t from e where not archived),
 c as (select uuid, len(t) as dl, len(list_filter(t, lambda x: x = 'the')) as a, len(list_filter(t, lambda x: x = 'que')) as b, len(list_filter(t, lambda x: x = 'freshly')) as c from t),
 z as (select count(*)::double as n, avg(dl) as mean, count(*) filter (a > 0) as da, count(*) filter (b > 0) as db, count(*) filter (c > 0) as dc from c),
 r as (select uuid, round(2 * ln(1 + (n - da + 0.5) / (da + 0.5)) * a * 2.2 / (a + 1.2 * (0.25 + 0.75 * dl / mean)) + ln(1 + (n - db + 0.5) / (db + 0.5)) * b * 2.2 / (b + 1.2 * (0.25 + 0.75 * dl / mean))
 + ln(1 + (n - dc + 0.5) / (dc + 0.5)) * c * 2.2 / (c + 1.2 * (0.25 + 0.75 * dl / mean)), 6) as score from c, z where a + b + c > 0 order by score desc, uuid limit 40)
select uuid, score, state from r, (values ('segments'), ('compacted')) as s(state)""",
    "vector_index": """with v as (select vec_id as id, embedding::double[] as v from embeddings),
 r as (select q.id as query, v.id, round(list_dot_product(q.v, v.v) / (sqrt(list_dot_product(q.v, q.v)) * sqrt(list_dot_product(v.v, v.v))), 6) as similarity from v q, v where q.id % 50 = 0),
 p as (select *, row_number() over (partition by query order by similarity desc, id)::int as place from r)
select * from p where place <= 10""",
    "pattern_hits": """with p as (select distinct lower(substring(text, 1, 30)) as pattern from benchmark where text is not null)
select pattern, count(*) as documents, min(doc_id) as first from p join documents d on contains(lower(d.text), pattern) group by pattern""",
}
