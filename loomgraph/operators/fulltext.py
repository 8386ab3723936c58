"""Full text by an inverted index: postings in hash buckets, appended segments, tombstones, compaction.

``postings/seq=S/bucket=B`` holds (term, uuid, tf, dl) of one segment, sorted by term in each file, so that a search reads the
buckets of its words alone and skips row groups by term. ``documents/seq=S`` has each document's length (null for a
removed one) and ``dead/seq=S`` the documents of earlier segments that the segment replaces or removes. The manifest
lists the segments that count, with what each adds to the number of documents and to their total length; it is replaced
as a whole after all files of a segment are written, so a writer that dies leaves the index as it was.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph import config
from loomgraph.functions.columns import blank
from loomgraph.tables import current_state, delete, materialise, replace_state

#: Hash buckets of terms, and shares of the documents that each is written in, so that a frequent word isn't one task's.
BUCKETS, SHARES = 64, 4
_MANIFEST = "seq string, place int, n bigint, total bigint"
_POSTINGS = "term string, uuid string, tf bigint, dl int, seq string, bucket int"


def tokens(text: Column) -> Column:
    """The lowered words of a text: runs of letters, digits and underscores."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}_]+"), lambda t: t != "")


def bucket(term: Column) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(BUCKETS)).cast("int")


class FullText:
    """An index of texts by uuid below a folder of the shared store. One writer at a time; any number of readers."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")

    def segments(self) -> list[tuple]:
        """(seq, place, documents added, length added) of the segments that count, in order."""
        return sorted((tuple(r) for r in current_state(self.spark, f"{self.root}/manifest", _MANIFEST).collect()), key=lambda r: r[1])  # one row a segment

    def _read(self, kind: str, schema: str, segments: Sequence[tuple]) -> DataFrame:
        if not segments:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).option("basePath", f"{self.root}/{kind}").parquet(*(f"{self.root}/{kind}/seq={s[0]}" for s in segments))

    def _write(self, postings: DataFrame, seq: str) -> None:
        """Postings by bucket and a share of the documents, sorted by term; ranges would count all words twice to find their bounds."""
        share = F.pmod(F.xxhash64("uuid"), F.lit(SHARES))
        postings.repartition("bucket", share).sortWithinPartitions("bucket", "term", "uuid").write.partitionBy("bucket").parquet(f"{self.root}/postings/seq={seq}")

    def _commit(self, segments: list[tuple]) -> None:
        replace_state(self.spark.createDataFrame(segments, _MANIFEST).coalesce(1), f"{self.root}/manifest")

    def add(self, episodes: DataFrame) -> None:
        """Index episodes (uuid, content, archived; one row a uuid) as a new segment; archived ones are taken out.

        Episodes that are known already are replaced. Only the new rows' texts are read, and no earlier file is written.
        """
        live = ~F.coalesce(F.col("archived"), F.lit(False))
        texts = episodes.select("uuid", F.when(live, blank("content")).alias("text"))
        split = lambda df: df.withColumn("t", tokens(F.col("text")))
        before, seq = self.segments(), uuid.uuid4().hex
        # Documents are dealt out by uuid, so that their words are counted where they lie: texts are shuffled for it, not pairs.
        tasks = int(self.spark.conf.get("spark.sql.shuffle.partitions"))  # a number, as small texts give many words and aren't put together
        dealt = split(texts.where("text is not null").repartition(tasks, "uuid"))
        counted = dealt.select("uuid", F.size("t").alias("dl"), F.explode("t").alias("term")).groupBy("uuid", "term", "dl").agg(F.count(F.lit(1)).alias("tf"))
        postings = counted.select(bucket(F.col("term")).alias("bucket"), "term", "uuid", "tf", "dl")
        self._write(postings, seq)
        split(texts).select("uuid", F.size("t").alias("dl")).withColumn("dl", F.when(F.col("dl") >= 0, F.col("dl"))).write.parquet(f"{self.root}/documents/seq={seq}")
        place = before[-1][1] + 1 if before else 0
        added = self._documents([(seq, place)])
        n, total = added.agg(F.count("dl"), F.coalesce(F.sum("dl"), F.lit(0))).first()
        if before:
            held = self._documents(before).join(added.select("uuid"), "uuid", "left_semi")
            last = materialise(held.groupBy("uuid").agg(F.max_by(F.struct("dl"), "place").alias("d")).where("d.dl is not null").select("uuid", "d.dl"), "replaced")
            gone, length = last.agg(F.count(F.lit(1)), F.coalesce(F.sum("dl"), F.lit(0))).first()
            n, total = n - gone, total - length
            last.select("uuid").write.parquet(f"{self.root}/dead/seq={seq}")
        else:
            self.spark.createDataFrame([], "uuid string").write.parquet(f"{self.root}/dead/seq={seq}")
        self._commit([*before, (seq, place, n, total)])

    def remove(self, uuids: DataFrame) -> None:
        """Take documents (uuid) out of the index."""
        self.add(uuids.select("uuid").distinct().withColumns({"content": F.lit(None).cast("string"), "archived": F.lit(True)}))

    def _places(self, rows: DataFrame, segments: Sequence[tuple]) -> DataFrame:
        """``rows`` with the place of their segment; the list of segments is a literal."""
        known = [x for s in segments for x in (F.lit(s[0]), F.lit(s[1]))]
        return rows.withColumn("place", F.element_at(F.create_map(*known), F.col("seq")))

    def _documents(self, segments: Sequence[tuple]) -> DataFrame:
        return self._places(self._read("documents", "uuid string, dl int, seq string", segments), segments)

    def _live(self, words: Sequence[str] | None, segments: Sequence[tuple]) -> DataFrame:
        """The postings that count, of some words (from their buckets alone) or of all."""
        rows = self._read("postings", _POSTINGS, segments)
        if words is not None:
            wanted = list(dict.fromkeys(words))
            keys = self.spark.range(1).select(*(bucket(F.lit(w)).alias(f"b{i}") for i, w in enumerate(wanted))).first()
            rows = rows.where(F.col("bucket").isin(*set(keys)) & F.col("term").isin(*wanted))
        if len(segments) < 2:
            return rows
        dead = self._places(self._read("dead", "uuid string, seq string", segments[1:]), segments).groupBy("uuid").agg(F.max("place").alias("until"))
        return self._places(rows, segments).join(dead, "uuid", "left").where("until is null or place >= until").drop("until", "place")

    def bm25(self, words: Sequence[str], k: int) -> DataFrame:
        """(uuid, score) of the k best documents by BM25 over the words; ties take the lesser uuid. No words find nothing."""
        segments = self.segments()
        n, total = sum(s[2] for s in segments), sum(s[3] for s in segments)
        if not words or not n:
            return self.spark.createDataFrame([], "uuid string, score double")
        found = self._live(words, segments)
        tf = {w: f"tf{i}" for i, w in enumerate(dict.fromkeys(words))}
        rows = found.groupBy("uuid").agg(F.first("dl").alias("dl"), *(F.coalesce(F.max(F.when(F.col("term") == w, F.col("tf"))), F.lit(0)).alias(c) for w, c in tf.items()))
        stats = found.agg(*(F.count_if(F.col("term") == w).alias(f"df_{c}") for w, c in tf.items()))
        score = F.lit(0.0)
        for w in words:
            df, f = F.col(f"df_{tf[w]}"), F.col(tf[w])
            score = score + F.ln(1 + (F.lit(n) - df + 0.5) / (df + 0.5)) * f * (config.K1 + 1) / (f + config.K1 * (1 - config.B + config.B * F.col("dl") / F.lit(total / n)))
        return rows.crossJoin(F.broadcast(stats)).select("uuid", F.round(score, 6).alias("score")).orderBy(F.desc("score"), "uuid").limit(k)  # stats is one row

    def compact(self) -> None:
        """Write the postings and documents that count as one segment, then delete the earlier ones."""
        before, seq = self.segments(), uuid.uuid4().hex
        live = self._live(None, before).select("bucket", "term", "uuid", "tf", "dl")
        self._write(live, seq)
        last = self._documents(before).groupBy("uuid").agg(F.max_by(F.struct("dl"), "place").alias("d")).where("d.dl is not null").select("uuid", "d.dl")
        last.write.parquet(f"{self.root}/documents/seq={seq}")
        self.spark.createDataFrame([], "uuid string").write.parquet(f"{self.root}/dead/seq={seq}")
        self._commit([(seq, 0, sum(s[2] for s in before), sum(s[3] for s in before))])
        for s in before:
            for kind in ("postings", "documents", "dead"):
                delete(self.spark, f"{self.root}/{kind}/seq={s[0]}")
