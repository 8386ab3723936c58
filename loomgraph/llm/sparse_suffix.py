"""Suffix-array dedup with sparse suffixes at content-selected positions.

A suffix is kept where a GRAM-word gram has the least hash among the grams of some LEAST-word window (a minimiser), so
that every repeated passage of LEAST words keeps a suffix at the same place of each of its occurrences. Suffixes whose
gram occurs in one document only are dropped by a bitmap sized to the shared grams.

The kept suffixes are range-partitioned and sorted by their gram, the words that follow and the words that precede it,
and every suffix is compared with its neighbour. Neighbours of two documents that agree on all of this are extended
left and right at once over the up to 3 * GRAM words around the gram. Those that agree on the gram but differ on a side
are edges of a match: they are extended by single words, each LEAST-word split around the gram being looked up among
those of the suffixes with the same gram. What is found grows into maximal spans by document. No pairs of occurrences
are formed, and a run of equal suffixes that a partition border cuts is put together from its parts' extremes.

Words are runs of characters other than space and \\x09-\\x0D, compared as they are, by 64-bit hashes. A passage repeats
if it occurs in two documents of different doc_id; rows with a null doc_id are ignored, null and short texts have no
spans. Documents without spans give no row. Equal texts are one class, whose documents repeat as a whole. Extra columns
are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomgraph.llm.common import Members, WordHasher, materialise, may_have, mix, powers, signed, table

LEAST, GRAM = 50, 25
_BASE = 0xB5297A4D3F84D5A9 | 1
_UP, _DOWN = powers(_BASE, 1 << 14), powers(pow(_BASE, -1, 1 << 64), 1 << 14)


def windows(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all k-word windows by differences of a running polynomial."""
    global _UP, _DOWN
    n = len(words)
    if n < k:
        return np.zeros(0, np.uint64)
    if n > len(_UP):
        _UP, _DOWN = powers(_BASE, 2 * n), powers(pow(_BASE, -1, 1 << 64), 2 * n)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(mix(words) * _UP[:n], out=total[1:])
    return mix((total[k:] - total[:-k]) * _DOWN[: n - k + 1] + np.uint64(k))


def minimisers(grams: np.ndarray, width: int) -> np.ndarray:
    """For each run of ``width`` grams the place of the least one (leftmost of equal ones), by blockwise minima."""
    n = len(grams)
    if n < width:
        return np.zeros(0, np.int64)
    key = (grams >> np.uint64(24) << np.uint64(24)) | np.arange(n, dtype=np.uint64)
    padded = np.concatenate((key, np.full(-n % width, np.iinfo(np.uint64).max, np.uint64))).reshape(-1, width)
    ahead = np.minimum.accumulate(padded, axis=1).ravel()
    behind = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].ravel()
    return (np.minimum(behind[: n - width + 1], ahead[width - 1 : n]) & np.uint64(0xFFFFFF)).astype(np.int64)


def anchored(words: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(offset, all grams, anchor place of each LEAST-word window) of a text, in parts of at most 2**23 words."""
    for at in range(0, max(len(words) - LEAST + 1, 0), 1 << 23):
        part = words[at : at + (1 << 23) + LEAST - 1]
        grams = windows(part, GRAM)
        yield at, grams, minimisers(grams, LEAST - GRAM + 1)


def stretches(words: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of words[start:end] for many bounds, empty ones included."""
    windows(words, len(words))  # makes the powers long enough
    total = np.zeros(len(words) + 1, np.uint64)
    np.cumsum(mix(words) * _UP[: len(words)], out=total[1:])
    return mix((total[end] - total[start]) * _DOWN[np.minimum(start, len(words) - 1)] + (end - start).astype(np.uint64))


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray]]:
    """(doc_id, word hashes), each text once a partition."""
    hasher, seen = WordHasher(), set()
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            for doc_id, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist(), strict=True):
                words = hasher.words(text or "")[0]
                if len(words) >= LEAST and (k := whole(words)) not in seen:
                    seen.add(k)
                    yield doc_id, words


def whole(words: np.ndarray) -> int:
    """The class of a text: a hash of all its words."""
    return int(signed(windows(words, len(words)))[0])


def shared_grams(documents: DataFrame) -> DataFrame:
    """(gram) of the anchors that two documents have."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams, docs = [], []

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(signed(np.concatenate(grams))), pa.array(np.concatenate(docs))], names=["gram", "doc"])

        for doc_id, words in _parts(batches):
            for _, g, place in anchored(words):
                fresh = place[np.flatnonzero(np.diff(place, prepend=-1))]
                grams.append(g[fresh])
                docs.append(np.full(len(fresh), doc_id, np.int64))
            if sum(map(len, grams)) > 100_000 or len(grams) > 2000:
                yield out()
                grams, docs = [], []
        if grams:
            yield out()

    return documents.mapInArrow(run, "gram bigint, doc bigint").groupBy("gram").agg(F.min("doc").alias("low"), F.max("doc").alias("high")).where("low <> high").select("gram")


SUFFIX = "gram bigint, right bigint, left bigint, doc bigint, place bigint, n_left int, n_right int, first bigint, windows array<bigint>"


def suffixes(documents: DataFrame, grams: Members) -> DataFrame:
    """The kept suffixes, written: gram, hashes of up to GRAM words after and before it, doc, place, and its windows.

    windows are the hashes of the LEAST-word windows whose minimiser it is; the first of them starts at ``first``.
    """
    shared = grams.shared

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for doc_id, words in _parts(batches):
            for offset, g, place in anchored(words):
                begin = np.flatnonzero(np.diff(place, prepend=-1))
                size = np.diff(np.append(begin, len(place)))
                hit = may_have(shared.value, signed(np.ascontiguousarray(g[place[begin]])))
                if not hit.any():
                    continue
                begin, size, kept = begin[hit], size[hit], place[begin[hit]]
                lead = min(offset, GRAM)  # words before the part
                around = words[offset - lead : offset + len(g) + 2 * GRAM - 1]
                at = kept + lead
                left, right = np.maximum(at - GRAM, 0), np.minimum(at + 2 * GRAM, len(around))
                h = windows(words[offset : offset + len(place) + LEAST - 1], LEAST)
                own = h[np.repeat(begin - (np.cumsum(size) - size), size) + np.arange(size.sum())]
                lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(size)), pa.int32()), pa.array(signed(own)))
                columns = [signed(g[kept]), signed(stretches(around, at + GRAM, right)), signed(stretches(around, left, at)), np.full(len(at), doc_id, np.int64), kept + offset]
                yield pa.RecordBatch.from_arrays([*map(pa.array, columns), pa.array(at - left, pa.int32()), pa.array(right - at - GRAM, pa.int32()), pa.array(begin + offset, pa.int64()), lists], names=[c.split()[0] for c in SUFFIX.split(", ")])

    return materialise(grams.exact(documents.mapInArrow(run, SUFFIX), "gram").select(*(c.split()[0] for c in SUFFIX.split(", "))), "suffixes")


def neighbours(suffix: DataFrame) -> DataFrame:
    """(gram, class, low, high): the runs of equal neighbours in the sorted order, with their least and greatest doc."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            gram, right, left, doc = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(4))
            if not len(gram):
                continue
            differs = (gram[1:] != gram[:-1]) | (right[1:] != right[:-1]) | (left[1:] != left[:-1])
            first = np.append(0, np.flatnonzero(differs) + 1)
            rows = [gram[first], right[first], left[first], np.minimum.reduceat(doc, first), np.maximum.reduceat(doc, first)]
            if held is not None:  # the last run may go on in this batch
                if all(held[i] == rows[i][0] for i in range(3)):
                    rows[3][0], rows[4][0] = min(rows[3][0], held[3]), max(rows[4][0], held[4])
                else:
                    rows = [np.append(h, r) for h, r in zip(held, rows, strict=True)]
            held = [r[-1] for r in rows]
            yield pa.RecordBatch.from_arrays([pa.array(r[:-1]) for r in rows], names=["gram", "right", "left", "low", "high"])
        if held is not None:
            yield pa.RecordBatch.from_arrays([pa.array([h], pa.int64()) for h in held], names=["gram", "right", "left", "low", "high"])

    key = ["gram", "right", "left"]
    ordered = suffix.select(*key, "doc").repartitionByRange(*key, "doc").sortWithinPartitions(*key, "doc")
    runs = ordered.mapInArrow(run, "gram bigint, right bigint, left bigint, low bigint, high bigint")
    return runs.groupBy(*key).agg(F.min("low").alias("low"), F.max("high").alias("high")).select("gram", F.xxhash64(*key).alias("class"), "low", "high")


def matches(suffix: DataFrame) -> DataFrame:
    """(doc, start, end) of matches of LEAST words or more between documents; they may overlap."""
    of = F.xxhash64("gram", "right", "left")
    runs = materialise(neighbours(suffix), "runs")
    whole_runs = materialise(runs.where("low <> high").select("class"), "whole")
    # Grams whose suffixes differ: each of these may have a longer match with another on one side.
    mixed = materialise(runs.groupBy("gram").agg(F.count(F.lit(1)).alias("n"), F.min("low").alias("low"), F.max("high").alias("high")).where("n > 1 and low <> high").select("gram"), "mixed")
    grams, edges = Members(mixed, "gram"), Members(runs.where("low = high").join(mixed, "gram", "left_semi").select("class"), "class")
    entire = suffix.select(of.alias("class"), "doc", "place", "n_left", "n_right").join(whole_runs, "class").select("doc", (F.col("place") - F.col("n_left")).alias("start"), (F.col("place") + GRAM + F.col("n_right")).alias("end"))

    def split(members: Members, by: str) -> DataFrame:
        """(window, doc, start) of the suffixes that may be members by a column."""
        shared = members.shared

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                part = batch.take(pa.array(np.flatnonzero(may_have(shared.value, batch.column("by").to_numpy(zero_copy_only=False)))))
                lists = part.column("windows")
                size = np.asarray(lists.value_lengths())
                begin = np.repeat(part.column("first").to_numpy(zero_copy_only=False) - (np.cumsum(size) - size), size) + np.arange(size.sum())
                yield pa.RecordBatch.from_arrays([lists.flatten(), pa.array(np.repeat(part.column("doc").to_numpy(zero_copy_only=False), size)), pa.array(begin)], names=["window", "doc", "start"])

        rows = members.exact(suffix.withColumn(by, F.col("gram") if by == "gram" else of), by)
        return rows.select(F.col(by).alias("by"), "doc", "first", "windows").mapInArrow(run, "window bigint, doc bigint, start bigint")

    repeated = materialise(split(grams, "gram").groupBy("window").agg(F.min("doc").alias("low"), F.max("doc").alias("high")).where("low <> high").select("window"), "repeated")
    partial = split(edges, "class").join(repeated, "window").select("doc", "start", (F.col("start") + LEAST).alias("end"))
    return entire.unionByName(partial)


def classes(documents: DataFrame) -> DataFrame:
    """(doc_id, class, n_words) of every text of LEAST words or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHasher()
        for batch in batches:
            rows = []
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                for doc_id, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist(), strict=True):
                    words = hasher.words(text or "")[0]
                    if len(words) >= LEAST:
                        rows.append((doc_id, whole(words), len(words)))
            ids, keys, n = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(keys, pa.int64()), pa.array(n, pa.int64())], names=["doc_id", "class", "n_words"])

    return documents.mapInArrow(run, "doc_id bigint, class bigint, n_words bigint")


def repeated_spans(documents: DataFrame) -> DataFrame:
    """doc_id, start_word, end_word (exclusive), n_words, copy_of of every maximal span of repeated LEAST-word windows.

    copy_of is given for a text that other documents hold as a whole: the least of their doc_ids, its own included.
    """
    source = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id is not null")
    known = materialise(classes(source), "classes")
    copied = materialise(known.groupBy("class").agg(F.min("doc_id").alias("copy_of"), F.max("doc_id").alias("last")).where("copy_of <> last").drop("last"), "copied")
    grams = Members(shared_grams(source), "gram")
    found = matches(suffixes(source, grams))
    order = Window.partitionBy("doc").orderBy("start", "end")
    reach = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    islands = found.withColumn("new", F.coalesce((F.col("start") > reach).cast("int"), F.lit(1))).withColumn("island", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    spans = islands.groupBy("doc", "island").agg(F.min("start").alias("start_word"), F.max("end").alias("end_word"))
    entire = known.join(copied, "class").select("doc_id", F.lit(0).cast("bigint").alias("start_word"), F.col("n_words").alias("end_word"), "copy_of").distinct()
    parts = spans.select(F.col("doc").alias("doc_id"), "start_word", "end_word", F.lit(None).cast("bigint").alias("copy_of")).join(entire.select("doc_id").distinct(), "doc_id", "left_anti")
    return entire.unionByName(parts).select("doc_id", "start_word", "end_word", (F.col("end_word") - F.col("start_word")).alias("n_words"), "copy_of")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_spans(table(spark, sf_dir, "documents"))


#: The spans by comparing all windows as text, in DuckDB SQL.
ORACLE = rf"""
with d as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents where doc_id is not null),
g as (select doc_id, p, md5(array_to_string(w[p + 1:p + {LEAST}], ' ')) as s from (select doc_id, w, unnest(range(0, len(w) - {LEAST - 1})) as p from d where len(w) >= {LEAST})),
c as (select s from g group by s having count(distinct doc_id) > 1),
f as (select doc_id, p, case when p - lag(p, 1, -1000) over (partition by doc_id order by p) > {LEAST} then 1 else 0 end as fresh from g join c using (s)),
i as (select *, sum(fresh) over (partition by doc_id order by p) as island from f),
k as (select array_to_string(w, ' ') as t, min(doc_id) as copy_of from d group by 1 having count(distinct doc_id) > 1)
select doc_id, min(p)::bigint as start_word, (max(p) + {LEAST})::bigint as end_word, (max(p) + {LEAST} - min(p))::bigint as n_words, any_value(k.copy_of) as copy_of
from i join d using (doc_id) left join k on k.t = array_to_string(d.w, ' ') group by doc_id, island"""
