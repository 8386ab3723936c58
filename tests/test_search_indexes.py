"""Full-text index, vector index and multi-pattern matcher against plain forms."""

import math
import random
import re
import tempfile
from collections import Counter
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomgraph.operators import patterns, retrieval
from loomgraph.operators.fulltext import FullText
from loomgraph.operators.vectors import VectorIndex

SF = "/root/testdata/sf0.1"
EPISODE = "uuid string, content string, archived boolean"


def plain_bm25(texts, words, k):
    """BM25 over a dict of texts in plain Python."""
    bags = {u: [t for t in re.split(r"[^\w]+", (c or "").lower()) if t] for u, c in texts.items()}
    n = len(bags)
    mean = sum(map(len, bags.values())) / n
    counts = {u: Counter(b) for u, b in bags.items()}
    df = {w: sum(c[w] > 0 for c in counts.values()) for w in words}
    out = []
    for u, c in counts.items():
        if any(c[w] for w in words):
            score = 0.0
            for w in words:
                score += math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) * c[w] * 2.2 / (c[w] + 1.2 * (0.25 + 0.75 * len(bags[u]) / mean))
            out.append((u, round(score, 6)))
    return sorted(out, key=lambda x: (-x[1], x[0]))[:k]


def files(root, kind):
    return {str(p.relative_to(root)): p.stat().st_mtime_ns for p in Path(root, kind).rglob("*.parquet")}


def same(got, want):
    assert [u for u, _ in got] == [u for u, _ in want] and all(abs(a[1] - b[1]) < 2e-6 for a, b in zip(got, want, strict=True))


def test_index_through_updates_removals_and_compaction(spark):
    draw, root = random.Random(4), tempfile.mkdtemp(prefix="loomgraph-test-")
    words = "apple pear plum fig lime kiwi date".split()
    texts = {f"u{i}": " ".join(draw.choice(words) for _ in range(draw.randint(0, 30))) for i in range(120)} | {"none": None, "long": "apple " * 20_000}
    index = FullText(spark, f"file://{root}")
    assert index.bm25(["apple"], 5).count() == 0
    rows = lambda part, gone=False: spark.createDataFrame([(u, c, gone) for u, c in part.items()], EPISODE).withColumns({c: F.lit("x") for c in ("term", "tf", "dl", "seq", "place")})
    index.add(rows(texts).unionByName(rows({"away": "apple pear"}, True)))
    asked = [["apple", "fig"], ["kiwi"], ["plum", "plum", "nothing"], ["nothing"]]

    def check():
        for q in asked:
            same([tuple(r) for r in index.bm25(q, 15).collect()], plain_bm25(texts, q, 15))

    check()
    first = {k: files(root, k) for k in ("postings", "documents")}
    change = {"u3": "fig fig fig", "u4": "", "new": "kiwi lime"}
    texts |= change
    index.add(rows(change))
    check()
    for u in ("u3", "u9", "long"):
        del texts[u]
    index.remove(spark.createDataFrame([("u3",), ("u9",), ("long",), ("unknown",), ("u9",)], "uuid string"))
    check()
    texts["u9"] = "plum back again"
    index.add(rows({"u9": texts["u9"]}))
    check()
    # Updates have written files of their own and no earlier one.
    assert all(first[k].items() <= files(root, k).items() for k in first) and len(index.segments()) == 4
    index.compact()
    check()
    assert len(index.segments()) == 1 and not first["postings"].keys() & files(root, "postings").keys()
    index.add(rows({"u1": "date"}))
    texts["u1"] = "date"
    check()
    assert index.bm25([], 5).count() == 0


def test_search_reads_the_buckets_of_its_words(spark):
    root = tempfile.mkdtemp(prefix="loomgraph-test-")
    index = FullText(spark, f"file://{root}")
    index.add(spark.createDataFrame([(f"u{i}", " ".join(f"w{(i * j) % 500}" for j in range(40)), None) for i in range(50)], EPISODE))
    plan = index._live(["w7", "w8"], index.segments())._jdf.queryExecution().toString()
    pruned = re.search(r"PartitionFilters: \[([^\]]*)", plan)[1]
    assert "bucket" in pruned and re.search(r"PushedFilters: \[[^\]]*In\(term", plan)
    found = index._live(["w7"], index.segments())
    found.collect()
    read = found._jdf.queryExecution().executedPlan().collectLeaves().head().metrics().apply("numFiles").value()
    assert 1 <= read <= 2 < len(files(root, "postings"))


def test_a_writer_that_dies_leaves_the_index(spark, monkeypatch):
    root = tempfile.mkdtemp(prefix="loomgraph-test-")
    index = FullText(spark, f"file://{root}")
    index.add(spark.createDataFrame([("a", "one two", None), ("b", "two", None)], EPISODE))
    before = index.bm25(["two"], 5).collect()
    with monkeypatch.context() as m:
        m.setattr(FullText, "_commit", lambda *a: (_ for _ in ()).throw(RuntimeError("lost")))
        with pytest.raises(RuntimeError, match="lost"):
            index.add(spark.createDataFrame([("a", "three", None)], EPISODE))
    assert index.bm25(["two"], 5).collect() == before and index.bm25(["three"], 5).count() == 0
    index.add(spark.createDataFrame([("a", "three", None)], EPISODE))
    assert [r.uuid for r in index.bm25(["two"], 5).collect()] == ["b"] and [r.uuid for r in index.bm25(["three"], 5).collect()] == ["a"]


def test_searches_with_and_without_an_index_agree(spark):
    rows = [(f"u{i}", f"capsule-{i}" if i % 3 else f"obs-{i}", f"word{i % 4} word{i % 3} filler" * (i % 5), i % 11 == 0, "type=bugfix project=p") for i in range(60)]
    e = spark.createDataFrame(rows, "uuid string, name string, content string, archived boolean, source_description string").withColumn("usage_count", F.lit(0))
    index = FullText(spark, f"file://{tempfile.mkdtemp(prefix='loomgraph-test-')}")
    index.add(e)
    for text in ("word1 word2", "capsule-1", "zzz", "  "):
        assert retrieval.matching(e, text, 12, index).orderBy("uuid").collect() == retrieval.matching(e, text, 12).orderBy("uuid").collect()


def unit(v):
    v = np.asarray(v, float)
    return v / np.sqrt((v**2).sum())


def test_exact_vector_search_equals_brute_force(spark):
    r = np.random.default_rng(2)
    centres = r.standard_normal((6, 8))
    rows = [(i, (centres[i % 6] + 0.3 * r.standard_normal(8)).astype(np.float32).tolist()) for i in range(300)]
    rows += [(1000 + i, rows[5][1]) for i in range(150)]  # a third of all rows are copies
    rows += [(2000, None), (2001, [0.0] * 8), (2002, [1.0, 2.0]), (2003, [])]
    table = spark.createDataFrame(rows, "id long, embedding array<float>").withColumns({"cell": F.lit(1), "angle": F.lit(0.0)})
    index = VectorIndex.build(table.repartition(5), f"file://{tempfile.mkdtemp(prefix='loomgraph-test-')}/v", cells=9)
    asked = [(i, v) for i, v in rows if i % 37 == 0 or i >= 2000]
    queries = spark.createDataFrame(asked, "id long, embedding array<float>")
    got = {}
    for x in index.search(queries, 7, probes=2, exact=True).collect():
        got.setdefault(x.query, []).append((x.place, x.id, x.similarity))
    good = [(i, unit(v)) for i, v in rows if v and len(v) == 8 and any(v)]
    for i, v in asked:
        if i >= 2000:
            assert i not in got
            continue
        want = sorted(((-round(float(unit(v) @ u), 6), j) for j, u in good))[:7]
        assert [(j, -s) for s, j in want] == [(j, s) for _, j, s in sorted(got[i])]
    empty = VectorIndex.build(table.limit(0), f"file://{tempfile.mkdtemp(prefix='loomgraph-test-')}/v")
    assert empty.search(queries, 3, exact=True).count() == 0 and index.search(queries.limit(0), 3).count() == 0


def test_recall_of_probes_over_the_table(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").select(F.col("vec_id").alias("id"), "embedding")
    index = VectorIndex.build(rows, f"file://{tempfile.mkdtemp(prefix='loomgraph-test-')}/v")
    queries = rows.where("id % 50 = 0")
    near = {(r.query, r.id) for r in index.search(queries, 10).collect()}
    true = {(r.query, r.id) for r in index.search(queries, 10, exact=True).collect()}
    recall = len(near & true) / len(true)
    print("recall", recall, "cells", len(index.centres))
    assert recall >= 0.9


def test_occurring_patterns(spark):
    texts = [(1, "abcabcab"), (2, "xéyé漢字"), (3, ""), (4, None), (5, "cab " * 50_000), (5, "bca")]
    asked = ["abc", "bca", "ab", "c", "é漢", "", None, "abc", "zz", "b c"]
    t = spark.createDataFrame(texts, "k long, t string").withColumn("pattern", F.lit("clash"))
    p = spark.createDataFrame([(a,) for a in asked], "pattern string")
    want = sorted((k, a) for k, x in texts if x is not None for a in {a for a in asked if a is not None} if a in x)
    for block in (1 << 20, 4):
        assert sorted(map(tuple, patterns.occurring(t, ["k"], "t", p, block).collect())) == want
    assert patterns.occurring(t, ["k"], "t", p.limit(0)).count() == 0 and patterns.occurring(t.limit(0), ["k"], "t", p).count() == 0
