"""Merge-on-read tables against a dict, with the files that each write leaves."""

import random
import tempfile
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from loomgraph.operators import merging

SCHEMA = "k long, name string, n int"


def files(root):
    return {str(p.relative_to(root)): p.stat().st_mtime_ns for p in Path(root, "data").rglob("*.parquet")}


def test_writes_deletes_and_compaction(spark):
    draw, root, want = random.Random(3), tempfile.mkdtemp(prefix="loomgraph-test-"), {}
    t = merging.MergeTable(spark, f"file://{root}", "k", SCHEMA, buckets=8)
    assert t.read().count() == 0 and t.lookup([1]).count() == 0 and t.compact() == []

    def put(rows):
        want.update({k: (name, n) for k, name, n in rows})
        t.upsert(spark.createDataFrame(rows, SCHEMA).withColumns({"deleted": F.lit("x"), "seq": F.lit("x"), "bucket": F.lit("x")}))

    def check():
        assert {r.k: (r.name, r.n) for r in t.read().collect()} == want
        assert t.read().count() == len(want)

    put([(i, f"n{i}", i) for i in range(200)])
    check()
    base = files(root)
    put([(5, "five", None), (7, None, 0), (900, "new", 1)])
    check()
    t.delete(spark.createDataFrame([(7,), (8,), (8,), (None,), (12345,)], "k long"))
    want.pop(7), want.pop(8)
    check()
    put([(8, "back", 8), (5, "again", 5)])
    check()
    merging.changed(t, spark.createDataFrame([(k,) for k in (1, 5, 6, 5, 999)], "k long"), {"n": F.coalesce("n", F.lit(0)) + 100})
    for k in (1, 5, 6):
        want[k] = (want[k][0], (want[k][1] or 0) + 100)
    check()
    # Small writes have left all earlier files alone.
    after = files(root)
    assert base.items() <= after.items() and len(after) < 3 * len(base)
    assert {r.k: r.name for r in t.lookup([5, 8, 7, 12345]).collect()} == {5: "again", 8: "back"} and t.lookup([]).count() == 0
    touched = {b for b, _, p in t.manifest() if p > 0}
    assert set(t.compact()) == touched and all(p == 0 for _, _, p in t.manifest())
    check()
    left = files(root)
    untouched = {f: m for f, m in base.items() if int(f.split("bucket=")[1].split("/")[0]) not in touched}
    assert untouched.items() <= left.items() and len(untouched) == len(base) - len(touched) and t.compact() == []
    for _ in range(3):
        put([(draw.randrange(250), "r", i) for i in range(1)])
    check()
    assert t.compact(least=5) == []


def test_a_writer_that_dies_and_unfit_keys(spark, monkeypatch):
    t = merging.MergeTable(spark, f"file://{tempfile.mkdtemp(prefix='loomgraph-test-')}", "k", SCHEMA)
    rows = lambda *r: spark.createDataFrame(list(r), SCHEMA)
    t.upsert(rows((1, "a", 1), (2, "b", 2)))
    with monkeypatch.context() as m:
        m.setattr(merging.MergeTable, "_commit", lambda *a: (_ for _ in ()).throw(RuntimeError("lost")))
        for write in (lambda: t.upsert(rows((1, "x", 9))), lambda: t.delete(rows((2, "", 0))), lambda: t.compact(0)):
            with pytest.raises(RuntimeError, match="lost"):
                write()
    assert sorted(map(tuple, t.read().collect())) == [(1, "a", 1), (2, "b", 2)]
    for unfit in (rows((3, "a", 1), (3, "b", 1)), rows((None, "a", 1))):
        with pytest.raises(ValueError, match="null keys"):
            t.upsert(unfit)
    t.upsert(rows().limit(0))
    assert sorted(map(tuple, t.read().collect())) == [(1, "a", 1), (2, "b", 2)]
    t.delete(rows((1, "", 0), (2, "", 0)))
    t.compact()
    assert t.read().count() == 0
