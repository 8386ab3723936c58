"""The audit of all filter orders against a plain run of every order, and against its SQL."""

import re
from itertools import permutations

import duckdb
from pyspark.sql import functions as F

from loomgraph.llm import filter_trie

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def plain(docs, labels):
    """Every order run on its own over lists."""
    good = {d for d, q, _ in labels if q == 1}
    toxic = {d for d, _, t in labels if t == 1}
    texts = {}
    for d, t, _ in docs:
        if d is not None:
            texts[t or ""] = min(d, texts.get(t or "", d))
    fails = []
    for d, t, _ in docs:
        t = t or ""
        words = WORD.findall(t)
        bad = {"A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words), "C": 100 * sum("A" <= c <= "Z" for c in t) > 2 * len(t), "D": any(c in "#$%&*|" for c in t), "E": d is not None and d > texts[t]}
        fails.append({k for k, v in bad.items() if v})
    out = {}
    for part in {s or "" for _, _, s in docs}:
        mine = [i for i, x in enumerate(docs) if (x[2] or "") == part]
        for order in permutations("ABCDE"):
            left = list(mine)
            for step, f in enumerate(order):
                gone = [i for i in left if f in fails[i]]
                out[part, "".join(order), step + 1] = [
                    len(left) - len(gone), len(gone), sum(f in fails[i] for i in mine if i not in left), sum(fails[i] == {f} for i in mine),
                    sum(docs[i][0] in good for i in gone), sum(docs[i][0] in toxic for i in gone), 0,
                ]
                left = [i for i in left if i not in gone]
    for (part, order, step), row in out.items():
        row[6] = sum(out[part, o, o.index(order[step - 1]) + 1][1] for o in map("".join, permutations("ABCDE")))
    return out


def result(df):
    rows = df.collect()
    assert all(r["filter"] == r.filter_order[r.step - 1] for r in rows)
    found = {(r.part, r.filter_order, r.step): [r[c] for c in COUNTS] for r in rows}
    assert len(found) == len(rows)
    return found


def test_every_order_of_odd_documents(spark):
    long = " ".join(f"w{i}" for i in range(250))
    docs = [
        (1, None, "a"), (2, "", "a"), (3, long, "a"), (4, long, None), (5, long + " X" * 40, "a"), (6, "same " * 300, "b"), (7, "same " * 300, "b"), (7, "same " * 300, "b"), (None, long, "b"), (None, None, None),
        (8, long + " #", "c"), (9, "AB|" * 9, "c"), (10, "é\x0bß " * 250, "c"), (11, "word " * 60_000, "d"), (12, long.upper(), "d"), (0, long.upper(), "d"),
    ]
    labels = [(3, 1, 0), (4, 0, 1), (4, 1, None), (8, 1, 1), (9, None, None), (None, 1, 1), (7, 1, 0)]
    documents = spark.createDataFrame(docs, "doc_id long, text string, source string").withColumns({c: F.lit(9) for c in ("part", "n", "filter", "key", "first", "fails_A", "good")})
    known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int").withColumn("part", F.lit("x"))
    want = plain(docs, [(d, q, t) for d, q, t in labels if d is not None])
    assert result(filter_trie.audit(documents, known)) == want
    assert filter_trie.audit(documents.limit(0), known).count() == 0
    assert {k: v[:4] for k, v in result(filter_trie.audit(documents, known.limit(0))).items()} == {k: v[:4] for k, v in want.items()}


def test_states_are_shared_by_their_orders(spark):
    rows = spark.createDataFrame([("p", True, False, i % 2 == 0, i % 3 == 0, i % 5 == 0) for i in range(60)], "part string, good boolean, toxic boolean, fails_X boolean, fails_Y boolean, fails_Z boolean")
    found = {r.state: (r.n, {k: v.removed for k, v in r.lost.items()}) for r in filter_trie.walk(rows, "XYZ").collect()}
    assert set(found) == {"", "X", "Y", "Z", "XY", "XZ", "YZ", "XYZ"}
    alive = lambda s: [i for i in range(60) if not any(i % n == 0 for k, n in zip("XYZ", (2, 3, 5), strict=True) if k in s)]
    for state, (n, lost) in found.items():
        assert n == len(alive(state))
        assert lost == {k: n - len(alive(state + k)) for k in "XYZ" if k not in state}
    assert not spark.sparkContext._jsc.getPersistentRDDs()


def test_query_equals_its_sql(spark):
    got = filter_trie.query(spark, SF)
    duck = duckdb.connect()
    for t in ("documents", "labels"):
        duck.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    cursor = duck.execute(filter_trie.ORACLE)
    names = [c[0] for c in cursor.description]
    assert sorted(names) == sorted(got.columns)
    assert sorted(map(tuple, got.select(*names).collect())) == sorted(cursor.fetchall())
