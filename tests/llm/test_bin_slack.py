"""Packing: exact round trip of all ids, windows without padding, the subset-sum against brute force."""

import random
import zlib
from collections import defaultdict
from itertools import product

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from loomgraph.llm import bin_slack

SF = "/root/testdata/sf0.001"


def tokenizer():
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    t.encode_special_tokens = True
    return t


def test_closest_sum_equals_brute_force():
    draw = random.Random(5)
    for _ in range(400):
        counts = {n: draw.randint(1, 3) for n in sorted(draw.sample(range(1, 30), draw.randint(1, 5)), reverse=True)}
        capacity = draw.randint(1, 60)
        chosen = bin_slack.closest(counts, capacity)
        assert all(0 < n <= counts[length] for length, n in chosen) and len({x for x, _ in chosen}) == len(chosen)
        sums = [sum(a * b for a, b in zip(counts, take, strict=True)) for take in product(*(range(n + 1) for n in counts.values()))]
        assert sum(a * b for a, b in chosen) == max(s for s in sums if s <= capacity)


def test_windows_are_full_and_the_last_are_powers_of_two():
    draw, pool, total = random.Random(1), bin_slack.Pool(), 0
    for i in range(300):
        n = 700 if i % 3 == 0 else draw.randint(1, 2047)
        pool.add(i, 0, bytes(4 * n), n)
        total += n
    sizes = [sum(len(p[2]) // 4 for p in w) for w in pool.windows(2048, 0)]
    assert sum(sizes) == total and pool.tokens == 0 and not pool.pieces
    full = total // 2048
    assert sizes[:full] == [2048] * full and sizes[full:] == [1 << b for b in range(11, -1, -1) if total % 2048 >> b & 1]


def check(rows, texts, capacity=2048):
    """All ids of all texts once and in order; sequences without gaps and without padding."""
    t, parts, sequences = tokenizer(), defaultdict(list), defaultdict(list)
    for r in rows:
        parts[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
    assert set(parts) == set(texts)
    for key, text in texts.items():
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 1]
        at = 0
        for r in sorted(parts[key], key=lambda r: r.start):
            assert r.start == at and 0 < r.length <= capacity and r.doc_tokens == len(ids)
            own = ids[at : at + r.length]
            assert (r.ids == own) if "ids" in r else (r.ids_crc32 == zlib.crc32(np.array(own, "<u4").tobytes()))
            at += r.length
        assert at == len(ids)
    for pieces in sequences.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= capacity and at & (at - 1) == 0  # full, or a power of two: nothing is padded
    return parts, sequences


TEXTS = [
    None, "", " \n\t ", "a", "Hello, world's don't I'll WE'VE 12345", "ÉCOLE über Straße ÿ ß", "İstanbul ΣΊΣΥΦΟΣ Ωmega", "été ́x", "漢字かな 🙂🙂  x y\x85z", "a\x1cb\x1fc\x00d",
    "<|endoftext|> x<|startoftext|>y", "ﬁ ｆｕｌｌ ǅ ŉ", "x" * 5000, "word " * 30_000, "don't " * 700, "''''s 's't", "ªº µ ½ ² ٣", "tab\tnew\nline\x0bvt\x0cff\rcr",
]


def test_round_trip_of_odd_texts(spark):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").withColumns({c: F.lit("x") for c in ("start", "ids", "offset", "length")})
    for digest in (False, True):
        check(bin_slack.pack(docs.repartition(3, "doc_id"), digest=digest).collect(), dict(enumerate(TEXTS)))
    repeated = spark.createDataFrame([(None, "a b"), (None, "a b"), (3, "c"), (3, "c")], "doc_id long, text string")
    rows = bin_slack.pack(repeated).collect()
    assert sorted(str(r.doc_id) for r in rows if r.start == 0) == ["3", "3", "None", "None"]
    assert sum(r.length for r in rows) == 2 * 3 + 2 * 2
    assert bin_slack.pack(docs.limit(0)).count() == 0


def test_pool_is_bounded_and_words_are_forgotten(spark, monkeypatch):
    monkeypatch.setattr(bin_slack, "REMEMBERED", 50)
    own, t = bin_slack.Encoder(bin_slack.VOCABULARY), tokenizer()
    for i in range(20):
        texts = [f"Wörd{(i * j) % 70} x{j % 9}, end{i}." for j in range(40)]
        assert [np.frombuffer(x, "<u4").tolist() for x in own.ids(texts)] == [t.encode(x, add_special_tokens=False).ids for x in texts]
        assert len(own) <= 50 + 120
    # A small capacity, so that windows are taken from the pool and from long texts many times.
    texts = {i: "alpha beta gamma " * (i % 60) for i in range(400)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").coalesce(1)
    check(bin_slack.pack(docs, capacity=64).collect(), texts, capacity=64)


def test_query_over_the_table(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}
    parts, sequences = check(bin_slack.query(spark, SF).collect(), texts)
    cut = sum(len(p) > -(-p[0].doc_tokens // 2048) for p in parts.values())
    assert cut <= 12 * len({s >> 40 for s in sequences})  # beyond full windows, documents are cut at the end of a task alone
