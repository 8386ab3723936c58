import hashlib
import random

import public_tokenizers
import tiktoken

from loomgraph.llm import byte_bpe

TEXTS = [
    None, "", " ", "\n\n  \n", "Hello world, it's 1234 o'clock!", "naïve ÉCOLE straße señor 漢字かな 🙂🙂\u0000",
    "a" * 3000, " " * 2500 + "x", "ab" * 900 + "!?" * 700, "word " * 500, "x" * 401, "y" * 1024, "y" * 1025, "日本語" * 200,
]


def exact():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.ranks(byte_bpe.VOCABULARY), special_tokens={})


def noise(seed):
    r = random.Random(seed)
    return "".join(r.choice("abcdehilnorstuéèß ñ\t\n.,!*#0123 ") for _ in range(r.randint(0, 400)))


def test_encoder_agrees_with_the_library_and_round_trips():
    texts = [t or "" for t in TEXTS] + [noise(i) for i in range(200)]
    own = byte_bpe.Encoder(byte_bpe.VOCABULARY, public_tokenizers.PATTERN)
    for text, (n, ids, raw) in zip(texts, own.spell(texts), strict=True):
        want = exact().encode_ordinary(text)
        assert ids.decode() == ",".join(map(str, want))
        assert n == len(want)
        assert raw == text.encode()


def test_heap_contraction_equals_the_query():
    rank = byte_bpe.ranks(byte_bpe.VOCABULARY)
    for i in range(100):
        word = noise(i).encode()[:60]
        if word:
            assert byte_bpe._heap_contract(word, rank) == exact()._encode_single_piece(word)


def test_every_word_takes_the_query_and_bytes_come_from_ids(monkeypatch):
    own = byte_bpe.Encoder(byte_bpe.VOCABULARY, public_tokenizers.PATTERN)
    sent = []
    query = own._query
    monkeypatch.setattr(own, "_query", lambda words: (sent.extend(w for _, w in words), query(words)))
    monkeypatch.setattr(byte_bpe, "_heap_contract", lambda word, rank: [rank[bytes([b])] for b in b"decoded from ids"])
    got = list(own.spell(["the cat sat" + "x" * 1100]))[0]
    assert {"the", " cat"} <= set(sent) and got[2] == b"the cat" + b"decoded from ids"


def test_what_a_worker_remembers_is_bounded(monkeypatch):
    monkeypatch.setattr(byte_bpe, "REMEMBERED_BYTES", 40_000)
    own = byte_bpe.Encoder(byte_bpe.VOCABULARY, public_tokenizers.PATTERN)
    for i in range(12):
        list(own.spell([" ".join(f"w{i}x{k}" for k in range(100))]))
        held = sum(len(v[0]) + len(v[1]) + len(w) + byte_bpe.WORD_OVERHEAD for d in (own.known, own.older) for w, v in d.items())
        assert held < 3 * 40_000


def test_memory_bound_doesnt_change_results(monkeypatch):
    monkeypatch.setattr(byte_bpe, "REMEMBERED_BYTES", 10)
    own = byte_bpe.Encoder(byte_bpe.VOCABULARY, public_tokenizers.PATTERN)
    for text in (noise(1), noise(2), noise(1)):
        assert list(own.spell([text]))[0][2] == text.encode()


def test_rows_nulls_repeats_and_clashing_columns(spark):
    rows = [(i, t, "n") for i, t in enumerate(TEXTS)] + [(0, "again", "n"), (0, "again", "n"), (None, "no id", "n")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")
    got = byte_bpe.encode(docs, digest=True).collect()
    assert len(got) == len(rows)
    by_id = {r.doc_id: r for r in got}
    want = exact().encode_ordinary(TEXTS[5])
    assert by_id[5].ids_sha256 == hashlib.sha256(",".join(map(str, want)).encode()).hexdigest()
    assert by_id[5].decoded_sha256 == hashlib.sha256(TEXTS[5].encode()).hexdigest()
    assert by_id[1].n_tokens == 0 and by_id[1].ids_sha256 == hashlib.sha256(b"").hexdigest()
    plain = {r.doc_id: r for r in byte_bpe.encode(docs).collect()}
    assert plain[4].decoded == TEXTS[4] and plain[4].token_ids == exact().encode_ordinary(TEXTS[4])
    assert byte_bpe.encode(docs.limit(0), digest=True).count() == 0
