"""Byte-level BPE encoding and decoding by DuckDB recursive queries inside each partition.

A partition cuts its texts into the tokenizer's pattern matches and hands the distinct ones to DuckDB as rows (word,
position, token). A recursive query joins neighbours with the merge table and contracts the leftmost pair of least rank
of every word until no pair merges; an ordered aggregation gives the ids and another one decodes them from the
vocabulary. Texts are then spelt out of the encoded and decoded words; decoded bytes are only kept where they differ from
the word's own, so that a worker holds each word once.

A recursive step contracts one pair of a word and keeps the word's rows, so that a word takes rows in the square of its
length: words are put together into queries of STEP_ROWS such rows. A match of more than LONG_WORD bytes, which would
take seconds or hours, is contracted by the same rule with a heap; its ids join the same tables for the aggregations.

Null texts count as empty: no ids, hashes of the empty string. Whole texts are encoded, without special tokens.
Repeated rows each give a row; extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from array import array
from collections.abc import Iterator
from functools import lru_cache

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm.common import KEPT, give_back, table

VOCABULARY = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
#: Bytes of words after which a Python worker starts a new generation; it remembers this one and the one before.
REMEMBERED_BYTES = 40 << 20
#: What a remembered word takes besides its own characters and ids.
WORD_OVERHEAD = 225
#: Rows that the steps of one recursive query keep, at most.
STEP_ROWS = 1_000_000
#: Texts are encoded in groups of about so many characters, so that memory doesn't follow the batch size.
GROUP_CHARS = 1_000_000
#: A longer pattern match (in bytes) is contracted by a heap.
LONG_WORD = 1024

CONTRACT = """
with recursive step(i, w, p, t, next) as (
 select 0, w, p, t, lead(t) over (partition by w order by p) from start
 union all
 select i, w, p, t, lead(t) over (partition by w order by p) from (
  select s.i + 1 as i, s.w, case when s.p > b.p then s.p - 1 else s.p end as p, case when s.p = b.p then b.m else s.t end as t
  from step s join (
   select a.w, (min(g.m::bigint << 20 | a.p) & 1048575)::int as p, (min(g.m::bigint << 20 | a.p) >> 20)::int as m
   from step a join merges g on g.l = a.t and g.r = a.next group by a.w) b on b.w = s.w
  where s.p <> b.p + 1)),
ended as (select w, max(i) as i from step group by w)
select w, p, t from step semi join ended using (w, i)
"""
SPELL = """
select w, string_agg(t::varchar, ',' order by p) as ids, from_hex(string_agg(hex(v.bytes), '' order by p)) as bytes
from contracted join vocabulary v on v.id = t group by w
"""


@lru_cache(maxsize=2)
def ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def _heap_contract(word: bytes, rank: dict[bytes, int]) -> list[int]:
    """The same contraction of one long word: leftmost pair of least rank first, by a heap over a linked list."""
    n = len(word)
    end = list(range(1, n + 1))
    before = list(range(-1, n - 1))
    alive = [True] * n
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := rank.get(word[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, stop = heapq.heappop(heap)
        if not alive[i] or (j := end[i]) >= n or end[j] != stop:
            continue
        alive[j] = False
        end[i] = stop
        if stop < n:
            before[stop] = i
            if (r := rank.get(word[i : end[stop]])) is not None:
                heapq.heappush(heap, (r, i, end[stop]))
        if (k := before[i]) >= 0 and (r := rank.get(word[k:stop])) is not None:
            heapq.heappush(heap, (r, k, stop))
    out, i = [], 0
    while i < n:
        out.append(rank[word[i : end[i]]])
        i = end[i]
    return out


class Encoder:
    """Encodes and decodes texts with one vocabulary; keeps two generations of words as (ids, decoded bytes if they aren't the word's own)."""

    def __init__(self, path: str, pattern: str) -> None:
        self.rank = ranks(path)
        self.find = regex.compile(pattern).findall
        self.known: dict[str, tuple[bytes, bytes]] = {}
        self.older: dict[str, tuple[bytes, bytes]] = {}
        self.odd = False  # whether any word was decoded to other bytes than its own
        self.held = 0
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": "128MB", "temp_directory": ""})
        rank = self.rank
        merges = {k: array("i") for k in "lrm"}
        for word, i in rank.items():
            for k in range(1, len(word)):
                if (a := rank.get(word[:k])) is not None and (b := rank.get(word[k:])) is not None:
                    merges["l"].append(a)
                    merges["r"].append(b)
                    merges["m"].append(i)
        self._table("merges", pa.table({k: np.frombuffer(v, np.int32) for k, v in merges.items()}))
        self._table("vocabulary", pa.table({"id": pa.array(rank.values(), pa.int32()), "bytes": pa.array(rank, pa.binary())}))
        self.single = np.array([rank[bytes([b])] for b in range(256)], np.int32)

    def _table(self, name: str, rows: pa.Table) -> None:
        self.db.register("incoming", rows)
        self.db.execute(f"create or replace table {name} as select * from incoming")
        self.db.unregister("incoming")

    def learn(self, words: list[str]) -> None:
        """Encode words that aren't known yet, in queries of words of like length."""
        raws = [(w.encode("utf-8", "replace"), w) for w in words]
        raws.sort(key=lambda x: len(x[0]))
        at = 0
        while at < len(raws) and len(raws[at][0]) <= LONG_WORD:
            end, rows = at, 0
            while end < len(raws) and len(raws[end][0]) <= LONG_WORD and (end == at or rows < STEP_ROWS):
                rows += len(raws[end][0]) ** 2 // 2 + 1
                end += 1
            self._query(raws[at:end])
            at = end
        for pair in raws[at:]:
            ids = np.array(_heap_contract(pair[0], self.rank), np.int32)
            self._table("contracted", pa.table({"w": np.zeros(len(ids), np.int32), "p": np.arange(len(ids), dtype=np.int32), "t": ids}))
            self._spell([pair])

    def _query(self, words: list[tuple[bytes, str]]) -> None:
        """Encode some words by the recursive query."""
        sizes = np.array([len(r) for r, _ in words])
        starts = np.cumsum(sizes) - sizes
        places = np.arange(sizes.sum(), dtype=np.int32) - np.repeat(starts, sizes)
        tokens = self.single[np.frombuffer(b"".join([r for r, _ in words]), np.uint8)]
        self._table("start", pa.table({"w": np.repeat(np.arange(len(words), dtype=np.int32), sizes), "p": places.astype(np.int32), "t": tokens}))
        self.db.execute(f"create or replace table contracted as {CONTRACT}")
        self._spell(words)

    def _spell(self, words: list[tuple[bytes, str]]) -> None:
        """Remember the ids of the words in ``contracted``, and what they are decoded to if it isn't the word."""
        for w, ids, raw in self.db.execute(SPELL).fetchall():
            own, word = words[w]
            other = b"" if raw == own else raw
            self.odd = self.odd or raw != own
            self.known[word] = (ids.encode(), other)
            self.held += len(ids) + len(other) + len(word) + WORD_OVERHEAD

    def spell(self, texts: list[str]) -> Iterator[tuple[int, bytes, bytes]]:
        """(number of ids, decimal ids joined by commas, decoded bytes) of every text."""
        if self.held > REMEMBERED_BYTES:
            self.known, self.older, self.held = {}, self.known, 0
        found = [self.find(t) for t in texts]
        known, older, new = self.known, self.older, []
        for w in set().union(*found):
            if w not in known:
                if w in older:
                    known[w] = ids, other = older[w]
                    self.held += len(ids) + len(other) + len(w) + WORD_OVERHEAD
                else:
                    new.append(w)
        self.learn(new)
        for words in found:
            ids = b",".join([known[w][0] for w in words])
            yield ids.count(b",") + 1 if ids else 0, ids, self._decoded(words)

    def _decoded(self, words: list[str]) -> bytes:
        if self.odd:
            return b"".join([self.known[w][1] or w.encode("utf-8", "replace") for w in words])
        return "".join(words).encode("utf-8", "replace")


_ENCODERS: dict[tuple[str, str], Encoder] = KEPT.setdefault("byte_bpe", {})


def encoder(path: str = VOCABULARY, pattern: str = public_tokenizers.PATTERN) -> Encoder:
    """One encoder a Python process, so that tasks on the same worker share its words until another operator runs."""
    if (path, pattern) not in _ENCODERS:
        give_back()
        _ENCODERS[path, pattern] = Encoder(path, pattern)
    return _ENCODERS[path, pattern]


def groups(texts: list[str]) -> Iterator[list[str]]:
    """Consecutive texts of about GROUP_CHARS characters together."""
    out, size = [], 0
    for t in texts:
        out.append(t)
        size += len(t)
        if size >= GROUP_CHARS:
            yield out
            out, size = [], 0
    if out:
        yield out


def encode(documents: DataFrame, digest: bool = False, path: str = VOCABULARY) -> DataFrame:
    """doc_id with n_tokens and, by ``digest``, the hashes of ids and decoded bytes, or else token_ids and decoded text.

    One narrow stage: nothing is shuffled, broadcast or collected.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from loomgraph.llm import byte_bpe  # the worker's own module, whose encoder outlives the task

        own = byte_bpe.encoder(path)
        for batch in (b.slice(i, 1000) for b in batches for i in range(0, b.num_rows, 1000)):
            texts = ["" if t is None else t for t in batch.column("text").to_pylist()]
            at = 0
            for group in byte_bpe.groups(texts):
                keys = batch.column("doc_id").slice(at, len(group))
                at += len(group)
                counts, ids, raws = [], [], []
                for n, joined, raw in own.spell(group):
                    counts.append(n)
                    ids.append(hashlib.sha256(joined).hexdigest() if digest else [int(x) for x in joined.split(b",")] if joined else [])
                    raws.append(hashlib.sha256(raw).hexdigest() if digest else raw.decode("utf-8", "replace"))
                yield pa.RecordBatch.from_arrays(
                    [keys, pa.array(counts, pa.int64()), pa.array(ids, pa.string() if digest else pa.list_(pa.int32())), pa.array(raws, pa.string())],
                    names=["doc_id", "n_tokens", "ids_sha256" if digest else "token_ids", "decoded_sha256" if digest else "decoded"],
                )

    shape = "doc_id bigint, n_tokens bigint, " + ("ids_sha256 string, decoded_sha256 string" if digest else "token_ids array<int>, decoded string")
    return documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, shape)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(table(spark, sf_dir, "documents"), digest=True)
