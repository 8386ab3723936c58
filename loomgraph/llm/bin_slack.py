"""Packing: documents' tokens into windows of a fixed capacity by minimum bin slack.

A document is its token ids and one end id. Full windows are cut from its front; what remains of it (less than a window)
joins the task's pool, kept by length. A window takes the multiset of remaining lengths whose sum is closest to the
capacity: a subset-sum over bitsets (bit s of an integer: some choice of the lengths so far has sum s), longest lengths
first, until the capacity's bit is set; how many pieces of each length to take is traced back through the bitsets. Where
no choice is exact, the slack is filled by cutting the longest piece left, which then is longer than the slack. The last
ids of a task, less than a window, go into windows of powers of two, so that nothing is padded anywhere.

One narrow stage: nothing is shuffled, collected or broadcast. A task holds its pool of POOL tokens at most and a bounded
memory of encoded words. Sequence ids hold the number of the partition, so a task that is run again gives the same rows,
provided that its partition has the same rows in the same order, as partitions read from files have.

A null text is empty: the end id alone. Strings of special tokens in a text are ordinary text. Repeated rows and null
ids are packed like others; other columns are ignored; an empty table gives no pieces.
"""

from __future__ import annotations

import os
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm.common import KEPT, free_kept, table

CAPACITY = 2048
END = 1
#: Tokens that a task's pool holds before windows are taken from it, down to half of them.
POOL = 1 << 19
#: Words that a worker remembers, in each of two generations; half as many pieces of words.
REMEMBERED = 700_000
#: Characters handled together.
GROUP_CHARS = 1 << 20
VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
#: Letters that normalisation leaves alone but for their case, which Python folds as the tokenizer does: Latin-1.
_PLAIN = re.compile(r"[\x21-\x7eÀ-ÖØ-öø-ÿ]*").fullmatch
#: The tokenizer's own pattern of pieces, its classes written out for these letters in lower case. Fixed value.
_PIECES = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^\sa-zß-öø-ÿ0-9]+").findall
_WORDS = re.compile(r"[^\x20\x09-\x0D]+").findall
#: Separators for Python's split that are no white space for the tokenizer.
_CONTROLS = ("\x1c", "\x1d", "\x1e", "\x1f")


class Encoder(dict):
    """Word (a run without ASCII white space) to its ids as little-endian 32-bit bytes; learns what it lacks.

    The tokenizer splits at white space, and no merge, normalisation or match crosses it, so a text's ids are those of
    its words. Plain words are cut into the tokenizer's pieces here, so that each piece is encoded once; all others go
    through the whole tokenizer.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        super().__init__()
        self.whole = Tokenizer.from_file(path)
        self.whole.encode_special_tokens = True
        # Pieces are joined by spaces and encoded together; a piece ends with the token that has the end-of-word mark.
        self.pieces = Tokenizer.from_file(path)
        self.pieces.encode_special_tokens = True
        self.pieces.normalizer = None
        self.pieces.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        mark, vocabulary = self.whole.model.end_of_word_suffix, self.whole.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for w, i in vocabulary.items() if w.endswith(mark)]] = True
        self.older: dict[str, bytes] = {}
        self.known: dict[str, bytes] = {}
        self.known_older: dict[str, bytes] = {}

    def _piece(self, piece: str) -> bytes | None:
        found = self.known.get(piece)
        if found is None and (found := self.known_older.get(piece)) is not None:
            self.known[piece] = found
        return found

    def learn(self, words: list[str]) -> None:
        """Remember the ids of new words."""
        plain, cut, known = [], [], self.known
        for w in words:
            if not _PLAIN(w):
                self[w] = array("I", self.whole.encode(w, add_special_tokens=False).ids).tobytes()
                continue
            low = w.lower()
            plain.append(w)
            cut.append([low] if low.isalpha() else [low[:-1], low[-1]] if low[-1] in ".,;:!?" and low[:-1].isalpha() else _PIECES(low))
        new = [p for p in set().union(*cut) if self._piece(p) is None]
        for at in range(0, len(new), 2000):
            some = new[at : at + 2000]
            ids = np.array(self.pieces.encode_batch_fast([" ".join(some)], add_special_tokens=False)[0].ids, "<u4")
            stops = np.flatnonzero(self.ends[ids]) + 1
            if len(stops) != len(some):
                raise ValueError("the tokenizer did not end every piece")
            raw, last = ids.tobytes(), 0
            for p, stop in zip(some, (4 * stops).tolist(), strict=True):
                known[p] = raw[last:stop]
                last = stop
        for w, pieces in zip(plain, cut, strict=True):
            self[w] = known[pieces[0]] if len(pieces) == 1 else b"".join([known[p] for p in pieces])

    def ids(self, texts: list[str]) -> Iterator[bytes]:
        """The ids of every text; each word is looked up once, and the missing ones of all texts are learned together."""
        if len(self) > REMEMBERED:
            self.older = dict(self)
            self.clear()
        if len(self.known) > REMEMBERED // 2:
            self.known, self.known_older = {}, self.known
        split = [_WORDS(t) if any(c in t for c in _CONTROLS) else t.split() for t in texts]
        found = [list(map(self.get, words)) for words in split]
        missing = [[k for k, ids in enumerate(x) if ids is None] if None in x else () for x in found]
        new = {words[k] for words, at in zip(split, missing, strict=True) for k in at}
        back = [w for w in new if w in self.older]
        self.update((w, self.older[w]) for w in back)
        self.learn(list(new.difference(back)))
        for words, ids, at in zip(split, found, missing, strict=True):
            for k in at:
                ids[k] = self[words[k]]
            yield b"".join(ids)


_ENCODERS: dict[str, Encoder] = KEPT.setdefault("bin_slack", {})


def encoder(path: str) -> Encoder:
    """One encoder a Python process until another operator runs."""
    if path not in _ENCODERS:
        free_kept()
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def closest(counts: dict[int, int], capacity: int) -> list[tuple[int, int]]:
    """(length, how many) of a choice from ``counts`` (length to number) whose sum is as close below ``capacity`` as can be.

    ``counts`` is in falling order of length. Bounded numbers are taken in steps of powers of two.
    """
    reach, layers, mask = 1, [], (1 << (capacity + 1)) - 1
    for length, n in counts.items():
        if length > capacity or not n:
            continue
        layers.append((length, reach))
        n, step = min(n, capacity // length), 1
        while n:
            step = min(step, n)
            reach |= (reach << (step * length)) & mask
            n -= step
            step *= 2
        if reach >> capacity:
            break
    at, out = reach.bit_length() - 1, []
    for length, before in reversed(layers):
        n = 0
        while not before >> at & 1:
            at -= length
            n += 1
        if n:
            out.append((length, n))
    return out


class Pool:
    """Pieces waiting for a window: (doc_id, start, ids, doc_tokens) by length."""

    def __init__(self) -> None:
        self.pieces: dict[int, list[tuple]] = {}
        self.tokens = 0

    def add(self, key, start: int, ids: bytes, total: int) -> None:
        self.pieces.setdefault(len(ids) // 4, []).append((key, start, ids, total))
        self.tokens += len(ids) // 4

    def windows(self, capacity: int, down_to: int) -> Iterator[list[tuple]]:
        """Full windows until no more than ``down_to`` tokens are left; the last of all are powers of two."""
        counts = {n: len(self.pieces[n]) for n in sorted(self.pieces, reverse=True)}
        while self.tokens > down_to:
            room = min(capacity, 1 << (self.tokens.bit_length() - 1))
            chosen, left = [], room
            for length, n in closest(counts, room):
                chosen += [self.pieces[length].pop() for _ in range(n)]
                counts[length] -= n
                left -= length * n
                if not counts[length]:
                    del counts[length], self.pieces[length]
            if left:  # every other piece is longer than the slack
                longest = next(iter(counts))
                key, start, ids, total = self.pieces[longest].pop()
                chosen.append((key, start, ids[: 4 * left], total))
                counts[longest] -= 1
                if not counts[longest]:
                    del counts[longest], self.pieces[longest]
                self.pieces.setdefault(longest - left, []).append((key, start + left, ids[4 * left :], total))
                counts[longest - left] = len(self.pieces[longest - left])
                counts = {n: counts[n] for n in sorted(counts, reverse=True)}
            self.tokens -= room
            yield chosen


def pack(documents: DataFrame, digest: bool = False, path: str = VOCABULARY, capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """The pieces of all windows: doc_id, start, length, doc_tokens, sequence_id, offset, and ``ids`` or by ``digest`` their crc32.

    ``capacity`` is a power of two.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from loomgraph.llm import bin_slack  # the worker's own module, whose encoder outlives the task

        own, pool = bin_slack.encoder(path), bin_slack.Pool()
        sequence, tail, out = TaskContext.get().partitionId() << 40, array("I", [end]).tobytes(), []

        def put(pieces: list[tuple]) -> None:
            nonlocal sequence
            offset = 0
            for key, start, ids, total in pieces:
                out.append((key, start, len(ids) // 4, zlib.crc32(ids) if digest else np.frombuffer(ids, "<u4").astype(np.int32), total, sequence, offset))
                offset += len(ids) // 4
            sequence += 1

        def rows() -> pa.RecordBatch:
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64() if digest else pa.list_(pa.int32()), pa.int64(), pa.int64(), pa.int64()]
            columns = [pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)]
            out.clear()
            return pa.RecordBatch.from_arrays(columns, names=["doc_id", "start", "length", "ids_crc32" if digest else "ids", "doc_tokens", "sequence_id", "offset"])

        for batch in (b.slice(i, 500) for b in batches for i in range(0, b.num_rows, 500)):
            keys, texts, at = batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), 0
            while at < len(texts):
                stop, size = at, 0
                while stop < len(texts) and size < GROUP_CHARS:
                    size += len(texts[stop] or "")
                    stop += 1
                for key, ids in zip(keys[at:stop], own.ids([t or "" for t in texts[at:stop]]), strict=True):
                    ids += tail
                    total, start = len(ids) // 4, 0
                    while total - start >= capacity:
                        put([(key, start, ids[4 * start : 4 * (start + capacity)], total)])
                        start += capacity
                    if start < total:
                        pool.add(key, start, ids[4 * start :], total)
                at = stop
                if pool.tokens > POOL:
                    for pieces in pool.windows(capacity, POOL // 2):
                        put(pieces)
                if out:
                    yield rows()
        for pieces in pool.windows(capacity, 0):
            put(pieces)
        if out:
            yield rows()

    kind = "ids_crc32 bigint" if digest else "ids array<int>"
    return documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, f"doc_id bigint, start bigint, length bigint, {kind}, doc_tokens bigint, sequence_id bigint, offset bigint")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), digest=True)
