"""Helpers shared by the training-data operators: tables, membership maps, hashing."""

from __future__ import annotations

import contextlib
import ctypes
import gc

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.tables import forget, materialise

#: The characters that separate words, fixed by the operators' contract.
SPACE = r"\x20\x09-\x0D"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out() -> Column:
    """True for the documents kept apart for evaluation: crc32 of doc_id as text, mod 5, is 0."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser over 64-bit hashes."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


#: What a Python worker keeps between tasks, by operator; a task of another operator frees it.
KEPT: dict[str, dict] = {}


def give_back() -> None:
    """Return freed memory to the system: Python workers live on, and what one operator frees the next doesn't need."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError, OSError):  # only glibc has it
        ctypes.CDLL(None).malloc_trim(0)


def free_kept() -> None:
    """Give back what earlier operators have kept in this worker."""
    for held in KEPT.values():
        held.clear()
    give_back()


_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: For terms: all ASCII characters but letters, digits and the apostrophe separate.
_IS_MARK = np.zeros(256, bool)
_IS_MARK[:128] = [not (chr(c).isalnum() or c == 39) for c in range(128)]
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, by doubling."""
    out = np.ones(max(n, 1), np.uint64)
    done, step = 1, base % (1 << 64)
    while done < n:
        take = min(done, n - done)
        out[done : done + take] = out[:take] * np.uint64(step)
        done += take
        step = step * step % (1 << 64)
    return out[:n]


class WordHasher:
    """64-bit hashes of the words of a text, vectorised over its UTF-8 bytes; powers are kept between calls."""

    def __init__(self) -> None:
        free_kept()
        self.up = powers(_BASE, 1 << 16)
        self.down = powers(_INVERSE, 1 << 16)

    def words(self, text: str, lower: bool = False, terms: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(hash, first byte, byte after the last) of every word, in order; ``terms``: words without punctuation."""
        raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
        n = len(raw)
        if n == 0:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        if n > len(self.up):
            self.up, self.down = powers(_BASE, 2 * n), powers(_INVERSE, 2 * n)
        if lower:
            raw = _LOWER[raw]
        edge = np.diff(np.concatenate(([True], (_IS_MARK if terms else _IS_SPACE)[raw], [True])).astype(np.int8))
        first, last = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(_BYTE[raw] * self.up[:n], out=total[1:])
        h = (total[last] - total[first]) * self.down[first]
        return mix(h + (last - first).astype(np.uint64)), first, last


def grams(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the k-word windows of a word sequence, in order; none if it is shorter."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    h = np.zeros(n, np.uint64)
    for i in range(k):
        h = h * np.uint64(_BASE) + words[i : i + n]
    return mix(h)


def signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)


#: Values that a membership map is made for, at most. Beyond them a join does its work, so that the broadcast stays at 16 MB.
MOST_MEMBERS = 1 << 24
_MEMBER_BITS = 8


def _places(values: np.ndarray, bits: int) -> np.ndarray:
    return mix(np.ascontiguousarray(values).view(np.uint64) ^ np.uint64(0xA5A5A5A55A5A5A5A)) & np.uint64(bits - 1)


class Members:
    """A set of bigints to filter by: a bitmap sized to it (eight bits a value or more), or a join if it is too large."""

    def __init__(self, members: DataFrame, column: str) -> None:
        """Null values are no members. ``members`` is written to the shared folder."""
        self.rows = materialise(members.select(F.col(column).cast("bigint").alias("member")).where("member is not null"), "members")
        n = self.rows.count()
        self.words = None
        if n <= MOST_MEMBERS:
            self.words = self._map(1 << max(16, (_MEMBER_BITS * n - 1).bit_length()))
        self.shared = members.sparkSession.sparkContext.broadcast(self.words)

    def _map(self, bits: int) -> np.ndarray:
        def run(batches):
            for batch in batches:
                at = np.unique(_places(batch.column(0).to_numpy(zero_copy_only=False), bits))
                word, one = (at >> np.uint64(6)).astype(np.int64), np.uint64(1) << (at & np.uint64(63))
                first = np.flatnonzero(np.diff(word, prepend=-1))
                rows = (word[first], np.bitwise_or.reduceat(one, first).view(np.int64)) if len(word) else (word, word)
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in rows], names=["at", "word"])

        words = np.zeros(bits // 64, np.int64)
        table = self.rows.mapInArrow(run, "at bigint, word bigint").groupBy("at").agg(F.bit_or("word").alias("word")).toArrow()
        words[table.column("at").to_numpy()] = table.column("word").to_numpy()
        return words

    def exact(self, rows: DataFrame, column: str) -> DataFrame:
        """What is left to do after ``may_have`` in the tasks: nothing after a map, a semi-join otherwise."""
        return rows if self.words is not None else rows.join(self.rows.withColumnRenamed("member", column), column, "left_semi")

    def done(self) -> None:
        forget(self.rows)


def may_have(words: np.ndarray | None, values: np.ndarray) -> np.ndarray:
    """True for every member and for a few other values; for all without a map."""
    if words is None:
        return np.ones(len(values), bool)
    at = _places(values, 64 * len(words))
    return (words.view(np.uint64)[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) > 0
