"""Language ID by multilingual mixture inference.

Training counts hashed letter trigrams of every language over all labelled documents outside the held-out fold. A
document is a mixture of languages: expectation-maximisation estimates its proportions from the trigram likelihoods,
and the set of languages is the one of best penalised likelihood among all nested sets of its largest proportions; sizes
whose penalty exceeds what the likelihood can still gain are not fitted, which changes no result.
The prediction is the language of largest proportion, its score that proportion times the share of trigrams that are
ordinary for the language. ``ordinary`` is the share of trigrams that are ordinary for some language of the set.

A null text or one without letters is ``und`` with score 0. Languages are compared as given; null ones teach nothing.
Ties go to the language that sorts first. Repeated rows each give a row; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm.common import free_kept, held_out, table

#: Buckets of hashed trigrams. The model keeps what each language has seen of them.
BUCKETS = 1 << 16
#: Languages that a training task counts at a time, and for which GROUP holds; with more, groups are smaller.
LANGUAGES = 64
ROUNDS = 12
#: Nats a further language must gain, for each doubling of the number of trigrams.
PENALTY = 6.0
UNDETERMINED = "und"
#: Code points handled at a time, so that memory doesn't follow the batch size.
GROUP = 500_000

#: Code point -> lower-case letter, or 0 for all that isn't a letter.
_FOLD = np.zeros(0x110000, np.uint32)


def _fold() -> np.ndarray:
    if not _FOLD[97]:
        for c in range(0x110000):
            if chr(c).isalpha():
                low = chr(c).lower()
                _FOLD[c] = ord(low) if len(low) == 1 else c
    return _FOLD


def trigrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, bucket, count) of the distinct letter trigrams of each text; runs of other characters are one gap."""
    codes = [np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32) for t in texts]
    owner = np.repeat(np.arange(len(texts), dtype=np.int64), [len(c) for c in codes])
    folded = _fold()[np.concatenate(codes) if codes else np.zeros(0, np.uint32)]
    gap = folded == 0
    if len(gap):
        keep = ~(gap & np.concatenate(([False], gap[:-1] & (owner[1:] == owner[:-1]))))
        folded, owner = folded[keep], owner[keep]
    if len(folded) < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    a, b, c = folded[:-2], folded[1:-1], folded[2:]
    ok = (owner[:-2] == owner[2:]) & (b > 0)
    h = (a[ok] * np.uint32(0x9E3779B1)) ^ (b[ok] * np.uint32(0x85EBCA77)) ^ (c[ok] * np.uint32(0xC2B2AE3D))
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x2C1B3C6D)
    key = owner[:-2][ok] << 16 | (h >> np.uint32(16)).astype(np.int64)
    # A stable sort of 16-bit buckets is a radix sort, and the documents are in order already.
    starts = np.flatnonzero(np.diff(owner[:-2][ok], prepend=-1))
    out, counts = [], []
    for i, j in zip(starts, [*starts[1:], len(key)], strict=True):
        part = np.sort((key[i:j] & 0xFFFF).astype(np.uint16), kind="stable")
        first = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1])))
        out.append((key[i] >> 16 << 16) | part[first].astype(np.int64))
        counts.append(np.diff(np.append(first, len(part))))
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    key = np.concatenate(out)
    return key >> 16, key & 0xFFFF, np.concatenate(counts)


def grouped(texts: list[str | None], size_of_group: int = GROUP) -> Iterator[tuple[int, list[str]]]:
    """(place of the first, texts) of consecutive texts of about GROUP code points; empty and null ones as one space."""
    out, size, first = [], 0, 0
    for i, t in enumerate(texts):
        t = f" {t or ''} "
        out.append(t)
        size += len(t)
        if size >= size_of_group:
            yield first, out
            out, size, first = [], 0, i + 1
    if out:
        yield first, out


class Model:
    """Likelihoods of buckets by language, additively smoothed; seen ones by bucket, and each language's unseen one."""

    def __init__(self, languages: list[str], bucket: np.ndarray, language: np.ndarray, count: np.ndarray) -> None:
        """One count for each (bucket, language) seen."""
        self.languages = languages
        k, smooth = len(languages), 0.5
        order = np.lexsort((language, bucket))
        bucket, self.language, count = bucket[order], language[order].astype(np.int32), count[order]
        self.start = np.searchsorted(bucket, np.arange(BUCKETS + 1))
        total = np.bincount(self.language, count, k)
        self.unseen = (smooth / (total + smooth * BUCKETS)).astype(np.float32)
        self.seen = ((count + smooth) / (total + smooth * BUCKETS)[self.language]).astype(np.float32)
        #: What share of a language's own trigrams is ordinary for it.
        self.expected = np.maximum(np.bincount(self.language, count * self.ordinary(self.seen), k) / np.maximum(total, 1), 0.5)

    @staticmethod
    def ordinary(likelihood: np.ndarray) -> np.ndarray:
        return likelihood > 1.5 / BUCKETS / 4

    def likelihood(self, bucket: np.ndarray) -> np.ndarray:
        """One row a bucket, one column a language."""
        out = np.tile(self.unseen, (len(bucket), 1))
        n = self.start[bucket + 1] - self.start[bucket]
        at = np.arange(n.sum()) + np.repeat(self.start[bucket] - (np.cumsum(n) - n), n)
        out[np.repeat(np.arange(len(bucket)), n), self.language[at]] = self.seen[at]
        return out

    def infer(self, texts: list[str]) -> list[tuple[str, float, dict[str, float], float]]:
        """(language, score, proportions of the chosen set, share of ordinary trigrams) of each text."""
        documents, k = len(texts), len(self.languages)
        owner, bucket, count = trigrams(texts)
        out: list[tuple[str, float, dict[str, float], float]] = [(UNDETERMINED, 0.0, {}, 0.0)] * documents
        if not len(owner) or not k:
            return out
        starts = np.flatnonzero(np.diff(owner, prepend=-1))
        present = owner[starts]
        row = np.repeat(np.arange(len(present)), np.diff(np.append(starts, len(owner))))
        found = self.likelihood(bucket)
        p = found.astype(np.float64)
        n = count.astype(np.float64)
        total = np.add.reduceat(n, starts)

        def fit(w: np.ndarray, rounds: int, p: np.ndarray, n: np.ndarray, row: np.ndarray, starts: np.ndarray) -> np.ndarray:
            size = np.add.reduceat(n, starts)
            for _ in range(rounds):
                joint = p * w[row]
                joint *= (n / joint.sum(axis=1))[:, None]
                w = np.add.reduceat(joint, starts, axis=0) / size[:, None]
            return w

        weight = fit(np.full((len(present), k), 1.0 / k), ROUNDS, p, n, row, starts)
        order = np.argsort(-weight, axis=1, kind="stable")
        best = np.full(len(present), -np.inf)
        chosen = np.zeros_like(weight)
        # No proportions give more: the likelihood is concave in them.
        joint = (p * weight[row]).sum(axis=1)
        slope = np.add.reduceat(p * (n / joint)[:, None], starts, axis=0).max(axis=1)
        most = np.add.reduceat(n * np.log(joint), starts) + total * np.log(np.maximum(slope / total, 1)) + 1e-6 * total
        for size in range(1, k + 1):
            penalty = PENALTY * (size - 1) * np.log2(total + 2)
            open_ = np.flatnonzero(most - penalty > best)
            if not len(open_):
                break
            mine = np.isin(row, open_)
            p_, n_, row_ = p[mine], n[mine], np.searchsorted(open_, row[mine])
            starts_ = np.flatnonzero(np.diff(row_, prepend=-1))
            mask = np.zeros((len(open_), k))
            np.put_along_axis(mask, order[open_, :size], 1.0, axis=1)
            w = weight[open_] * mask + 1e-300 * mask
            w /= w.sum(axis=1, keepdims=True)
            if size > 1:
                w = fit(w, 2, p_, n_, row_, starts_)
            fitted = np.add.reduceat(n_ * np.log((p_ * w[row_]).sum(axis=1)), starts_) - penalty[open_]
            better = fitted > best[open_]
            best[open_[better]], chosen[open_[better]] = fitted[better], w[better]
        top = chosen.argmax(axis=1)
        own = self.ordinary(found)
        usual = np.add.reduceat(n * own[np.arange(len(row)), top[row]], starts) / total / self.expected[top]
        some = np.add.reduceat(n * (own & (chosen > 0)[row]).any(axis=1), starts) / total / (chosen @ self.expected)
        for i, d in enumerate(present):
            proportions = {self.languages[j]: float(chosen[i, j]) for j in np.flatnonzero(chosen[i] > 0)}
            out[d] = self.languages[top[i]], float(min(1.0, chosen[i, top[i]] * min(1.0, usual[i]))), proportions, float(min(1.0, some[i]))
        return out


def train(documents: DataFrame) -> Model:
    """A model of the languages of ``documents`` (text, lang). Counts are over all of them, for every language."""

    def flush(counts: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
        for lang, c in counts.items():
            at = np.flatnonzero(c)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(c[at])], names=["lang", "bucket", "n"])
        counts.clear()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        free_kept()
        counts: dict[str, np.ndarray] = {}
        for batch in (b.slice(i, 1000) for b in batches for i in range(0, b.num_rows, 1000)):
            langs = np.array(batch.column("lang").to_pylist(), object)
            for first, texts in grouped(batch.column("text").to_pylist()):
                owner, bucket, count = trigrams(texts)
                of = langs[first + owner] if len(owner) else owner
                for lang in set(of):
                    mine = of == lang
                    counts.setdefault(lang, np.zeros(BUCKETS, np.int64))
                    counts[lang] += np.bincount(bucket[mine], count[mine], BUCKETS).astype(np.int64)
                    if len(counts) >= LANGUAGES:
                        yield from flush(counts)
        yield from flush(counts)

    labelled = documents.where("lang is not null and text is not null").select("text", "lang")
    summed = labelled.mapInArrow(run, "lang string, bucket int, n bigint").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    # A language whose texts have no letters has no counts but is known all the same.
    languages = sorted(r.lang for r in labelled.select("lang").distinct().collect())
    place = pa.array(languages, pa.string())
    at = pc.index_in(summed.column("lang").combine_chunks(), place).to_numpy(zero_copy_only=False)
    return Model(languages, summed.column("bucket").to_numpy(), at, summed.column("n").to_numpy())


def predict(documents: DataFrame, model: Model, carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``lang_pred, score, languages`` (the chosen set with its proportions) and ``ordinary`` of every whole text, after columns to carry."""
    shared = documents.sparkSession.sparkContext.broadcast(model)
    names = [f"_{i}" for i in range(len(carry))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        free_kept()
        model = shared.value
        for batch in (b.slice(i, 1000) for b in batches for i in range(0, b.num_rows, 1000)):
            for first, texts in grouped(batch.column(read).to_pylist(), GROUP * LANGUAGES // max(LANGUAGES, len(model.languages))):
                found = model.infer(texts)
                own = batch.slice(first, len(texts))
                yield pa.RecordBatch.from_arrays(
                    [*(own.column(n) for n in names), pa.array([f[0] for f in found]), pa.array([f[1] for f in found], pa.float64()), pa.array([list(f[2].items()) for f in found], pa.map_(pa.string(), pa.float64())), pa.array([f[3] for f in found], pa.float64())],
                    names=[*names, "lang_pred", "score", "languages", "ordinary"],
                )

    # A carried text is read where it is carried, so that it goes to Python once.
    read = names[carry.index("text")] if "text" in carry else "text"
    extra = [] if "text" in carry else [F.col("text").cast("string").alias("text")]
    source = documents.select(*((F.col(c).cast("string") if c == "text" else F.col(c)).alias(n) for c, n in zip(carry, names, strict=True)), *extra)
    kept = ", ".join(f"{n} {source.schema[n].dataType.simpleString()}" for n in names)
    found = source.mapInArrow(run, f"{kept}, lang_pred string, score double, languages map<string,double>, ordinary double")
    return found.withColumnsRenamed(dict(zip(names, carry, strict=True)))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    model = train(documents.where(~held_out()))
    return predict(documents, model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score", F.array_join(F.array_sort(F.map_keys("languages")), ",").alias("languages"))
