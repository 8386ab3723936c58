"""Quality classifier: random Fourier features over document statistics, ridge scores, isotonic calibration.

The statistics of each whole text are taken once and written to the shared folder. Random Fourier features approximate
a Gaussian kernel over the standardised statistics; each partition sums its part of the normal equations of a ridge
regression on the labels, and Spark adds the parts entry by entry, so that the driver gets a matrix of fixed size
whatever the corpus. The sums are kept by FOLDS folds, so that each fold's rows can be scored by weights that the others
taught. These raw scores are counted in BINS bins and made monotone by pooling adjacent violators; a score is the
calibrated chance of label 1.

All labelled rows outside the held-out fold teach. Empty and null texts have zero statistics and a score like any
other. Without labels of both kinds every score is the share of label 1 (0.5 without any label). Repeated rows each
give a row; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm.common import WordHasher, held_out, materialise, table
from loomgraph.llm.quality_rules import STOP_WORDS

FEATURES, SEED, WIDTH, RIDGE = 192, 20_240_229, 3.0, 1e-3
BINS, FOLDS = 512, 4
THRESHOLD = 0.3
STATISTICS = ("words", "word_length", "letters", "digits", "symbols", "bangs", "bars", "stops", "upper", "not_ascii", "distinct", "top_word", "repeated_lines", "line_words", "repeated_grams", "short_words")
_STOP = np.sort(np.concatenate([WordHasher().words(w)[0] for w in STOP_WORDS]))
_CLASS = np.zeros((256, 7), bool)
_CLASS[[*range(65, 91), *range(97, 123)], 0] = True
_CLASS[48:58, 1] = True
_CLASS[list(b"#*$%&<>@^~=+_{}[]\\"), 2] = True
_CLASS[list(b"!"), 3] = True
_CLASS[list(b"|"), 4] = True
_CLASS[65:91, 5] = True
_CLASS[128:, 6] = True


def statistics(text: str | None, hasher: WordHasher) -> np.ndarray:
    """STATISTICS of a whole text, each of a bounded range."""
    out = np.zeros(len(STATISTICS))
    words, first, last = hasher.words((text or "").lower())
    n = len(words)
    if n == 0:
        return out
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    letters, digits, symbols, bangs, bars, upper, high = np.bincount(raw, minlength=256) @ _CLASS
    size = float(len(raw))
    sorted_words = np.sort(words)
    runs = np.diff(np.flatnonzero(np.concatenate(([True], sorted_words[1:] != sorted_words[:-1], [True]))))
    at = np.minimum(np.searchsorted(_STOP, words), len(_STOP) - 1)
    lines = [x for x in text.split("\n") if x.strip()]
    triples = words[:-2] * np.uint64(3) + words[1:-1] * np.uint64(5) + words[2:] * np.uint64(7)
    lengths = last - first
    out[:] = (
        np.log1p(n) / 10, np.minimum(lengths.mean(), 30) / 30, letters / size, digits / size, min(symbols / n, 3), min(bangs / n, 3), min(bars / n, 3),
        (_STOP[at] == words).mean(), upper / max(letters, 1), high / size, len(runs) / n, runs.max() / n,
        1 - len(set(lines)) / len(lines), np.log1p(n / len(lines)) / 10, 1 - len(np.unique(triples)) / max(len(triples), 1) if len(triples) else 0.0, (lengths <= 2).mean(),
    )
    return out


def measured(documents: DataFrame) -> DataFrame:
    """(doc_id, x) with the statistics of every text as an array."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHasher()
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                x = [statistics(t, hasher) for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(x, pa.list_(pa.float64()))], names=["doc_id", "x"])

    return documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id bigint, x array<double>")


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, len(STATISTICS))


@dataclass
class Model:
    """Centre and spread of the statistics, ridge weights of the features, and the calibration's steps."""

    centre: np.ndarray
    spread: np.ndarray
    weights: np.ndarray
    edges: np.ndarray
    values: np.ndarray

    def features(self, x: np.ndarray) -> np.ndarray:
        r = np.random.default_rng(SEED)
        w = r.standard_normal((x.shape[1], FEATURES)) / WIDTH
        phase = r.uniform(0, 2 * np.pi, FEATURES)
        z = np.clip((x - self.centre) / self.spread, -6, 6)
        return np.hstack((np.ones((len(x), 1)), np.sqrt(2 / FEATURES) * np.cos(z @ w + phase)))

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.features(x) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(self.raw(x), self.edges, self.values), 0.0, 1.0)


def pool(values: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Isotonic least squares of values with weights, by pooling adjacent violators."""
    blocks: list[list[float]] = []
    for v, w in zip(values, weights, strict=True):
        blocks.append([v, w, 1])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            v2, w2, n2 = blocks.pop()
            v1, w1, n1 = blocks.pop()
            blocks.append([(v1 * w1 + v2 * w2) / (w1 + w2), w1 + w2, n1 + n2])
    return np.concatenate([np.full(int(n), v) for v, _, n in blocks]) if blocks else np.zeros(0)


def train(labelled: DataFrame) -> Model:
    """A model from rows (x, y, fold) with y 0 or 1 and fold from 0 to FOLDS - 1."""
    d = len(STATISTICS)
    sums = labelled.agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("y"), *(f(F.col("x")[i]).alias(f"{k}{i}") for i in range(d) for k, f in (("m", F.avg), ("s", F.stddev_pop)))).first()
    centre, spread = np.zeros(d), np.ones(d)
    share = float(sums["y"]) / sums["n"] if sums["n"] else 0.5
    blank = Model(centre, spread, np.zeros(FEATURES + 1), np.array([0.0, 1.0]), np.array([share, share]))
    if not sums["n"] or share in (0.0, 1.0):
        return blank
    blank.centre = np.array([sums[f"m{i}"] for i in range(d)])
    blank.spread = np.maximum(np.array([sums[f"s{i}"] for i in range(d)]), 1e-3)
    model = blank

    def normal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((FOLDS, FEATURES + 2, FEATURES + 2))
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                z = np.hstack((model.features(_matrix(part.column("x"))), part.column("y").to_numpy(zero_copy_only=False)[:, None].astype(float)))
                fold = part.column("fold").to_numpy(zero_copy_only=False)
                for k in range(FOLDS):
                    total[k] += z[fold == k].T @ z[fold == k]
        i, j = np.triu_indices(FEATURES + 2)
        for k in range(FOLDS):
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(i), k), pa.int32()), pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(total[k, i, j])], names=["fold", "i", "j", "v"])

    parts = labelled.select("x", "y", "fold").mapInArrow(normal, "fold int, i int, j int, v double").groupBy("fold", "i", "j").agg(F.sum("v").alias("v")).toArrow()
    full = np.zeros((FOLDS, FEATURES + 2, FEATURES + 2))
    k, i, j, v = (parts.column(c).to_numpy() for c in ("fold", "i", "j", "v"))
    full[k, i, j] = full[k, j, i] = v

    def solved(total: np.ndarray) -> np.ndarray:
        penalty = RIDGE * total[0, 0] * np.eye(FEATURES + 1)
        penalty[0, 0] = 1e-9
        return np.linalg.solve(total[:-1, :-1] + penalty, total[:-1, -1])

    model.weights = solved(full.sum(axis=0))
    # A fold that holds all rows leaves nothing to learn from; its rows are scored by the whole.
    apart = np.stack([solved(full.sum(axis=0) - full[k]) if full[k][0, 0] < sums["n"] else model.weights for k in range(FOLDS)])

    def binned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fold = batch.column("fold").to_numpy(zero_copy_only=False)
            raw = np.einsum("ij,ij->i", model.features(_matrix(batch.column("x"))), apart[fold])
            at = np.clip(np.floor((raw + 0.5) * (BINS / 2)), 0, BINS - 1).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(at), batch.column("y")], names=["bin", "y"])

    bins = labelled.select("x", "y", "fold").mapInArrow(binned, "bin int, y int").groupBy("bin").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("y")).orderBy("bin").toArrow()
    at, n, y = (bins.column(c).to_numpy().astype(float) for c in ("bin", "n", "y"))
    model.edges = (at + 0.5) / (BINS / 2) - 0.5
    model.values = pool(y / n, n)
    return model


def score(rows: DataFrame, model: Model) -> DataFrame:
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(shared.value.score(_matrix(batch.column("x"))))], names=["doc_id", "score"])

    return rows.select("doc_id", "x").mapInArrow(run, "doc_id bigint, score double")


def classify(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    rows = materialise(measured(documents), "statistics")
    known = labels.where("quality in (0, 1)").select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("quality").cast("int").alias("y"))
    fold = F.pmod(F.xxhash64("doc_id"), F.lit(FOLDS)).cast("int").alias("fold")
    labelled = materialise(rows.where(~held_out()).join(known, "doc_id").select("x", "y", fold), "labelled")
    return score(rows, train(labelled)).select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
