"""Mixing sources to target weights with soft domain membership.

The labels table teaches a softmax regression over hashed terms and coarse document statistics; only features that
tell the domains apart (chi-squared above SIGNIFICANT) take part. It predicts each document's posterior over the
domains ``clean``, ``low`` and ``toxic``. Document rates are the nonnegative solution of a least-squares problem:
projected gradient steps from rate 1, scaled by the documents that can still move and halved where they don't help,
until the expected tokens of each domain match the targets. A step needs a few sums over the corpus; a rate is a closed
expression of the document's posteriors and the steps so far, so nothing but those sums is collected and no rates are
stored between steps. The steps end when the targets are met to TOLERANCE or no step of any size helps any more, as with
targets that no rates can meet; ``met`` says which.

Targets are token budgets by domain. By default the domains' shares are WEIGHTS and the budget is as large as the
clean tokens allow (with HEADROOM over them). copies is the rate rounded up or down by a hash of text and doc_id, right
on average. Null and empty texts have no tokens and the prior as posterior; without labels every posterior is uniform.
Repeated rows each give a row; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm.common import WordHasher, forget, held_out, materialise, table
from loomgraph.llm.quality_kernel import STATISTICS, statistics

DOMAINS = ("clean", "low", "toxic")
WEIGHTS = {"clean": 0.96, "low": 0.02, "toxic": 0.02}
HEADROOM = 1.05
#: Buckets of hashed terms, and coarse cells of each statistic after them.
BUCKETS, CELLS = 1 << 16, 12
WIDTH = BUCKETS + CELLS * len(STATISTICS)
#: Labelled rows that teach, at most.
SAMPLE = 20_000
SIGNIFICANT, MOST_FEATURES = 30.0, 384
RIDGE, FIT_STEPS = 1e-3, 250
TOLERANCE = 1e-5
#: A step scaled down so far, or one that shortens the distance by less than this share, doesn't help any more.
LEAST_SCALE, LEAST_GAIN = 2.0**-20, 1e-4
#: Scales of a step that are tried in one pass over the rows; the first that helps is taken.
TRIED = 4


def features(text: str | None, hasher: WordHasher) -> tuple[int, np.ndarray]:
    """(number of words, distinct feature numbers) of a whole text."""
    n = len((text or "").split())
    terms = hasher.words(text or "", lower=True, terms=True)[0]
    x = statistics(text, hasher)
    cells = np.clip(np.floor(np.sqrt(np.abs(x)) * CELLS), 0, CELLS - 1).astype(np.int64)
    return n, np.concatenate((np.unique(terms & np.uint64(BUCKETS - 1)).astype(np.int64), BUCKETS + np.arange(len(x)) * CELLS + cells))


@dataclass
class Model:
    """Bias and weights of each domain; ``kept`` are the sorted feature numbers."""

    prior: np.ndarray
    kept: np.ndarray
    weight: np.ndarray

    def posterior(self, found: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.kept, found)
        at = at[(at < len(self.kept)) & (self.kept[np.minimum(at, len(self.kept) - 1)] == found)] if len(self.kept) else at[:0]
        z = self.prior + self.weight[at].sum(axis=0)
        p = np.exp(z - z.max())
        return p / p.sum()


def sampled(labels: DataFrame) -> DataFrame:
    """(doc_id, domain) of at most SAMPLE labelled documents outside the held-out fold, those of least hash."""
    rows = labels.where("doc_id is not null and (quality is not null or toxic is not null)").where(~held_out())
    domain = F.when(F.col("toxic") == 1, 2).when(F.col("quality") == 0, 1).otherwise(0).alias("domain")
    return rows.select(F.col("doc_id").cast("bigint").alias("doc_id"), domain).orderBy(F.xxhash64("doc_id"), "doc_id", "domain").limit(SAMPLE)


def train(documents: DataFrame, labels: DataFrame) -> Model:
    """Counts of every feature by domain over the sampled labelled documents; the sample's size bounds the broadcast."""
    text = F.col("text").cast("string").alias("text")
    texts = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), text).join(F.broadcast(sampled(labels)), "doc_id")

    def taken(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHasher()
        for batch in (b.slice(i, 500) for b in batches for i in range(0, b.num_rows, 500)):
            lists = [features(t, hasher)[1].astype(np.int32) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("domain").cast(pa.int32()), pa.array(lists, pa.list_(pa.int32()))], names=["domain", "features"])

    own = materialise(texts.select("text", "domain").mapInArrow(taken, "domain int, features array<int>"), "taught")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((WIDTH + 1, len(DOMAINS)), np.int64)
        for batch in (b.slice(i, 500) for b in batches for i in range(0, b.num_rows, 500)):
            d, lists = batch.column("domain").to_numpy(zero_copy_only=False).astype(np.int64), batch.column("features")
            f = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            counts += np.bincount(f * len(DOMAINS) + np.repeat(d, np.asarray(lists.value_lengths())), minlength=counts.size).reshape(counts.shape)
            counts[WIDTH] += np.bincount(d, minlength=len(DOMAINS))
        at = np.flatnonzero(counts.sum(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), *(pa.array(counts[at, k]) for k in range(len(DOMAINS)))], names=["feature", *DOMAINS])

    summed = own.mapInArrow(run, "feature int, " + ", ".join(f"{d} bigint" for d in DOMAINS)).groupBy("feature").agg(*(F.sum(d).alias(d) for d in DOMAINS)).toArrow()
    counts = np.zeros((WIDTH + 1, len(DOMAINS)))
    counts[summed.column("feature").to_numpy()] = np.stack([summed.column(d).to_numpy() for d in DOMAINS], axis=1)
    total, counts = counts[WIDTH], counts[:WIDTH]
    n = total.sum()
    if n == 0:
        return Model(np.zeros(len(DOMAINS)), np.zeros(0, np.int64), np.zeros((0, len(DOMAINS))))
    share = total / n
    row = counts.sum(axis=1, keepdims=True)
    expected = np.maximum(row * share, 1e-9)
    chi = ((counts - expected) ** 2 / expected).sum(axis=1) + ((counts - expected) ** 2 / np.maximum(total - expected, 1e-9)).sum(axis=1)
    best = np.argsort(-chi, kind="stable")[:MOST_FEATURES]
    kept = np.sort(best[chi[best] > SIGNIFICANT])
    found = own.mapInArrow(picked(kept), "domain int, features array<int>").toArrow()
    forget(own)
    d = found.column("domain").to_numpy().astype(int)
    x = np.zeros((len(d), len(kept)), np.float32)
    lists = found.column("features").combine_chunks()
    x[np.repeat(np.arange(len(d)), np.asarray(lists.value_lengths())), lists.flatten().to_numpy()] = 1
    return fit(x, d, kept)


def picked(kept: np.ndarray):
    """For each sampled text its domain and which of the kept features it has: at most SAMPLE rows of MOST_FEATURES."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for found in batch.column("features"):
                found = found.values.to_numpy(zero_copy_only=False)
                at = np.searchsorted(kept, found)
                out.append(at[kept[np.minimum(at, len(kept) - 1)] == found] if len(kept) else [])
            yield pa.RecordBatch.from_arrays([batch.column("domain"), pa.array(out, pa.list_(pa.int32()))], names=["domain", "features"])

    return run


def fit(x: np.ndarray, d: np.ndarray, kept: np.ndarray) -> Model:
    """Softmax regression of domains on standardised binary features: accelerated gradient steps with a ridge penalty."""
    n, y = len(d), np.eye(len(DOMAINS), dtype=np.float32)[d]
    bias = np.log((y.sum(axis=0) + 1) / (n + len(DOMAINS))).astype(np.float32)
    centre = x.mean(axis=0)
    spread = np.maximum(np.sqrt(centre * (1 - centre)), 0.01).astype(np.float32)
    x -= centre
    x /= spread
    v = np.full(x.shape[1], 1.0, np.float32)
    for _ in range(15):
        v = x.T @ (x @ v)
        v /= max(float(np.linalg.norm(v)), 1e-9)
    largest = float(np.linalg.norm(x @ v)) ** 2 / n if x.size else 0.0
    step = 1.0 / (0.5 * (1.05 * largest + 1) + RIDGE)
    w = np.zeros((x.shape[1], len(DOMAINS)), np.float32)
    b, look, look_b, momentum = bias, w, bias, 1.0
    for _ in range(FIT_STEPS):
        z = x @ look + look_b
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        e = (p - y) / n
        after, after_b = look - step * (x.T @ e + RIDGE * look), look_b - step * e.sum(axis=0)
        faster = (1 + np.sqrt(1 + 4 * momentum**2)) / 2
        ahead = (momentum - 1) / faster
        look, look_b = after + ahead * (after - w), after_b + ahead * (after_b - b)
        w, b, momentum = after, after_b, faster
    weight = (w / spread[:, None]).astype(np.float64)
    return Model(b - (centre / spread) @ w, kept, weight)


def predict(documents: DataFrame, model: Model, carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """u, n_tokens, p_clean, p_low and p_toxic of every text after columns to carry; u in [0, 1) is a hash of text and doc_id."""
    shared = documents.sparkSession.sparkContext.broadcast(model)
    names = [f"_{i}" for i in range(len(carry))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, model = WordHasher(), shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                found = [features(t, hasher) for t in part.column(read).to_pylist()]
                p = np.array([model.posterior(f[1]) for f in found])
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names), part.column("u"), pa.array([f[0] for f in found], pa.int64()), *(pa.array(p[:, k]) for k in range(len(DOMAINS)))], names=[*names, "u", "n_tokens", *(f"p_{d}" for d in DOMAINS)])

    text = F.col("text").cast("string")
    u = F.pmod(F.xxhash64(F.col("doc_id").cast("bigint"), text), F.lit(1 << 20)) / F.lit(float(1 << 20))
    # A carried text is read where it is carried, so that it goes to Python once.
    read = names[carry.index("text")] if "text" in carry else "text"
    source = documents.select(*((text if c == "text" else F.col(c)).alias(n) for c, n in zip(carry, names, strict=True)), *([] if "text" in carry else [text.alias("text")]), u.alias("u"))
    kept = ", ".join(f"{n} {source.schema[n].dataType.simpleString()}" for n in names)
    found = source.mapInArrow(run, f"{kept}, u double, n_tokens bigint, " + ", ".join(f"p_{d} double" for d in DOMAINS))
    return found.withColumnsRenamed(dict(zip(names, carry, strict=True)))


def _rate(steps: list[np.ndarray]) -> Column:
    """The rate after some steps: r <- max(0, r - p . step), from 1."""
    rate = F.lit(1.0)
    for step in steps:
        rate = F.greatest(F.lit(0.0), rate - sum((F.col(f"p_{d}") * F.lit(float(v)) for d, v in zip(DOMAINS, step, strict=True)), F.lit(0.0)))
    return rate


def _sums(rows: DataFrame, steps: list[np.ndarray], tried: list[np.ndarray]) -> np.ndarray:
    """A row for each step tried after ``steps``: all tokens, the domains' tokens, and the products of posteriors over documents whose rate isn't 0.

    The steps go to the tasks as numbers, so that the plan is as small after a hundred of them as before the first.
    """
    k = len(DOMAINS)
    width = 1 + k + k * k

    def moved(rate: np.ndarray, p: np.ndarray, step: np.ndarray) -> np.ndarray:
        return np.maximum(0.0, rate - sum(p[i] * step[i] for i in range(k)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((len(tried), width))
        for batch in batches:
            t, *p = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.float64) for c in names)
            before = np.ones(len(t))
            for step in steps:
                before = moved(before, p, step)
            p = np.stack(p)
            for i, step in enumerate(tried):
                rate = moved(before, p, step)
                sums[i, 0] += t.sum()
                sums[i, 1 : k + 1] += p @ (t * rate)
                sums[i, k + 1 :] += ((p * (t * (rate > 0))) @ p.T).ravel()
        yield pa.RecordBatch.from_arrays([pa.array([v]) for v in sums.ravel()], names=columns)

    names, columns = ["n_tokens", *(f"p_{d}" for d in DOMAINS)], [f"s{i}" for i in range(len(tried) * width)]
    found = rows.select(*names).mapInArrow(run, ", ".join(f"{c} double" for c in columns)).agg(*(F.sum(c) for c in columns)).first()
    return np.array([v or 0.0 for v in found]).reshape(len(tried), width)


def solve(rows: DataFrame, weights: Mapping[str, float] | None = None, targets: Mapping[str, float] | None = None) -> tuple[list[np.ndarray], bool]:
    """Steps whose rates make the expected tokens of the domains match ``targets`` (default: from ``weights``), and whether they do.

    Without any tokens there are no steps, and only targets of 0 are met.
    """
    k = len(DOMAINS)

    def measured(steps: list[np.ndarray], tried: list[np.ndarray]) -> list[tuple[float, np.ndarray, np.ndarray]]:
        """For each step tried all tokens, the shares the rates give each domain, and the metric over documents whose rate isn't 0."""
        sums = _sums(rows, steps, tried)
        return [(s[0], s[1 : k + 1] / (s[0] or 1.0), s[k + 1 :].reshape(k, k) / (s[0] or 1.0) + 1e-9 * np.eye(k)) for s in sums]

    total, got, metric = measured([], [np.zeros(k)])[0]
    if total == 0:
        return [], not any((targets or {}).values())
    if targets is not None:
        goal = np.array([targets[d] for d in DOMAINS]) / total
    else:
        share = np.array([(weights or WEIGHTS)[d] for d in DOMAINS])
        share = share / share.sum()
        goal = share * (got[0] / share[0] if share[0] else 1.0) * HEADROOM
    steps: list[np.ndarray] = []
    scale = 1.0
    while np.abs(got - goal).max() >= TOLERANCE and scale >= LEAST_SCALE:
        whole = np.linalg.solve(metric, got - goal)
        tried = [s * whole for i in range(TRIED) if (s := scale / 2**i) >= LEAST_SCALE]
        for step, (_, after, after_metric) in zip(tried, measured(steps, tried), strict=True):
            if np.linalg.norm(after - goal) < (1 - LEAST_GAIN) * np.linalg.norm(got - goal):
                steps, got, metric, scale = [*steps, step], after, after_metric, min(1.0, 2 * scale)
                break
            scale /= 2
    return steps, bool(np.abs(got - goal).max() < TOLERANCE)


def mix(documents: DataFrame, labels: DataFrame, weights: Mapping[str, float] | None = None, targets: Mapping[str, float] | None = None, carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """n_tokens, posteriors, rate, copies and met of every document, after the columns of ``documents`` to carry."""
    rows = materialise(predict(documents, train(documents, labels), carry), "posteriors")
    steps, met = solve(rows, weights, targets)
    rate = _rate(steps)
    return rows.select(*carry, "n_tokens", *(f"p_{d}" for d in DOMAINS), rate.alias("rate"), F.floor(rate + F.col("u")).cast("bigint").alias("copies"), F.lit(met).alias("met"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
