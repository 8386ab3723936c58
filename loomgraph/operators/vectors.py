"""Nearest vectors by a coarse quantiser: cells as partitions of a written table, probes, and an exact mode by cell bounds.

Centroids are fitted on at most SAMPLE rows (those of least hash: a documented bound); every row is then assigned to its
nearest one and written below that cell's partition, so that a search reads the cells it probes and no others. A cell
keeps the largest angle between its centroid and a member. How many cells a search probes is measured on the sample when
the index is built. In exact mode a second pass reads the further cells that may
still hold a nearer row by that bound. A query's cells are searched batch by batch, and a task keeps k rows a query.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomgraph.operators.retrieval import top_of_block
from loomgraph.tables import materialise

#: Rows that the quantiser is fitted on, cells at most, rounds of fitting.
SAMPLE, CELLS, ROUNDS = 16_384, 1024, 8
#: The number of probed cells is the least that finds so many of the nearest NEAR rows of TRIALS rows within the sample.
TARGET, NEAR, TRIALS = 0.95, 10, 256
#: Queries handled in one pass.
QUERY_BLOCK = 4096
_FOUND = "query bigint, id bigint, similarity double"


def _units(column: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows, unit vectors) of the vectors that have ``dim`` numbers and a direction."""
    right = pc.fill_null(pc.equal(pc.list_value_length(column), dim), False).to_numpy(zero_copy_only=False)
    rows = np.flatnonzero(right)
    x = column.take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, dim)
    norm = np.sqrt((x**2).sum(axis=1))
    good = np.isfinite(norm) & (norm > 0)
    return rows[good], x[good] / norm[good, None]


def _fit(x: np.ndarray, cells: int) -> np.ndarray:
    """Unit centroids by spherical k-means from evenly spread rows; a cell without members keeps its centroid."""
    centres = x[np.linspace(0, len(x) - 1, cells).astype(int)].copy()
    for _ in range(ROUNDS):
        own = (x @ centres.T).argmax(axis=1)
        total = np.zeros_like(centres)
        np.add.at(total, own, x)
        norm = np.sqrt((total**2).sum(axis=1))
        centres[norm > 0] = total[norm > 0] / norm[norm > 0, None]
    return centres


def _probes(x: np.ndarray, centres: np.ndarray) -> int:
    """The least number of probed cells that reaches TARGET among the rows ``x``."""
    own, asked = (x @ centres.T).argmax(axis=1), x[np.linspace(0, len(x) - 1, min(len(x), TRIALS)).astype(int)]
    near = np.argsort(-(asked @ x.T), axis=1, kind="stable")[:, :NEAR]
    rank = np.argsort(np.argsort(-(asked @ centres.T), axis=1, kind="stable"), axis=1)
    needed = np.sort(np.take_along_axis(rank, own[near], axis=1).ravel())
    return int(needed[int(np.ceil(TARGET * len(needed))) - 1]) + 1


class VectorIndex:
    """Written cells with their centroids and radii (angles), and the number of cells to probe."""

    def __init__(self, spark: SparkSession, root: str, centres: np.ndarray, radii: np.ndarray, probes: int) -> None:
        self.spark, self.root, self.centres, self.radii, self.probes = spark, root, centres, radii, probes

    @classmethod
    def build(cls, vectors: DataFrame, root: str, cells: int | None = None) -> VectorIndex:
        """Index vectors (id, embedding). Rows without a direction (null, zero, of another length) are near nothing and left out.

        Writing is dealt out by cell and hash of the id, so that a cell with a third of all rows is many tasks' work.
        """
        spark = vectors.sparkSession
        rows = vectors.select(F.col("id").cast("bigint").alias("id"), F.col("embedding").cast("array<float>").alias("embedding"))
        some = rows.where(F.size("embedding") > 0).orderBy(F.xxhash64("id"), "id").limit(SAMPLE).toArrow()
        dim = int(np.median(pc.list_value_length(some.column("embedding")).to_numpy())) if some.num_rows else 1
        _, x = _units(some.column("embedding").combine_chunks(), dim)
        if not len(x):
            x = np.zeros((1, dim))
        n = rows.count()
        centres = _fit(x, min(len(x), cells or max(1, min(CELLS, int(n**0.5)))))

        def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                at, unit = _units(batch.column("embedding"), dim)
                sim = unit @ centres.T
                cell = sim.argmax(axis=1) if len(at) else np.zeros(0, int)
                angle = np.arccos(np.clip(sim[np.arange(len(at)), cell], -1, 1))
                where = pa.array(at)
                yield pa.RecordBatch.from_arrays([batch.column("id").take(where), batch.column("embedding").take(where), pa.array(cell, pa.int32()), pa.array(angle, pa.float64())], names=["id", "embedding", "cell", "angle"])

        placed = rows.mapInArrow(assign, "id bigint, embedding array<float>, cell int, angle double")
        placed.repartitionByRange("cell", F.xxhash64("id")).write.partitionBy("cell").parquet(f"{root}/cells")
        radii = np.zeros(len(centres))
        if n:
            for r in cls._rows(spark, root).groupBy("cell").agg(F.max("angle").alias("angle")).collect():  # one row a cell
                radii[r.cell] = r.angle
        return cls(spark, root, centres, radii, _probes(x, centres))

    @staticmethod
    def _rows(spark: SparkSession, root: str) -> DataFrame:
        return spark.read.schema("id bigint, embedding array<float>, angle double, cell int").parquet(f"{root}/cells")

    def _scan(self, ids: np.ndarray, q: np.ndarray, wanted: np.ndarray, k: int) -> DataFrame:
        """The k best rows a query within its wanted cells (query by cell, boolean)."""
        cells = np.flatnonzero(wanted.any(axis=0))
        if not len(cells):
            return self.spark.createDataFrame([], _FOUND)
        shared = self.spark.sparkContext.broadcast((ids, q, wanted))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids, q, wanted = shared.value
            best: tuple[np.ndarray, ...] | None = None
            for batch in batches:
                _, unit = _units(batch.column("embedding"), q.shape[1])
                own, cell = batch.column("id").to_numpy(), batch.column("cell").to_numpy()
                for c in np.unique(cell):
                    asked, rows = np.flatnonzero(wanted[:, c]), np.flatnonzero(cell == c)
                    sim = np.round(unit[rows] @ q[asked].T, 6)
                    i, j = top_of_block(sim, own[rows], k)
                    part = (ids[asked[j]], own[rows[i]], sim[i, j])
                    best = part if best is None else tuple(map(np.concatenate, zip(best, part, strict=True)))
                    if len(best[0]) > 4 * k * len(ids) + 100_000:
                        best = _best(best, k)
            if best is not None:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in _best(best, k)], names=["query", "id", "similarity"])

        return self._rows(self.spark, self.root).where(F.col("cell").isin([int(c) for c in cells])).select("id", "embedding", "cell").mapInArrow(run, _FOUND)

    def search(self, queries: DataFrame, k: int, probes: int | None = None, exact: bool = False) -> DataFrame:
        """(query, id, similarity, place): the k nearest rows of each query (id, embedding), by ``probes`` cells (the index's own number) or exactly.

        Similarities are rounded to six places and ties take the lesser id. Queries without a direction find nothing. The
        set is handled in blocks of QUERY_BLOCK queries.
        """
        known = materialise(queries.select(F.col("id").cast("bigint").alias("id"), F.col("embedding").cast("array<float>").alias("embedding")), "queries")
        blocks = max(1, -(-known.count() // QUERY_BLOCK))
        out = self.spark.createDataFrame([], _FOUND)
        order = Window.partitionBy("query").orderBy(F.desc("similarity"), "id")
        for b in range(blocks):
            block = known.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == b).toArrow()
            at, q = _units(block.column("embedding").combine_chunks(), self.centres.shape[1]) if block.num_rows else (np.zeros(0, int), None)
            if not len(at):
                continue
            ids = block.column("id").to_numpy()[at]
            near = q @ self.centres.T
            wanted = np.zeros(near.shape, bool)
            np.put_along_axis(wanted, np.argsort(-near, axis=1, kind="stable")[:, : probes or self.probes], True, axis=1)
            found = self._scan(ids, q, wanted, k)
            if exact:
                found = materialise(found, "probed")
                ranked = found.withColumn("place", F.row_number().over(order)).where(F.col("place") == k)
                least = dict(ranked.select("query", "similarity").collect())  # one row a query of the block
                bound = np.cos(np.maximum(0, np.arccos(np.clip(near, -1, 1)) - self.radii))
                more = ~wanted & (bound >= np.array([least.get(int(i), -2.0) for i in ids])[:, None] - 2e-6)
                found = found.unionByName(self._scan(ids, q, more, k))
            out = out.unionByName(found)
        return out.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)


def _best(rows: tuple[np.ndarray, ...], k: int) -> tuple[np.ndarray, ...]:
    """The first k of each query by similarity and id."""
    query, own, sim = rows
    order = np.lexsort((own, -sim, query))
    query = query[order]
    start = np.flatnonzero(np.diff(query, prepend=query[0] - 1))
    kept = order[np.arange(len(order)) - np.repeat(start, np.diff(np.append(start, len(order)))) < k]
    return tuple(x[kept] for x in rows)
