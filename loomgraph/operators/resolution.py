"""Entity resolution by hashing: similar entities of a block without comparing the block with itself."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.operators import pairs
from loomgraph.tables import materialise

#: Bits of a signature: enough that a bucket of unrelated rows holds some BUCKET of them, within these bounds.
LEAST_BITS, MOST_BITS, BUCKET = 8, 24, 1024


def plan(largest: int, least: float, recall: float) -> tuple[int, int]:
    """(bits, bands) for blocks of at most ``largest`` rows, so that a pair at the cosine ``least`` shares a band with the chance ``recall``.

    Two vectors fall on the same side of a random plane with the chance 1 - angle / pi.
    """
    bits = min(MOST_BITS, max(LEAST_BITS, math.ceil(math.log2(max(largest, 1) / BUCKET))))
    same = (1 - math.acos(least) / math.pi) ** bits
    return bits, 1 if same >= 1 else math.ceil(math.log(1 - recall) / math.log(1 - same))


def signatures(vector: Column, bits: int, bands: int, seed: int) -> Column:
    """For each band the sides of ``bits`` seeded random planes as one number; null for a vector without a direction."""

    @F.pandas_udf("array<bigint>")
    def signed(vectors: pd.Series) -> pd.Series:
        out, weights = [None] * len(vectors), 1 << np.arange(bits, dtype=np.int64)
        sizes = vectors.map(lambda v: 0 if v is None else len(v)).to_numpy()
        for dim in np.unique(sizes[sizes > 0]):
            planes = np.random.default_rng([seed, int(dim)]).standard_normal((bands * bits, int(dim)))
            at = np.flatnonzero(sizes == dim)
            x = np.stack([np.asarray(vectors.iloc[i], dtype=float) for i in at])
            sides = (x @ planes.T >= 0).reshape(len(at), bands, bits) @ weights
            for i, row, good in zip(at, sides, np.isfinite(x).all(axis=1) & (x != 0).any(axis=1), strict=True):
                out[i] = row if good else None
        return pd.Series(out)

    return signed(vector)


def hashed_links(entities: DataFrame, block: Column, vector: str, least: float, recall: float = 0.99, seed: int = 0) -> DataFrame:
    """Links (a, b) that connect entities of one block whose vectors have at least the cosine ``least``; every link is exact.

    A pair at the bound is found with the chance ``recall``, a nearer one with a higher one; ``graph.resolve_entities``
    is the exact way, by all pairs of a block. Equal vectors of a block are one class, so copies are never compared.
    Candidates share a band of their signatures. A bucket's members are compared with each other where their vectors lie
    (``pairs.similar``: buckets in bounded cells), so that candidates are never rows; of the similar ones those stay that
    connect the bucket without a cycle, which gives the same components as all candidate pairs. What is shuffled is each
    vector once a band. Null blocks, null vectors and those without a direction match nothing; a repeated uuid is one
    entity of each vector.
    """
    rows = entities.select("uuid", block.alias("block"), F.col(vector).cast("array<double>").alias("v")).where("block is not null and v is not null")
    classes = materialise(rows.groupBy("block", "v").agg(F.min("uuid").alias("a"), F.count(F.lit(1)).alias("n")), "classes")
    copies = rows.join(classes.where("n > 1"), ["block", "v"]).select("a", F.col("uuid").alias("b")).where("a <> b").distinct()
    largest = classes.groupBy("block").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0  # one number
    bits, bands = plan(largest, least, recall)
    known = materialise(classes.select(F.col("a").alias("uuid"), "block", *pairs.packed("v"), signatures(F.col("v"), bits, bands, seed).alias("signs")).where("signs is not null"), "signed")
    keys = known.select("uuid", "block", "dim", "v", F.posexplode("signs").alias("band", "sign"))
    found = pairs.similar(keys, ["block", "band", "sign"], least, forest=True)
    return found.unionByName(copies.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))).distinct()
