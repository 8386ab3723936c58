"""Pairs of similar vectors inside blocks: bounded cells of a block against itself, each a product of two matrices."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows of a block's part at most (about), products of a matrix at once, rows of a batch of cells (about), tasks at most.
PART, PRODUCTS, TASK_ROWS, MOST_TASKS = 2048, 2_000_000, 8192, 2000


def _bytes(vectors: pd.Series) -> pd.Series:
    out = []
    for v in vectors:
        x = None if v is None else np.asarray(v, dtype="<f8")
        # As single floats where they are the same numbers.
        out.append(None if x is None else (short if np.array_equal(short := x.astype("<f4"), x, equal_nan=True) else x).tobytes())
    return pd.Series(out, dtype=object)


def packed(vector: str) -> list[Column]:
    """``dim`` and the numbers ``v`` of a vector; null for one that is null or has a null."""
    whole = ~F.exists(vector, lambda x: x.isNull())
    return [F.when(whole, F.size(vector)).alias("dim"), F.when(whole, F.pandas_udf(_bytes, "binary")(F.col(vector).cast("array<double>"))).alias("v")]


def unpacked(values: list[bytes], dim: int) -> np.ndarray:
    """The matrix of packed vectors of one length."""
    out = np.empty((len(values), dim))
    for i, v in enumerate(values):
        out[i] = np.frombuffer(v, "<f4" if len(v) == 4 * dim else "<f8")
    return out


def spanning(label: np.ndarray, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Those of the pairs (x, y) that connect what ``label`` has apart, without a cycle; ``label`` takes them in."""
    kept = [], []
    while True:
        a, b = label[x], label[y]
        apart = a != b
        x, y, a, b = x[apart], y[apart], a[apart], b[apart]
        if not len(x):
            return np.concatenate([[], *kept[0]]).astype(int), np.concatenate([[], *kept[1]]).astype(int)
        high, low = np.maximum(a, b), np.minimum(a, b)
        order = np.lexsort((low, high))
        first = order[np.unique(high[order], return_index=True)[1]]  # one pair a label: no cycle, as the other one is less
        kept[0].append(x[first])
        kept[1].append(y[first])
        parent = np.arange(len(label))
        parent[high[first]] = low[first]
        while (parent != (above := parent[parent])).any():
            parent = above
        label[:] = parent[label]


def _similar(v: np.ndarray, ids: pa.Array, right: np.ndarray, whole: bool, least: float, forest: bool) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of one cell's rows: of its left ones with its right ones or, if it is ``whole``, of all."""
    dim = v.shape[1]
    with np.errstate(all="ignore"):
        squares = np.zeros(len(v))
        for k in range(dim):  # in the order of the vector, as SQL adds
            squares += v[:, k] * v[:, k]
        norm = np.sqrt(squares)
        left, right = (np.arange(len(v)), np.arange(len(v))) if whole else (np.flatnonzero(~right), np.flatnonzero(right))
        label, found, step = np.arange(len(v)), ([], []), max(1, PRODUCTS // max(len(right), 1))
        for at in range(0, len(left), step):
            rows = left[at : at + step]
            dots, scale = v[rows] @ v[right].T, np.outer(norm[rows], norm[right])
            x, y = np.nonzero(~(dots < (least - 1e-9) * scale))
            sure = dots[x, y] > (least + 1e-9) * scale[x, y]
            x, y = rows[x], right[y]
            if whole:
                x, y, sure = x[x < y], y[x < y], sure[x < y]
            near = np.flatnonzero(~sure)
            a, b, dot = x[near], y[near], np.zeros(len(near))
            for k in range(dim):
                dot += v[a, k] * v[b, k]
            swapped = np.array([ids[int(p)].as_py() > ids[int(q)].as_py() for p, q in zip(a, b, strict=True)], bool)
            bound = least * norm[np.where(swapped, b, a)] * norm[np.where(swapped, a, b)]
            sure[near] = (dot >= bound) | np.isnan(dot)
            x, y = x[sure], y[sure]
            if forest:
                x, y = spanning(label, x, y)
            found[0].append(x)
            found[1].append(y)
    return tuple(np.concatenate([np.empty(0, int), *f]) for f in found)


def _batch(table: pa.Table, cell: list[str], least: float, forest: bool) -> pa.Table:
    """Pairs of some cells, one after the other."""
    table = table.sort_by("uuid") if forest else table  # so that equal pairs of several bands are kept
    values, ids, keys = table["v"].to_pylist(), table["uuid"].combine_chunks(), table.select(cell).to_pandas()
    dims, right, whole = keys["dim"].to_numpy(), table["right"].to_numpy().astype(bool), (keys["i"] == keys["j"]).to_numpy()
    found = [], []
    for at in keys.groupby(cell, sort=False, dropna=False).indices.values():
        if len(at) > 1:
            v = unpacked([values[k] for k in at], int(dims[at[0]]))
            for side, place in zip(found, _similar(v, ids.take(pa.array(at)), right[at], whole[at[0]], least, forest), strict=True):
                side.append(at[place])
    x, y = (np.concatenate([np.empty(0, int), *f]) for f in found)
    return pa.table({"x": ids.take(pa.array(x)), "y": ids.take(pa.array(y))})


def similar(rows: DataFrame, by: list[str], least: float, forest: bool = False) -> DataFrame:
    """(a, b), a < b: pairs of rows (uuid, dim, v, packed) with equal keys ``by`` whose vectors have at least a cosine.

    With ``forest`` only pairs that connect a cell's rows, without a cycle: the components are the same, and a row has
    one pair for each part of its block. A block of more than PART rows is dealt out over parts by a hash, and each two
    parts are a cell, so that no task holds more than two parts and the products of one cell are worked in tiles.
    Null keys and vectors match nothing; neither do vectors of different lengths.
    """
    keys, kind = [*by, "dim"], rows.schema["uuid"].dataType.simpleString()
    rows = rows.select("uuid", *keys, "v").dropna(subset=[*keys, "v", "uuid"])
    sizes = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1").withColumn("parts", F.ceil(F.col("n") / PART).cast("int"))
    compared, cells = sizes.agg(F.sum(F.col("n") * F.col("parts")), F.sum(F.col("parts").cast("bigint") * (F.col("parts") + 1) / 2)).first()  # two numbers
    large = F.broadcast(sizes.where("parts > 1").select(*keys, "parts"))  # a row for each PART rows at most
    parts = F.coalesce("parts", F.lit(1))
    dealt = rows.join(large, keys, "left").withColumns({"part": F.pmod(F.xxhash64("uuid", "v"), parts).cast("int"), "other": F.explode(F.sequence(F.lit(0), parts - 1))})
    cell = [*keys, "i", "j"]
    dealt = dealt.select("uuid", *keys, "v", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"), (F.col("part") > F.col("other")).alias("right"))
    batches = int(max(1, min(compared or 0, cells or 0, max((compared or 0) // TASK_ROWS, 64))))
    # Small cells share a call.
    dealt = dealt.withColumn("batch", F.pmod(F.xxhash64(*cell), F.lit(batches))).repartition(min(batches, MOST_TASKS), "batch")
    found = dealt.groupBy("batch").applyInArrow(lambda t: _batch(t, cell, least, forest), f"x {kind}, y {kind}")
    return found.where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
