"""Tables in the folder that the whole cluster shares: written intermediates, state versions, connected components."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def workspace(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where it is unset, a local session takes a temporary folder; a cluster is refused, since each machine would write
    to its own disk.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="loomgraph-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{workspace(spark)}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` into the shared folder and read it again: cuts the lineage and survives a lost executor."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def delete(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared store."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def forget(df: DataFrame) -> None:
    """Delete the files of a materialised table that nothing reads any more."""
    for path in {f.rpartition("/")[0] for f in df.inputFiles()}:
        delete(df.sparkSession, path)


def replace_state(state: DataFrame, root: str) -> None:
    """Make ``state`` the current version below ``root``: a new folder first, then the pointer to it, then the old one goes.

    ``state`` may be read from the version it replaces. A reader sees the old version or the new one, never a mixture;
    a writer that dies leaves the old one current.
    """
    spark = state.sparkSession
    version = uuid.uuid4().hex
    state.write.parquet(f"{root}/{version}")
    old = None if (known := _current(spark, root)) is None else known
    spark.createDataFrame([(version,)], "version string").coalesce(1).write.mode("overwrite").json(f"{root}/next")
    fs_path = spark._jvm.org.apache.hadoop.fs.Path
    fs = fs_path(root).getFileSystem(spark._jsc.hadoopConfiguration())
    fs.delete(fs_path(f"{root}/pointer"), True)
    fs.rename(fs_path(f"{root}/next"), fs_path(f"{root}/pointer"))
    if old:
        delete(spark, f"{root}/{old}")


def _current(spark: SparkSession, root: str) -> str | None:
    fs_path = spark._jvm.org.apache.hadoop.fs.Path
    fs = fs_path(root).getFileSystem(spark._jsc.hadoopConfiguration())
    for name in ("pointer", "next"):  # between delete and rename the next pointer is the current one
        if fs.exists(fs_path(f"{root}/{name}/_SUCCESS")):
            return spark.read.schema("version string").json(f"{root}/{name}").first().version
    return None


def current_state(spark: SparkSession, root: str, schema: str) -> DataFrame:
    """The current version below ``root``; no rows where there is none."""
    version = _current(spark, root)
    return spark.createDataFrame([], schema) if version is None else spark.read.schema(schema).parquet(f"{root}/{version}")


def components(links: DataFrame) -> DataFrame:
    """(node, root) of every node of links (a, b): root is the least node of its connected component.

    Alternates large-star and small-star steps; a node's neighbours are never gathered, only their minimum. Each round
    is written to the shared folder, and the rounds grow with the logarithm of the longest path.
    """
    edges = materialise(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges")
    before = None
    while True:
        state = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(state) == before or state[0] == 0:
            return edges.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("root")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        before = tuple(state)
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # Written first, so that a hub's edges meet its minimum in a join of two plain exchanges, which can be split.
        least = materialise(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
        after = materialise(small.where("u <> v").distinct(), "edges")
        forget(edges)
        forget(least)
        edges = after
