"""Tables that are updated by small written deltas and merged when read: upserts, deletes, compaction by bucket.

``data/seq=S/bucket=B`` holds the rows of one write whose key falls into a hash bucket. The manifest says for each bucket
which writes count and in what order; it is replaced as a whole after all files of a write are there, so a writer that
dies leaves the old version. Reading takes the latest delta row of each key and the base rows without one: base rows
meet the deltas' keys alone. Compaction rewrites only buckets that have deltas. One writer at a time.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from loomgraph.tables import current_state, delete, materialise, replace_state

BUCKETS = 32
_MANIFEST = "bucket int, seq string, place int"


class MergeTable:
    """A table with a unique key below a folder of the shared store. ``schema`` is a DDL string and has the key."""

    def __init__(self, spark: SparkSession, root: str, key: str, schema: str, buckets: int = BUCKETS) -> None:
        self.spark, self.root, self.key, self.buckets = spark, root.rstrip("/"), key, buckets
        self.columns = StructType.fromDDL(schema).names
        self.stored = f"{schema}, deleted boolean, seq string, bucket int"

    def _bucket(self, key: Column) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(self.buckets)).cast("int")

    def manifest(self) -> list[tuple]:
        """(bucket, seq, place) of every write that counts; place 0 is a bucket's base."""
        found = current_state(self.spark, f"{self.root}/manifest", _MANIFEST).collect()  # writes x buckets, until compaction
        return sorted((tuple(r) for r in found), key=lambda r: (r[0], r[2]))

    def _commit(self, entries: Sequence[tuple]) -> None:
        replace_state(self.spark.createDataFrame(list(entries), _MANIFEST).coalesce(1), f"{self.root}/manifest")

    def _files(self, entries: Sequence[tuple]) -> DataFrame:
        if not entries:
            return self.spark.createDataFrame([], self.stored)
        return self.spark.read.schema(self.stored).option("basePath", f"{self.root}/data").parquet(*(f"{self.root}/data/seq={s}/bucket={b}" for b, s, _ in entries))

    def _write(self, rows: DataFrame) -> tuple[str, list[int]]:
        """A new write's name and the buckets it has rows of."""
        seq = uuid.uuid4().hex
        placed = rows.withColumn("bucket", self._bucket(F.col(self.key)))
        placed.repartitionByRange("bucket", self.key).write.partitionBy("bucket").parquet(f"{self.root}/data/seq={seq}")
        written = self.spark.read.schema(self.stored).parquet(f"{self.root}/data/seq={seq}")
        keys = written.agg(F.count(F.lit(1)), F.count(self.key), F.count_distinct(self.key)).first()
        if keys[0] != keys[2]:
            delete(self.spark, f"{self.root}/data/seq={seq}")
            raise ValueError(f"{keys[0] - keys[1]} null keys and {keys[1] - keys[2]} repeated ones in one write")
        return seq, [r.bucket for r in written.select("bucket").distinct().collect()]

    def _add(self, rows: DataFrame) -> None:
        before = self.manifest()
        seq, own = self._write(rows)
        places = {b: p for b, _, p in before}
        self._commit([*before, *((b, seq, places.get(b, -1) + 1) for b in own)])

    def upsert(self, rows: DataFrame) -> None:
        """Insert rows or replace those of the same key; a null or repeated key in ``rows`` is an error."""
        self._add(rows.select(*self.columns).withColumn("deleted", F.lit(False)))

    def delete(self, keys: DataFrame) -> None:
        """Delete the rows of some keys; unknown ones do nothing."""
        kinds = {f.name: f.dataType for f in StructType.fromDDL(self.stored)}
        gone = keys.select(self.key).where(F.col(self.key).isNotNull()).distinct()
        self._add(gone.select(*(F.col(c) if c == self.key else F.lit(None).cast(kinds[c]).alias(c) for c in self.columns), F.lit(True).alias("deleted")))

    def _merged(self, entries: Sequence[tuple]) -> DataFrame:
        base, deltas = [e for e in entries if e[2] == 0], [e for e in entries if e[2] > 0]
        rows = self._files(base)
        if not deltas:
            return rows.where("not deleted").select(*self.columns)
        places = F.create_map(*(x for (b, s), p in {(b, s): p for b, s, p in deltas}.items() for x in (F.lit(f"{b}/{s}"), F.lit(p))))
        place = F.element_at(places, F.concat_ws("/", F.col("bucket").cast("string"), "seq"))
        latest = self._files(deltas).withColumn("place", place).groupBy(self.key).agg(F.max_by(F.struct(*(c for c in self.columns if c != self.key), "deleted"), "place").alias("row")).select(self.key, "row.*")
        kept = rows.where("not deleted").join(latest.select(self.key), self.key, "left_anti").select(*self.columns)
        return kept.unionByName(latest.where("not deleted").select(*self.columns))

    def read(self) -> DataFrame:
        """The current rows."""
        return self._merged(self.manifest())

    def lookup(self, keys: Sequence) -> DataFrame:
        """The current rows of a short list of keys, out of their buckets alone."""
        kind = StructType.fromDDL(self.stored)[self.key].dataType
        wanted = {r[0] for r in self.spark.range(1).select(F.explode(F.array(*(self._bucket(F.lit(k).cast(kind)) for k in keys)))).collect()} if keys else set()
        return self._merged([e for e in self.manifest() if e[0] in wanted]).where(F.col(self.key).isin(*keys) if keys else F.lit(False))

    def compact(self, least: int = 1) -> list[int]:
        """Merge the buckets that have ``least`` deltas or more into new bases; returns them. Other buckets are not read."""
        before = self.manifest()
        counts: dict[int, int] = {}
        for b, _, p in before:
            counts[b] = counts.get(b, 0) + (p > 0)
        chosen = sorted(b for b, n in counts.items() if n >= least)
        if not chosen:
            return []
        old = [e for e in before if e[0] in chosen]
        seq, own = self._write(self._merged(old).withColumn("deleted", F.lit(False)))
        self._commit([*(e for e in before if e[0] not in chosen), *((b, seq, 0) for b in own)])
        for b, s, _ in old:
            delete(self.spark, f"{self.root}/data/seq={s}/bucket={b}")
        return chosen


def changed(table: MergeTable, keys: DataFrame, changes: dict[str, Column]) -> None:
    """Set columns of the rows of some keys to expressions over their current values; only these rows are written."""
    rows = table.read().join(keys.select(table.key).distinct(), table.key, "left_semi")
    table.upsert(materialise(rows.withColumns(changes), "changed"))
