"""Which of very many fixed texts occur in each row's text: an automaton over all of them, one pass over each text.

The patterns are distinct rows; they are broadcast in blocks of BLOCK_CHARS characters at most, each of which costs one
pass over the texts. A worker builds the automaton of a block once.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.tables import materialise

#: Characters of patterns in one broadcast.
BLOCK_CHARS = 1 << 22
#: Texts that a worker holds at a time, out of an Arrow batch.
ROWS = 256
#: The automaton of the last block that this worker has seen, by the block's number.
_BUILT: dict[int, ahocorasick.Automaton] = {}


def _automaton(shared) -> ahocorasick.Automaton:
    if shared.id not in _BUILT:
        made = ahocorasick.Automaton()
        for p in shared.value:
            made.add_word(p, p)
        made.make_automaton()
        _BUILT.clear()
        _BUILT[shared.id] = made
    return _BUILT[shared.id]


class _Shared:
    """A broadcast block of patterns with a number that the workers know it by."""

    def __init__(self, held, number: int) -> None:
        self.held, self.id = held, number

    @property
    def value(self) -> list[str]:
        return self.held.value


def occurring(texts: DataFrame, keys: Sequence[str], text: str, patterns: DataFrame, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """(keys, pattern): the distinct patterns that occur in column ``text`` of each row; both are taken as they are.

    patterns: column ``pattern``; null ones are left out, an empty one occurs in every text. Null texts hold nothing.
    """
    spark = texts.sparkSession
    known = materialise(patterns.select(F.col("pattern").cast("string").alias("pattern")).where("pattern is not null").distinct(), "patterns")
    total = known.agg(F.sum(F.char_length("pattern"))).first()[0] or 0
    blocks = max(1, -(-total // block_chars))
    rows = texts.select(*keys, F.col(text).cast("string").alias("_text"))
    shape = rows.select(*keys).withColumn("pattern", F.lit("")).schema
    out = None
    for b in range(blocks):
        own = [r.pattern for r in known.where(F.pmod(F.xxhash64("pattern"), F.lit(blocks)) == b).collect()]  # about block_chars characters
        if not own:
            continue
        held = spark.sparkContext.broadcast([p for p in own if p])
        part = rows.mapInArrow(_finder(_Shared(held, id(held)), "" in own, bool(held.value)), shape)
        out = part if out is None else out.unionByName(part)
    return spark.createDataFrame([], shape) if out is None else out


def _finder(shared: _Shared, always: bool, some: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from loomgraph.operators import patterns  # the worker's own module, whose automaton outlives the task

        find = patterns._automaton(shared).iter if some else None
        for batch in (b.slice(i, ROWS) for b in batches for i in range(0, b.num_rows, ROWS)):
            at, hits = [], []
            for i, t in enumerate(batch.column(batch.num_columns - 1).to_pylist()):
                if t is None:
                    continue
                found = {p for _, p in find(t)} if find else set()
                if always:
                    found.add("")
                at += [i] * len(found)
                hits += sorted(found)
            where = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays([*(c.take(where) for c in batch.columns[:-1]), pa.array(hits, pa.string())], names=[*batch.schema.names[:-1], "pattern"])

    return run
