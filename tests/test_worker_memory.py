"""Workers hold a bounded part of an Arrow batch, or no batch at all."""

import ahocorasick
import pyarrow as pa
from pyspark.util import PythonEvalType

from loomgraph.operators import patterns, retrieval
from loomgraph.sources import readers


def test_answers_reach_the_parser_row_by_row():
    assert readers.fenced_json_items.evalType == PythonEvalType.SQL_BATCHED_UDF


def test_texts_are_searched_some_rows_at_a_time():
    class Shared:
        id, value = -1, ["a"]

    n = 2 * patterns.ROWS + 3
    batch = pa.RecordBatch.from_arrays([pa.array(range(n)), pa.array(["xa" if i % 2 else "b" for i in range(n)])], names=["k", "t"])
    got = list(patterns._finder(Shared(), False, True)(iter([batch])))
    assert [b.num_rows for b in got] == [patterns.ROWS // 2, patterns.ROWS // 2, 1]
    assert [k for b in got for k in b.column("k").to_pylist()] == list(range(1, n, 2))
    assert isinstance(patterns._BUILT[-1], ahocorasick.Automaton)


def test_nearest_vectors_are_the_same_for_any_block(spark, monkeypatch):
    facts = spark.createDataFrame([(i, f"f{i}", [float(i % 5), float(i % 7), 1.0]) for i in range(60)], "edge_id long, fact string, embedding array<double>").coalesce(1)
    queries = [(1, [1.0, 0.0, 0.0]), (2, [0.0, 1.0, 1.0])]
    want = sorted(map(tuple, retrieval.batch_vector_top(facts, queries, 6).collect()))
    monkeypatch.setattr(retrieval, "BLOCK_CELLS", 6)
    assert sorted(map(tuple, retrieval.batch_vector_top(facts, queries, 6).collect())) == want
