"""Registry of the engine's queries and of the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from loomgraph.plans import episode_queries, gate_queries, graph_queries, index_queries, intake_queries, lifecycle_queries, scan_queries, state_queries, stream_queries

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
for _module in (gate_queries, episode_queries, graph_queries, scan_queries, state_queries, lifecycle_queries, stream_queries, index_queries, intake_queries):
    QUERIES |= _module.QUERIES
    ORACLES |= _module.ORACLES
