"""Nearest sessions of a stream at the bounds of the interval, and over more than a month."""

import datetime as dt

import duckdb
from pyspark.sql import functions as F

from loomgraph.plans import stream_queries

DAY = dt.datetime(2024, 1, 1)


def rows():
    at = lambda seconds, days=0: DAY + dt.timedelta(days=days, seconds=seconds)
    out = []
    for k, (ts, start) in enumerate([(1000.9, 820.1), (1000.1, 4600.9), (1000.9, 819.9), (1000.1, 4601.1), (1000.5, 1500.5)]):  # whole seconds apart: -180, 3600, -181, 3601, 500
        for days in (0, 9, 40, 75):  # later days of a month come before the first ones of the next
            out += [(len(out), 10 * k + days, "purchase", at(ts, days)), (len(out) + 1, 10 * k + days, "signup", at(start, days))]
    return out


def test_nearest_equals_its_sql_at_the_bounds_and_over_months(spark, tmp_path):
    spark.createDataFrame(rows(), "event_id long, user_id long, event_type string, ts timestamp_ntz").repartition(3).write.parquet(f"{tmp_path}/events.parquet")
    got = sorted(tuple(r) for r in stream_queries.stream_nearest(spark, str(tmp_path)).select("id", "session_id", F.col("gap").cast("long")).collect())
    c = duckdb.connect()
    c.execute(f"create view events as select * from '{tmp_path}/events.parquet/*.parquet'")
    want = sorted(c.execute(stream_queries.ORACLES["stream_nearest"]).fetchall())
    assert got == want and len(want) == 12
