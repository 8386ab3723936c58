"""A day of the quota stream is written by many tasks and is one batch all the same."""

import duckdb

from loomgraph.plans import stream_queries

SF = "/root/testdata/sf0.01"


def test_no_task_writes_a_whole_day(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet").repartition(5)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    seen, plain = [], stream_queries.scratch
    stream_queries.scratch = lambda s, name: seen.append(plain(s, name)) or seen[-1]
    spark.conf.set("spark.sql.files.maxPartitionBytes", "100000")
    try:
        out = stream_queries.stream_quotas(spark, str(tmp_path))
        got = sorted((r.id, r.layer, r.day, -1 if r.waits is None else r.waits) for r in out.collect())
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        stream_queries.scratch = plain
    c = duckdb.connect()
    c.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    assert got == sorted((i, a, b, -1 if w is None else w) for i, a, b, w in c.execute(stream_queries.ORACLES["stream_quotas"]).fetchall())
    for day in range(3):
        assert len(spark.read.parquet(f"{seen[0]}/in/day-{day}").inputFiles()) > 1
