"""Postings of a frequent word lie in several files, each sorted by term."""

from pyspark.sql import functions as F

from loomgraph.operators.fulltext import SHARES, FullText


def test_a_frequent_word_is_shared_out(spark, tmp_path):
    rows = [(f"u{i}", "the the " + " ".join(f"w{i}x{j}" for j in range(20)), False) for i in range(60)]
    index = FullText(spark, f"{tmp_path}/index")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # small tables would be one task
    index.add(spark.createDataFrame(rows, "uuid string, content string, archived boolean").repartition(3))
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    read = spark.read.parquet(f"{tmp_path}/index/postings").withColumn("file", F.input_file_name())
    the = read.where("term = 'the'").collect()
    assert len(the) == 60 and {r.tf for r in the} == {2} and {r.dl for r in the} == {22}
    assert 1 < len({r.file for r in the}) <= SHARES
    for (file,) in read.select("file").distinct().collect():
        terms = [r.term for r in spark.read.parquet(file).select("term").collect()]
        assert terms == sorted(terms)
