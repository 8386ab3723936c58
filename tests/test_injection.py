"""The injected text against its SQL on odd texts and on rows of one id."""

import duckdb
import pytest

from loomgraph.plans import lifecycle_queries

SQL = lifecycle_queries.ORACLES["injection_text"]


@pytest.mark.parametrize("odd", ["spaces", "copies"])
def test_injected_text_equals_its_sql(spark, tmp_path, odd):
    text = {10: "the the the the the", 20: "the the the", 30: "the", 40: "the x"}
    if odd == "spaces":
        text = {k: f"　 {v}{'y' * 380}  {'z' * 50}" for k, v in text.items()}
    docs = [(k, v, "en", "src1", len(v)) for k, v in text.items()]
    if odd == "copies":
        docs.append(docs[0])
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(10, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    c = duckdb.connect()
    for t in ("documents", "labels"):
        c.execute(f"create view {t} as select * from '{tmp_path}/{t}.parquet/*.parquet'")
    got = [r.text for r in lifecycle_queries.injected(spark, str(tmp_path)).collect()]
    assert got == [c.execute(SQL).fetchone()[0]]
