"""The pipeline's stages: each one's rows against its operator's decisions, and the whole run."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from loomgraph.llm import jaccard_join, secret_ledger
from loomgraph.llm.common import materialise

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def kept(spark):
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), {}
    out["documents"] = docs
    for name, stage in corpus_pipeline.STAGES:
        docs = materialise(stage(spark, docs, SF), name)
        out[name] = docs
    return out


def ids(df):
    return sorted(r.doc_id for r in df.select("doc_id").collect())


def test_columns_stay_until_the_last_stage(kept):
    want = kept["documents"].columns
    for name, _ in corpus_pipeline.STAGES[:-1]:
        assert sorted(kept[name].columns) == sorted(want)


def test_language_stage_keeps_texts_with_letters(kept):
    gone = set(ids(kept["documents"])) - set(ids(kept["language_id"]))
    assert len(gone) <= 2


def test_near_duplicates_leave_one_of_each_group(kept):
    groups = jaccard_join.join(kept["language_id"]).groupBy("component_id").agg(F.min("doc_id").alias("doc_id"))
    assert ids(kept["near_duplicates"]) == ids(groups)


def test_secrets_go_and_documents_stay(kept):
    assert ids(kept["secret_scan"]) == ids(kept["near_duplicates"])
    left = secret_ledger.update_ledger(kept["secret_scan"])
    assert left.where(F.size("spans") > 0).count() == 0


def test_mixing_keeps_most_clean_documents(spark, kept):
    labels = spark.read.parquet(f"{SF}/labels.parquet").where("quality = 1 and toxic = 0")
    clean = kept["secret_scan"].join(labels, "doc_id", "left_semi").count()
    assert kept["source_mixing"].join(labels, "doc_id", "left_semi").count() >= 0.9 * clean


def test_last_stage_encodes_what_is_left(spark, kept):
    assert ids(kept["tokenisation"]) == ids(kept["source_mixing"])
    assert ids(corpus_pipeline.run(spark, SF)) == ids(kept["tokenisation"])


ODD = [(1, "The house of the river and the garden of the town. " * 8, "en", "a", 1), (1, "The house of the river and the garden of the town. " * 8, "en", "a", 1), (None, "Der Hund und die Katze sind im Garten. token=abcdefgh1 " * 6, "de", "b", 2), (None, None, None, None, None), (2, "", "en", "a", 0), (3, "word " * 60_000 + "end", "en", "a", 9)]


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stages_take_odd_rows(spark, name):
    """Nulls in every column, repeated rows, blank and very long texts, clashing columns; and an empty table."""
    stage = dict(corpus_pipeline.STAGES)[name]
    docs = spark.createDataFrame(ODD, "doc_id long, text string, lang string, source string, n_chars long")
    for c in ("spans", "blob", "score", "copies", "key", "node", "rate", "n_tokens", "u", "token", "_0"):
        docs = docs.withColumn(c, F.lit("clash"))
    got = stage(spark, docs, SF).collect()
    texts = [r[1] for r in ODD]
    if name == "tokenisation":
        assert len(got) == len(ODD) and sorted(r.n_tokens == 0 for r in got) == [False] * 4 + [True] * 2
        return
    assert got[0].__fields__ == list(corpus_pipeline.COLUMNS)
    left = [r.text for r in got]
    if name == "language_id":
        assert sorted(left) == sorted(t for t in texts if t)
    elif name == "near_duplicates":
        assert sorted(map(str, left)) == sorted(map(str, set(texts)))
    elif name == "secret_scan":
        assert len(got) == len(ODD) and sum("[assign]" in (t or "") for t in left) == 1
    else:
        assert {str(t) for t in left} == {str(t) for t in texts}
    assert stage(spark, docs.limit(0), SF).count() == 0


def test_mixing_stage_gives_each_document_its_copies(spark, kept):
    from loomgraph.llm import soft_mixing

    want = {r.doc_id: r.copies for r in soft_mixing.mix(kept["secret_scan"], spark.read.parquet(f"{SF}/labels.parquet")).collect()}
    got = kept["source_mixing"].groupBy("doc_id").count().collect()
    assert {r.doc_id: r["count"] for r in got} == {i: c for i, c in want.items() if c}


def test_near_duplicates_keep_one_row_with_repeated_and_null_ids(spark):
    text = " ".join(f"word{i}" for i in range(60))
    near, other, lone = text + " more", " ".join(f"other{i}" for i in range(30)), " ".join(f"lone{i}" for i in range(30))
    rows = [(1, text, "a"), (1, text, "b"), (1, text, "a"), (2, near, "a"), (2, lone, "a"), (None, text, "a"), (None, other, "b"), (None, other, "a"), (None, other, "a"), (None, None, "a"), (None, None, "a"), (7, " ", "a"), (7, " ", "a")]
    docs = spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = corpus_pipeline.near_duplicates(spark, docs.repartition(3), SF)
    want = [(1, text, "a"), (2, lone, "a"), (None, other, "a"), (None, None, "a"), (None, None, "a"), (7, " ", "a"), (7, " ", "a")]
    assert sorted(map(str, got.select("doc_id", "text", "source").collect())) == sorted(map(str, spark.createDataFrame(want, "doc_id long, text string, source string").collect()))
