"""Corpus pipeline: language ID, near-duplicate join, secret scan, source mixing, tokenisation.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; its result is written as Parquet and read again as the
next one's docs. All but the last return the columns of documents; other columns are left out. Every row is handled on
its own, whatever its id, except that near duplicates keep one row of least doc_id of their group. A null or blank text
has no language and goes in the first stage; given to a later one it stays, with no tokens. Empty tables give empty ones.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm import byte_bpe, jaccard_join, language_mixture, secret_ledger, soft_mixing
from loomgraph.llm.common import give_back, held_out, materialise, table

#: Documents of which less is ordinary text of their languages, or that have no letters, are rejected.
LEAST_LANGUAGE_SCORE = 0.25
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents of no determinable language. The model learns from the documents of known language outside the held-out fold."""
    give_back()  # what the driver has freed of the stage before
    model = language_mixture.train(table(spark, sf_dir, "documents").where(~held_out()))
    kept = docs.select(*COLUMNS)
    scored = language_mixture.predict(kept, model, carry=COLUMNS)
    return scored.where((F.col("lang_pred") != language_mixture.UNDETERMINED) & (F.col("ordinary") >= LEAST_LANGUAGE_SCORE)).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each group of near duplicates, one of least doc_id (null ones last); rows without words all stay."""
    give_back()  # what the driver has freed of the stage before
    kept, where = docs.select(*COLUMNS).withColumn("key", jaccard_join.text_key()), ["doc_id", "key"]
    first = materialise(jaccard_join.representatives(docs).select("doc_id", "key", "first", "n_rows"), "representatives")

    def beside(other: DataFrame, how: str) -> DataFrame:
        other = other.select(*(F.col(c).alias(f"_{c}") for c in where))
        return kept.join(other, F.col("doc_id").eqNullSafe(F.col("_doc_id")) & (F.col("key") == F.col("_key")), how)

    lone = beside(first.where("not first or n_rows > 1"), "left_anti").select(*COLUMNS)
    # Rows of one id and text: one of them stays, that of least other columns.
    several = materialise(first.where("first and n_rows > 1"), "several")
    least = beside(several, "left_semi").groupBy(*where).agg(F.min(F.struct(*(c for c in COLUMNS if c != "doc_id"))).alias("row"))
    return lone.unionByName(least.select("doc_id", "row.*").select(*COLUMNS))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces every secret in the texts by its kind in brackets; all documents stay."""
    give_back()  # what the driver has freed of the stage before
    ledger = materialise(secret_ledger.update_ledger(docs), "ledger")
    clean = secret_ledger.redact(secret_ledger.report(docs.select(*COLUMNS), ledger))
    return clean.withColumn("n_chars", F.char_length("text").cast("bigint")).select(*COLUMNS)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its mixing rate says, so that the rows have the target weights; rate 0 leaves it out."""
    give_back()  # what the driver has freed of the stage before
    mixed = soft_mixing.mix(docs, table(spark, sf_dir, "labels"), carry=COLUMNS)
    return mixed.where("copies >= 1").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).select(*COLUMNS)


def tokenisation(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every document."""
    give_back()  # what the driver has freed of the stage before
    return byte_bpe.encode(docs, digest=True)


STAGES = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("secret_scan", secret_scan),
    ("source_mixing", source_mixing),
    ("tokenisation", tokenisation),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each stage's rows are written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return docs


#: SQL expresses neither the language model nor the mixing; tests compare the stages with brute force.
ORACLE_SQL = None
