"""Calls of a model from a table of texts: every distinct request once, its answer or its failure kept in a ledger."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.functions.columns import blank
from loomgraph.operators.merging import MergeTable
from loomgraph.tables import forget, materialise

#: A hook takes a list of prompts and gives an answer for each, or raises. It runs in the workers.
Hook = Callable[[Sequence[str]], Sequence[str]]
_LEDGER = "key string, status string, answer string, error string, tries int"
#: Tags that an episode's visibility can have; anything else that a model says becomes the first. Fixed values.
TAGS = ("internal-note", "professional-guide", "public-story")


class AnswerLedger:
    """Answers of one hook below a folder of the shared store. ``version`` names model and prompt: a new one asks anew.

    A request is known by a hash of version and prompt, so equal prompts are asked once, in this run and all later ones.
    A hook that fails on a batch is asked for each of its prompts alone, and one that still fails is kept as a row with
    its error and tried again in the next run, ``most_tries`` times in all. Answers are written before anything reads
    them, so that a lost executor costs the requests of its own unwritten tasks at most. The ledger is a merge-on-read
    table: a run writes the rows of its own requests.
    """

    def __init__(self, spark: SparkSession, root: str, hook: Hook, version: str = "1", batch: int = 15, most_tries: int = 3) -> None:
        self.table = MergeTable(spark, root, "key", _LEDGER)
        self.hook, self.version, self.batch, self.most_tries = hook, version, batch, most_tries

    def key(self, prompt: str) -> Column:
        return F.sha2(F.concat_ws("\n", F.lit(self.version), F.col(prompt)), 256)

    def _asked(self) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
        hook, size = self.hook, self.batch

        def called(prompts: list[str]) -> list[tuple]:
            try:
                answers = list(hook(prompts))
                if len(answers) != len(prompts) or not all(isinstance(a, str) for a in answers):
                    raise ValueError(f"{len(answers)} answers to {len(prompts)} prompts")
                return [("ok", a, None) for a in answers]
            except Exception as e:  # noqa: BLE001 - whatever a model's client raises becomes a row
                if len(prompts) == 1:
                    return [("error", None, f"{type(e).__name__}: {e}"[:500])]
                return [r for p in prompts for r in called([p])]

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in frames:
                prompts = frame["prompt"].tolist()
                rows = [r for i in range(0, len(prompts), size) for r in called(prompts[i : i + size])]
                yield pd.DataFrame({"key": frame["key"], "status": [r[0] for r in rows], "answer": [r[1] for r in rows], "error": [r[2] for r in rows], "tries": frame["tries"] + 1}).astype({"tries": "int32"})

        return run

    def ask(self, requests: DataFrame, prompt: str = "prompt") -> DataFrame:
        """``requests`` with status, answer and error, after the hook was called for what no earlier run has answered.

        A null or empty prompt isn't asked: its status is ``empty``. The columns status, answer and error are replaced.
        """
        real = blank(prompt) != ""
        kept = requests.drop("status", "answer", "error")
        wanted = kept.where(real).select(self.key(prompt).alias("key"), F.col(prompt).alias("prompt")).dropDuplicates(["key"])
        known = self.table.read().select("key", F.col("status").alias("_status"), F.col("tries").alias("_tries"))
        due = wanted.join(known, "key", "left").where(F.col("_status").isNull() | ((F.col("_status") == "error") & (F.col("_tries") < self.most_tries)))
        due = due.select("key", "prompt", F.coalesce("_tries", F.lit(0)).alias("tries"))
        new = materialise(due.mapInPandas(self._asked(), _LEDGER), "answers")
        if not new.isEmpty():
            self.table.upsert(new)
        forget(new)
        held = self.table.read().select(F.col("key").alias("_key"), "status", "answer", "error")
        rows = kept.withColumn("_key", F.when(real, self.key(prompt))).join(held, "_key", "left").drop("_key")
        return rows.withColumn("status", F.coalesce("status", F.lit("empty")))


def tag_prompt(content: Column) -> Column:
    """What a model sees of an episode: its first 300 characters on one line, trimmed and cut at 200."""
    return F.substring(F.replace(F.trim(F.substring(F.coalesce(content, F.lit("")), 1, 300), F.lit(" \t\r\n")), F.lit("\n"), F.lit(" ")), 1, 200)


def suggested_tag(answer: Column) -> Column:
    """The tag that an answer suggests: itself if it is one, else the most reserved. Null where nothing was answered."""
    return F.when(answer.isNull(), None).when(answer.isin(*TAGS), answer).otherwise(TAGS[0])
