"""The answer ledger: what is asked, what is kept, what is tried again."""

from pyspark.sql import functions as F

from loomgraph.operators import hooks


def calls(folder):
    return sorted(line for f in folder.iterdir() for line in f.read_text().splitlines())


def counting(folder):
    """A hook that writes down every prompt it answers and fails on some."""
    import os
    import uuid

    def hook(prompts):
        if any("fail" in p for p in prompts):
            raise TimeoutError("no answer")
        with open(os.path.join(folder, uuid.uuid4().hex), "w") as f:
            f.write("\n".join(prompts))
        return [p.upper() for p in prompts]

    return hook


def test_only_unseen_requests_are_asked_and_failures_come_again(spark, tmp_path):
    log = tmp_path / "log"
    log.mkdir()
    ledger = hooks.AnswerLedger(spark, f"file://{tmp_path}/ledger", counting(str(log)), batch=3, most_tries=2)
    first = spark.createDataFrame([(1, "a", "x"), (2, "a", "x"), (3, "b", "x"), (4, "fail", "x"), (5, None, "x"), (6, "", "x")], "id int, prompt string, status string")
    got = {r.id: (r.status, r.answer, r.error) for r in ledger.ask(first).collect()}
    assert got == {1: ("ok", "A", None), 2: ("ok", "A", None), 3: ("ok", "B", None), 4: ("error", None, "TimeoutError: no answer"), 5: ("empty", None, None), 6: ("empty", None, None)}
    assert calls(log) == ["a", "b"]
    second = spark.createDataFrame([(7, "b"), (8, "c"), (9, "fail")], "id int, prompt string")
    assert {r.id: r.status for r in ledger.ask(second).collect()} == {7: "ok", 8: "ok", 9: "error"}
    assert calls(log) == ["a", "b", "c"]
    tries = lambda: ledger.table.read().where("status = 'error'").first().tries
    assert tries() == 2
    ledger.ask(second)  # tried as often as may be
    assert tries() == 2 and calls(log) == ["a", "b", "c"]
    healed = hooks.AnswerLedger(spark, f"file://{tmp_path}/ledger", lambda prompts: ["fine"] * len(prompts), most_tries=3)
    assert {r.id: r.answer for r in healed.ask(second).collect()} == {7: "B", 8: "C", 9: "fine"}


def test_another_version_asks_anew_and_bad_answers_are_failures(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "id int, prompt string")
    old = hooks.AnswerLedger(spark, f"file://{tmp_path}/l", lambda p: [x + "1" for x in p])
    new = hooks.AnswerLedger(spark, f"file://{tmp_path}/l", lambda p: [x + "2" for x in p], version="2")
    short = hooks.AnswerLedger(spark, f"file://{tmp_path}/l", lambda p: [], version="3")
    assert [r.answer for r in old.ask(rows).orderBy("id").collect()] == ["a1", "b1"]
    assert [r.answer for r in new.ask(rows).orderBy("id").collect()] == ["a2", "b2"]
    assert {r.status for r in short.ask(rows).collect()} == {"error"}
    assert old.ask(rows.limit(0)).count() == 0


def test_tags(spark):
    df = spark.createDataFrame([("public-story",), ("whatever",), (None,)], "a string")
    assert [r[0] for r in df.select(hooks.suggested_tag(F.col("a"))).collect()] == ["public-story", "internal-note", None]
    text = spark.createDataFrame([("\n  one\ntwo " + "x" * 400,), (None,), (" \n",)], "t string").select(hooks.tag_prompt(F.col("t"))).collect()
    assert [(r[0][:7], len(r[0])) for r in text] == [("one two", 200), ("", 0), ("", 0)]
