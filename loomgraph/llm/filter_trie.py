"""Filter interaction audit: every order of a set of filters, walked as a trie of permutations.

The trie is walked depth first. A node holds the documents that survive the filters above it as a persisted DataFrame;
orders of the same filters lead to the same documents, so each unordered prefix is computed once, remembered, and shared
by all its orders (32 states stand for the 326 nodes of five filters). At each state one aggregation counts, by part,
the survivors and what every filter that is left would remove: the edges of the trie. At most one state a level is held
at a time; a lost executor's blocks are computed again from the written flags.

Null texts count as empty, a null source as the part ''. A text is a copy if a row of a smaller doc_id has the same text,
removed or not; a null doc_id is neither smaller than another nor larger. Repeated rows count each; a document with
several labels is good or toxic if any of them says so. An empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import permutations
from math import factorial

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm.common import SPACE, materialise, table
from loomgraph.tables import scratch

#: The filters in natural order: a letter each, with the column of the measured rows that says that a document fails.
FILTERS: dict[str, Column | Callable[[], Column]] = {
    "A": lambda: F.col("n_words") < 200,
    "B": lambda: 100 * F.col("n_distinct") < 50 * F.col("n_words"),
    "C": lambda: 100 * F.col("n_capitals") > 2 * F.col("n_points"),
    "D": lambda: F.col("marked"),
    "E": lambda: F.coalesce(F.col("doc_id") > F.col("first"), F.lit(False)),
}
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def measure(documents: DataFrame) -> DataFrame:
    """doc_id, part, the measures of the whole text and ``first``, the least doc_id of an equal text (null without copies).

    Texts are read once and not shuffled: copies are found by the SHA-256 of the text. A hash that many rows share is
    combined before the shuffle for its least doc_id. Those hashes are written, so that the join back is one of two plain
    exchanges, which adaptive execution splits.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    words = F.filter(F.split(text, f"[{SPACE}]+"), lambda w: w != "")
    counted = F.element_at(F.transform(F.array(words), lambda w: F.struct(F.size(w).alias("n_words"), F.size(F.array_distinct(w)).alias("n_distinct"))), 1)
    rows = documents.select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"),
        counted.alias("counted"),
        (F.octet_length(text) - F.octet_length(F.translate(text, CAPITALS, ""))).alias("n_capitals"),
        F.char_length(text).alias("n_points"),
        text.rlike("[#$%&*|]").alias("marked"),
        F.unhex(F.sha2(text, 256)).alias("key"),
    )
    measured = materialise(rows.select("doc_id", "part", "counted.*", "n_capitals", "n_points", "marked", "key"), "measured")
    copied = materialise(measured.groupBy("key").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select("key", "first"), "copied")
    return measured.join(copied, "key", "left").drop("key")


def flagged(documents: DataFrame, labels: DataFrame, filters: dict = FILTERS) -> DataFrame:
    """part, good, toxic and a boolean a filter for every document, written to the shared folder."""
    known = labels.groupBy(F.col("doc_id").cast("bigint").alias("doc_id")).agg(
        F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic")
    )
    failing = measure(documents).select("doc_id", "part", *(F.coalesce(test(), F.lit(False)).alias(f"fails_{k}") for k, test in filters.items()))
    marks = [F.coalesce(c, F.lit(False)).alias(c) for c in ("good", "toxic")]
    return materialise(failing.join(known, "doc_id", "left").select("part", *marks, *(f"fails_{k}" for k in filters)), "flagged")


def _edges(survivors: DataFrame, state: str, left: list[str]) -> DataFrame:
    """(part, state, n, lost) of a state: survivors, and by filter how many of them it removes, good and toxic ones apart."""
    counts = [F.count(F.lit(1)).alias("n")]
    for k in left:
        fails = F.col(f"fails_{k}")
        counts += [F.count_if(fails).alias(f"removed_{k}"), F.count_if(fails & F.col("good")).alias(f"good_{k}"), F.count_if(fails & F.col("toxic")).alias(f"toxic_{k}")]
    lost = [x for k in left for x in (F.lit(k), F.struct(F.col(f"removed_{k}").alias("removed"), F.col(f"good_{k}").alias("good"), F.col(f"toxic_{k}").alias("toxic")))]
    kind = "map<string,struct<removed:bigint,good:bigint,toxic:bigint>>"
    return survivors.groupBy("part").agg(*counts).select("part", F.lit(state).alias("state"), "n", (F.create_map(*lost) if lost else F.create_map()).cast(kind).alias("lost"))


def walk(rows: DataFrame, letters: str) -> DataFrame:
    """The counts of all states: (part, state, n, lost), where a state is its filters in natural order.

    A part without survivors in a state has no row for it.
    """
    root, written = scratch(rows.sparkSession, "states"), {}

    def visit(state: str, survivors: DataFrame) -> None:
        survivors = survivors.persist(StorageLevel.MEMORY_AND_DISK)
        left = [k for k in letters if k not in state]
        found = _edges(survivors, state, left)
        written[state] = f"{root}/{len(written)}"
        found.write.parquet(written[state])
        for k in left:
            after = "".join(x for x in letters if x in state or x == k)
            if after not in written:  # else another order of the same filters has been here
                visit(after, survivors.where(~F.col(f"fails_{k}")).drop(f"fails_{k}"))
        survivors.unpersist()

    visit("", rows)
    return rows.sparkSession.read.schema("part string, state string, n bigint, lost map<string,struct<removed:bigint,good:bigint,toxic:bigint>>").parquet(*written.values())


def audit(documents: DataFrame, labels: DataFrame, filters: dict = FILTERS) -> DataFrame:
    """One row a part, order of the filters and step: kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley.

    Counts of all states of a part (2**k for k filters) meet in one row; the table of orders (k! times k rows) is
    broadcast. Both depend on the filters alone, not on the documents.
    """
    letters = "".join(filters)
    k, spark = len(letters), documents.sparkSession
    states = walk(flagged(documents, labels, filters), letters)
    steps = []
    for order in permutations(letters):
        for i, f in enumerate(order):
            before, after = ("".join(x for x in letters if x in order[:j]) for j in (i, i + 1))
            steps.append(("".join(order), i + 1, f, before, after))
    orders = spark.createDataFrame(steps, "filter_order string, step int, filter string, before string, after string")
    trie = F.array(*(F.struct(F.lit(f).alias("filter"), F.lit(b).alias("before"), F.lit(a).alias("after"), F.lit(factorial(len(b)) * factorial(k - 1 - len(b))).cast("bigint").alias("orders")) for f, b, a in sorted({x[2:] for x in steps})))
    zero = F.lit(0).cast("bigint")

    def counted(x: Column) -> Column:
        lost = F.try_element_at(F.try_element_at(F.col("states"), x["before"])["lost"], x["filter"])
        return F.struct(
            x["filter"].alias("filter"), x["before"].alias("before"), x["orders"].alias("orders"),
            F.coalesce(F.try_element_at(F.col("states"), x["after"])["n"], zero).alias("kept"),
            *(F.coalesce(lost[c], zero).alias(c) for c in ("removed", "good", "toxic")),
        )

    parts = states.groupBy("part").agg(F.map_from_entries(F.collect_list(F.struct("state", F.struct("n", "lost")))).alias("states")).select("part", F.transform(trie, counted).alias("edges"))
    edge = parts.select("part", "edges", F.explode("edges").alias("e"))
    same = lambda test: F.filter("edges", lambda x: (x["filter"] == F.col("e.filter")) & test(x))
    only = lambda n: F.element_at(same(lambda x: F.char_length(x["before"]) == n), 1)["removed"]
    rows = edge.select(
        "part", F.col("e.filter").alias("filter"), F.col("e.before").alias("before"), "e.kept", "e.removed",
        (only(0) - F.col("e.removed")).alias("redundant"), only(k - 1).alias("unique_fails"), F.col("e.good").alias("good_lost"), F.col("e.toxic").alias("toxic_lost"),
        F.aggregate(same(lambda x: F.lit(True)), zero, lambda acc, x: acc + x["orders"] * x["removed"]).alias("shapley"),
    )
    return rows.join(F.broadcast(orders.drop("after")), ["filter", "before"]).select("part", "filter_order", "step", "filter", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


#: The same counts in DuckDB SQL: documents by what they fail, then every order and step on those groups.
ORACLE = r"""
with t as (select doc_id, coalesce(source, '') as part, coalesce(text, '') as x from documents),
q as (select doc_id, bool_or(coalesce(quality = 1, false)) as good, bool_or(coalesce(toxic = 1, false)) as toxic from labels group by doc_id),
w as (select *, regexp_extract_all(x, '[^\x20\x09-\x0D]+') as ws, min(doc_id) over (partition by x) as first from t),
f as (select part, [len(ws) < 200, 100 * len(list_distinct(ws)) < 50 * len(ws), 100 * (length(x) - length(regexp_replace(x, '[A-Z]', '', 'g'))) > 2 * length(x), regexp_matches(x, '[#$%&*|]'), coalesce(w.doc_id > first, false)] as bad,
 coalesce(good, false) as good, coalesce(toxic, false) as toxic from w left join q on q.doc_id = w.doc_id),
g as (select part, bad, good, toxic, count(*) as n from f group by all),
l as (select unnest(range(1, 6)) as i),
o as (select [a.i, b.i, c.i, d.i, e.i] as o from l a, l b, l c, l d, l e where len(list_distinct([a.i, b.i, c.i, d.i, e.i])) = 5),
s as (select o, l.i as s, o[:l.i - 1] as earlier, o[l.i] as now from o, l),
r as (select part, o, s, now, bad[now] as fails, len(list_filter(earlier, lambda i: bad[i])) > 0 as gone, len(list_filter(bad, lambda b: b)) = 1 as lone, good, toxic, n from g, s)
select part, array_to_string(list_transform(o, lambda i: chr((64 + i)::int)), '') as filter_order, s::int as step, chr((64 + now)::int) as filter,
 coalesce(sum(n) filter (not gone and not fails), 0)::bigint as kept, coalesce(sum(n) filter (fails and not gone), 0)::bigint as removed, coalesce(sum(n) filter (fails and gone), 0)::bigint as redundant,
 coalesce(sum(n) filter (fails and lone), 0)::bigint as unique_fails, coalesce(sum(n) filter (fails and not gone and good), 0)::bigint as good_lost, coalesce(sum(n) filter (fails and not gone and toxic), 0)::bigint as toxic_lost,
 (sum(coalesce(sum(n) filter (fails and not gone), 0)) over (partition by part, now))::bigint as shapley
from r group by part, o, s, now"""
