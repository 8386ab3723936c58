"""Quality rules: a table of thresholds compiled into one Spark projection.

Null texts count as empty. Words are runs of characters other than space and \\x09-\\x0D. All measures are computed
over the whole text by built-in functions; no user function runs. Repeated rows each give a row, extra columns of the
input are ignored, an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm.common import SPACE, table

#: Frequent short words of the languages in the corpus, one list for all. Fixed values.
STOP_WORDS = ("the of and to in is that was for it on a an be at by this with as are "
              "le la les de des et un une est que qui dans pour sur pas au du en ne avec "
              "der die das und ist ein eine von zu den mit auf im für nicht dem sich es "
              "el los las y que del se por con para una su al lo como más o").split()
SYMBOLS = "#*$%&|<>"
WINDOW = 8


@dataclass(frozen=True)
class Rule:
    """Keep a document only if ``least <= measure <= most``; a bound of None doesn't hold."""

    name: str
    measure: str
    least: float | None = None
    most: float | None = None


#: The threshold table. Ratios are per word, except where the measure says otherwise.
RULES = (
    Rule("mean_word", "mean_word_chars", 2.0, 14.0),
    Rule("symbols", "symbol_ratio", None, 0.05),
    Rule("exclamations", "exclamation_ratio", None, 0.25),
    Rule("stop_words", "stop_word_ratio", 0.05, None),
    Rule("dup_lines", "dup_line_ratio", None, 0.40),
)


def _let(value: Column, body) -> Column:
    """Evaluate ``value`` once and use it several times inside ``body``."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _repeated(words: Column) -> Column:
    """Words that lie in 8-word windows which occur twice or more in the text."""
    n = F.size(words)

    def covered(hashes: Column) -> Column:
        def count(order: Column) -> Column:
            # order: (hash, position) sorted, so that equal windows are neighbours
            same = lambda x, i: F.coalesce(F.get(order, i)["h"] == x["h"], F.lit(False))
            at = F.transform(F.filter(order, lambda x, i: same(x, i - 1) | same(x, i + 1)), lambda x: x["p"])
            return F.aggregate(
                F.sort_array(at),
                F.struct(F.lit(0).alias("n"), F.lit(-WINDOW).alias("last")),
                lambda acc, p: F.struct((acc["n"] + F.least(F.lit(WINDOW), p - acc["last"])).alias("n"), p.alias("last")),
                lambda acc: acc["n"],
            )

        paired = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("p"))))
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(_let(paired, count))

    hashes = F.transform(F.sequence(F.lit(1), n - (WINDOW - 1)), lambda i: F.xxhash64(F.slice(words, i, WINDOW)))
    return F.when(n <= WINDOW, F.lit(0)).otherwise(_let(hashes, covered))


def _measured(words: Column, text: Column, lines: Column) -> Column:
    kept_lines = F.filter(lines, lambda x: x.rlike(f"[^{SPACE}]"))
    joined = F.array_join(words, "")
    symbols = F.lit(0)
    for c in SYMBOLS:
        symbols = symbols + (F.octet_length(text) - F.octet_length(F.replace(text, F.lit(c))))
    stop = F.size(F.filter(words, lambda w: F.lower(w).isin(*STOP_WORDS)))
    return F.struct(
        F.size(words).cast("bigint").alias("n_words"),
        F.char_length(joined).cast("bigint").alias("word_chars"),
        symbols.cast("bigint").alias("n_symbols"),
        _let(kept_lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("bigint").alias("n_dup_lines"),
        _repeated(words).cast("bigint").alias("n_repeat_words"),
        stop.cast("bigint").alias("n_stop_words"),
        F.size(kept_lines).cast("bigint").alias("n_lines"),
        (F.octet_length(text) - F.octet_length(F.replace(text, F.lit("!")))).cast("bigint").alias("n_exclamations"),
    )


MEASURES = {
    "mean_word_chars": ("word_chars", "n_words"),
    "symbol_ratio": ("n_symbols", "word_chars"),
    "exclamation_ratio": ("n_exclamations", "n_words"),
    "stop_word_ratio": ("n_stop_words", "n_words"),
    "dup_line_ratio": ("n_dup_lines", "n_lines"),
}


def compile_rules(rules: tuple[Rule, ...] = RULES) -> Column:
    """The verdict of the whole table as one boolean expression: numerator against bound times denominator."""
    verdict = F.lit(True)
    for rule in rules:
        over, under = (F.col(c).cast("double") for c in MEASURES[rule.measure])
        if rule.least is not None:
            verdict = verdict & (over >= F.lit(rule.least) * under)
        if rule.most is not None:
            verdict = verdict & (over <= F.lit(rule.most) * under)
    return verdict


def apply_rules(documents: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """doc_id, the measures, base_failed and kept for every row; documents needs doc_id and text only."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    words = F.filter(F.split(text, f"[{SPACE}]+"), lambda w: w != "")
    measured = documents.select("doc_id", _let(F.struct(words.alias("w"), text.alias("t")), lambda x: _measured(x["w"], x["t"], F.split(x["t"], "\n"))).alias("m"))
    base = measured.select("doc_id", "m.*").withColumn("base_failed", (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words")))
    return base.withColumn("kept", ~F.col("base_failed") & compile_rules(rules))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return apply_rules(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_stop_words", "n_lines", "n_exclamations")


def _oracle() -> str:
    stop = ", ".join(f"'{w}'" for w in STOP_WORDS)
    n_symbols = " + ".join(f"(length(t) - length(replace(t, '{c}', '')))" for c in SYMBOLS)
    tests = []
    for rule in RULES:
        over, under = MEASURES[rule.measure]
        tests += [f"{over}::double >= {rule.least!r}::double * {under}::double"] * (rule.least is not None) + [f"{over}::double <= {rule.most!r}::double * {under}::double"] * (rule.most is not None)
    return f"""
with d as (select row_number() over () as rid, doc_id, coalesce(text, '') as t from documents),
w as (select *, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') as ws, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) as ls from d),
g as (select rid, p, array_to_string(ws[p:p + {WINDOW - 1}], ' ') as gram from (select rid, ws, unnest(range(1, len(ws) - {WINDOW - 2})) as p from w where len(ws) >= {WINDOW})),
r as (select rid, count(distinct p + k) as n from (select rid, p, count(*) over (partition by rid, gram) as c from g), range({WINDOW}) as o(k) where c > 1 group by rid),
m as (select doc_id, len(ws)::bigint as n_words, length(array_to_string(ws, ''))::bigint as word_chars, ({n_symbols})::bigint as n_symbols,
 (len(ls) - len(list_distinct(ls)))::bigint as n_dup_lines, coalesce(r.n, 0)::bigint as n_repeat_words,
 len(list_filter(ws, lambda x: lower(x) in ({stop})))::bigint as n_stop_words, len(ls)::bigint as n_lines, (length(t) - length(replace(t, '!', '')))::bigint as n_exclamations
 from w left join r using (rid)),
b as (select *, n_words < 20 or 100 * n_repeat_words > 30 * n_words as base_failed from m)
select *, not base_failed and {" and ".join(tests)} as kept from b"""


#: The same measures and verdict in DuckDB SQL.
ORACLE = _oracle()
