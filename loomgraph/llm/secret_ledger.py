"""Secret scans: an incremental ledger of content-addressed blobs.

Every version of a text is addressed by its SHA-256. A ledger holds the findings of each (blob, rule version) pair that
was ever scanned, so that only unseen pairs are scanned, also after a return to older rules; findings are joined back to
every path that holds the blob. All work is done by built-in expressions. Null texts count as empty; a text without
secrets has zero counts, empty span lists and the hash of the empty string; repeated rows each give a row; empty tables
give empty ledgers and reports. A report's columns ``blob`` and ``spans`` take the place of ones of these names.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm.common import materialise, table


@dataclass(frozen=True)
class SecretRule:
    """Matches of ``pattern``, leftmost and non-overlapping, whose group ``group`` has ``least`` characters or more."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1


_KEYWORDS = ("password", "passwd", "secret", "token")


def _fold(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" for c in word)


ASSIGN = rf"""({"|".join(map(_fold, _KEYWORDS))}|{_fold("api")}_?{_fold("key")})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""

#: The order of the rules breaks ties between spans that start together. The first three are the base kinds; a run of
#: 32 or more hexadecimal digits is the same as a maximal run of that length, and likewise for access keys.
RULES = (
    SecretRule("assign", ASSIGN, 2, 8),
    SecretRule("access", "AKIA[A-Z0-9]{12,}"),
    SecretRule("hex", "[0-9a-f]{32,}"),
    SecretRule("private_key", "-----BEGIN [A-Z ]{0,24}PRIVATE KEY-----"),
    SecretRule("github", "gh[pousr]_[A-Za-z0-9]{36,}"),
    SecretRule("slack", "xox[abprs]-[A-Za-z0-9-]{10,}"),
    SecretRule("web_token", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
)
BASE = ("assign", "access", "hex")
RULE_VERSION = "1"
_SPAN = "array<struct<start:bigint,rank:int,kind:string,end:bigint>>"


#: Elements that running values are formed over at a time, so that their cost grows with the list and not with its square.
STRIDE = 256


def _let(value: Column, body) -> Column:
    """Evaluate ``value`` once and use it several times inside ``body``."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _blocks(values: Column) -> Column:
    """A list in consecutive pieces of STRIDE elements; no piece of an empty list."""
    starts = lambda v: F.filter(F.sequence(F.lit(0), F.greatest(F.size(v) - 1, F.lit(0)), F.lit(STRIDE)), lambda i: i < F.size(v))
    return _let(values, lambda v: F.transform(starts(v), lambda i: F.slice(v, i + 1, STRIDE)))


def _before(values: Column, start: Column, combine) -> Column:
    """For each of some bigints what those before it combine to, from ``start``; then what all do."""
    none = F.array().cast("array<bigint>")
    folded = F.aggregate(values, F.struct(start.alias("now"), none.alias("out")), lambda acc, x: F.struct(combine(acc["now"], x).alias("now"), F.concat(acc["out"], F.array(acc["now"])).alias("out")))
    return _let(folded, lambda x: F.concat(x["out"], F.array(x["now"])))


def _running(values: Column, combine) -> Column:
    """``_before`` from 0 for long lists: over the pieces first, then inside of each; ``combine`` is associative, with 0 neutral."""
    zero = F.lit(0).cast("bigint")

    def inner(blocks: Column) -> Column:
        totals = F.transform(blocks, lambda b: F.aggregate(b, zero, combine))
        starts = _before(totals, zero, combine)
        within = lambda s: F.flatten(F.transform(blocks, lambda b, i: F.slice(_before(b, F.get(s, i), combine), 1, F.size(b))))
        return _let(starts, lambda s: F.concat(within(s), F.slice(s, -1, 1)))

    return _let(_blocks(values), inner)


def _spans(text: Column, rank: int, rule: SecretRule) -> Column:
    """Spans of one rule: pieces between matches and the matches themselves give the offsets in code points."""
    pattern = F.lit(rule.pattern)
    lengths = lambda parts: F.transform(parts, lambda x: F.char_length(x).cast("bigint"))
    step = F.arrays_zip(
        lengths(F.split(text, rule.pattern, -1)).alias("gap"),
        lengths(F.regexp_extract_all(text, pattern, F.lit(0))).alias("size"),
        lengths(F.regexp_extract_all(text, pattern, F.lit(rule.group))).alias("core"),
    )

    def placed(step: Column) -> Column:
        at = _running(F.transform(step, lambda x: x["gap"] + x["size"]), lambda a, b: a + b)
        every = lambda at: F.transform(step, lambda x, i: F.struct((F.get(at, i) + x["gap"]).alias("start"), F.lit(rank).alias("rank"), F.lit(rule.kind).alias("kind"), (F.get(at, i) + x["gap"] + x["size"]).alias("end"), x["core"].alias("core")))
        kept = F.filter(_let(at, every), lambda x: x["core"] >= rule.least)
        return F.transform(kept, lambda x: F.struct(x["start"].alias("start"), x["rank"].alias("rank"), x["kind"].alias("kind"), x["end"].alias("end"))).cast(_SPAN)

    found = _let(F.filter(step, lambda x: x["size"].isNotNull()), placed)
    return F.when(text.rlike(rule.pattern), found).otherwise(F.array().cast(_SPAN))


def scan_blobs(blobs: DataFrame, rules: tuple[SecretRule, ...] = RULES, version: str = RULE_VERSION) -> DataFrame:
    """(blob, rule_version, spans) of blobs (blob, text); spans are sorted by start, then by the order of the rules."""
    every = F.concat(*(_spans(F.col("text"), i, r) for i, r in enumerate(rules)))
    return blobs.select("blob", F.lit(version).alias("rule_version"), F.sort_array(every).alias("spans"))


def update_ledger(versions: DataFrame, ledger: DataFrame | None = None, rules: tuple[SecretRule, ...] = RULES, version: str = RULE_VERSION) -> DataFrame:
    """The ledger after ``versions`` (any rows with a text): all its rows stay, and the unseen pairs are scanned.

    Equal texts are one blob; the aggregation combines them before the shuffle, so a hot blob doesn't pile up.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    blobs = versions.select(F.sha2(text, 256).alias("blob"), text.alias("text")).dropDuplicates(["blob"])
    if ledger is None:
        return scan_blobs(blobs, rules, version)
    known = ledger.where(F.col("rule_version") == version)
    unseen = blobs.join(known.select("blob"), "blob", "left_anti")
    return ledger.select("blob", "rule_version", "spans").unionByName(scan_blobs(unseen, rules, version))


def report(versions: DataFrame, ledger: DataFrame, version: str = RULE_VERSION) -> DataFrame:
    """``versions`` with the spans of their blobs by one rule version; only blobs with findings take part in the join."""
    blob = F.sha2(F.coalesce(F.col("text").cast("string"), F.lit("")), 256)
    found = ledger.where((F.col("rule_version") == version) & (F.size("spans") > 0)).select("blob", "spans")
    rows = versions.select(*(c for c in versions.columns if c not in ("blob", "spans")), blob.alias("blob"))
    return rows.join(found, "blob", "left").withColumn("spans", F.coalesce("spans", F.array().cast(_SPAN)))


def _listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def _of_kind(kind: str):
    return lambda s: s["kind"] == kind


def summarise(found: DataFrame) -> DataFrame:
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE))
    return found.select(
        "doc_id",
        *(F.size(F.filter("spans", _of_kind(k))).cast("bigint").alias(f"n_{k}") for k in BASE),
        F.sha2(_listed(base), 256).alias("base_sha256"),
        _listed(F.col("spans")).alias("spans"),
    )


def redact(documents: DataFrame, spans: str = "spans") -> DataFrame:
    """``documents`` with each span of the text replaced by its kind in brackets; overlapping spans become one mark.

    A span that begins before the end of an earlier one only makes its mark longer. Texts are cut into stretches of
    STRIDE marks and these into pieces, so that no piece is looked for from the start of a long text.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    part = lambda t, a, b: F.substring(t, (a + 1).cast("int"), (b - a).cast("int"))

    def cut(reach: Column) -> Column:
        """reach: the furthest end before each span, then of all."""
        marks = F.filter(F.transform(F.col(spans), lambda s, i: F.struct(F.get(reach, i).alias("after"), s["start"].alias("start"), s["kind"].alias("kind"))), lambda m: m["start"] >= m["after"])

        def stretch(block: Column) -> Column:
            first, last = F.get(block, F.lit(0))["after"], F.element_at(block, -1)["start"]
            pieces = lambda t: F.transform(block, lambda m: F.concat(part(t, m["after"] - first, m["start"] - first), F.lit("["), m["kind"], F.lit("]")))
            return F.array_join(_let(part(text, first, last), pieces), "")

        end = F.element_at(reach, -1)
        return F.concat(F.array_join(F.transform(_blocks(marks), stretch), ""), part(text, end, F.char_length(text).cast("bigint")))

    reach = _running(F.transform(F.col(spans), lambda s: s["end"]), lambda a, b: F.greatest(a, b))
    return documents.withColumn("text", F.when(F.size(spans) > 0, _let(reach, cut)).otherwise(F.col("text")))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table in two increments: the texts of about half of the rows first, then all, of which only new blobs are scanned."""
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    first = F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 0
    ledger = materialise(update_ledger(documents.where(first)), "ledger")
    ledger = materialise(update_ledger(documents.where(~first), ledger), "ledger")
    return summarise(report(documents, ledger))


def _oracle() -> str:
    parts = []
    for rank, rule in enumerate(RULES):
        pattern = rule.pattern.replace("'", "''")
        parts.append(f"""select t, list_filter(list_transform(range(1, len(m) + 1), lambda i: {{'start': list_sum(list_transform(g[:i], lambda x: length(x)))::bigint + coalesce(list_sum(list_transform(m[:i - 1], lambda x: length(x))), 0)::bigint, 'rank': {rank}, 'kind': '{rule.kind}', 'size': length(m[i]), 'core': length(c[i])}}), lambda x: x['core'] >= {rule.least}) as s
 from (select t, regexp_extract_all(t, '{pattern}') as m, regexp_extract_all(t, '{pattern}', {rule.group}) as c, string_split_regex(t, '{pattern}') as g from d)""")
    return f"""
with d as (select distinct coalesce(text, '') as t from documents),
f as (select t, unnest(s) as s from ({" union all ".join(parts)})),
o as (select t, s['kind'] as kind, s['rank'] as rank, coalesce(s['start'], 0)::bigint as start, coalesce(s['start'], 0)::bigint + s['size']::bigint as stop from f),
a as (select t, {", ".join(f"count(*) filter (kind = '{k}') as n_{k}" for k in BASE)},
 coalesce(string_agg(kind || ':' || start || ':' || stop, ',' order by start, rank) filter (kind in {BASE}), '') as base,
 string_agg(kind || ':' || start || ':' || stop, ',' order by start, rank) as spans from o group by t)
select x.doc_id, {", ".join(f"coalesce(n_{k}, 0)::bigint as n_{k}" for k in BASE)}, sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans
from documents x left join a on a.t = coalesce(x.text, '')"""


#: The same scan in DuckDB SQL, without the ledger.
ORACLE = _oracle()
