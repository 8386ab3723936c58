"""Readers and sinks: observation scans, logs, documents, backups; all with declared schemas."""

from __future__ import annotations

import gzip
import re
import zlib

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomgraph.schemas import DECISION, DELIVERY

HOOK_LINE = r"^(\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d(?:\.\d+)?Z)\s+(.*)$"


def id_range(observations: DataFrame, after: int, upto: int | None = None, limit: int = 500) -> DataFrame:
    """Rows of a range of ids in order; the bounds reach the scan."""
    rows = observations.where(F.col("id") > after)
    return (rows if upto is None else rows.where(F.col("id") <= upto)).orderBy("id").limit(limit)


def by_ids(observations: DataFrame, ids: DataFrame) -> DataFrame:
    return observations.join(ids.select("id").distinct(), "id", "left_semi")


def newest(observations: DataFrame, limit: int) -> DataFrame:
    return observations.orderBy(F.desc("created_at_epoch"), F.desc("id")).limit(limit)


def watermark(observations: DataFrame) -> DataFrame:
    return observations.agg(F.coalesce(F.max("id"), F.lit(0)).alias("watermark"))


def jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A JSON-lines log; blank and unparsable lines are dropped."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def decision_log(spark: SparkSession, path: str) -> DataFrame:
    return jsonl(spark, path, DECISION)


def delivery_log(spark: SparkSession, path: str) -> DataFrame:
    return jsonl(spark, path, DELIVERY)


def windowed(rows: DataFrame, spec: str, now: Column, ts: str = "ts") -> DataFrame:
    """Rows of a look-back window ``Nd``, ``Nh``, ``Nm`` or ``all``; without a window bad times stay."""
    units = {"d": "day", "h": "hour", "m": "minute"}
    if spec == "all":
        return rows
    if spec[-1:] not in units or not spec[:-1].isdigit():
        raise ValueError(f"no window: {spec}")
    return rows.where(F.try_to_timestamp(F.col(ts).cast("string")) >= now - F.expr(f"interval {int(spec[:-1])} {units[spec[-1]]}"))


def hook_log(spark: SparkSession, path: str) -> DataFrame:
    """Lines ``<ISO time>Z <body>`` with the body's kind and fields; others are dropped."""
    lines = spark.read.text(path).where(F.col("value").rlike(HOOK_LINE))
    body = F.regexp_extract("value", HOOK_LINE, 2)
    field = lambda name: F.nullif(F.regexp_extract(body, rf"\b{name}=(\S+)", 1), F.lit(""))
    names = F.nullif(F.regexp_extract(body, r"names=\[([^\]]*)\]", 1), F.lit(""))
    kind = F.when(body.startswith("START"), "start").when(body.startswith("OK"), "ok").when(body.startswith("no match"), "no_match").when(body.startswith("picked but"), "empty").when(body.startswith("bumped usage"), "usage").otherwise("error")
    return lines.select(
        F.to_timestamp(F.regexp_extract("value", HOOK_LINE, 1)).alias("ts"), kind.alias("kind"), field("fmt").alias("fmt"), field("kw").alias("kw"), field("picked").try_cast("int").alias("picked"),
        F.coalesce(F.transform(F.split(names, ","), lambda x: F.trim(x)), F.array().cast("array<string>")).alias("names"), F.regexp_extract(body, r"elapsed=([\d.]+)s", 1).try_cast("double").alias("elapsed"),
    )


def injections(log: DataFrame, prefix: str) -> DataFrame:
    """Successful deliveries with the names of one prefix; rows without such a name are dropped."""
    return log.where("kind = 'ok'").withColumn("names", F.filter("names", lambda n: n.startswith(prefix))).where(F.size("names") > 0)


@F.pandas_udf(T.BinaryType())
def unpacked(content: pd.Series) -> pd.Series:
    """Bytes, unpacked if they start with the gzip mark, whatever the file's name; null for broken ones."""

    def one(raw: bytes | None) -> bytes | None:
        if raw is None:
            return None
        raw = bytes(raw)
        if raw[:2] != b"\x1f\x8b":
            return raw
        try:
            return gzip.decompress(raw)
        except (OSError, EOFError, zlib.error):
            return None

    return content.map(one)


def documents(spark: SparkSession, root: str, pattern: str = "*.{md,md.gz}", least_bytes: int = 1500) -> DataFrame:
    """path, name, text, n_bytes, sha of all documents below a folder with at least so many unpacked bytes.

    Size and hash are of the unpacked bytes; bad UTF-8 is replaced in the text alone. Broken archives are left out.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(root)
    rows = files.select("path", F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.md(\.gz)?$", "").alias("name"), unpacked("content").alias("raw"))
    rows = rows.where(F.octet_length("raw") >= least_bytes)
    return rows.select("path", "name", F.make_valid_utf8(F.col("raw").cast("string")).alias("text"), F.octet_length("raw").alias("n_bytes"), F.sha2("raw", 256).alias("sha"))


def slug(path: Column) -> Column:
    """A path as a name: without the document's extension, slashes as dashes."""
    return F.replace(F.regexp_replace(path, r"\.md(\.gz)?$", ""), F.lit("/"), F.lit("-"))


def json_fixture(spark: SparkSession, path: str, schema: str, key: str | None = None) -> DataFrame:
    """Rows of a JSON document: a list of objects, or the list under a key of one object. A missing key gives no rows."""
    read = spark.read.option("multiLine", "true")
    if key is None:
        return read.schema(schema).json(path)
    return read.schema(f"`{key}` array<struct<{schema}>>").json(path).select(F.inline(key))


@F.udf(T.ArrayType(T.StringType()), useArrow=False)
def fenced_json_items(text: str | None) -> list[str]:
    """The items of the first JSON list of an answer, whose code fence is taken off.

    Without Arrow, a worker holds a hundred answers at a time and not a batch of 10,000 with their items.
    """
    return first_json_list(re.sub(r"^```(?:json)?\s*|\s*```$", "", (text or "").strip()))


OBSERVATION_ITEM = "type string, title string, facts string, narrative string, concepts string"


def parsed_observations(answers: DataFrame, types: tuple[str, ...], most: int = 8) -> DataFrame:
    """One row an observation out of answers (id, answer): id, place, type, title, facts, narrative, concepts.

    Items without a title or facts are dropped, unknown types become ``discovery``; titles are cut to 60 characters,
    facts to 6, narratives to 600 characters, concepts to 5, observations to ``most``. An answer without a list has none.
    """
    listed = lambda c: F.coalesce(F.from_json(c, "array<string>"), F.array().cast("array<string>"))
    items = answers.select("id", F.posexplode(fenced_json_items("answer")).alias("at", "item")).withColumn("o", F.from_json("item", OBSERVATION_ITEM))
    facts = F.filter(F.transform(listed(F.col("o.facts")), lambda x: F.trim(x)), lambda x: x != "")
    title = F.trim(F.coalesce("o.title", F.lit("")))
    rows = items.select("id", "at", F.when(F.trim("o.type").isin(*types), F.trim("o.type")).otherwise("discovery").alias("type"), title.alias("title"), facts.alias("facts"), F.substring(F.trim(F.coalesce("o.narrative", F.lit(""))), 1, 600).alias("narrative"), F.slice(F.transform(listed(F.col("o.concepts")), lambda x: F.trim(x)), 1, 5).alias("concepts"))
    rows = rows.where((F.col("title") != "") & (F.size("facts") > 0))
    rows = rows.withColumn("place", F.row_number().over(Window.partitionBy("id").orderBy("at"))).where(F.col("place") <= most)
    return rows.select("id", "place", "type", F.substring("title", 1, 60).alias("title"), F.slice("facts", 1, 6).alias("facts"), "narrative", "concepts")


def categorised(files: DataFrame, rules: list[tuple[str, str]]) -> DataFrame:
    """The first category whose pattern matches a path; others are dropped."""
    category = None
    for pattern, name in rules:
        category = F.when(F.col("path").rlike(pattern), name) if category is None else category.when(F.col("path").rlike(pattern), name)
    return files.withColumn("category", category).where("category is not null")


def registry_changes(registry: DataFrame, stored: DataFrame) -> DataFrame:
    """Registered documents whose hash isn't the stored one."""
    return registry.join(stored.select("path", "sha"), ["path", "sha"], "left_anti")


def first_json_list(raw: str | None) -> list[str]:
    """The first JSON list of a text as JSON items, tried at each bracket; none is empty."""
    import json

    decoder = json.JSONDecoder()
    at = (raw or "").find("[")
    while at >= 0:
        try:
            found, _ = decoder.raw_decode(raw[at:])
            if isinstance(found, list):
                return [json.dumps(x, ensure_ascii=False) for x in found]
        except ValueError:
            pass
        at = raw.find("[", at + 1)
    return []


def append_json(rows: DataFrame, path: str, by: str | None = None) -> None:
    """Append rows to a JSON log, by date folders if a column is given."""
    writer = rows.write.mode("append")
    (writer.partitionBy(by) if by else writer).json(path)


def retained(log: DataFrame, now: Column, days: int, ts: str = "ts") -> DataFrame:
    """A log without its rows older than some days: rotation by rewriting date partitions."""
    return log.where(F.col(ts) >= now - F.make_interval(days=F.lit(days)))
