"""Deterministic classifiers of episodes: origin, durability, kind, provenance, route, duplicates."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph import config
from loomgraph.functions.columns import blank, contains_any, declared, json_list, lines, looked_up

#: Path or name prefixes that tell the producing tool, in order of precedence.
TOOL_RULES = (("doc", "docs"), ("obs", "observer"))


def origin(name: str = "name", source: str = "source_description", capsule_prefix: str = config.CAPSULE_PREFIX, canonical_prefix: str = config.CANONICAL_PREFIX, workspaces: Mapping[str, str] | None = None) -> Column:
    """device, tool and project of an episode: ordered rules on its name and source.

    ``workspaces`` gives the tool that a workspace (a declared project, in lower case) belongs to; observations of other
    workspaces have the observer as their tool. Nulls count as empty.
    """
    n, sd = blank(name), blank(source)
    low = F.lower(sd)
    capsule, canonical = n.startswith(capsule_prefix), n.startswith(canonical_prefix) | low.startswith(canonical_prefix)
    device = F.when(capsule, "remote").otherwise("local")
    tool = F.when(capsule, "capsule").when(canonical | low.startswith("case-pack"), "hub")
    for prefix, value in TOOL_RULES:
        own = looked_up(F.lower(declared(source, "project")), dict(workspaces), F.lit(value)) if workspaces and prefix == "obs" else F.lit(value)
        tool = tool.when(low.startswith(prefix), own)
    tool = tool.otherwise("unknown")
    project = F.coalesce(declared(source, "project"), F.when(tool == "capsule", "capsule").when(tool == "hub", "hub").otherwise("unknown"))
    return F.struct(device.alias("origin_device"), tool.alias("origin_tool"), project.alias("origin_project"))


def durability(title: str = "name") -> Column:
    """time-bound by words of the title alone."""
    return F.when(blank(title).rlike(config.TIME_BOUND), "time-bound").otherwise("evergreen")


def kind(name: str = "name", source: str = "source_description", canonical_prefix: str = config.CANONICAL_PREFIX) -> Column:
    """(kind, confidence): canonical names, then the declared type, else unclassified."""
    t = F.lower(declared(source, "type"))
    canonical = blank(name).startswith(canonical_prefix)
    k = F.when(canonical, config.CANONICAL_KIND[0]).otherwise(looked_up(t, {x: v[0] for x, v in config.TYPE_KIND.items()}, F.lit(config.UNCLASSIFIED)))
    c = F.when(canonical, config.CANONICAL_KIND[1]).otherwise(looked_up(t, {x: v[1] for x, v in config.TYPE_KIND.items()}, F.lit(0.0)))
    return F.struct(k.alias("kind"), c.alias("kind_confidence"))


def resolved_kind(derived: Column, override: Column, hook: Column | None = None, least: float = 0.7) -> Column:
    """An override counts fully; below ``least`` a classifier hook may answer (kind, kind_confidence), else unclassified."""
    second = F.coalesce(hook, derived) if hook is not None else derived
    chosen = F.when(derived["kind_confidence"] >= least, derived).when(second["kind_confidence"] >= least, second)
    none = F.struct(F.lit(config.UNCLASSIFIED).alias("kind"), F.lit(0.0).alias("kind_confidence"))
    return F.when(override.isNotNull(), F.struct(override.alias("kind"), F.lit(1.0).alias("kind_confidence"))).otherwise(F.coalesce(chosen, none))


def without_downgrade(old: Column, new: Column) -> Column:
    """A recomputed ``unclassified`` never replaces a set kind."""
    return F.when((new == config.UNCLASSIFIED) & old.isNotNull() & (old != config.UNCLASSIFIED), old).otherwise(F.coalesce(new, old))


#: Lines and headings that name sources. Fixed values.
LABELLED_SOURCE = r"\*\*[^*\n]*来源[^*\n]*\*\*\s*{colon}\s*([^\n]+)"
SOURCE_HEADING = r"(?ms)^#{2,4}[ \t]*[^\n#]*来源[^\n]*$(.*?)(?=^#{1,6}[ \t]|\z)"


def source_lines(content: str = "content", lenient: bool = False) -> Column:
    """Lines that name a source: a bold label before an ASCII colon, and the lines below a heading for sources.

    ``lenient`` also takes the full-width colon after the label.
    """
    text = blank(content)
    colon = "[:：]" if lenient else ":"
    labelled = F.regexp_extract_all(text, F.lit(LABELLED_SOURCE.format(colon=colon)), F.lit(1))
    blocks = F.regexp_extract_all(text, F.lit(SOURCE_HEADING), F.lit(1))
    below = F.flatten(F.transform(blocks, lambda b: F.transform(lines(b), lambda x: F.trim(F.regexp_replace(F.trim(x), r"^[-*]+", "")))))
    return F.concat(labelled, F.filter(below, lambda x: x != ""))


def provenance(content: str = "content", lenient: bool = False) -> Column:
    """external-article before external-community before firsthand; any external line wins."""
    found = source_lines(content, lenient)
    article = F.exists(found, lambda s: s.contains("文章《"))
    community = F.exists(found, lambda s: contains_any(F.lower(s), config.COMMUNITY))
    return F.when(article, "external-article").when(community, "external-community").otherwise("firsthand")


def has_source(content: str = "content") -> Column:
    return F.size(source_lines(content)) > 0


def is_catalog(name: str = "name", content: str = "content") -> Column:
    """A list rather than knowledge: by its name, first heading, or mostly enumerated lines without a conclusion."""
    rows = lines(blank(content))
    heading = F.coalesce(F.get(F.filter(rows, lambda x: F.ltrim(x).startswith("#")), F.lit(0)), F.lit(""))
    listed = F.size(F.filter(rows, lambda x: F.ltrim(x).startswith("|") | x.rlike(r"^\s*[-*•]\s")))
    mostly = (F.size(rows) >= 20) & (10 * listed > 6 * F.size(rows)) & ~blank(content).rlike(config.CONCLUSION)
    return blank(name).rlike(config.CATALOG) | heading.rlike(config.CATALOG) | mostly


def route(name: str = "name", content: str = "content", prefix: str = config.CAPSULE_PREFIX, least_bytes: int = 1500) -> Column:
    """catalog, split (by UTF-8 bytes) or null; only names with the prefix are routed."""
    return F.when(blank(name).startswith(prefix), F.when(is_catalog(name, content), "catalog").when(F.octet_length(blank(content)) >= least_bytes, "split"))


def first_line(content: str = "content", size: int | None = None) -> Column:
    line = F.coalesce(F.get(lines(blank(content)), F.lit(0)), F.lit(""))
    return F.substring(line, 1, size) if size else line


def duplicate_clusters(episodes: DataFrame, title: Column, active_only: bool = False) -> DataFrame:
    """(project, title) groups of two or more episodes. The three definitions in use differ in title and archived rows."""
    rows = episodes.where("not archived") if active_only else episodes
    project = F.coalesce(declared("source_description", "project"), F.lit("unknown"))
    return rows.groupBy(project.alias("project"), title.alias("title")).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def source_values(episodes: DataFrame) -> DataFrame:
    """Per source (the first word of the description): episodes, those with a type and a project, shares of high- and low-value types.

    Of several declarations the last counts; nulls count as no source.
    """
    last = lambda key: F.element_at(F.regexp_extract_all(blank("source_description"), F.lit(rf"{key}=(\S+)"), F.lit(1)), -1)
    has = lambda key: F.size(F.regexp_extract_all(blank("source_description"), F.lit(rf"{key}=(\S+)"), F.lit(1))) > 0
    rows = episodes.select(F.split(blank("source_description"), " ")[0].alias("source"), F.when(has("type"), last("type")).alias("type"), F.when(has("project"), last("project")).alias("project"))
    share = lambda kinds: F.round(100.0 * F.count_if(F.col("type").isin(*kinds)) / F.count(F.lit(1)), 2)
    return rows.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.count("type").alias("typed"), F.count("project").alias("with_project"), share(config.KNOWLEDGE_TYPES).alias("high_percent"), share(config.OPERATIONAL_TYPES).alias("low_percent"))


def observation_body(most_files: int = 20, full: bool = False) -> Column:
    """An observation as the text of its episode: type and title, narrative, facts, concepts, files; empty parts are left out.

    ``full`` adds the subtitle, the files read and the project (``?`` without one), of columns of these names. The
    headings are fixed values.
    """
    facts, concepts, files = json_list("facts"), json_list("concepts"), json_list("files_modified")
    none = F.array().cast("array<string>")
    given = lambda when, *parts: F.when(when, F.concat(*parts)).otherwise(none)
    lines_ = F.concat(
        F.array(F.concat(F.lit("["), F.upper(F.coalesce(F.nullif("type", F.lit("")), F.lit("obs"))), F.lit("] "), F.coalesce(F.nullif("title", F.lit("")), F.lit("(untitled)")))),
        given(blank("subtitle") != "", F.array("subtitle")) if full else none,
        F.array(F.lit("")),
        given(blank("narrative") != "", F.array(F.lit("Narrative:"), F.col("narrative"), F.lit(""))),
        given(F.size(facts) > 0, F.array(F.lit("Key facts:")), F.transform(facts, lambda x: F.concat(F.lit("- "), x)), F.array(F.lit(""))),
        given(F.size(concepts) > 0, F.array(F.concat(F.lit("Concepts: "), F.array_join(concepts, ", ")))),
        given(F.size(files) > 0, F.array(F.concat(F.lit("Files modified: "), F.array_join(F.slice(files, 1, most_files), ", ")))),
        *((given(F.size(json_list("files_read")) > 0, F.array(F.concat(F.lit("Files read: "), F.array_join(F.slice(json_list("files_read"), 1, most_files), ", ")))), F.array(F.concat(F.lit("Project: "), F.coalesce("project", F.lit("?"))))) if full else ()),
    )
    return F.array_join(lines_, "\n")


def payload(origin: str) -> Column:
    """An observation with its platform as an ingest request: name, source description, key and the full body.

    The key is the origin's name with the id.
    """
    number = F.col("id").cast("string")
    said = F.concat(F.lit(f"{origin} id="), number, F.lit(" project="), F.coalesce("project", F.lit("?")), F.lit(" type="), F.coalesce("type", F.lit("?")), F.lit(" platform="), F.coalesce(F.nullif("platform", F.lit("")), F.lit("_default")))
    return F.struct(F.concat(F.lit(f"{origin}-"), number).alias("name"), said.alias("source_description"), F.concat(F.lit(f"{origin}-id-"), number).alias("source_obs_id"), observation_body(full=True).alias("episode_body"))


def health(episodes: DataFrame, noise: Column, title: Column) -> DataFrame:
    """One row of health metrics: totals, use of live episodes and of canonical ones, noise, clusters of live duplicates."""
    live, used = ~F.coalesce("archived", F.lit(False)), F.coalesce("usage_count", F.lit(0)) > 0
    canonical = F.col("name").startswith(config.CANONICAL_PREFIX)
    share = lambda part, whole: F.round(100.0 * F.count_if(part) / F.greatest(F.count_if(whole), F.lit(1)), 2)
    counts = episodes.agg(
        F.count(F.lit(1)).alias("total"), F.count_if(live).alias("active"), F.count_if(~live).alias("archived"), share(live & used, live).alias("injected_percent"),
        share(canonical & live & ~used, canonical & live).alias("dormant_percent"), F.count_if(noise & live).alias("noise_active"), F.count_if(noise & ~live).alias("noise_archived"),
    )
    clusters = duplicate_clusters(episodes, title, active_only=True).agg(F.count(F.lit(1)).alias("duplicate_clusters"))
    return counts.crossJoin(F.broadcast(clusters))  # one row each


def keep_longest(episodes: DataFrame, title: Column) -> DataFrame:
    """All but the longest episode of each (project, title) group, with the one that is kept; ties keep the first by uuid.

    The kept one is an aggregate over lengths and uuids; no content is shuffled. Nulls count as empty.
    """
    project = F.coalesce(declared("source_description", "project"), F.lit("unknown"))
    rows = episodes.select("uuid", project.alias("project"), title.alias("title"), F.char_length(blank("content")).alias("size"))
    best = rows.groupBy("project", "title").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct((-F.col("size")).alias("size"), "uuid")).alias("best")).where("n > 1")
    return rows.join(best, ["project", "title"]).select("uuid", "project", "title", F.col("best.uuid").alias("kept")).where("uuid <> kept")


def _first_of(rows: DataFrame, key: Column, order: list[str], by: str) -> DataFrame:
    """The rows that come first in their group: their keys by an aggregate that is combined before its shuffle, then a semi-join."""
    first = rows.groupBy(key.alias("key")).agg(F.min(F.struct(*order)).alias("first")).select(F.col(f"first.{by}").alias(by))
    return rows.join(first, by, "left_semi")


def keep_earliest(episodes: DataFrame, created: str) -> DataFrame:
    """One row of each content hash, the earliest; ties by uuid (unique). Null contents count as empty."""
    return _first_of(episodes, F.sha2(blank("content"), 256), [created, "uuid"], "uuid")


def first_bytes_dedupe(files: DataFrame, path: str = "path", content: str = "content", size: int = 200) -> DataFrame:
    """The first file by (unique) path of each group with equal leading UTF-8 bytes. Null contents count as empty."""
    return _first_of(files, F.substring(F.encode(blank(content), "UTF-8"), 1, size), [path], path)
