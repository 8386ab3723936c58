"""Column helpers shared by the operators."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F


def blank(c: Column | str) -> Column:
    """The text, or '' for a null."""
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


def occurrences(text: Column, word: Column | str) -> Column:
    """Non-overlapping occurrences of a word; none for an empty word."""
    w = F.lit(word) if isinstance(word, str) else word
    return F.when(F.length(w) == 0, F.lit(0)).otherwise(((F.length(text) - F.length(F.replace(text, w, F.lit("")))) / F.length(w)).cast("bigint"))


def json_list(c: Column | str) -> Column:
    """A JSON array of strings; anything else is empty."""
    return F.coalesce(F.from_json(F.col(c) if isinstance(c, str) else c, "array<string>"), F.array().cast("array<string>"))


def declared(c: Column | str, key: str) -> Column:
    """The value of ``key=value`` in a source description, null if there is none."""
    return F.nullif(F.regexp_extract(blank(c), rf"{key}=(\S+)", 1), F.lit(""))


def looked_up(key: Column, values: Mapping[str, object], default: Column | None = None) -> Column:
    """A value by a small fixed table; an empty table gives the default alone."""
    if not values:
        return default if default is not None else F.lit(None)
    out = None
    for k, v in values.items():
        out = F.when(key == k, F.lit(v)) if out is None else out.when(key == k, F.lit(v))
    return out.otherwise(default) if default is not None else out


def contains_any(text: Column, words: Iterable[str]) -> Column:
    found = F.lit(False)
    for w in words:
        found = found | text.contains(w)
    return found


def snippet(text: Column, size: int) -> Column:
    """Trimmed, on one line, cut after ``size`` characters with an ellipsis."""
    flat = F.regexp_replace(F.trim(text), "\n", " ")
    return F.when(F.char_length(flat) > size, F.concat(F.substring(flat, 1, size), F.lit("…"))).otherwise(flat)


def escaped(text: Column) -> Column:
    """Text for HTML."""
    return F.replace(F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def lines(text: Column) -> Column:
    return F.split(text, r"\R")


def days_between(later: Column, earlier: Column) -> Column:
    """Whole days from one timestamp to another, rounded down."""
    return F.floor((F.unix_timestamp(later) - F.unix_timestamp(earlier)) / 86_400).cast("bigint")


def humanised(seconds: Column) -> Column:
    """An age as s, min, h or d with cut-offs of 90 s, 90 min and 48 h."""
    s = seconds.cast("bigint")
    return (
        F.when(s < 90, F.concat(s.cast("string"), F.lit("s")))
        .when(s < 5400, F.concat(F.floor(s / 60).cast("string"), F.lit("min")))
        .when(s < 172_800, F.concat(F.floor(s / 3600).cast("string"), F.lit("h")))
        .otherwise(F.concat(F.floor(s / 86_400).cast("string"), F.lit("d")))
    )


def short_age(seconds: Column) -> Column:
    """An age in whole minutes below an hour, hours below a day, else days; null stays null."""
    whole = lambda unit, name: F.concat(F.floor(seconds / unit).cast("string"), F.lit(name))
    return F.when(seconds < 3600, whole(60, "m")).when(seconds < 86_400, whole(3600, "h")).otherwise(whole(86_400, "d"))


def cpu_seconds(text: Column) -> Column:
    """Seconds of a ``[[dd:]hh:]mm:ss`` time; null for a bad one."""
    return F.aggregate(F.split(text, ":"), F.lit(0.0), lambda acc, x: acc * 60 + x.try_cast("double"))


def path_keywords(path: Column, system: Iterable[str], least: int = 5) -> Column:
    """Last and last but one part of a path, without system folders and parts of fewer than ``least`` characters."""
    parts = F.filter(F.split(F.coalesce(path, F.lit("")), "/"), lambda x: x != "")
    ends = F.slice(F.reverse(parts), 1, 2)
    return F.filter(ends, lambda x: (F.char_length(x) >= least) & ~x.isin(*system))


#: Space characters of any script, which SQL's trim takes; line ends and tabs are none.
SPACES = " \u00a0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u202f\u205f\u3000"


def excerpt(text: Column, size: int = 400, share: float = 0.6, mark: str = "\n[…]") -> Column:
    """The first ``size`` characters of a trimmed text, back to the last line end if that lies after ``share`` of them, with a mark if cut."""
    body = F.trim(F.coalesce(text, F.lit("")), F.lit(SPACES))
    head = F.substring(body, 1, size)
    cut = F.lit(size) - F.locate("\n", F.reverse(head))  # characters before the last line end; size without one
    short = F.when((F.locate("\n", head) > 0) & (cut > size * share), F.substring(head, F.lit(1), cut)).otherwise(head)
    return F.when(F.char_length(body) > size, F.concat(F.rtrim(short, F.lit(SPACES)), F.lit(mark))).otherwise(head)


def in_hours(ts: Column, start: int, end: int, zone: str = "+08:00") -> Column:
    """Whether the local hour lies in [start, end); the window may wrap midnight, equal bounds mean never."""
    h = F.hour(F.from_utc_timestamp(ts, zone))
    if start == end:
        return F.lit(False) & h.isNotNull()
    return (h >= start) & (h < end) if start < end else (h >= start) | (h < end)


def clamped(value: object, least: int, most: int, default: int) -> int:
    """An integer argument within bounds; a bad one is the default."""
    try:
        return min(max(int(value), least), most)
    except (TypeError, ValueError):
        return default
