"""Scalar text functions as Column expressions, free of Python at run time.

Java's classes differ from those of the Unicode-aware patterns meant here, hence the explicit white-space class SPACE.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as Unicode has it, spelled out for Java.
SPACE = "[\\t-\\r\\x1c-\\x20\\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]"
#: Control characters that cleaning deletes (those that are white space became spaces before).
CONTROL = "[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f\\x7f]"


def clean_text(c: Column) -> Column:
    """One space for every run of white space, no control characters, plain quotes and dashes, no margins; null gives ''."""
    spaced = F.regexp_replace(F.coalesce(c, F.lit("")), f"{SPACE}+", " ")
    return F.trim(F.translate(F.regexp_replace(spaced, CONTROL, ""), "«»–—", '""--'))


def worth_reading(c: Column, min_length: int = 20) -> Column:
    """False for texts that are too short or have fewer than five letters; null is false."""
    t = stripped(F.coalesce(c, F.lit("")))
    return (F.length(t) >= min_length) & (F.length(F.regexp_replace(t, "\\P{L}", "")) >= 5)


def stripped(c: Column) -> Column:
    return F.regexp_replace(c, f"^{SPACE}+|{SPACE}+$", "")


def digits_only(c: Column) -> Column:
    return F.regexp_replace(c, "\\P{Nd}", "")


def normalize_phone(c: Column) -> Column:
    return F.regexp_replace(c, f"{SPACE}|[-()+]", "")


def normalize_value(c: Column) -> Column:
    """A finding's value without white space and hyphens, in lower case."""
    return F.lower(F.regexp_replace(c, f"(?:{SPACE}|-)+", ""))


def masked(c: Column) -> Column:
    """Two characters at either end, stars between; all stars up to four characters."""
    n = F.length(c)
    inner = F.concat(F.substring(c, 1, 2), F.rpad(F.lit(""), n - 4, "*"), F.substring(c, -2, 2))
    return F.when(n <= 4, F.rpad(F.lit(""), n, "*")).otherwise(inner)


def snippet(text: Column, start: Column, length: Column, window: int = 60) -> Column:
    """`window` characters on either side of text[start : start + length] (from 0), line feeds as spaces, … where cut."""
    left = F.greatest(F.lit(0), start - window)
    right = F.least(F.length(text), start + length + window)
    core = F.translate(F.substring(text, left + 1, right - left), "\n", " ")
    return F.concat(F.when(left > 0, "…").otherwise(""), core, F.when(right < F.length(text), "…").otherwise(""))


def char_count(c: Column) -> Column:
    return F.length(c)


def word_count(c: Column) -> Column:
    t = stripped(F.coalesce(c, F.lit("")))
    return F.when(F.length(t) == 0, 0).otherwise(F.size(F.split(t, f"{SPACE}+")))


def is_empty(c: Column) -> Column:
    return F.length(stripped(F.coalesce(c, F.lit("")))) == 0


def suffix(path: Column) -> Column:
    """Lower-case extension without the dot; '' for none, and for a hidden name without another dot."""
    return F.lower(F.regexp_extract(file_name(path), "^.+\\.([^.]+)$", 1))


def file_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def strip_tags(c: Column) -> Column:
    """Every tag becomes a space."""
    return F.regexp_replace(c, "<[^>]+>", " ")


def clean_subtitles(c: Column) -> Column:
    """Spoken text of SRT or WebVTT: no time ranges, counters, tags, header or blank lines."""
    t = F.regexp_replace(F.translate(c, "\r", ""), "\\d{2}:\\d{2}:\\d{2}[,.]\\d{3}\\s*-->\\s*\\d{2}:\\d{2}:\\d{2}[,.]\\d{3}[^\\n]*", "")
    t = F.regexp_replace(F.regexp_replace(t, "(?m)^\\d+$", ""), "<[^>]+>", "")
    t = F.regexp_replace(t, "(?m)^WEBVTT[^\\n]*$", "")
    lines = F.filter(F.transform(F.split(t, "\n"), lambda x: stripped(x)), lambda x: F.length(x) > 0)
    return F.array_join(lines, "\n")


def category_text(counts: Column) -> Column:
    """'name(count), name(count)' of a map's positive counts in the map's order; a dash for none."""
    shown = F.transform(F.filter(F.map_entries(counts), lambda e: e["value"] > 0), lambda e: F.concat(e["key"], F.lit("("), e["value"].cast("string"), F.lit(")")))
    return F.when(F.size(shown) > 0, F.array_join(shown, ", ")).otherwise("—")


def shortened(c: Column, most: int, mark: str = "…") -> Column:
    return F.when(F.length(c) > most, F.concat(F.substring(c, 1, most), F.lit(mark))).otherwise(c)


def listing_time(ts: Column) -> Column:
    """Month, day and time in lower case."""
    return F.lower(F.date_format(ts, "MMM dd HH:mm"))
