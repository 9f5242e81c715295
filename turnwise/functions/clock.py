"""Time stamps in text and seconds from the start of a stream."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def hms(seconds: Column, pad_hours: bool = True) -> Column:
    """`HH:MM:SS` (or `H:MM:SS`) of a number of seconds, fractions cut off."""
    whole = F.floor(seconds).cast("long")
    style = "%02d:%02d:%02d" if pad_hours else "%d:%02d:%02d"
    return F.format_string(style, (whole / 3600).cast("long"),
                           (whole % 3600 / 60).cast("long"), whole % 60)


def _total(parts: list[Column]) -> Column:
    value = F.lit(0.0)
    for part in parts:
        value = value * 60 + part
    return value


def parse_hms(text: Column) -> Column:
    """`HH:MM:SS[.fff]` (a decimal comma is fine) to seconds, null if it has another form."""
    stamp = r"^\s*(\d+):(\d+):(\d+(?:[.,]\d+)?)\s*$"
    parts = [
        F.regexp_replace(F.regexp_extract(text, stamp, i), ",", ".").try_cast("double")
        for i in (1, 2, 3)]
    return _total(parts)


def find_stamp(text: Column) -> Column:
    """First `H:MM:SS` anywhere in a text, null if there is none."""
    return _total([F.regexp_extract(text, r"(\d+):(\d+):(\d+)", i).try_cast("double")
                   for i in (1, 2, 3)])


def strict_stamp(text: Column) -> Column:
    """`H:MM:SS` or `MM:SS` as the whole (trimmed, unbracketed) text, else null."""
    bare = F.trim(F.regexp_replace(text, r"[\[\]]", ""))
    three = [F.regexp_extract(bare, r"^(\d+):(\d+):(\d+)$", i).try_cast("double") for i in (1, 2, 3)]
    two = [F.regexp_extract(bare, r"^(\d+):(\d+)$", i).try_cast("double") for i in (1, 2)]
    return F.coalesce(_total(three), _total(two))
