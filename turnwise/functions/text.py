"""Text columns: tokens, normal form, word-set similarity."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def tokens(text: Column) -> Column:
    """Whitespace tokens. `\\S+` is the one definition of a word in this package."""
    return F.regexp_extract_all(text, F.lit(r"\S+"), F.lit(0))


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"\S+"))


def normalize(text: Column) -> Column:
    """Lower case, every run of whitespace one blank, no blanks at the ends."""
    return F.trim(F.regexp_replace(F.lower(text), r"\s+", " "))


def word_set(text: Column) -> Column:
    return F.array_distinct(tokens(F.lower(text)))


def overlap_coefficient(a: Column, b: Column) -> Column:
    """|A n B| / min(|A|, |B|) of two arrays without repeats, 0 if one is empty."""
    small = F.least(F.size(a), F.size(b))
    return F.when(small > 0, F.size(F.array_intersect(a, b)) / small).otherwise(F.lit(0.0))


def topic_words(name: Column, stop: list[str]) -> Column:
    """Words of a topic name or id, split on blanks, `_` and `-`, without stop words."""
    parts = F.split(F.lower(name), r"[_\s-]+")
    kept = F.filter(F.array_distinct(parts), lambda w: w != "")
    return F.array_except(kept, F.array(*[F.lit(w) for w in stop]).cast("array<string>"))


def label_role(speaker: Column, hosts: list[str]) -> Column:
    """host / unknown / guest from a raw speaker label."""
    low = F.lower(F.coalesce(speaker, F.lit("")))
    return (F.when(low.isin([h.lower() for h in hosts]), "host")
            .when(low.isin("unknown", "unidentified", ""), "unknown")
            .otherwise("guest"))
