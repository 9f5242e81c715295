"""Model answers as data: typed rows out of raw text, and a scorer the user supplies."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Text between two fence lines; a fence line begins with three backticks and may name a language.
FENCE = r"(?ms)^[ \t]*```[^`\n]*$\n(.*?)^[ \t]*```"


def json_part(text: Column) -> Column:
    """The JSON in an answer: the whole text, else a fenced block, else all from the first `{` to the
    last `}`, else from the first `[` to the last `]`; null if none of them parses."""
    # The parser stops at the end of a first value. Inside brackets, a text of more than one value
    # shows: it makes a list of two.
    def single(t: Column) -> Column:
        listed = F.try_variant_get(F.try_parse_json(F.concat(F.lit("["), t, F.lit("]"))), "$", "array<variant>")
        return F.size(listed) == 1
    # One form is tried after the other; what comes later is not even cut out where an earlier one parses.
    whole = F.trim(text)
    fenced = F.get(F.filter(F.transform(F.regexp_extract_all(text, F.lit(FENCE), F.lit(1)), lambda t: F.trim(t)), single), 0)
    cuts = [F.get(F.filter(F.regexp_extract_all(text, F.lit(p), F.lit(0)), single), 0) for p in (r"\{[\s\S]*\}", r"\[[\s\S]*\]")]
    return F.coalesce(F.when(single(whole), whole), F.when(F.contains(text, F.lit("```")), fenced), *cuts)


def parse_responses(answers: DataFrame, schema: str, *, text: str = "answer") -> tuple[DataFrame, DataFrame]:
    """Answers -> (typed rows, rejects). Every answer is in one of them.

    An object is a row; a list gives a row for each object in it, numbered by its place. An answer without an object,
    be it no JSON, a number, a string, null or a list without objects, is a reject: it keeps its text and a `reason`.
    """
    # Generated columns are worked out once: filters that read them are not moved below, which would parse the text again.
    found = answers.select("*", F.inline(F.array(F.struct(json_part(F.col(text)).alias("_json")))))
    value = F.try_parse_json("_json")
    listed = F.coalesce(F.try_variant_get(value, "$", "array<variant>"), F.array(value))
    numbered = F.transform(listed, lambda v, i: F.struct(i.alias("no"), v.alias("v")))
    objects = F.filter(numbered, lambda x: F.schema_of_variant(x["v"]).startswith("OBJECT"))
    found = found.select("*", F.inline(F.array(F.struct(F.transform(objects, lambda x: F.struct(
        x["no"].alias("item_no"), F.to_json(x["v"]).alias("_text"))).alias("_objects")))))
    empty = F.coalesce(F.size("_objects"), F.lit(0)) <= 0
    rows = (found.select(*[c for c in answers.columns if c != text], F.inline("_objects"))
            .withColumn("_item", F.from_json("_text", f"struct<{schema}>")).select("*", "_item.*").drop("_item", "_text"))
    reason = F.when(F.col("_json").isNull(), "no JSON").otherwise("no object")
    return rows, found.filter(empty).withColumn("reason", reason).drop("_json", "_objects")


def score_windows(windows: DataFrame, fn: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """Run a user's scorer over windows, a batch of rows at a time. Put cheap filters before this
    call: none is moved across it. The size of a batch is
    `spark.sql.execution.arrow.maxRecordsPerBatch`."""
    def batches(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            yield fn(pdf)
    return windows.mapInPandas(batches, schema)
