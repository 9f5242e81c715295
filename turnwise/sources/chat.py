"""Turns and words from chat logs, on a clock of 0.3 s per word."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnwise.functions.text import tokens, word_count
from turnwise.plans.blocks import by_position, running
from turnwise.schema import KEY, SECONDS_PER_WORD


def turns_from_chat(chat: DataFrame, *, stream: str = "conv_id", turn: str = "turn",
                    speaker: Column | None = None) -> DataFrame:
    """conversations -> turns with start and end on the word clock of their stream."""
    rows = chat.select(F.col(stream).alias("stream_id"), F.col(turn).alias("idx"),
                       (F.col("role") if speaker is None else speaker).alias("speaker"),
                       "text", word_count(F.col("text")).alias("word_count"))
    rows = running(rows, KEY, ["idx"], by_position("idx", 10_000),
                   sums={"_said": F.col("word_count").cast("long")})
    return (rows.withColumn("start", (F.col("_said") - F.col("word_count")) * SECONDS_PER_WORD)
            .withColumn("end", F.col("_said") * SECONDS_PER_WORD).drop("_said"))


def words_from_turns(turns: DataFrame) -> DataFrame:
    """Turns -> words. `pos` counts the words of a stream, starts lie 0.3 s apart."""
    first = F.round(F.col("start") / SECONDS_PER_WORD).cast("long")
    return (turns.select("stream_id", "idx", "speaker", first.alias("_first"),
                         F.posexplode(tokens(F.col("text"))).alias("_i", "text"))
            .withColumn("pos", F.col("_first") + F.col("_i"))
            .select("stream_id", "idx", "pos", "text",
                    (F.col("pos") * SECONDS_PER_WORD).alias("start"),
                    ((F.col("pos") + 1) * SECONDS_PER_WORD).alias("end"), "speaker"))
