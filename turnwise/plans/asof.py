"""Nearest and as-of lookups: both sides in one ordered stream, no range blow-up."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnwise.plans.blocks import by_time, running


def _merged(left: DataFrame, right: DataFrame, keys: list[str], left_time: Column,
            right_time: Column, right_tie: list[str]) -> tuple[DataFrame, DataFrame]:
    hit = F.struct(right_time.alias("_t"), *[F.col(c) for c in right.columns if c not in keys])
    rows = right.select(*keys, right_time.cast("double").alias("_time"),
                        F.struct(*right_tie).alias("_tie"), hit.alias("_hit"))
    # Of rows at one time the first by tie order is the one to find.
    points = (rows.groupBy(*keys, "_time").agg(F.min_by("_hit", "_tie").alias("_hit"))
              .withColumn("_side", F.lit(0)))
    asks = left.withColumn("_time", left_time.cast("double")).withColumn("_side", F.lit(1))
    return points, asks


def lookup(left: DataFrame, right: DataFrame, keys: list[str], *, left_time: Column,
           right_time: Column, left_id: list[str], right_tie: list[str],
           direction: str, block_seconds: float = 3600.0) -> DataFrame:
    """Left rows with struct columns of the latest right row at or before the time
    (`found_before`) and / or the earliest at or after it (`found_after`).

    direction: "before", "after" or "both". `left_id` makes left rows of equal time distinct.
    """
    points, asks = _merged(left, right, keys, left_time, right_time, right_tie)
    both = asks.unionByName(points, allowMissingColumns=True)
    # Right rows sort before left rows of the same time, so an equal time is found looking back;
    # looking ahead it is taken from there.
    ahead = {} if direction == "before" else {"_next": F.col("_hit")}
    both = running(both, keys, ["_time", "_side", *left_id], by_time("_time", block_seconds),
                   fill={"_last": F.col("_hit")}, fill_back=ahead)
    both = both.filter("_side = 1")
    if direction in ("before", "both"):
        both = both.withColumn("found_before", F.col("_last"))
    if direction in ("after", "both"):
        both = both.withColumn("found_after", F.when(F.col("_last._t") == F.col("_time"), F.col("_last"))
                               .otherwise(F.col("_next")))
    return both.drop("_side", "_time", "_hit", "_last", "_next")


def nearest(left: DataFrame, right: DataFrame, keys: list[str], *, left_time: Column,
            right_time: Column, left_id: list[str], right_tie: list[str],
            max_distance: float | None = None, block_seconds: float = 3600.0) -> DataFrame:
    """Left rows with `found` (closest right row, earlier one on a tie) and `distance`."""
    rows = lookup(left, right, keys, left_time=left_time, right_time=right_time,
                  left_id=left_id, right_tie=right_tie, direction="both",
                  block_seconds=block_seconds)
    behind = left_time - F.col("found_before._t")
    ahead = F.col("found_after._t") - left_time
    use_ahead = behind.isNull() | (ahead < behind)
    rows = (rows.withColumn("found", F.when(use_ahead, F.col("found_after"))
                            .otherwise(F.col("found_before")))
            .withColumn("distance", F.abs(F.col("found._t") - left_time))
            .drop("found_before", "found_after"))
    if max_distance is not None:
        near = F.col("distance") <= max_distance
        rows = (rows.withColumn("found", F.when(near, F.col("found")))
                .withColumn("distance", F.when(near, F.col("distance"))))
    return rows
