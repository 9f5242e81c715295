"""Joins on overlapping ranges, planned as equi-joins on (key, time bucket)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def band_join(left: DataFrame, right: DataFrame, keys: list[str], width: float, *,
              left_range: tuple[Column, Column], right_range: tuple[Column, Column],
              condition: Column | None = None, salts: int = 1) -> DataFrame:
    """Inner join of rows whose closed ranges meet, both sides keyed by `keys`.

    Each side is spread over the buckets its range touches; a pair that shares several buckets
    is kept in the later of the two first ones, so it comes out once. `width` should be some
    times the usual length of the longer side: an interval costs length / width + 1 rows.
    A crowded stream falls apart into buckets; a single crowded bucket is left to the
    skew-join rule of adaptive execution, or split with `salts` (left rows are dealt out, the
    right side of a bucket is repeated `salts` times, results stay the same).
    Columns of the right side must not share names with the left, apart from `keys`.
    """
    lo_l, hi_l = left_range
    lo_r, hi_r = right_range
    # A range that runs backwards meets nothing, but its row must not break `sequence`.
    a = (left.withColumn("_lo_l", lo_l).withColumn("_hi_l", hi_l)
         .filter(F.col("_lo_l") <= F.col("_hi_l"))
         .withColumn("_first_l", F.floor(F.col("_lo_l") / width))
         .withColumn("_bucket", F.explode(F.sequence(
             F.col("_first_l"), F.floor(F.col("_hi_l") / width)))))
    b = (right.withColumn("_lo_r", lo_r).withColumn("_hi_r", hi_r)
         .filter(F.col("_lo_r") <= F.col("_hi_r"))
         .withColumn("_first_r", F.floor(F.col("_lo_r") / width))
         .withColumn("_bucket", F.explode(F.sequence(
             F.col("_first_r"), F.floor(F.col("_hi_r") / width)))))
    on = [*keys, "_bucket"]
    if salts > 1:
        a = a.withColumn("_salt", F.pmod(F.xxhash64("_lo_l", "_hi_l"), F.lit(salts)))
        b = b.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"),
                                                       F.lit(salts - 1).cast("long"))))
        on.append("_salt")
    met = a.join(b, on).filter(
        (F.col("_lo_l") <= F.col("_hi_r")) & (F.col("_lo_r") <= F.col("_hi_l"))
        & (F.col("_bucket") == F.greatest("_first_l", "_first_r")))
    if condition is not None:
        met = met.filter(condition)
    return met.drop("_lo_l", "_hi_l", "_first_l", "_lo_r", "_hi_r", "_first_r", "_bucket", "_salt")
