"""Pick clips: overlap pairs, suppression, merging, natural ends, caps, summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnwise.functions.text import overlap_coefficient, word_set
from turnwise.plans.bands import band_join
from turnwise.plans.blocks import by_time, neighbours
from turnwise.plans.folds import fold_kept, suppress
from turnwise.schema import KEY


def overlap_pairs(clips: DataFrame, *, clip_id: str, share: float = 0.3, width: float = 600.0,
                  keys: list[str] | None = None) -> DataFrame:
    """Ordered pairs in which the overlap is more than `share` of the first clip's own length."""
    keys = keys or KEY
    a = clips.select(*keys, F.col(clip_id).alias("a_id"), F.col("start").alias("_as"), F.col("end").alias("_ae"))
    b = clips.select(*keys, F.col(clip_id).alias("b_id"), F.col("start").alias("_bs"), F.col("end").alias("_be"))
    shared = F.least("_ae", "_be") - F.greatest("_as", "_bs")
    return (band_join(a, b, keys, width, left_range=(F.col("_as"), F.col("_ae")),
                      right_range=(F.col("_bs"), F.col("_be")),
                      condition=(F.col("a_id") != F.col("b_id")) & (shared > (F.col("_ae") - F.col("_as")) * share))
            .select(*keys, "a_id", "b_id", shared.alias("overlap")))


def drop_overlaps(clips: DataFrame, *, clip_id: str, score: str = "score", share: float = 0.3,
                  keys: list[str] | None = None, segments: Column | None = None, **tuning) -> DataFrame:
    """Greedy suppression by score; clips with several parts pass them as `segments`. Intervals
    that run backwards are turned down first."""
    if segments is None:
        segments = F.array(F.struct(F.col("start").cast("double").alias("start"), F.col("end").cast("double").alias("end")))
    sane = clips.filter(F.forall(segments, lambda s: s["end"] >= s["start"]))
    return suppress(sane, keys or KEY, segments=segments, score=F.col(score), tie=clip_id, share=share, **tuning)


def merge_events(events: DataFrame, *, within: float = 60.0, alike: float = 0.5) -> DataFrame:
    """Melt an event into the last kept one if it has its type, starts at most `within` seconds
    after it and describes alike; the first one's time stays, the higher confidence counts."""
    rows = events.withColumn("_words", word_set(F.col("description"))).withColumn("merged", F.lit(1).cast("long"))
    fields = ["pos", "time", "event_type", "description", "confidence", "_words", "merged"]
    return fold_kept(
        rows, KEY, ["time", "pos"], row={f: F.col(f) for f in fields},
        absorbs=lambda k, c: (k["event_type"] == c["event_type"]) & (c["time"] - k["time"] <= within)
        & (overlap_coefficient(k["_words"], c["_words"]) >= alike),
        merge=lambda k, c: {"confidence": F.greatest(k["confidence"], c["confidence"]),
                            "merged": k["merged"] + 1}).drop("_words")


def natural_ends(clips: DataFrame, words: DataFrame, *, clip_id: str, reach: float = 30.0,
                 width: float = 120.0, block: Column | None = None) -> DataFrame:
    """Move clips to where speakers change.

    Start: the latest change of speaker in [start - 30, start). End: the first pause over 1 s or
    change of speaker from max(anchor + 20, end - 10) on, plus 0.5 s. Below 45 s a clip is made 60 s
    long; it never goes past the last word. Clips without words near keep their ends.
    """
    block = by_time("start") if block is None else block
    linked = neighbours(words.select(*KEY, "pos", "start", "end", "speaker"), KEY, ["start", "pos"], block,
                        before={"_pw": F.col("speaker"), "_ps": F.col("start")},
                        after={"_nw": F.col("speaker"), "_ns": F.col("start")})
    side = linked.select(*KEY, F.col("pos").alias("_pos"), F.col("start").alias("_t"), F.col("end").alias("_te"),
                         F.col("speaker").alias("_who"), "_pw", "_ps", "_nw", "_ns")
    asked = clips.select(*KEY, clip_id, F.col("start").alias("_s"), F.col("end").alias("_e"), F.col("anchor").alias("_a"))
    near = band_join(asked, side, KEY, width, left_range=(F.col("_s") - reach, F.col("_e") + reach),
                     right_range=(F.col("_t"), F.col("_t")))
    opens = ((F.col("_t") < F.col("_s")) & (F.col("_ps") >= F.col("_s") - reach)
             & ~F.col("_pw").eqNullSafe(F.col("_who")))
    closes = ((F.col("_t") >= F.greatest(F.col("_a") + 20, F.col("_e") - 10)) & (F.col("_ns") <= F.col("_e") + reach)
              & ((F.col("_ns") - F.col("_te") > 1.0) | ~F.col("_nw").eqNullSafe(F.col("_who"))))
    found = near.groupBy(*KEY, clip_id).agg(
        F.max_by("_t", F.when(opens, F.struct("_t", "_pos"))).alias("_ns2"),
        F.min_by("_te", F.when(closes, F.struct("_t", "_pos"))).alias("_ne2"), F.lit(True).alias("_near"))
    last = words.groupBy(*KEY).agg(F.max_by("end", F.struct("start", "pos")).alias("_last"))
    start = F.coalesce("_ns2", "start")
    end = F.coalesce(F.col("_ne2") + 0.5, F.col("end"))
    return (clips.join(found, [*KEY, clip_id], "left").join(last, KEY, "left")
            .withColumn("new_start", start)
            .withColumn("new_end", F.when(F.col("_near").isNull(), F.col("end")).otherwise(
                F.least(F.when(end - start < 45, start + 60).otherwise(end), F.col("_last"))))
            .drop("_ns2", "_ne2", "_near", "_last"))


def clip_summary(clips: DataFrame, *, conv: str, kind: str, score: str) -> DataFrame:
    """Clips and mean score in all, per conversation and per kind (grouping sets)."""
    return (clips.groupingSets([[], [F.col(conv)], [F.col(kind)]], F.col(conv), F.col(kind))
            .agg(F.count(F.lit(1)).alias("clips"), F.coalesce(F.avg(score), F.lit(0.0)).alias("mean_score")))


def cut_summary(cuts: DataFrame) -> DataFrame:
    """Cuts that worked and failed, and the size of the files, per stream."""
    return cuts.groupBy(*KEY).agg(
        F.count(F.lit(1)).alias("total"), F.count_if(F.col("status") == "success").alias("successful"),
        F.count_if(F.col("status") == "failed").alias("failed"), F.sum("size_mb").alias("size_mb"))


def distinct_values(rows: DataFrame, value: Column, *, keys: list[str] | None = None, approximate: float | None = None) -> DataFrame:
    """How many different values each stream has: n. With `approximate`, a relative error, the count is an estimate
    from one sketch a stream, which moves no values; null values do not count."""
    keys = keys or KEY
    one = rows.select(*keys, value.alias("_v"))
    if approximate is not None:
        return one.groupBy(*keys).agg(F.approx_count_distinct("_v", approximate).alias("n"))
    return one.groupBy(*keys, "_v").agg(F.lit(1)).groupBy(*keys).agg(F.count("_v").alias("n"))
