"""Who speaks when: interval joins between words and segments, and speaker figures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnwise.plans.asof import lookup
from turnwise.plans.bands import band_join
from turnwise.plans.blocks import by_time, neighbours, running
from turnwise.plans.cut import cut
from turnwise.schema import KEY


def _steps(segs: DataFrame, block: float) -> DataFrame:
    """The segments (`_ss` to `_se`) that end after all before them in the order of start and seg_pos, numbered by `_r`.

    Any other one lies within an earlier segment, so it is neither the first at a point nor the one a range overlaps
    most. From step to step starts never fall and ends rise, which leaves lookups to do instead of pairs.
    """
    order = ["_ss", "seg_pos"]
    tops = running(segs.dropna(subset=KEY), KEY, order, by_time("_ss", block), peaks={"_top": F.col("_se")})
    steps = tops.filter(F.col("_top").isNull() | (F.col("_se") > F.col("_top"))).drop("_top")
    return running(steps, KEY, order, by_time("_ss", block), sums={"_r": F.lit(1).cast("long")})


def _longest_steps(asked: DataFrame, steps: DataFrame) -> DataFrame:
    """The longest of the steps `_from` to `_to` (the first of equals) for each row of `asked`, as `_inner`.

    Steps are put together two by two, level by level, and a range reads at most two nodes of a level.
    """
    asked = cut(asked.distinct())
    height = F.floor(F.log2(F.col("_to") - F.col("_from") + 1)).cast("int")
    top = asked.agg(F.max(height)).first()[0] or 0
    step = F.struct((F.col("_se") - F.col("_ss")).alias("long"), (-F.col("_r")).alias("first"), "_r", "_ss", "_se", "seg_speaker")
    nodes = (steps.withColumn("_level", F.explode(F.sequence(F.lit(0), F.lit(top))))
             .groupBy(*KEY, "_level", F.expr("shiftright(_r, _level)").alias("_node")).agg(F.max(step).alias("_inner")))
    ends = (asked.withColumn("_level", F.explode(F.sequence(F.lit(0), height)))
            .withColumn("_lo", F.expr("shiftright(_from + shiftleft(1L, _level) - 1, _level)"))
            .withColumn("_hi", F.expr("shiftright(_to + 1, _level)")).filter("_lo < _hi"))
    sides = F.array(F.when(F.col("_lo") % 2 == 1, F.col("_lo")), F.when(F.col("_hi") % 2 == 1, F.col("_hi") - 1))
    return (ends.withColumn("_node", F.explode(F.array_compact(sides))).join(nodes, [*KEY, "_level", "_node"])
            .groupBy(*KEY, "_from", "_to").agg(F.max("_inner").alias("_inner")))


def assign_speaker(words: DataFrame, segs: DataFrame, *, offset: float = 0.0, width: float = 120.0,
                   word_id: str = "pos", salts: int = 1) -> DataFrame:
    """Give every word the speaker of the segment it overlaps most (ties: earliest segment).

    A word that overlaps none, so every word without length, keeps `fallback_<speaker>`.
    Segments: seg_pos, seg_speaker, seg_start, seg_end; `offset` shifts them first.

    No pairs of word and segment are formed, however many segments overlap: a word looks up the last step (`_steps`) that has
    begun when it begins, and the first that lasts to its end. If that one has begun too, it covers the word; else
    the steps between the two lie inside the word, and the longest counts. Work is done in blocks of `width`
    seconds; `salts` changes nothing any more.
    """
    s = segs.select(*KEY, "seg_pos", "seg_speaker", (F.col("seg_start") + offset).alias("_ss"),
                    (F.col("seg_end") + offset).alias("_se")).filter("_ss < _se")
    steps = cut(_steps(s, width).select(*KEY, "_r", "_ss", "_se", "seg_speaker", (-F.col("_r")).alias("_late")))
    rows = words.withColumns({"_ws": F.col("start"), "_we": F.coalesce(F.col("end"), F.col("start") + 0.1)})
    rows = lookup(rows, steps, KEY, left_time=F.col("_ws"), right_time=F.col("_ss"), left_id=[word_id],
                  right_tie=["_late"], direction="before", block_seconds=width)
    rows = lookup(rows, steps, KEY, left_time=F.col("_we"), right_time=F.col("_se"), left_id=[word_id],
                  right_tie=["_r"], direction="after", block_seconds=width)
    count = steps.groupBy(*KEY).agg(F.max("_r").alias("_steps"))
    rows = (rows.join(count, KEY, "left")
            .withColumn("_from", F.coalesce("found_before._r", F.lit(0)) + 1)
            .withColumn("_to", F.coalesce(F.col("found_after._r") - 1, "_steps")))
    rows = cut(rows.withColumn("_open", F.coalesce((F.col("_ws") < F.col("_we")) & (F.col("_from") <= F.col("_to")), F.lit(False))))

    asking = rows.filter("_open")
    inner = _longest_steps(asking.select(*KEY, "_from", "_to"), steps)
    kind = dict(inner.dtypes)["_inner"]
    rows = (rows.filter("NOT _open").withColumn("_inner", F.lit(None).cast(kind))
            .unionByName(asking.join(inner, [*KEY, "_from", "_to"], "left")))

    def offer(step: str) -> Column:
        overlap = F.least("_we", f"{step}._se") - F.greatest("_ws", f"{step}._ss")
        known = F.col(f"{step}._r").isNotNull() & (F.col("_ws") < F.col("_we"))
        return F.when(known & (overlap > 0), F.struct(overlap.alias("overlap"), (-F.col(f"{step}._r")).alias("first"),
                                                      F.col(f"{step}.seg_speaker").alias("named")))
    named = F.greatest(offer("found_before"), offer("found_after"), offer("_inner"))["named"]
    fallback = F.concat(F.lit("fallback_"), F.coalesce(F.col("speaker"), F.lit("unknown")))
    return (rows.withColumn("_named", named).withColumn("matched", F.col("_named").isNotNull())
            .withColumn("speaker_name", F.coalesce("_named", fallback)).select(*words.columns, "matched", "speaker_name"))


def speaker_at(points: DataFrame, segs: DataFrame, *, point_id: str, time: str,
               width: float = 120.0) -> DataFrame:
    """Segment speaker at a time: both ends count, the first segment in start order wins.

    That is the first step (`_steps`) that ends then or later, if it has begun. No pairs of point and segment are formed.
    """
    s = segs.select(*KEY, "seg_pos", "seg_speaker", F.col("seg_start").alias("_ss"), F.col("seg_end").alias("_se")).filter("_ss <= _se")
    steps = _steps(s, width).select(*KEY, "_r", "_ss", "_se", "seg_speaker")
    rows = lookup(points, steps, KEY, left_time=F.col(time), right_time=F.col("_se"), left_id=[point_id],
                  right_tie=["_r"], direction="after", block_seconds=width)
    begun = F.col("found_after._ss") <= F.col(time)
    return rows.withColumn("speaker_at", F.when(begun, F.col("found_after.seg_speaker"))).select(*points.columns, "speaker_at")


def talk_time_within(intervals: DataFrame, segs: DataFrame, *, interval_id: str, label: Column,
                     labels: list[str], lo: str = "start", hi: str = "end",
                     block_seconds: float = 3600.0) -> DataFrame:
    """Seconds each label talks inside an interval, segments clipped at its ends.

    What was said up to a time t is t * n - s, n the segments begun less those ended by then, s the
    sum of their starts less that of their ends. So two running totals over the marks of a stream
    answer every interval at its two ends: linear, and no pairs of interval and segment are formed.
    """
    marks = (segs.filter(F.col("seg_end") > F.col("seg_start"))
             .select(*KEY, label.alias("_label"), F.col("seg_pos").cast("long").alias("_id"), F.inline(F.array(
                 F.struct(F.col("seg_start").alias("_t"), F.lit(1.0).alias("_sign")),
                 F.struct(F.col("seg_end").alias("_t"), F.lit(-1.0).alias("_sign")))))
             .withColumn("_ask", F.lit(0)))
    asks = (intervals.select(*KEY, F.col(interval_id).cast("long").alias("_id"), F.inline(F.array(
        F.struct(F.col(lo).cast("double").alias("_t"), F.lit(-1.0).alias("_sign")),
        F.struct(F.col(hi).cast("double").alias("_t"), F.lit(1.0).alias("_sign")))))
        .withColumns({"_ask": F.lit(1), "_label": F.lit(None).cast("string")}))
    sums = {}
    for i, v in enumerate(labels):
        sums[f"_n{i}"] = F.when(F.col("_label") == v, F.col("_sign")).otherwise(0.0)
        sums[f"_s{i}"] = F.when(F.col("_label") == v, F.col("_sign") * F.col("_t")).otherwise(0.0)
    said = running(marks.unionByName(asks), KEY, ["_t", "_ask", "_id", "_sign"], by_time("_t", block_seconds), sums=sums)
    totals = said.filter("_ask = 1").groupBy(*KEY, F.col("_id").alias(interval_id)).agg(*[
        F.greatest(F.lit(0.0), F.sum(F.col("_sign") * (F.col("_t") * F.col(f"_n{i}") - F.col(f"_s{i}")))).alias(f"{v}_time")
        for i, v in enumerate(labels)])
    return intervals.join(totals, [*KEY, interval_id], "left").fillna(0.0, [f"{v}_time" for v in labels])


def name_speakers(rows: DataFrame, names: DataFrame) -> DataFrame:
    """Label -> name, the label itself where no name is known. `names`: stream_id, speaker, name."""
    return (rows.join(names, [*KEY, "speaker"], "left")
            .withColumn("speaker_name", F.coalesce("name", "speaker")).drop("name"))


def names_from_segments(segs: DataFrame, match: Column, order: list[str]) -> DataFrame:
    """First match that is not null per speaker, in stream order."""
    return (segs.withColumn("_m", match).filter(F.col("_m").isNotNull())
            .groupBy(*KEY, "speaker").agg(F.min_by("_m", F.struct(*order)).alias("name")))


def word_stats(words: DataFrame) -> DataFrame:
    """Words, spoken seconds, first start and end of the last word per speaker (null = 0)."""
    who = F.coalesce(F.col("speaker"), F.lit("0"))
    return (words.groupBy(*KEY, who.alias("speaker"))
            .agg(F.count(F.lit(1)).alias("word_count"),
                 F.sum(F.col("end") - F.col("start")).alias("total_time"),
                 F.min_by("start", "pos").alias("first_word"),
                 F.max_by("end", "pos").alias("last_word")))


def named_stats(words: DataFrame) -> DataFrame:
    return (words.groupBy(*KEY, "speaker_name")
            .agg(F.count(F.lit(1)).alias("word_count"), F.min("start").alias("first_word_time"),
                 F.max("start").alias("last_word_time")))


def talk_time(segs: DataFrame, role: Column) -> DataFrame:
    """Seconds of host, guests and unknown voices, and the end of the last segment."""
    span = F.col("seg_end") - F.col("seg_start")
    return segs.withColumn("_role", role).groupBy(*KEY).agg(
        *[F.sum(F.when(F.col("_role") == r, span).otherwise(0.0)).alias(f"{r}_time")
          for r in ("host", "guest", "unknown")],
        F.max("seg_end").alias("total_duration"))


def speaker_profiles(segs: DataFrame, names: DataFrame, hosts: list[str]) -> DataFrame:
    """First and last appearance, seconds, segments, type and confidence of every label."""
    label = F.col("seg_speaker")
    known = F.col("name").isNotNull()
    host = F.coalesce(F.lower("name").isin([h.lower() for h in hosts]), F.lit(False))
    return (segs.groupBy(*KEY, label.alias("speaker"))
            .agg(F.min("seg_start").alias("first_appearance"), F.max("seg_end").alias("last_appearance"),
                 F.sum(F.col("seg_end") - F.col("seg_start")).alias("total_duration"),
                 F.count(F.lit(1)).alias("segment_count"))
            .join(names, [*KEY, "speaker"], "left")
            .withColumn("speaker_type", F.when(host, "host").when(known, "panel").otherwise("unknown"))
            .withColumn("confidence", F.when(host, 0.95).when(known, 0.85).otherwise(0.7)))


def elect_host(words: DataFrame) -> DataFrame:
    """The speaker with the most words per stream; on a tie the one heard first."""
    return (words.groupBy(*KEY, "speaker")
            .agg(F.count(F.lit(1)).alias("_n"), F.min("pos").alias("_first"))
            .groupBy(*KEY)
            .agg(F.max_by("speaker", F.struct(F.col("_n"), -F.col("_first"))).alias("host"),
                 F.max("_n").alias("host_count")))


def host_alias(turns: DataFrame, is_host: Column, is_fallback: Column, *,
               window: int = 600, share: float = 0.6) -> DataFrame:
    """Streams whose most frequent fallback label is the host under another name.

    It is, if the stream has a host at all and the label turns up in more than `share` of the
    `window`-second windows of the stream.
    """
    per_label = (turns.filter(is_fallback).groupBy(*KEY, "speaker")
                 .agg(F.count(F.lit(1)).alias("_n"), F.min("idx").alias("_first"),
                      F.count_distinct(F.floor(F.col("start") / window)).alias("present"))
                 .groupBy(*KEY)
                 .agg(F.max_by(F.struct("speaker", "present"),
                               F.struct(F.col("_n"), -F.col("_first"))).alias("_top")))
    whole = turns.groupBy(*KEY).agg(F.count_if(is_host).alias("_hosts"),
                                    F.max_by("end", "idx").alias("_end"))
    return (whole.filter(F.col("_hosts") > 0).join(per_label, KEY)
            .withColumn("windows", F.ceil(F.col("_end").cast("long") / window))
            .select(*KEY, F.col("_top.speaker").alias("alias"), F.col("_top.present").alias("present"),
                    "windows")
            .filter(F.col("windows") > 0)
            .filter(F.col("present") / F.col("windows") > share))


def speaker_events(segs: DataFrame, *, block: Column | None = None) -> DataFrame:
    """First appearances and speaker changes, in stream order (the first row is no change)."""
    block = by_time("seg_start") if block is None else block
    linked = neighbours(segs, KEY, ["seg_start", "seg_pos"], block,
                        before={"_who": F.col("seg_speaker")})
    firsts = (segs.groupBy(*KEY, F.col("seg_speaker").alias("speaker"))
              .agg(F.min(F.struct("seg_start", "seg_pos")).alias("_at"))
              .select(*KEY, F.col("_at.seg_start").alias("time"), F.col("_at.seg_pos").alias("pos"),
                      F.lit("first_appearance").alias("event_type"), "speaker",
                      F.lit(None).cast("string").alias("from_speaker")))
    changes = (linked.filter(F.col("_who") != F.col("seg_speaker"))
               .select(*KEY, F.col("seg_start").alias("time"), F.col("seg_pos").alias("pos"),
                       F.lit("speaking_start").alias("event_type"),
                       F.col("seg_speaker").alias("speaker"), F.col("_who").alias("from_speaker")))
    return firsts.unionByName(changes)


def speaker_timeline(events: DataFrame, profiles: DataFrame) -> DataFrame:
    return events.join(profiles.select(*KEY, "speaker", "speaker_type", "confidence"),
                       [*KEY, "speaker"], "left")


def alignment(words: DataFrame) -> DataFrame:
    return words.groupBy(*KEY).agg(F.count_if("matched").alias("matched_words"),
                                   F.count_if(~F.col("matched")).alias("unmatched_words"))


def cross_validate(firsts: DataFrame, visuals: DataFrame, cues: DataFrame, *, hosts: list[str],
                   visual_window: float = 60.0, cue_window: float = 30.0) -> DataFrame:
    """Check first appearances against sights and spoken cues near them.

    firsts   event_id, time, speaker, speaker_type, confidence
    visuals  v_pos, v_time (new persons only)     cues  c_pos, c_time, c_phrase (intro, welcome)
    Of the signals inside the window the first in input order counts, not the nearest.
    """
    ask = firsts.filter(~F.col("speaker").isin(hosts))
    def first_near(other: DataFrame, pos: str, at: str, window: float, keep: list[str]) -> DataFrame:
        near = band_join(ask.select(*KEY, "event_id", F.col("time").alias("_t")), other, KEY,
                         2 * window, left_range=(F.col("_t") - window, F.col("_t") + window),
                         right_range=(F.col(at), F.col(at)),
                         condition=F.abs(F.col(at) - F.col("_t")) <= window)
        return near.groupBy(*KEY, "event_id").agg(F.min_by(F.struct(*keep), pos).alias(f"_{pos}"))
    out = (ask.join(first_near(visuals, "v_pos", "v_time", visual_window, ["v_time"]),
                    [*KEY, "event_id"], "left")
           .join(first_near(cues, "c_pos", "c_time", cue_window, ["c_time", "c_phrase"]),
                 [*KEY, "event_id"], "left"))
    seen, heard = F.col("_v_pos").isNotNull(), F.col("_c_pos").isNotNull()
    return out.select(
        *KEY, "event_id", "time", "speaker",
        F.col("_v_pos.v_time").alias("visual_time"),
        (1 - F.abs(F.col("_v_pos.v_time") - F.col("time")) / visual_window).alias("visual_correlation"),
        F.col("_c_pos.c_phrase").alias("cue_phrase"),
        (1 - F.abs(F.col("_c_pos.c_time") - F.col("time")) / cue_window).alias("cue_correlation"),
        F.when(seen & heard, "triple_confirmed").when(seen | heard, "double_confirmed")
        .otherwise("voice_only").alias("validation"),
        F.when(seen & heard, F.least(F.lit(1.0), F.col("confidence") + 0.2))
        .when(seen | heard, F.least(F.lit(1.0), F.col("confidence") + 0.1))
        .otherwise(F.col("confidence") * 0.8).alias("final_confidence"),
        F.coalesce(F.col("speaker_type").isin("unknown", "guest"), F.lit(False)).alias("likely_guest"))
