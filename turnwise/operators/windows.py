"""Analysis windows over turns, word context, and the texts made of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turnwise.functions.clock import hms
from turnwise.plans.asof import lookup
from turnwise.plans.bands import band_join
from turnwise.plans.blocks import by_time, neighbours, running
from turnwise.plans.cut import join_per_key
from turnwise.schema import KEY


def turn_line(start: str = "start") -> Column:
    """`[H:MM:SS] speaker: text`."""
    return F.concat(F.lit("["), hms(F.col(start), pad_hours=False), F.lit("] "), F.col("speaker"),
                    F.lit(": "), F.col("text"))


def ordered_text(order: list[str], line: Column, glue: str = "\n") -> Column:
    """Aggregate: lines in order, glued to one text."""
    rows = F.array_sort(F.collect_list(F.struct(*order, line.alias("_line"))))
    return F.array_join(F.transform(rows, lambda r: r["_line"]), glue)


def stream_bounds(turns: DataFrame) -> DataFrame:
    """Start of the first and end of the last turn."""
    return turns.groupBy(*KEY).agg(F.min_by("start", "idx").alias("_s0"), F.max_by("end", "idx").alias("_s1"))


def sliding_windows(turns: DataFrame, *, size: float, hop: float, from_zero: bool = False,
                    closed: bool = False) -> DataFrame:
    """Windows [w, w + size) (closed: both ends count) every `hop` seconds, from the first turn
    or from zero, as long as they start before the stream ends. Windows without turns get no
    number, so window ids are dense. A turn finds its windows by arithmetic, one more at either end, and those count whose
    ends it keeps to: a quotient of floats may fall on the other side of a window's end.
    """
    rows = join_per_key(turns, stream_bounds(turns), KEY, [*KEY, "idx"])
    anchor = F.lit(0.0) if from_zero else F.col("_s0")
    past = F.col("start") - anchor
    low = F.greatest(F.floor((past - size) / hop) - 1, F.lit(0))
    rows = (rows.withColumn("_low", low).withColumn("_high", F.floor(past / hop) + 1)
            .filter(F.col("_low") <= F.col("_high"))
            .withColumn("_k", F.explode(F.sequence("_low", "_high")))
            .withColumn("w_start", anchor + F.col("_k") * hop)
            .withColumn("w_end", F.least(F.col("w_start") + size, F.col("_s1")))
            .filter((F.col("w_start") < F.col("_s1")) & (F.col("w_start") <= F.col("start"))))
    rows = rows.filter(F.col("start") <= F.col("w_end") if closed else F.col("start") < F.col("w_start") + size)
    found = (rows.groupBy(*KEY, "_k")
             .agg(F.min("w_start").alias("w_start"), F.min("w_end").alias("w_end"),
                  F.count(F.lit(1)).alias("turns"), ordered_text(["idx"], turn_line()).alias("text")))
    number = F.row_number().over(Window.partitionBy(*KEY).orderBy("_k"))
    return found.withColumn("window_id", (number - 1).cast("long")).drop("_k")


def chunk_spans(convs: DataFrame, *, conv_id: str, whole_up_to: float = 1200.0, size: float = 600.0,
                overlap: float = 120.0) -> DataFrame:
    """Spans to read a conversation in: all of it if short, else overlapping chunks."""
    hop = size - overlap
    long = F.col("end") - F.col("start") > whole_up_to
    # Chunks start at start + k * hop for every k that lies before the end.
    last = F.when(long, F.ceil((F.col("end") - F.col("start")) / hop) - 1).otherwise(F.lit(0))
    return (convs.select(*KEY, conv_id, "start", "end", long.alias("_long"),
                         F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("chunk"))
            .withColumn("lo", F.col("start") + F.col("chunk") * hop)
            .withColumn("hi", F.when(F.col("_long"), F.least(F.col("lo") + size, F.col("end")))
                        .otherwise(F.col("end")))
            .select(*KEY, conv_id, "chunk", "lo", "hi"))


def span_texts(spans: DataFrame, turns: DataFrame, *, span_id: list[str], width: float = 600.0,
               min_chars: int = 0) -> DataFrame:
    """Text of the turns that start in [lo, hi]; spans with less than `min_chars` are skipped."""
    side = turns.select(*KEY, F.col("idx").alias("_idx"), F.col("start").alias("_t"),
                        turn_line().alias("_text"))
    met = band_join(spans, side, KEY, width, left_range=(F.col("lo"), F.col("hi")),
                    right_range=(F.col("_t"), F.col("_t")))
    out = (met.groupBy(*KEY, *span_id)
           .agg(F.min("lo").alias("lo"), F.min("hi").alias("hi"), F.count(F.lit(1)).alias("turns"),
                ordered_text(["_idx"], F.col("_text")).alias("text")))
    return out.filter(F.length("text") >= min_chars)


def tumbling_chunks(turns: DataFrame, *, size: float = 300.0, batch: int = 3) -> DataFrame:
    """Chunks [c, c + size) from the first turn on, the last cut at the end; chunks without
    turns fall away and every `batch` of the rest form a batch."""
    rows = join_per_key(turns, stream_bounds(turns), KEY, [*KEY, "idx"])
    found = (rows.filter(F.col("start") < F.col("_s1"))
             .withColumn("_k", F.floor((F.col("start") - F.col("_s0")) / size))
             .groupBy(*KEY, "_k")
             .agg(F.min(F.col("_s0") + F.col("_k") * size).alias("c_start"),
                  F.min(F.least(F.col("_s0") + (F.col("_k") + 1) * size, F.col("_s1"))).alias("c_end"),
                  F.count(F.lit(1)).alias("turns"), ordered_text(["idx"], turn_line()).alias("text")))
    rank = F.row_number().over(Window.partitionBy(*KEY).orderBy("_k"))
    return (found.withColumn("chunk_no", (rank - 1).cast("long"))
            .withColumn("batch_no", F.floor(F.col("chunk_no") / batch)).drop("_k"))


def word_context(words: DataFrame, spots: DataFrame, *, spot_id: str, size: int = 30) -> DataFrame:
    """Up to `size` words before and after a match (first_pos .. last_pos), joined by blanks."""
    asked = spots.select(*KEY, spot_id, "first_pos", "last_pos")
    near = band_join(asked, words.select(*KEY, F.col("pos").alias("_pos"), F.col("text").alias("_word")),
                     KEY, 8 * size,
                     left_range=(F.col("first_pos") - size, F.col("last_pos") + size),
                     right_range=(F.col("_pos"), F.col("_pos")))
    before, after = F.col("_pos") < F.col("first_pos"), F.col("_pos") > F.col("last_pos")
    def side(keep: Column) -> Column:
        rows = F.array_sort(F.collect_list(F.when(keep, F.struct("_pos", "_word"))))
        return F.array_join(F.transform(rows, lambda r: r["_word"]), " ")
    texts = near.groupBy(*KEY, spot_id).agg(side(before).alias("context_before"),
                                            side(after).alias("context_after"))
    return spots.join(texts, [*KEY, spot_id], "left")


def char_offsets(words: DataFrame, *, block: Column) -> DataFrame:
    """Where each word begins and ends in the running text of its stream (one blank between)."""
    rows = running(words, KEY, ["pos"], block, sums={"_upto": F.length("text").cast("long") + 1})
    return (rows.withColumn("char_end", F.col("_upto") - 1)
            .withColumn("char_start", F.col("char_end") - F.length("text")).drop("_upto"))


def frame_pairs(frames: DataFrame, *, interval: float, block: Column) -> DataFrame:
    """Every frame with the one after it; the pair's time is that of the later frame."""
    numbered = running(frames, KEY, ["time"], block, sums={"_n": F.lit(1).cast("long")})
    pairs = neighbours(numbered, KEY, ["time"], block, after={"next_time": F.col("time")})
    return (pairs.filter(F.col("next_time").isNotNull())
            .withColumn("pair_no", F.col("_n") - 1)
            .withColumn("event_time", F.col("_n") * interval).drop("_n"))


def sentence_boundary(points: DataFrame, words: DataFrame, *, point_id: str, time: str,
                      direction: str = "before", block_seconds: float = 3600.0) -> DataFrame:
    """End of the last finished sentence at or before a time, or of the first one that ends with
    a word starting at or after it; without one the start of the first (end of the last) word,
    0 for a stream without words."""
    closing = words.filter(F.right("text", F.lit(1)).isin(".", "?", "!"))
    asked = points.select(*KEY, point_id, F.col(time).alias("_ask"))
    if direction == "before":
        hits = closing.select(*KEY, F.col("end").alias("b_at"), F.col("end").alias("b_end"),
                              F.col("pos").alias("b_pos"))
        found = lookup(asked, hits, KEY, left_time=F.col("_ask"), right_time=F.col("b_at"),
                       left_id=[point_id], right_tie=["b_pos"], direction="before",
                       block_seconds=block_seconds)
        value = F.col("found_before.b_end")
        rest = words.groupBy(*KEY).agg(F.min_by("start", "pos").alias("_rest"))
    else:
        hits = closing.select(*KEY, F.col("start").alias("b_at"), F.col("end").alias("b_end"),
                              F.col("pos").alias("b_pos"))
        found = lookup(asked, hits, KEY, left_time=F.col("_ask"), right_time=F.col("b_at"),
                       left_id=[point_id], right_tie=["b_pos"], direction="after",
                       block_seconds=block_seconds)
        value = F.col("found_after.b_end")
        rest = words.groupBy(*KEY).agg(F.max_by("end", "pos").alias("_rest"))
    found = found.select(*KEY, point_id, value.alias("_hit"))
    return (points.join(found, [*KEY, point_id]).join(rest, KEY, "left")
            .withColumn("boundary", F.coalesce("_hit", "_rest", F.lit(0.0))).drop("_hit", "_rest"))


def with_context(clips: DataFrame, turns: DataFrame, *, clip_id: str, seconds: float = 120.0,
                 slack: float = 2.0, width: float = 300.0) -> DataFrame:
    """Turns before (over before the clip starts), inside (end at most `slack` late) and after."""
    side = turns.select(*KEY, F.col("idx").alias("_idx"), F.col("start").alias("_t"),
                        F.col("end").alias("_te"), turn_line().alias("_text"))
    asked = clips.select(*KEY, clip_id, F.col("start").alias("_lo"), F.col("end").alias("_hi"))
    met = band_join(asked, side, KEY, width,
                    left_range=(F.greatest(F.lit(0.0), F.col("_lo") - seconds), F.col("_hi") + seconds),
                    right_range=(F.col("_t"), F.col("_t")))
    part = {"before": F.col("_te") < F.col("_lo"),
            "inside": (F.col("_t") >= F.col("_lo")) & (F.col("_te") <= F.col("_hi") + slack),
            "after": (F.col("_t") > F.col("_hi")) & (F.col("_t") < F.col("_hi") + seconds)}
    def text(keep: Column) -> Column:
        rows = F.array_sort(F.collect_list(F.when(keep, F.struct("_idx", "_text"))))
        return F.array_join(F.transform(rows, lambda r: r["_text"]), "\n")
    texts = met.groupBy(*KEY, clip_id).agg(*[text(c).alias(f"text_{n}") for n, c in part.items()])
    return clips.join(texts, [*KEY, clip_id], "left")


def budget_text(text: Column, limit: int, marker: str = "\n[... truncated ...]") -> Column:
    return F.when(F.length(text) > limit, F.concat(F.substring(text, 1, limit), F.lit(marker))).otherwise(text)


def build_context(windows: DataFrame, topics: DataFrame, *, query: str | None = None) -> DataFrame:
    """One text per window: its turn lines, the topic blocks of the stream that touch it, the
    topics that come back, and the request.

    topics: stream_id, topic_id, topic_name, t_start, t_end, sentiment
    """
    stamp = F.concat(F.lit("["), hms(F.col("t_start"), False), F.lit("-"), hms(F.col("t_end"), False), F.lit("]"))
    line = F.concat(F.lit("- "), stamp, F.lit(" "), F.col("topic_name"), F.lit(" ("), F.col("topic_id"),
                    F.lit(") ["), F.col("sentiment"), F.lit("]"))
    near = band_join(windows.select(*KEY, "window_id", "w_start", "w_end"),
                     topics.withColumn("_line", line).withColumn("_stamp", stamp), KEY, 600.0,
                     left_range=(F.col("w_start"), F.col("w_end")),
                     right_range=(F.col("t_start"), F.col("t_end")))
    listed = near.groupBy(*KEY, "window_id").agg(
        ordered_text(["t_start", "topic_id"], F.col("_line")).alias("_topics"))
    again = (near.groupBy(*KEY, "window_id", "topic_id")
             .agg(F.count(F.lit(1)).alias("_n"), ordered_text(["t_start"], F.col("_stamp"), " AND ").alias("_r"))
             .filter("_n >= 2").groupBy(*KEY, "window_id")
             .agg(ordered_text(["topic_id"], F.concat(F.lit("- "), F.col("topic_id"), F.lit(": "), F.col("_r")))
                  .alias("_again")))
    parts = [F.concat(F.lit("TOPICS\n"), F.coalesce("_topics", F.lit("(none)"))),
             F.concat(F.lit("RETURNING\n"), F.col("_again")),
             F.concat(F.lit("REQUEST\n"), F.lit(query)) if query else F.lit(None).cast("string"),
             F.concat(F.lit("TURNS\n"), F.col("text"))]
    return (windows.join(listed, [*KEY, "window_id"], "left").join(again, [*KEY, "window_id"], "left")
            .select(*KEY, "window_id", F.concat_ws("\n\n", *parts).alias("context")))
