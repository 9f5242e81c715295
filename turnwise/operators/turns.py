"""Turns out of words, runs out of turns, and the figures of a talk."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turnwise.plans.bands import band_join
from turnwise.plans.blocks import BLOCK, Agg, by_position, by_time, neighbours, runs
from turnwise.plans.cut import small
from turnwise.schema import KEY


def build_turns(words: DataFrame, *, max_pause: float = 2.0, order: tuple[str, ...] = ("pos",),
                block: Column | None = None, with_text: bool = True) -> DataFrame:
    """Words -> turns: a new turn on a change of speaker or a pause longer than `max_pause`
    between the end of the last word and the start of the next. A word without an end lasts
    0.1 s, one without a speaker counts as `unknown`.
    """
    who = F.coalesce(F.col("speaker"), F.lit("unknown"))
    end = F.coalesce(F.col("end"), F.col("start") + 0.1)
    aggs = {"speaker": Agg("first", who), "start": Agg("first", F.col("start")),
            "end": Agg("last", end), "word_count": Agg("count", F.lit(1))}
    if with_text:
        aggs["words"] = Agg("list", F.col("text"))
    turns = runs(words, KEY, list(order), by_position("pos") if block is None else block,
                 look={"who": who, "start": F.col("start"), "end": end},
                 opens=lambda p, c: ~p["who"].eqNullSafe(c["who"])
                 | (c["start"] - p["end"] > max_pause), aggs=aggs)
    if with_text:
        turns = turns.withColumn("text", F.array_join("words", " ")).drop("words")
    return turns


def turn_parts(words: DataFrame, *, max_pause: float = 2.0, part_words: int = 1_000, block_rows: int = 50_000) -> DataFrame:
    """Words -> turns in parts, for talk without a bound: turn (0, 1, ... in its stream), part (0, 1, ... in its turn), speaker, start,
    end, word_count, text.

    Turns are those of `build_turns`; words are numbered by `pos`, and a part ends where `pos` reaches a multiple of
    `part_words`. No row and no task holds the words of a turn: words are shuffled once, to blocks of positions that hold whole
    parts, and glued together there. Only one row for each block of a stream that has several goes on, to number its turns and parts
    from where the block before ended. Which streams those are is counted when this is called. `turns_of_parts` gives the turns
    without their text.
    """
    who = F.coalesce(F.col("speaker"), F.lit("unknown"))
    end = F.coalesce(F.col("end"), F.col("start") + 0.1)
    block = F.coalesce(by_position("pos", -(-block_rows // part_words) * part_words), F.lit(-(1 << 63)))
    cell = Window.partitionBy(*KEY, BLOCK).orderBy("pos")
    upto = cell.rowsBetween(Window.unboundedPreceding, 0)
    opens = F.coalesce((F.col("_said")["who"] != who) | (F.col("start") - F.col("_said")["end"] > max_pause), F.lit(False))
    # in its block, the first row opens nothing: run 0 may go on from the block before
    told = (words.select(*KEY, "pos", "speaker", "start", "end", "text").withColumn(BLOCK, block)
            .withColumn("_said", F.lag(F.struct(who.alias("who"), end.alias("end"))).over(cell))
            .withColumn("_opens", opens).withColumn("_run", F.sum(F.col("_opens").cast("long")).over(upto))
            .withColumn("_from", F.last(F.when(F.col("_opens") | F.col("_said").isNull(), F.col("pos")), ignorenulls=True).over(upto)))
    slot = lambda c: F.floor(F.col(c) / part_words)
    said = F.array_sort(F.collect_list(F.struct("pos", "text")))
    parts = (told.groupBy(*KEY, BLOCK, "_run", slot("pos").alias("_slot"))
             .agg(F.first(who).alias("speaker"), F.min_by("start", "pos").alias("start"), F.max_by(end, "pos").alias("end"),
                  F.count(F.lit(1)).alias("word_count"), F.array_join(F.transform(said, lambda w: w["text"]), " ").alias("text"),
                  F.min("_from").alias("_from")))
    out = ("speaker", "start", "end", "word_count", "text")
    many = small(words.groupBy(*KEY).agg(F.min(block).alias("_lo"), F.max(block).alias("_hi")).filter("_lo < _hi")
                 .select(F.struct(*KEY).alias("_of")))
    if many.isEmpty():
        return parts.select(*KEY, F.col("_run").alias("turn"), (F.col("_slot") - slot("_from")).alias("part"), *out)
    ends = (told.join(many, F.struct(*KEY).eqNullSafe(F.col("_of")), "left_semi").groupBy(*KEY, BLOCK)
            .agg(F.min_by(F.struct(who.alias("who"), "start", "pos"), "pos").alias("_head"),
                 F.max_by(F.struct(who.alias("who"), end.alias("end")), "pos").alias("_tail"), F.max("_run").alias("_runs"),
                 F.max(F.when(F.col("_opens"), F.col("pos"))).alias("_last")))
    chain = Window.partitionBy(*KEY).orderBy(BLOCK)
    before, earlier = chain.rowsBetween(Window.unboundedPreceding, 0), chain.rowsBetween(Window.unboundedPreceding, -1)
    head, tail = F.col("_head"), F.col("_before")
    starts = tail.isNull() | F.coalesce((tail["who"] != head["who"]) | (head["start"] - tail["end"] > max_pause), F.lit(False))
    first = F.when(F.col("_starts"), head["pos"])
    linked = (ends.withColumn("_before", F.lag("_tail").over(chain)).withColumn("_starts", starts)
              .withColumn("_base", F.sum(F.col("_starts").cast("long")).over(before) + F.coalesce(F.sum("_runs").over(earlier), F.lit(0)) - 1)
              .withColumn("_open", F.coalesce(first, F.last(F.coalesce("_last", first), ignorenulls=True).over(earlier)))
              .select(F.struct(*KEY, BLOCK).alias("_of"), "_base", "_open"))
    met = parts.join(small(linked), F.struct(*KEY, BLOCK).eqNullSafe(F.col("_of")), "left")
    begun = F.when((F.col("_run") == 0) & F.col("_base").isNotNull(), F.col("_open")).otherwise(F.col("_from"))
    return (met.withColumn("_from", begun)
            .select(*KEY, (F.col("_run") + F.coalesce("_base", F.lit(0))).alias("turn"), (F.col("_slot") - slot("_from")).alias("part"), *out))


def turns_of_parts(parts: DataFrame) -> DataFrame:
    """Turns of `turn_parts`, without text: idx, speaker, start, end, word_count and the number of parts."""
    return (parts.groupBy(*KEY, F.col("turn").alias("idx"))
            .agg(F.first("speaker").alias("speaker"), F.min_by("start", "part").alias("start"), F.max_by("end", "part").alias("end"),
                 F.sum("word_count").alias("word_count"), F.count(F.lit(1)).alias("parts")))


def speaker_runs(rows: DataFrame, *, speaker: Column | None = None,
                 order: tuple[str, ...] = ("idx",), block: Column | None = None,
                 count: Column | None = None) -> DataFrame:
    """Runs of one speaker, pauses ignored; `speaker` may relabel first (host / guest)."""
    who = F.col("speaker") if speaker is None else speaker
    return runs(rows, KEY, list(order), by_position(order[0]) if block is None else block,
                look={"who": who}, opens=lambda p, c: ~p["who"].eqNullSafe(c["who"]),
                aggs={"speaker": Agg("first", who), "start": Agg("first", F.col("start")),
                      "end": Agg("last", F.col("end")),
                      "rows": Agg("count", F.lit(1)) if count is None else Agg("sum", count)})


def talk_metrics(turns: DataFrame, is_host: Column, *, order: tuple[str, ...] = ("idx",),
                 block: Column | None = None) -> DataFrame:
    """Per stream: words of host and guests, host share, turns (1 + changes), host last?"""
    linked = neighbours(turns, KEY, list(order), by_position(order[0]) if block is None else block,
                        before={"_who": F.col("speaker")})
    words = F.col("word_count")
    return (linked.groupBy(*KEY)
            .agg(F.sum(F.when(is_host, words).otherwise(0)).alias("host_words"),
                 F.sum(F.when(is_host, 0).otherwise(words)).alias("guest_words"),
                 (1 + F.count_if(F.col("_who") != F.col("speaker"))).alias("turns"),
                 F.max_by(is_host, F.struct(*order)).alias("host_last"))
            .withColumn("host_ratio", F.col("host_words")
                        / F.greatest(F.col("host_words") + F.col("guest_words"), F.lit(1))))


def range_metrics(ranges: DataFrame, turns: DataFrame, is_host: Column, *, range_id: str,
                  lo: str = "start", hi: str = "end", width: float = 300.0,
                  order: tuple[str, ...] = ("idx",), block: Column | None = None) -> DataFrame:
    """Talk figures of the turns that start in a closed range; ranges without turns get zeros.

    The turn before is found once per turn, not once per range: inside a range a change counts
    if the turn before also starts in it.
    """
    linked = neighbours(turns, KEY, list(order), by_position(order[0]) if block is None else block,
                        before={"_who": F.col("speaker"), "_at": F.col("start")})
    side = linked.select(*KEY, F.struct(*order).alias("_order"), F.col("start").alias("_t"),
                         is_host.alias("_host"), F.col("speaker").alias("_speaker"), "_who", "_at",
                         F.col("word_count").alias("_words"))
    asked = ranges.select(*KEY, F.col(range_id), F.col(lo).alias("_lo"), F.col(hi).alias("_hi"))
    met = band_join(asked, side, KEY, width, left_range=(F.col("_lo"), F.col("_hi")),
                    right_range=(F.col("_t"), F.col("_t")))
    figures = (met.groupBy(*KEY, range_id)
               .agg(F.sum(F.when(F.col("_host"), F.col("_words")).otherwise(0)).alias("host_words"),
                    F.sum(F.when(F.col("_host"), 0).otherwise(F.col("_words"))).alias("guest_words"),
                    (1 + F.count_if((F.col("_who") != F.col("_speaker"))
                                    & (F.col("_at") >= F.col("_lo")))).alias("turns"),
                    F.max_by("_host", "_order").alias("host_last")))
    out = ranges.join(figures, [*KEY, range_id], "left")
    for name in ("host_words", "guest_words", "turns"):
        out = out.withColumn(name, F.coalesce(name, F.lit(0)).cast("long"))
    return (out.withColumn("host_last", F.coalesce("host_last", F.lit(False)))
            .withColumn("host_ratio", F.col("host_words")
                        / F.greatest(F.col("host_words") + F.col("guest_words"), F.lit(1))))


def exchanges(rows: DataFrame, *, order: tuple[str, ...] = ("start", "pos"),
              keys: list[str] | None = None, block: Column | None = None) -> DataFrame:
    """Number of speaker changes per stream (or per group of `keys`)."""
    keys = keys or KEY
    linked = neighbours(rows, keys, list(order), by_time(order[0]) if block is None else block,
                        before={"_who": F.col("speaker")})
    return linked.groupBy(*keys).agg(
        F.count_if(F.col("_who") != F.col("speaker")).alias("exchanges"))


def turn_summary(turns: DataFrame) -> DataFrame:
    """Totals per speaker and, in the row without a speaker, per stream."""
    return (turns.rollup("stream_id", "speaker")
            .agg(F.sum("word_count").alias("total_words"), F.count(F.lit(1)).alias("total_turns"),
                 F.min("start").alias("first_seen"), F.max("end").alias("last_seen"),
                 F.round(F.max_by("end", "idx") - F.min_by("start", "idx"), 1).alias("duration"),
                 F.grouping_id().alias("_level"))
            .filter(F.col("_level") < 3)
            .withColumn("duration", F.when(F.col("_level") == 1, F.col("duration")))
            .drop("_level"))


def top_per_stream(rows: DataFrame, by: list[Column], k: int, *, keys: list[str] | None = None,
                   rank: str = "rank") -> DataFrame:
    """First k rows per stream. The limit is applied map-side before the shuffle."""
    w = Window.partitionBy(*(keys or KEY)).orderBy(*by)
    return rows.withColumn(rank, F.row_number().over(w).cast("long")).filter(F.col(rank) <= k)
