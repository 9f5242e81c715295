"""Conversations of one guest each, guests on screen, topic hints."""

from __future__ import annotations

from heapq import heappop, heappush

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turnwise.operators.speakers import talk_time_within
from turnwise.operators.turns import exchanges
from turnwise.plans.bands import band_join
from turnwise.plans.blocks import Agg, by_time, running, runs
from turnwise.plans.cut import cut, join_per_key
from turnwise.schema import KEY


def _leading_labels(start: np.ndarray, code: np.ndarray, names: np.ndarray, own: np.ndarray,
                    half: float, need: int) -> list:
    """Most frequent label (earliest first, null code = no vote) around every own row.

    Two ends move over the sorted rows. A label's count and its first row in the window stand in a heap, old entries
    of which are thrown away when they come to the top; so the work follows the rows, not the number of labels.
    """
    need = max(need, 1)
    places: list[list[int]] = [[] for _ in names]
    for i, c in enumerate(code.tolist()):
        if c >= 0:
            places[c].append(i)
    first, count = [0] * len(names), [0] * len(names)
    times, codes, heap, found, left, right = start.tolist(), code.tolist(), [], [], 0, 0

    def enter(c: int) -> None:
        if count[c] >= need:
            heappush(heap, (-count[c], places[c][first[c]], c))
    for i, mine in enumerate(own.tolist()):
        if not mine:
            continue
        while right < len(times) and times[right] <= times[i] + half:
            if (c := codes[right]) >= 0:
                count[c] += 1
                enter(c)
            right += 1
        while times[left] < times[i] - half:
            if (c := codes[left]) >= 0:
                count[c] -= 1
                first[c] += 1
                enter(c)
            left += 1
        while heap and (-heap[0][0] != count[heap[0][2]] or heap[0][1] != places[heap[0][2]][first[heap[0][2]]]):
            heappop(heap)
        found.append(names[heap[0][2]] if heap else None)
    return found


def rolling_dominance(turns: DataFrame, is_host: Column, *, half_window: float = 60.0,
                      need: int = 3, block_seconds: float = 3600.0, cell_rows: int = 20_000,
                      order: str = "idx") -> DataFrame:
    """For every turn the guest who speaks most often within +- half_window (both ends count),
    null below `need` turns, ties to who comes first in the window.

    A block of time is cut into as many equal cells as its turns need, `cell_rows` each, but none shorter than a window.
    A cell is one group; turns near its rim are copied into the next one, so no group grows with the length of a stream,
    a crowded hour is many groups, and no pairs are formed. Turns without a start have no window and no dominant guest.
    """
    rows = turns.select(*KEY, order, "start", F.when(~is_host, F.col("speaker")).alias("_who")).filter("start is not null")
    counted = rows.groupBy(*KEY, F.floor(F.col("start") / block_seconds).alias("_block")).agg(F.count(F.lit(1)).alias("_n"))
    most = max(1, int(block_seconds // max(2 * half_window, 1e-9)))
    cells = counted.select(*KEY, "_block", F.least(F.ceil(F.col("_n") / cell_rows), F.lit(most)).alias("_cells"))

    def cell_at(t: Column) -> Column:
        """The cell of a time inside the block, the last one for the end of the block."""
        part = F.floor((t - F.col("_block") * block_seconds) * F.col("_cells") / block_seconds)
        return F.least(F.greatest(part, F.lit(0)), F.col("_cells") - 1)
    low, high = F.col("start") - half_window, F.col("start") + half_window
    spread = rows.withColumn("_block", F.explode(F.sequence(F.floor(low / block_seconds), F.floor(high / block_seconds))))
    spread = join_per_key(spread, cells, [*KEY, "_block"], [*KEY, "_block", order])
    spread = spread.withColumn("_home", F.when(F.col("_block") == F.floor(F.col("start") / block_seconds), cell_at(F.col("start"))))
    spread = spread.withColumn("_cell", F.explode(F.sequence(cell_at(low), cell_at(high))))

    def lead(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["start", order])
        code, names = pd.factorize(pdf["_who"])
        own = (pdf["_home"] == pdf["_cell"]).to_numpy()  # a turn lent by another block has no home here
        out = pdf.loc[own, [*KEY, order]].copy()
        labels = _leading_labels(pdf["start"].to_numpy(), code, np.asarray(names, dtype=object), own,
                                 half_window, need)
        out["dominant"] = pd.Series(labels, index=out.index, dtype=object)
        return out

    found = spread.groupBy(*KEY, "_block", "_cell").applyInPandas(
        lead, f"stream_id long, {order} long, dominant string")
    return turns.join(found, [*KEY, order], "left")


def segment_conversations(turns: DataFrame, is_host: Column, *, half_window: float = 60.0,
                          need: int = 3, min_duration: float = 60.0, order: str = "idx",
                          block_seconds: float = 3600.0) -> DataFrame:
    """Conversations: stretches led by one guest.

    Turns without a leading guest extend the open stretch (at the start of a stream they are
    left out). Stretches below `min_duration` go, then neighbours of the same guest are joined;
    words and turns of what went are not counted.
    """
    led = cut(rolling_dominance(turns.select(*KEY, order, "start", "end", "speaker", "word_count"),
                                is_host, half_window=half_window, need=need,
                                block_seconds=block_seconds, order=order))
    ordered = ["start", order]
    block = by_time("start", block_seconds)
    filled = (running(led, KEY, ordered, block, fill={"_lead": F.col("dominant")})
              .filter(F.col("_lead").isNotNull()))
    words = F.col("word_count").cast("long")
    stretches = runs(filled, KEY, ordered, block, look={"who": F.col("_lead")},
                     opens=lambda p, c: p["who"] != c["who"],
                     aggs={"dominant": Agg("first", F.col("_lead")), "start": Agg("first", F.col("start")),
                           "end": Agg("last", F.col("end")),
                           "host_words": Agg("sum", F.when(is_host, words).otherwise(0)),
                           "guest_words": Agg("sum", F.when(is_host, 0).otherwise(words)),
                           "turn_count": Agg("sum", F.when(is_host, 0).otherwise(1)),
                           "guests": Agg("set", F.when(~is_host, F.col("speaker")))})
    kept = cut(stretches.filter(F.col("end") - F.col("start") >= min_duration))
    merged = runs(kept, KEY, ["start"], block, look={"who": F.col("dominant")},
                  opens=lambda p, c: p["who"] != c["who"],
                  aggs={"dominant": Agg("first", F.col("dominant")), "start": Agg("first", F.col("start")),
                        "end": Agg("last", F.col("end")),
                        "host_words": Agg("sum", F.col("host_words")),
                        "guest_words": Agg("sum", F.col("guest_words")),
                        "turn_count": Agg("sum", F.col("turn_count")),
                        "guests": Agg("set", F.col("guests"))})
    merged = merged.withColumn("guests", F.array_sort(F.array_distinct(F.flatten("guests"))))
    # A conversation lasts at least `min_duration`, so a stream has a bounded number of them.
    number = F.row_number().over(Window.partitionBy(*KEY).orderBy("start")).cast("long")
    return (merged.withColumn("conv_no", number)
            .withColumn("duration", F.col("end") - F.col("start")))


def guests_on_screen(frames: DataFrame, *, interval: float, min_frames: int = 2,
                     skip: list[str] | None = None) -> DataFrame:
    """Frames with nested people -> one row per guest description seen at least twice.

    `skip` leaves out descriptions (the host, say); numbers follow first sight.
    """
    people = frames.select(*KEY, "time", F.posexplode("people").alias("_i", "_p"))
    desc = F.lower(F.trim(F.col("_p.description")))
    rows = people.select(*KEY, "time", "_i", desc.alias("description"))
    if skip:
        rows = rows.filter(~F.col("description").isin([s.lower().strip() for s in skip]))
    guests = (rows.groupBy(*KEY, "description")
              .agg(F.min(F.struct("time", "_i")).alias("_at"), F.min("time").alias("first_seen"),
                   F.max("time").alias("last_seen"), F.count(F.lit(1)).alias("frame_count"))
              .filter(F.col("frame_count") >= min_frames))
    number = F.row_number().over(Window.partitionBy(*KEY).orderBy("_at")).cast("long")
    return (guests.withColumn("guest_no", number).drop("_at")
            .withColumn("screen_time", F.col("frame_count") * interval))


def guest_conversations(guests: DataFrame, segs: DataFrame, role: Column, *,
                        min_duration: float = 60.0, width: float = 3600.0) -> DataFrame:
    """One conversation per guest: from first to last sight, with talk times and exchanges."""
    spans = guests.select(*KEY, "guest_no", "description", F.col("first_seen").alias("start"),
                          F.col("last_seen").alias("end"))
    voiced = segs.withColumn("_role", role)
    timed = talk_time_within(spans, segs, interval_id="guest_no", label=role,
                             labels=["host", "guest"])
    inside = band_join(spans.select(*KEY, "guest_no", F.col("start").alias("_lo"), F.col("end").alias("_hi")),
                       voiced, KEY, width, left_range=(F.col("_lo"), F.col("_hi")),
                       right_range=(F.col("seg_start"), F.col("seg_end")),
                       condition=(F.col("seg_end") > F.col("_lo")) & (F.col("seg_start") < F.col("_hi")))
    rows = inside.select(*KEY, "guest_no", "seg_start", "seg_end", "seg_pos", F.col("_role").alias("speaker"))
    group = [*KEY, "guest_no"]
    swaps = exchanges(rows, order=("seg_start", "seg_pos"), keys=group,
                      block=by_time("seg_start", 3600))
    spoken = rows.filter("speaker = 'guest'").groupBy(*group).agg(
        F.min("seg_start").alias("first_spoke"), F.max("seg_end").alias("last_spoke"))
    number = F.row_number().over(Window.partitionBy(*KEY).orderBy("start", "guest_no")).cast("long")
    return (timed.join(swaps, group, "left").join(spoken, group, "left")
            .withColumn("duration", F.col("end") - F.col("start"))
            .filter(F.col("duration") >= min_duration)
            .withColumn("exchanges", F.coalesce("exchanges", F.lit(0)))
            .withColumn("conv_no", number))


def person_timeline(frames: DataFrame, term: str, *, block: Column | None = None) -> DataFrame:
    """Stretches of consecutive frames in which a description contains `term`."""
    shown = F.exists("people", lambda p: F.lower(p["description"]).contains(term.lower()))
    out = runs(frames, KEY, ["time"], by_time("time", 86_400) if block is None else block,
               look={"shown": shown}, opens=lambda p, c: p["shown"] != c["shown"],
               aggs={"shown": Agg("first", shown), "start": Agg("first", F.col("time")),
                     "end": Agg("last", F.col("time")), "frames": Agg("count", F.lit(1))})
    return out.filter("shown").drop("shown")


def topic_hints(turns: DataFrame, *, entity_pattern: str, stop: list[str], topics: list[str],
                top: int = 8, keys: list[str] | None = None) -> DataFrame:
    """Best terms of a conversation: named things count double, dictionary words once and only
    if they are no named thing; ties to named things, then to what comes first."""
    keys = keys or KEY
    named = (turns.select(*keys, "idx", F.posexplode(F.regexp_extract_all(
        F.col("text"), F.lit(entity_pattern), F.lit(0))).alias("_i", "_m"))
        .withColumn("term", F.lower(F.trim("_m")))
        .filter((F.length("term") > 2) & ~F.col("term").isin(stop)))
    plain = (turns.select(*keys, "idx", F.posexplode(F.regexp_extract_all(
        F.lower("text"), F.lit("[a-z]+"), F.lit(0))).alias("_i", "term"))
        .filter(F.col("term").isin(topics)))
    at = F.struct("idx", "_i")
    both = (named.select(*keys, "term", at.alias("_at"), F.lit(0).alias("_kind"))
            .unionByName(plain.select(*keys, "term", at.alias("_at"), F.lit(1).alias("_kind"))))
    score = F.when(F.min("_kind") == 0, 2 * F.count_if(F.col("_kind") == 0)).otherwise(F.count(F.lit(1)))
    ranked = (both.groupBy(*keys, "term")
              .agg(score.alias("score"), F.min("_kind").alias("_k"),
                   F.min_by("_at", F.struct("_kind", "_at")).alias("_first"))
              .withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(
                  F.desc("score"), "_k", "_first")).cast("long")))
    return ranked.filter(F.col("rank") <= top).select(*keys, "term", "score", "rank")


def stream_duration(words: DataFrame, meta: DataFrame | None = None) -> DataFrame:
    """Length of a stream: what the metadata say, if they do, else the end of the last word."""
    last = words.groupBy(*KEY).agg(F.max_by("end", "pos").alias("_end"), F.max("end").alias("max_end"))
    if meta is not None:
        last = last.join(meta.select(*KEY, F.nullif(F.col("duration"), F.lit(0)).alias("_meta")), KEY, "left")
        return last.select(*KEY, F.coalesce("_meta", "_end").alias("duration"), "max_end")
    return last.withColumnRenamed("_end", "duration")


def conversation_totals(convs: DataFrame) -> DataFrame:
    return convs.groupBy(*KEY).agg(F.count(F.lit(1)).alias("conversations"),
                                   F.sum("host_time").alias("host_time"),
                                   F.sum("guest_time").alias("guest_time"),
                                   F.sum("duration").alias("covered"))
