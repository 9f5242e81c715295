"""Documents, transcripts, reports and timelines out of tables.

A stream of any length is cut into parts (`part` = turn number / part size), so no row of a sink
holds a whole long stream.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnwise.functions.clock import hms
from turnwise.operators.windows import ordered_text, turn_line
from turnwise.schema import KEY


def documents(turns: DataFrame, *, part_turns: int = 10_000) -> DataFrame:
    """One nested document per stream and part: utterances in order; the first part also carries the
    summary of the whole stream (totals, duration, figures per speaker)."""
    item = F.struct("idx", "speaker", "start", "end", "text", "word_count")
    parts = (turns.groupBy(*KEY, F.floor(F.col("idx") / part_turns).alias("part"))
             .agg(F.array_sort(F.collect_list(item)).alias("utterances")))
    per_speaker = turns.groupBy(*KEY, "speaker").agg(
        F.sum("word_count").alias("w"), F.count(F.lit(1)).alias("n"), F.min("start").alias("f"), F.max("end").alias("l"),
        F.min_by("start", "idx").alias("_s"), F.min("idx").alias("_si"), F.max_by("end", "idx").alias("_e"), F.max("idx").alias("_ei"))
    figures = F.struct(F.col("w").alias("total_words"), F.col("n").alias("total_utterances"),
                       F.col("f").alias("first_seen"), F.col("l").alias("last_seen"))
    summary = per_speaker.groupBy(*KEY).agg(F.struct(
        F.sum("n").alias("total_utterances"), F.sum("w").alias("total_words"),
        F.round(F.max_by("_e", "_ei") - F.min_by("_s", "_si"), 1).alias("duration_seconds"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("speaker", figures.alias("figures"))))).alias("speakers")
    ).alias("summary")).withColumn("part", F.lit(0).cast("long"))
    return (parts.join(summary, [*KEY, "part"], "left")
            .select(*KEY, "part", F.lit("utterances").alias("format"), "utterances", "summary"))


def write_documents(turns: DataFrame, path: str, *, part_turns: int = 10_000) -> None:
    documents(turns, part_turns=part_turns).write.mode("overwrite").json(path)


def render_transcript(turns: DataFrame, *, part_turns: int = 10_000) -> DataFrame:
    """Readable text per stream and part, one `[H:MM:SS] speaker: text` line per turn."""
    return (turns.groupBy(*KEY, F.floor(F.col("idx") / part_turns).alias("part"))
            .agg(ordered_text(["idx"], turn_line()).alias("text")))


def write_transcript(turns: DataFrame, path: str) -> None:
    """Transcript lines as text, each after its stream and a tab. Lines are range-sorted: the files in
    name order hold all streams in order, a long stream fills several, and no stream costs a file."""
    flat = turns.withColumn("text", F.regexp_replace("text", r"\s+", " "))
    line = F.concat(F.col("stream_id").cast("string"), F.lit("\t"), turn_line())
    (flat.repartitionByRange("stream_id", "idx").sortWithinPartitions("stream_id", "idx")
     .select(line.alias("value")).write.mode("overwrite").text(path))


def clip_report(clips: DataFrame, segs: DataFrame) -> DataFrame:
    """Text block per clip in rank order, with a header line of counts as rank 0.

    clips: stream_id, clip_id, rank, title, score, assembly   segs: + seg_no, start, end, purpose
    """
    span = F.concat(F.lit("["), hms(F.col("start"), False), F.lit(" - "), hms(F.col("end"), False), F.lit("]"))
    line = F.concat(F.col("seg_no").cast("string"), F.lit(". "), F.upper("purpose"), F.lit(" "), span, F.lit(" ("),
                    F.round(F.col("end") - F.col("start")).cast("long").cast("string"), F.lit("s)"))
    listed = segs.groupBy(*KEY, "clip_id").agg(ordered_text(["seg_no"], line).alias("_lines"))
    block = F.concat_ws("\n", F.concat(F.lit("Clip "), F.col("rank").cast("string"), F.lit(": "), F.col("title")),
                        F.concat(F.lit("Assembly: "), F.col("assembly")),
                        F.concat(F.lit("Score: "), F.format_string("%.1f", F.col("score").cast("double"))), F.lit("Segments:"), F.col("_lines"))
    body = clips.join(listed, [*KEY, "clip_id"], "left").select(*KEY, "rank", block.alias("text"))
    n = F.count(F.lit(1)).cast("string")
    head = clips.groupBy(*KEY).agg(F.concat(
        F.lit("Clips: "), n, F.lit(" ("), F.count_if(F.col("assembly") == "continuous").cast("string"), F.lit(" continuous, "),
        F.count_if(F.col("assembly") == "composite").cast("string"), F.lit(" composite)")).alias("text"))
    return head.select(*KEY, F.lit(0).cast("long").alias("rank"), "text").unionByName(body)


def write_report(report: DataFrame, path: str) -> None:
    (report.repartitionByRange("stream_id", "rank").sortWithinPartitions("stream_id", "rank")
     .write.mode("overwrite").json(path))


def timeline(convs: DataFrame, topics: DataFrame, clips: DataFrame) -> DataFrame:
    """One flat table of the conversation, topic and clip tracks."""
    def track(df: DataFrame, name: str, ident: Column, label: Column, start: str, end: str) -> DataFrame:
        return df.select(*KEY, F.lit(name).alias("track"), ident.cast("string").alias("item"), label.alias("label"),
                         F.col(start).alias("start"), F.col(end).alias("end"))
    return (track(convs, "conversation", F.col("conv_no"), F.col("dominant"), "start", "end")
            .unionByName(track(topics, "topic", F.col("block_no"), F.col("topic_name"), "t_start", "t_end"))
            .unionByName(track(clips, "clip", F.col("cand_id"), F.col("status"), "start", "end")))
