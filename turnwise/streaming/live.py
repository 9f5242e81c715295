"""Live jobs on words, events, cues, usage and job tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnwise.streaming.ordered import Merge, first_times, walk


class Turns(Merge):
    """Words of one speaker without a long pause; the words themselves are pieces."""
    fields = "at double, pos long, until double, speaker string, text string"
    record = "speaker string, start double, end double, word_count long"
    piece = "text string"
    output = "speaker string, start double, end double, word_count long, text string"

    def __init__(self, max_pause: float):
        self.max_pause = max_pause

    def opened(self, row):
        at, _, until, speaker, _ = row
        return speaker, at, until, 1

    def joins(self, record, row):
        return record[0] == row[3] and row[0] - record[2] <= self.max_pause

    def joined(self, record, row):
        speaker, start, _, count = record
        return speaker, start, row[2], count + 1

    def piece_of(self, row):
        return (row[4],)

    def result(self, record, pieces):
        return *record, " ".join(t for t, in pieces if t is not None)

    def closes(self, record):
        return record[2] + self.max_pause


class Cues(Merge):
    """Cues of one type that follow closely on the kept one: the better stays."""
    fields = "at double, cue_id string, cue_type string, confidence double"
    record = output = "cue_id string, cue_type string, at double, confidence double"

    def __init__(self, apart: float):
        self.apart = apart

    def opened(self, row):
        at, cue_id, cue_type, confidence = row
        return cue_id, cue_type, at, confidence

    def joins(self, record, row):
        return record[1] == row[2] and row[0] - record[2] < self.apart

    def joined(self, record, row):
        return self.opened(row) if (row[3] or 0.0) > (record[3] or 0.0) else record

    def result(self, record, pieces):
        return record

    def closes(self, record):
        return record[2] + self.apart


def live_turns(words: DataFrame, *, max_pause: float = 2.0, delay: str = "10 seconds") -> DataFrame:
    """Turns out of a live word stream, as `build_turns` makes them: a turn comes out when the speaker
    changes, after a pause, or when the stream has been quiet for that long.

    words: stream_id, ts, at (seconds since the epoch), pos, until, speaker, text. A word without an end lasts 0.1 s,
    one without a speaker counts as `unknown`, one without a text adds none; words without a time are left out (`ordered.untimed`).
    """
    whole = words.withColumns({"until": F.coalesce("until", F.col("at") + 0.1), "speaker": F.coalesce("speaker", F.lit("unknown"))})
    return walk(whole, keys=["stream_id"], delay=delay, key_schema="stream_id long", merge=Turns(max_pause))


def live_cues(cues: DataFrame, *, apart: float = 5.0, delay: str = "10 seconds") -> DataFrame:
    """Cues without near repeats, as `dedup_cues` leaves them, with the last kept cue carried along.

    cues: stream_id, ts, at, cue_id, cue_type, confidence. No confidence counts as 0; cues without a time are left out.
    """
    return walk(cues, keys=["stream_id"], delay=delay, key_schema="stream_id long", merge=Cues(apart))


def first_appearances(words: DataFrame, *, life: float, delay: str = "10 seconds") -> DataFrame:
    """First time each speaker is heard. A speaker is remembered for `life` seconds after the first
    word, the longest a stream lasts; rows may be late by `delay`, whichever comes first counts. Rows without a time are left out."""
    return first_times(words, keys=["stream_id", "speaker"], delay=delay, key_schema="stream_id long, speaker string", life=life)


def window_counts(words: DataFrame, *, size: str, hop: str | None = None, delay: str = "1 minute") -> DataFrame:
    """Rows per stream and sliding (or, without `hop`, tumbling) window; late rows are dropped."""
    window = F.window("ts", size, hop) if hop else F.window("ts", size)
    return (words.withWatermark("ts", delay).groupBy("stream_id", window.alias("w"))
            .agg(F.count(F.lit(1)).alias("rows"))
            .select("stream_id", F.col("w.start").alias("w_start"), F.col("w.end").alias("w_end"), "rows"))


def sessions(words: DataFrame, *, gap: str = "2 seconds", delay: str = "1 minute") -> DataFrame:
    """Sessions per stream and speaker that end after a gap."""
    return (words.withWatermark("ts", delay)
            .groupBy("stream_id", "speaker", F.session_window("ts", gap).alias("w"))
            .agg(F.count(F.lit(1)).alias("rows"))
            .select("stream_id", "speaker", F.col("w.start").alias("s_start"), F.col("w.end").alias("s_end"), "rows"))


def live_correlation(voices: DataFrame, signals: DataFrame, *, window: int = 60, delay: str = "1 minute") -> DataFrame:
    """Voice events with the first signal (in input order) within `window` seconds, or none.

    voices: stream_id, ts, event_id      signals: stream_id, s_ts, s_pos
    """
    v = voices.withWatermark("ts", delay)
    s = signals.select(F.col("stream_id").alias("s_stream"), "s_ts", "s_pos").withWatermark("s_ts", delay)
    near = F.expr(f"stream_id = s_stream AND s_ts >= ts - INTERVAL {window} SECONDS AND s_ts <= ts + INTERVAL {window} SECONDS")
    met = v.join(s, near, "leftOuter")
    return (met.groupBy(F.window("ts", "1 second").alias("w"), "stream_id", "event_id")
            .agg(F.min("s_pos").alias("s_pos"), F.min_by("s_ts", "s_pos").alias("s_ts"), F.min("ts").alias("at"))
            .select("stream_id", "event_id", "at", "s_pos",
                    (1 - F.abs(F.unix_micros("s_ts") - F.unix_micros("at")) / 1e6 / window).alias("correlation")))


def usage_per_minute(usage: DataFrame, *, delay: str = "1 minute") -> DataFrame:
    """Requests and tokens per sliding minute, every ten seconds."""
    return (usage.withWatermark("ts", delay).groupBy(F.window("ts", "1 minute", "10 seconds").alias("w"))
            .agg(F.count(F.lit(1)).alias("requests"), F.sum("tokens").alias("tokens"))
            .select(F.col("w.start").alias("w_start"), "requests", "tokens"))


def record_jobs(jobs: DataFrame, path: str, checkpoint: str, *, trigger: dict | None = None):
    """Append a status row for every pending job. A batch owns its folder and replaces it when it is
    run again after a failure, so a job is recorded once per (source, row, batch)."""
    def write(batch: DataFrame, batch_id: int) -> None:
        pending = batch.filter((F.trim(F.coalesce("status", F.lit(""))) == "") & (F.trim("url") != ""))
        (pending.select("source", "row_no", "url", F.lit("processing").alias("status"), F.lit(batch_id).alias("seq"))
         .dropDuplicates(["source", "row_no"]).write.mode("overwrite").parquet(f"{path}/batch={batch_id}"))
    return (jobs.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
            .trigger(**(trigger or {"availableNow": True})).start())


def latest_status(log: DataFrame) -> DataFrame:
    return log.groupBy("source", "row_no").agg(F.max_by("status", "seq").alias("status"), F.count(F.lit(1)).alias("entries"))


def dropped_late_rows(query) -> int:
    """Rows that were later than the watermark and so dropped, as the state operators of the latest
    progress reports count them: an aggregation counts rows it has already combined per task."""
    return sum(op["numRowsDroppedByWatermark"] for p in query.recentProgress for op in p["stateOperators"])
