"""Speaker queries."""

from pyspark.sql import functions as F

from turnwise.catalog import query
from turnwise.catalog.bridges import (ITEM_WORDS, SEGMENTS, SIGNALS, TURNS, item_words, segments,
                                      signals, turns)
from turnwise.functions.text import label_role
from turnwise.operators import speakers as ops
from turnwise.operators import turns as talk
from turnwise.plans.asof import nearest
from turnwise.plans.blocks import by_time

R = F.round


@query("join1_max_overlap", f"""
WITH {SEGMENTS},
hits AS (
  SELECT w.stream_id, w.pos, s.seg_speaker,
         row_number() OVER (PARTITION BY w.stream_id, w.pos
           ORDER BY least(w."end", s.seg_end) - greatest(w.start, s.seg_start) DESC,
                    s.seg_start, s.seg_pos) AS rk
  FROM signals w JOIN segs s ON w.stream_id = s.stream_id
   AND least(w."end", s.seg_end) - greatest(w.start, s.seg_start) > 0)
SELECT w.stream_id, w.pos, coalesce(h.seg_speaker, 'fallback_' || w.speaker) AS speaker_name
FROM signals w LEFT JOIN hits h ON w.stream_id = h.stream_id AND w.pos = h.pos AND h.rk = 1""")
def join1(spark, sf):
    named = ops.assign_speaker(signals(spark, sf), segments(spark, sf), width=600.0)
    return named.select("stream_id", "pos", "speaker_name")


@query("scr21_alignment", f"""
WITH {SEGMENTS}
SELECT w.stream_id,
       count(*) FILTER (WHERE EXISTS (SELECT 1 FROM segs s WHERE s.stream_id = w.stream_id
          AND least(w."end", s.seg_end + 5) - greatest(w.start, s.seg_start + 5) > 0)) AS matched_words,
       count(*) FILTER (WHERE NOT EXISTS (SELECT 1 FROM segs s WHERE s.stream_id = w.stream_id
          AND least(w."end", s.seg_end + 5) - greatest(w.start, s.seg_start + 5) > 0)) AS unmatched_words
FROM signals w GROUP BY w.stream_id""")
def scr21(spark, sf):
    return ops.alignment(ops.assign_speaker(signals(spark, sf), segments(spark, sf), offset=5.0,
                                            width=600.0))


@query("join2_speaker_at", f"""
WITH {SEGMENTS},
hits AS (
  SELECT p.pos, s.seg_speaker, row_number() OVER (PARTITION BY p.pos ORDER BY s.seg_start, s.seg_pos) rk
  FROM signals p JOIN segs s ON p.stream_id = s.stream_id AND p.start BETWEEN s.seg_start AND s.seg_end)
SELECT p.stream_id, p.pos, h.seg_speaker AS speaker_at
FROM signals p LEFT JOIN hits h ON p.pos = h.pos AND h.rk = 1""")
def join2(spark, sf):
    return (ops.speaker_at(signals(spark, sf), segments(spark, sf), point_id="pos", time="start",
                           width=600.0).select("stream_id", "pos", "speaker_at"))


@query("join3_talk_time_within", f"""
WITH {SEGMENTS},
asked AS (SELECT stream_id, pos, start, start + 900 AS "end" FROM signals WHERE speaker = 'signup')
SELECT a.stream_id, a.pos,
  round(coalesce(sum(least(a."end", s.seg_end) - greatest(a.start, s.seg_start))
     FILTER (WHERE s.seg_speaker = 'voice_0'), 0), 4) AS host_time,
  round(coalesce(sum(least(a."end", s.seg_end) - greatest(a.start, s.seg_start))
     FILTER (WHERE s.seg_speaker <> 'voice_0'), 0), 4) AS guest_time
FROM asked a LEFT JOIN segs s ON a.stream_id = s.stream_id
 AND least(a."end", s.seg_end) - greatest(a.start, s.seg_start) > 0
GROUP BY a.stream_id, a.pos""")
def join3(spark, sf):
    asked = (signals(spark, sf).filter("speaker = 'signup'")
             .select("stream_id", "pos", "start", (F.col("start") + 900).alias("end")))
    out = ops.talk_time_within(asked, segments(spark, sf), interval_id="pos",
                               label=label_role(F.col("seg_speaker"), ["voice_0"]),
                               labels=["host", "guest"])
    return out.select("stream_id", "pos", R("host_time", 4).alias("host_time"),
                      R("guest_time", 4).alias("guest_time"))


@query("join4_nearest", f"""
WITH {SIGNALS},
l AS (SELECT * FROM signals WHERE speaker = 'error'),
r AS (SELECT * FROM signals WHERE speaker = 'signup'),
b AS (SELECT l.stream_id, l.pos, l.start, r.pos AS bp, r.start AS bt
      FROM l ASOF LEFT JOIN r ON l.stream_id = r.stream_id AND l.start >= r.start),
both_sides AS (SELECT b.*, r.pos AS ap, r.start AS aft
      FROM b ASOF LEFT JOIN r ON b.stream_id = r.stream_id AND b.start <= r.start),
near AS (SELECT stream_id, pos,
      CASE WHEN bt IS NULL OR aft - start < start - bt THEN ap ELSE bp END AS fp,
      CASE WHEN bt IS NULL OR aft - start < start - bt THEN aft - start ELSE start - bt END AS d
      FROM both_sides)
SELECT stream_id, pos, CASE WHEN d <= 1800 THEN fp END AS nearest_pos,
       CASE WHEN d <= 1800 THEN round(d, 5) END AS distance FROM near""")
def join4(spark, sf):
    s = signals(spark, sf)
    out = nearest(s.filter("speaker = 'error'"),
                  s.filter("speaker = 'signup'").select("stream_id", F.col("pos").alias("rpos"),
                                                        F.col("start").alias("rt")),
                  ["stream_id"], left_time=F.col("start"), right_time=F.col("rt"), left_id=["pos"],
                  right_tie=["rpos"], max_distance=1800.0)
    return out.select("stream_id", "pos", F.col("found.rpos").alias("nearest_pos"),
                      R("distance", 5).alias("distance"))


@query("join6_cross_validate", f"""
WITH {SEGMENTS},
firsts AS (SELECT stream_id, seg_speaker AS speaker, min(seg_start) AS time FROM segs GROUP BY ALL),
ask AS (SELECT *, CASE speaker WHEN 'voice_1' THEN 'host' WHEN 'voice_2' THEN 'guest' ELSE 'unknown' END AS speaker_type,
        CASE speaker WHEN 'voice_1' THEN 0.95::DOUBLE WHEN 'voice_2' THEN 0.85::DOUBLE ELSE 0.7::DOUBLE END AS confidence
        FROM firsts WHERE speaker <> 'voice_0'),
v AS (SELECT a.stream_id, a.speaker, min_by(s.start, s.pos) AS vt FROM ask a JOIN signals s
      ON a.stream_id = s.stream_id AND s.speaker = 'click' AND abs(s.start - a.time) <= 900 GROUP BY ALL),
c AS (SELECT a.stream_id, a.speaker, min_by(s.start, s.pos) AS ct, min(s.pos) AS cp FROM ask a JOIN signals s
      ON a.stream_id = s.stream_id AND s.speaker = 'signup' AND abs(s.start - a.time) <= 600 GROUP BY ALL)
SELECT a.stream_id, a.speaker, round(a.time, 4) AS time, round(vt, 4) AS visual_time,
  round(1 - abs(vt - a.time) / 900, 6) AS visual_correlation,
  'cue ' || cp AS cue_phrase, round(1 - abs(ct - a.time) / 600, 6) AS cue_correlation,
  CASE WHEN vt IS NOT NULL AND ct IS NOT NULL THEN 'triple_confirmed'
       WHEN vt IS NOT NULL OR ct IS NOT NULL THEN 'double_confirmed' ELSE 'voice_only' END AS validation,
  round(CASE WHEN vt IS NOT NULL AND ct IS NOT NULL THEN least(1, confidence + 0.2)
       WHEN vt IS NOT NULL OR ct IS NOT NULL THEN least(1, confidence + 0.1)
       ELSE confidence * 0.8 END, 6) AS final_confidence,
  speaker_type IN ('unknown', 'guest') AS likely_guest
FROM ask a LEFT JOIN v USING (stream_id, speaker) LEFT JOIN c USING (stream_id, speaker)""")
def join6(spark, sf):
    s = signals(spark, sf)
    firsts = (segments(spark, sf).groupBy("stream_id", F.col("seg_speaker").alias("speaker"))
              .agg(F.min("seg_start").alias("time"))
              .withColumn("event_id", F.col("speaker"))
              .withColumn("speaker_type", F.when(F.col("speaker") == "voice_1", "host")
                          .when(F.col("speaker") == "voice_2", "guest").otherwise("unknown"))
              .withColumn("confidence", F.when(F.col("speaker") == "voice_1", 0.95)
                          .when(F.col("speaker") == "voice_2", 0.85).otherwise(0.7)))
    visuals = s.filter("speaker = 'click'").select("stream_id", F.col("pos").alias("v_pos"),
                                                   F.col("start").alias("v_time"))
    cues = s.filter("speaker = 'signup'").select(
        "stream_id", F.col("pos").alias("c_pos"), F.col("start").alias("c_time"),
        F.concat(F.lit("cue "), F.col("pos").cast("string")).alias("c_phrase"))
    out = ops.cross_validate(firsts, visuals, cues, hosts=["voice_0"], visual_window=900.0,
                             cue_window=600.0).drop("event_id")
    return (out.withColumn("time", R("time", 4)).withColumn("visual_time", R("visual_time", 4))
            .withColumn("visual_correlation", R("visual_correlation", 6))
            .withColumn("cue_correlation", R("cue_correlation", 6))
            .withColumn("final_confidence", R("final_confidence", 6)))


NAMES = """
names AS (SELECT stream_id, seg_speaker AS speaker, min_by('Person ' || seg_pos % 7, (seg_start, seg_pos)) AS name
          FROM segs WHERE seg_pos % 3 = 0 AND seg_speaker <> 'voice_4' GROUP BY ALL)"""


def _names(segs):
    match = F.when((F.col("seg_pos") % 3 == 0) & (F.col("seg_speaker") != "voice_4"),
                   F.concat(F.lit("Person "), (F.col("seg_pos") % 7).cast("string")))
    return ops.names_from_segments(segs.withColumn("speaker", F.col("seg_speaker")), match,
                                   ["seg_start", "seg_pos"])


@query("join13_speaker_names", f"""
WITH {SEGMENTS}, {NAMES}
SELECT s.stream_id, s.seg_pos, coalesce(n.name, s.seg_speaker) AS speaker_name
FROM segs s LEFT JOIN names n ON s.stream_id = n.stream_id AND s.seg_speaker = n.speaker""")
def join13(spark, sf):
    segs = segments(spark, sf)
    return (ops.name_speakers(segs.withColumnRenamed("seg_speaker", "speaker"), _names(segs))
            .select("stream_id", "seg_pos", "speaker_name"))


@query("agg1_word_stats", f"""
WITH {ITEM_WORDS}
SELECT stream_id, speaker, count(*) AS word_count, sum("end" - start) AS total_time,
       min_by(start, pos) AS first_word, max_by("end", pos) AS last_word
FROM item_words GROUP BY stream_id, speaker""")
def agg1(spark, sf):
    return ops.word_stats(item_words(spark, sf))


@query("agg2_named_stats", f"""
WITH {ITEM_WORDS}
SELECT stream_id, 'name ' || speaker AS speaker_name, count(*) AS word_count,
       min(start) AS first_word_time, max(start) AS last_word_time
FROM item_words GROUP BY ALL""")
def agg2(spark, sf):
    named = item_words(spark, sf).withColumn("speaker_name", F.concat(F.lit("name "), F.col("speaker")))
    return ops.named_stats(named)


@query("agg3_turn_summary", f"""
WITH {TURNS}
SELECT stream_id, speaker, CAST(sum(word_count) AS BIGINT) AS total_words, count(*) AS total_turns,
       min(start) AS first_seen, max("end") AS last_seen,
       CASE WHEN speaker IS NULL THEN round(max_by("end", idx) - min_by(start, idx), 1) END AS duration
FROM turns GROUP BY GROUPING SETS ((stream_id, speaker), (stream_id))""")
def agg3(spark, sf):
    return talk.turn_summary(turns(spark, sf))


@query("agg4_talk_time", f"""
WITH {SEGMENTS}
SELECT stream_id, round(sum(CASE WHEN seg_speaker = 'voice_0' THEN seg_end - seg_start ELSE 0 END), 4) AS host_time,
  round(sum(CASE WHEN seg_speaker IN ('voice_1', 'voice_2') THEN seg_end - seg_start ELSE 0 END), 4) AS guest_time,
  round(sum(CASE WHEN seg_speaker IN ('voice_3', 'voice_4') THEN seg_end - seg_start ELSE 0 END), 4) AS unknown_time,
  round(max(seg_end), 4) AS total_duration
FROM segs GROUP BY stream_id""")
def agg4(spark, sf):
    voice = F.when(F.col("seg_speaker").isin("voice_3", "voice_4"), "Unidentified").otherwise(F.col("seg_speaker"))
    out = ops.talk_time(segments(spark, sf), label_role(voice, ["Voice_0"]))
    return out.select("stream_id", *[R(c, 4).alias(c) for c in out.columns[1:]])


@query("agg5_speaker_profiles", f"""
WITH {SEGMENTS}, {NAMES},
p AS (SELECT stream_id, seg_speaker AS speaker, min(seg_start) AS a, max(seg_end) AS b,
      sum(seg_end - seg_start) AS d, count(*) AS n FROM segs GROUP BY ALL)
SELECT p.stream_id, p.speaker, round(a, 4) AS first_appearance, round(b, 4) AS last_appearance,
       round(d, 4) AS total_duration, n AS segment_count, name,
       CASE WHEN name IN ('Person 0', 'Person 1') THEN 'host' WHEN name IS NOT NULL THEN 'panel' ELSE 'unknown' END AS speaker_type,
       CAST(CASE WHEN name IN ('Person 0', 'Person 1') THEN 0.95 WHEN name IS NOT NULL THEN 0.85 ELSE 0.7 END AS DOUBLE) AS confidence
FROM p LEFT JOIN names n ON p.stream_id = n.stream_id AND p.speaker = n.speaker""")
def agg5(spark, sf):
    segs = segments(spark, sf)
    out = ops.speaker_profiles(segs, _names(segs), ["person 0", "PERSON 1"])
    for c in ("first_appearance", "last_appearance", "total_duration"):
        out = out.withColumn(c, R(c, 4))
    return out


@query("agg16_host_election", f"""
WITH {ITEM_WORDS},
n AS (SELECT stream_id, speaker, count(*) AS c, min(pos) AS f FROM item_words GROUP BY ALL)
SELECT stream_id, speaker AS host, c AS host_count FROM n
QUALIFY row_number() OVER (PARTITION BY stream_id ORDER BY c DESC, f) = 1""")
def agg16(spark, sf):
    return ops.elect_host(item_words(spark, sf))


@query("agg17_host_alias", f"""
WITH {SIGNALS},
fb AS (SELECT stream_id, 'fallback_' || user_id % 5 AS speaker, count(*) AS n, min(pos) AS f,
       count(DISTINCT floor(start / 600)) AS present FROM signals WHERE speaker <> 'click' GROUP BY stream_id, 2
       QUALIFY row_number() OVER (PARTITION BY stream_id ORDER BY count(*) DESC, min(pos)) = 1),
w AS (SELECT stream_id, CAST(ceil(trunc(max_by("end", pos)) / 600) AS BIGINT) AS windows, count(*) FILTER (WHERE speaker = 'click') AS h
      FROM signals GROUP BY stream_id)
SELECT w.stream_id, fb.speaker AS alias, fb.present, w.windows
FROM w JOIN fb ON w.stream_id = fb.stream_id WHERE h > 0 AND present / windows > 0.02""")
def agg17(spark, sf):
    speaker = F.when(F.col("speaker") == "click", "host").otherwise(
        F.concat(F.lit("fallback_"), (F.col("user_id") % 5).cast("string")))
    t = signals(spark, sf).withColumn("speaker", speaker).withColumn("idx", F.col("pos"))
    return ops.host_alias(t, F.col("speaker") == "host", F.col("speaker").startswith("fallback_"),
                          share=0.02)


EVENTS_SQL = """
linked AS (SELECT *, lag(seg_speaker) OVER (PARTITION BY stream_id ORDER BY seg_start, seg_pos) AS prev,
           row_number() OVER (PARTITION BY stream_id, seg_speaker ORDER BY seg_start, seg_pos) AS nth FROM segs),
sp_events AS (
  SELECT stream_id, seg_start AS time, seg_pos AS pos, 'first_appearance' AS event_type,
         seg_speaker AS speaker, NULL AS from_speaker FROM linked WHERE nth = 1
  UNION ALL
  SELECT stream_id, seg_start, seg_pos, 'speaking_start', seg_speaker, prev FROM linked WHERE prev <> seg_speaker)"""


@query("win6_speaker_events", f"""
WITH {SEGMENTS}, {EVENTS_SQL}
SELECT stream_id, round(time, 4) AS time, pos, event_type, speaker, from_speaker FROM sp_events""")
def win6(spark, sf):
    return ops.speaker_events(segments(spark, sf), block=by_time("seg_start", 3600)).withColumn("time", R("time", 4))


@query("win7_speaker_timeline", f"""
WITH {SEGMENTS}, {EVENTS_SQL}, {NAMES}
SELECT e.stream_id, e.pos, e.event_type, e.speaker,
       CASE WHEN name = 'Person 0' THEN 'host' WHEN name IS NOT NULL THEN 'panel' ELSE 'unknown' END AS speaker_type
FROM sp_events e LEFT JOIN names n ON e.stream_id = n.stream_id AND e.speaker = n.speaker""")
def win7(spark, sf):
    segs = segments(spark, sf)
    out = ops.speaker_timeline(ops.speaker_events(segs, block=by_time("seg_start", 3600)),
                               ops.speaker_profiles(segs, _names(segs), ["Person 0"]))
    return out.select("stream_id", "pos", "event_type", "speaker", "speaker_type")


@query("flt4_overlap_filter", f"""
WITH {SEGMENTS}
SELECT stream_id, seg_pos, seg_speaker FROM segs WHERE seg_end > 36000 AND seg_start < 39600""")
def flt4(spark, sf):
    return (segments(spark, sf).filter("seg_end > 36000 and seg_start < 39600")
            .select("stream_id", "seg_pos", "seg_speaker"))


@query("flt5_min_duration", f"""
WITH {SEGMENTS}
SELECT stream_id, seg_pos, round(seg_end - seg_start, 4) AS duration FROM segs WHERE seg_end - seg_start >= 60""")
def flt5(spark, sf):
    span = F.col("seg_end") - F.col("seg_start")
    return segments(spark, sf).filter(span >= 60).select("stream_id", "seg_pos", R(span, 4).alias("duration"))


@query("prj1_label_roles", f"""
WITH {SIGNALS}
SELECT CASE WHEN speaker = 'click' THEN 'host' WHEN speaker = 'error' THEN 'unknown' ELSE 'guest' END AS role,
       count(*) AS n FROM signals GROUP BY 1""")
def prj1(spark, sf):
    label = F.when(F.col("speaker") == "error", "Unknown").otherwise(F.upper("speaker"))
    return (signals(spark, sf).groupBy(label_role(label, ["click"]).alias("role"))
            .agg(F.count(F.lit(1)).alias("n")))
