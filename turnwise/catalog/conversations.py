"""Turn, run and conversation queries."""

from pyspark.sql import functions as F

from turnwise.catalog import query
from turnwise.catalog.bridges import (FRAMES, ITEM_WORDS, SEGMENTS, SIGNALS, TURNS, frames,
                                      item_words, segments, signals, turns)
from turnwise.functions.text import label_role
from turnwise.operators import conversations as conv
from turnwise.operators import turns as talk
from turnwise.plans.blocks import by_time, running

R = F.round


@query("top1_top_speakers", f"""
WITH {TURNS},
s AS (SELECT stream_id, speaker, CAST(sum(word_count) AS BIGINT) AS total_words, count(*) AS total_turns
      FROM turns GROUP BY ALL)
SELECT stream_id, speaker, total_words, total_turns,
       row_number() OVER (PARTITION BY stream_id ORDER BY total_words DESC, speaker) AS rank
FROM s QUALIFY rank <= 2""")
def top1(spark, sf):
    summary = (talk.turn_summary(turns(spark, sf)).filter(F.col("speaker").isNotNull())
               .select("stream_id", "speaker", "total_words", "total_turns"))
    return talk.top_per_stream(summary, [F.desc("total_words"), F.asc("speaker")], 2)


@query("seq1_build_turns", f"""
WITH {ITEM_WORDS},
f AS (SELECT *, CASE WHEN lag(speaker) OVER w IS DISTINCT FROM speaker OR start - lag("end") OVER w > 2 THEN 1 ELSE 0 END AS new
      FROM item_words WINDOW w AS (PARTITION BY stream_id ORDER BY pos)),
g AS (SELECT *, sum(new) OVER (PARTITION BY stream_id ORDER BY pos) AS run FROM f)
SELECT stream_id, any_value(speaker) AS speaker, min(start) AS start, max_by("end", pos) AS "end",
       count(*) AS word_count, string_agg(text, ' ' ORDER BY pos) AS text
FROM g GROUP BY stream_id, run""")
def seq1(spark, sf):
    return talk.build_turns(item_words(spark, sf))


@query("seq1_turn_parts", f"""
WITH {ITEM_WORDS},
f AS (SELECT *, CASE WHEN lag(speaker) OVER w IS DISTINCT FROM speaker OR start - lag("end") OVER w > 2 THEN 1 ELSE 0 END AS new
      FROM item_words WINDOW w AS (PARTITION BY stream_id ORDER BY pos)),
g AS (SELECT *, sum(new) OVER (PARTITION BY stream_id ORDER BY pos) AS run FROM f),
p AS (SELECT *, pos // 4 - min(pos) OVER (PARTITION BY stream_id, run) // 4 AS part FROM g)
SELECT stream_id, CAST(run - 1 AS BIGINT) AS turn, CAST(part AS BIGINT) AS part, any_value(speaker) AS speaker, min(start) AS start, max_by("end", pos) AS "end",
       count(*) AS word_count, string_agg(text, ' ' ORDER BY pos) AS text
FROM p GROUP BY stream_id, run, part""")
def seq1_parts(spark, sf):
    return talk.turn_parts(item_words(spark, sf), part_words=4)


@query("seq1_event_turns", f"""
WITH {SIGNALS},
f AS (SELECT *, CASE WHEN lag(user_id % 3) OVER w IS DISTINCT FROM user_id % 3 OR start - lag("end") OVER w > 600 THEN 1 ELSE 0 END AS new
      FROM signals WINDOW w AS (PARTITION BY stream_id ORDER BY start, pos)),
g AS (SELECT *, sum(new) OVER (PARTITION BY stream_id ORDER BY start, pos) AS run FROM f)
SELECT stream_id, CAST(any_value(user_id % 3) AS VARCHAR) AS speaker, round(min(start), 4) AS start,
       round(max_by("end", (start, pos)), 4) AS "end", count(*) AS word_count
FROM g GROUP BY stream_id, run""")
def seq1_events(spark, sf):
    words = signals(spark, sf).withColumn("speaker", (F.col("user_id") % 3).cast("string"))
    out = talk.build_turns(words, max_pause=600.0, order=("start", "pos"),
                           block=by_time("start", 3600), with_text=False)
    return out.withColumn("start", R("start", 4)).withColumn("end", R("end", 4))


@query("seq2_speaker_runs", f"""
WITH {SIGNALS},
r AS (SELECT *, CASE WHEN speaker IN ('click', 'view') THEN 'host' ELSE 'guest' END AS who FROM signals),
f AS (SELECT *, CASE WHEN lag(who) OVER (PARTITION BY stream_id ORDER BY start, pos) IS DISTINCT FROM who THEN 1 ELSE 0 END AS new FROM r),
g AS (SELECT *, sum(new) OVER (PARTITION BY stream_id ORDER BY start, pos) AS run FROM f)
SELECT stream_id, any_value(who) AS speaker, round(min(start), 4) AS start, round(max_by("end", (start, pos)), 4) AS "end",
       count(*) AS rows FROM g GROUP BY stream_id, run""")
def seq2(spark, sf):
    who = F.when(F.col("speaker").isin("click", "view"), "host").otherwise("guest")
    out = talk.speaker_runs(signals(spark, sf), speaker=who, order=("start", "pos"),
                            block=by_time("start", 3600))
    return out.withColumn("start", R("start", 4)).withColumn("end", R("end", 4))


@query("agg7_talk_metrics", f"""
WITH {TURNS},
f AS (SELECT *, lag(speaker) OVER (PARTITION BY stream_id ORDER BY idx) AS prev FROM turns)
SELECT stream_id, CAST(coalesce(sum(word_count) FILTER (WHERE speaker = 'host'), 0) AS BIGINT) AS host_words,
  CAST(coalesce(sum(word_count) FILTER (WHERE speaker <> 'host'), 0) AS BIGINT) AS guest_words,
  1 + count(*) FILTER (WHERE prev <> speaker) AS turns, max_by(speaker = 'host', idx) AS host_last,
  round(coalesce(sum(word_count) FILTER (WHERE speaker = 'host'), 0) / greatest(sum(word_count), 1), 6) AS host_ratio
FROM f GROUP BY stream_id""")
def agg7(spark, sf):
    return (talk.talk_metrics(turns(spark, sf), F.col("speaker") == "host")
            .withColumn("host_ratio", R("host_ratio", 6)))


RANGES = """
ranges AS (SELECT stream_id, idx AS range_id, start AS lo, start + 60 AS hi FROM turns WHERE speaker = 'guest')"""


def chat_ranges(t):
    return t.filter("speaker = 'guest'").select("stream_id", F.col("idx").alias("range_id"),
                                                "start", (F.col("start") + 60).alias("end"))


@query("agg7_range_metrics", f"""
WITH {TURNS}, {RANGES},
m AS (SELECT r.stream_id, r.range_id, t.*, lag(t.speaker) OVER (PARTITION BY r.stream_id, r.range_id ORDER BY t.idx) AS prev
      FROM ranges r JOIN turns t ON r.stream_id = t.stream_id AND t.start BETWEEN r.lo AND r.hi)
SELECT stream_id, range_id,
  CAST(coalesce(sum(word_count) FILTER (WHERE speaker = 'host'), 0) AS BIGINT) AS host_words,
  CAST(coalesce(sum(word_count) FILTER (WHERE speaker <> 'host'), 0) AS BIGINT) AS guest_words,
  1 + count(*) FILTER (WHERE prev <> speaker) AS turns, max_by(speaker = 'host', idx) AS host_last
FROM m GROUP BY stream_id, range_id""")
def agg7_ranges(spark, sf):
    t = turns(spark, sf)
    return (talk.range_metrics(chat_ranges(t), t, F.col("speaker") == "host", range_id="range_id")
            .select("stream_id", "range_id", "host_words", "guest_words", "turns", "host_last"))


@query("agg8_exchanges", f"""
WITH {SIGNALS},
f AS (SELECT *, lag(speaker) OVER (PARTITION BY stream_id ORDER BY start, pos) AS prev FROM signals)
SELECT stream_id, count(*) FILTER (WHERE prev <> speaker) AS exchanges FROM f GROUP BY stream_id""")
def agg8(spark, sf):
    return talk.exchanges(signals(spark, sf), block=by_time("start", 3600))


DOMINANT = """
guests AS (SELECT a.stream_id, a.pos, b.speaker, count(*) AS n, min((b.start, b.pos)) AS first
  FROM signals a JOIN signals b ON a.stream_id = b.stream_id AND b.speaker <> 'click'
   AND b.start BETWEEN a.start - 1800 AND a.start + 1800 GROUP BY ALL),
top_guest AS (SELECT stream_id, pos, speaker, n FROM guests
  QUALIFY row_number() OVER (PARTITION BY stream_id, pos ORDER BY n DESC, first) = 1),
led AS (SELECT s.*, CASE WHEN n >= 3 THEN g.speaker END AS dominant
  FROM signals s LEFT JOIN top_guest g ON s.stream_id = g.stream_id AND s.pos = g.pos)"""


def _as_turns(spark, sf):
    return (signals(spark, sf).withColumn("word_count", F.floor("value").cast("int"))
            .withColumn("idx", F.col("pos")))


@query("win1_rolling_dominance", f"""
WITH {SIGNALS}, {DOMINANT}
SELECT stream_id, pos, dominant FROM led""")
def win1(spark, sf):
    out = conv.rolling_dominance(_as_turns(spark, sf), F.col("speaker") == "click", half_window=1800.0)
    return out.select("stream_id", "pos", "dominant")


CONVS = f"""
WITH {SIGNALS}, {DOMINANT},
filled AS (SELECT *, last_value(dominant IGNORE NULLS) OVER (PARTITION BY stream_id ORDER BY start, pos) AS lead FROM led),
open AS (SELECT *, CASE WHEN lag(lead) OVER (PARTITION BY stream_id ORDER BY start, pos) IS DISTINCT FROM lead THEN 1 ELSE 0 END AS new
         FROM filled WHERE lead IS NOT NULL),
numbered AS (SELECT *, sum(new) OVER (PARTITION BY stream_id ORDER BY start, pos) AS run FROM open),
stretch AS (SELECT stream_id, run, any_value(lead) AS dominant, min(start) AS start, max_by("end", (start, pos)) AS "end",
  sum(CASE WHEN speaker = 'click' THEN floor(value) ELSE 0 END) AS hw,
  sum(CASE WHEN speaker = 'click' THEN 0 ELSE floor(value) END) AS gw,
  count(*) FILTER (WHERE speaker <> 'click') AS tc,
  list(DISTINCT speaker) FILTER (WHERE speaker <> 'click') AS who FROM numbered GROUP BY stream_id, run),
kept AS (SELECT *, CASE WHEN lag(dominant) OVER (PARTITION BY stream_id ORDER BY start) IS DISTINCT FROM dominant THEN 1 ELSE 0 END AS new
         FROM stretch WHERE "end" - start >= 600),
grouped AS (SELECT *, sum(new) OVER (PARTITION BY stream_id ORDER BY start) AS conv_no FROM kept),
convs AS (SELECT stream_id, CAST(conv_no AS BIGINT) AS conv_no, any_value(dominant) AS dominant, min(start) AS start,
  max_by("end", start) AS "end", CAST(sum(hw) AS BIGINT) AS host_words, CAST(sum(gw) AS BIGINT) AS guest_words,
  CAST(sum(tc) AS BIGINT) AS turn_count, list_sort(list_distinct(flatten(list(who)))) AS guests
  FROM grouped GROUP BY stream_id, conv_no)"""


def event_conversations(spark, sf):
    return conv.segment_conversations(_as_turns(spark, sf), F.col("speaker") == "click",
                                      half_window=1800.0, min_duration=600.0)


@query("seq3_conversations", CONVS + """
SELECT stream_id, conv_no, dominant, round(start, 4) AS start, round("end", 4) AS "end", host_words,
       guest_words, turn_count, array_to_string(guests, ',') AS guests, round("end" - start, 4) AS duration
FROM convs""")
def seq3(spark, sf):
    out = event_conversations(spark, sf)
    out = out.withColumn("guests", F.array_join("guests", ","))
    return out.withColumns({c: R(c, 4) for c in ("start", "end", "duration")})


@query("agg6_guests_on_screen", f"""
WITH {FRAMES},
g AS (SELECT stream_id, lower(trim(description)) AS description, min(time) AS first_seen, max(time) AS last_seen,
      count(*) AS frame_count, min((time, i)) AS place FROM people GROUP BY ALL)
SELECT stream_id, description, first_seen, last_seen, frame_count, frame_count * 6e2 AS screen_time,
       row_number() OVER (PARTITION BY stream_id ORDER BY place) AS guest_no
FROM g WHERE frame_count >= 2 AND description <> 'guest 7'""")
def agg6(spark, sf):
    return conv.guests_on_screen(frames(spark, sf), interval=600.0, skip=["Guest 7"])


@query("seq11_guest_conversations", f"""
WITH {FRAMES}, {SEGMENTS.replace(SIGNALS + ',', '')},
g AS (SELECT stream_id, lower(trim(description)) AS description, min(time) AS start, max(time) AS "end",
      count(*) AS frame_count, min((time, i)) AS place FROM people GROUP BY ALL),
h AS (SELECT *, row_number() OVER (PARTITION BY stream_id ORDER BY place) AS guest_no FROM g WHERE frame_count >= 2),
m AS (SELECT h.stream_id, h.guest_no, h.start, h."end", s.seg_start, s.seg_end, s.seg_pos,
        CASE WHEN seg_speaker = 'voice_0' THEN 'host' ELSE 'guest' END AS role
      FROM h JOIN segs s ON h.stream_id = s.stream_id AND s.seg_end > h.start AND s.seg_start < h."end"),
n AS (SELECT *, lag(role) OVER (PARTITION BY stream_id, guest_no ORDER BY seg_start, seg_pos) AS prev FROM m),
t AS (SELECT stream_id, guest_no,
        sum(least(seg_end, "end") - greatest(seg_start, start)) FILTER (WHERE role = 'host') AS ht,
        sum(least(seg_end, "end") - greatest(seg_start, start)) FILTER (WHERE role = 'guest') AS gt,
        count(*) FILTER (WHERE prev <> role) AS ex, min(seg_start) FILTER (WHERE role = 'guest') AS fs,
        max(seg_end) FILTER (WHERE role = 'guest') AS ls FROM n GROUP BY ALL)
SELECT h.stream_id, h.description, h.start, h."end" - h.start AS duration, round(coalesce(ht, 0), 4) AS host_time,
  round(coalesce(gt, 0), 4) AS guest_time, coalesce(ex, 0) AS exchanges, round(fs, 4) AS first_spoke,
  round(ls, 4) AS last_spoke, row_number() OVER (PARTITION BY h.stream_id ORDER BY h.start, h.guest_no) AS conv_no
FROM h LEFT JOIN t ON h.stream_id = t.stream_id AND h.guest_no = t.guest_no WHERE h."end" - h.start >= 1800""")
def seq11(spark, sf):
    out = _guest_convs(spark, sf)
    return out.select("stream_id", "description", "start", "duration", R("host_time", 4).alias("host_time"),
                      R("guest_time", 4).alias("guest_time"), "exchanges",
                      R("first_spoke", 4).alias("first_spoke"), R("last_spoke", 4).alias("last_spoke"), "conv_no")


def _guest_convs(spark, sf):
    return conv.guest_conversations(
        conv.guests_on_screen(frames(spark, sf), interval=600.0), segments(spark, sf),
        label_role(F.col("seg_speaker"), ["voice_0"]), min_duration=1800.0)


@query("agg19_conversation_totals", CONVS + """
SELECT stream_id, count(*) AS conversations, CAST(sum(host_words) AS DOUBLE) AS host_time,
       CAST(sum(guest_words) AS DOUBLE) AS guest_time, round(sum("end" - start), 4) AS covered
FROM convs GROUP BY stream_id""")
def agg19(spark, sf):
    c = (event_conversations(spark, sf).withColumn("host_time", F.col("host_words").cast("double"))
         .withColumn("guest_time", F.col("guest_words").cast("double")))
    return conv.conversation_totals(c).withColumn("covered", R("covered", 4))


@query("seq4_person_timeline", f"""
WITH {FRAMES},
f AS (SELECT stream_id, time, bool_or(description LIKE '%Guest 1%') AS shown FROM people GROUP BY ALL),
n AS (SELECT *, row_number() OVER (PARTITION BY stream_id ORDER BY time)
        - row_number() OVER (PARTITION BY stream_id, shown ORDER BY time) AS island FROM f)
SELECT stream_id, min(time) AS start, max(time) AS "end", count(*) AS frames
FROM n WHERE shown GROUP BY stream_id, island""")
def seq4(spark, sf):
    return conv.person_timeline(frames(spark, sf), "guest 1", block=by_time("time", 7200))


# A name is a word of four letters and more with a capital; the dictionaries are words that occur in the test texts.
ENTITY = r"\p{Lu}\p{Ll}{3,}"
STOP_TERMS = ["the", "and", "that", "les", "des", "une"]
TOPIC_TERMS = ["the", "and", "est", "les", "which", "was", "una", "los", "und", "die"]
HINTS = f"""
named AS (SELECT stream_id, idx, unnest(range(len(m))) AS i, lower(trim(unnest(m))) AS term
  FROM (SELECT stream_id, idx, regexp_extract_all(text, '{ENTITY}') AS m FROM turns)),
plain AS (SELECT stream_id, idx, unnest(range(len(m))) AS i, unnest(m) AS term
  FROM (SELECT stream_id, idx, regexp_extract_all(lower(text), '[a-z]+') AS m FROM turns)),
terms AS (
  SELECT stream_id, term, 2 * count(*) AS score, 0 AS kind, min((idx, i)) AS first FROM named
  WHERE length(term) > 2 AND term NOT IN ({', '.join(repr(s) for s in STOP_TERMS)}) GROUP BY ALL
  UNION ALL
  SELECT p.stream_id, term, count(*), 1, min((idx, i)) FROM plain p
  WHERE term IN ({', '.join(repr(s) for s in TOPIC_TERMS)}) AND NOT EXISTS (
    SELECT 1 FROM named n WHERE n.stream_id = p.stream_id AND n.term = p.term
      AND length(n.term) > 2 AND n.term NOT IN ({', '.join(repr(s) for s in STOP_TERMS)})) GROUP BY ALL),
hints AS (SELECT stream_id, term, score, row_number() OVER (PARTITION BY stream_id ORDER BY score DESC, kind, first) AS rank
  FROM terms QUALIFY rank <= 8)"""


def chat_hints(spark, sf):
    return conv.topic_hints(turns(spark, sf), entity_pattern=ENTITY, stop=STOP_TERMS, topics=TOPIC_TERMS)


@query("agg13_topic_hints", f"""
WITH {TURNS}, {HINTS}
SELECT stream_id, term, score, rank FROM hints""")
def agg13(spark, sf):
    return chat_hints(spark, sf)


@query("agg20_stream_duration", f"""
WITH {SIGNALS},
w AS (SELECT stream_id, max_by("end", pos) AS e, max("end") AS m, count(*) AS n FROM signals GROUP BY ALL)
SELECT stream_id, round(CASE WHEN stream_id % 2 = 0 THEN n * 10.0 ELSE e END, 4) AS duration, round(m, 4) AS max_end FROM w""")
def agg20(spark, sf):
    s = signals(spark, sf)
    meta = s.groupBy("stream_id").agg((F.count(F.lit(1)) * 10.0).alias("_d")).select(
        "stream_id", F.when(F.col("stream_id") % 2 == 0, F.col("_d")).otherwise(0.0).alias("duration"))
    out = conv.stream_duration(s, meta)
    return out.withColumn("duration", R("duration", 4)).withColumn("max_end", R("max_end", 4))


@query("agg12_distinct_people", f"""
WITH {FRAMES}
SELECT stream_id, count(DISTINCT description) AS people, string_agg(DISTINCT description, '|' ORDER BY description) AS names
FROM people GROUP BY stream_id""")
def agg12(spark, sf):
    rows = frames(spark, sf).select("stream_id", F.explode("people.description").alias("d"))
    return (rows.groupBy("stream_id", "d").count().groupBy("stream_id")
            .agg(F.count(F.lit(1)).alias("people"), F.array_sort(F.collect_list("d")).alias("names"))
            .withColumn("names", F.array_join("names", "|")))


@query("prj5_explode_people", f"""
WITH {FRAMES}
SELECT stream_id, time, i, description, position FROM people""")
def prj5(spark, sf):
    return (frames(spark, sf).select("stream_id", "time", F.posexplode("people").alias("i", "p"))
            .select("stream_id", "time", F.col("i").cast("long").alias("i"), "p.description", "p.position"))


@query("prj6_frame_times", f"""
WITH {FRAMES},
f AS (SELECT stream_id, time FROM people GROUP BY ALL)
SELECT stream_id, row_number() OVER w - 1 AS frame_no, (row_number() OVER w - 1) * 3e1 AS event_time FROM f
WINDOW w AS (PARTITION BY stream_id ORDER BY time)""")
def prj6(spark, sf):
    out = running(frames(spark, sf).select("stream_id", "time"), ["stream_id"], ["time"],
                  by_time("time", 7200), sums={"n": F.lit(1).cast("long")})
    return out.select("stream_id", (F.col("n") - 1).alias("frame_no"), ((F.col("n") - 1) * 30.0).alias("event_time"))


@query("flt15_frames_in_range", f"""
WITH {FRAMES}
SELECT stream_id, time, count(*) AS persons FROM people WHERE time BETWEEN 36000 AND 43200 GROUP BY ALL""")
def flt15(spark, sf):
    return (frames(spark, sf).filter(F.col("time").between(36000, 43200))
            .select("stream_id", "time", F.size("people").cast("long").alias("persons")))
