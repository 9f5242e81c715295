"""Window, context and range queries."""

from pyspark.sql import functions as F

from turnwise.catalog import query
from turnwise.catalog.bridges import (CHAT_WORDS, FRAMES, SIGNALS, TURNS, chat_words, frames, signals,
                                      table, turns)
from turnwise.operators import turns as talk
from turnwise.operators import windows as ops
from turnwise.plans.bands import band_join
from turnwise.plans.blocks import by_position, by_time
from turnwise.schema import KEY

R = F.round


def _event_turns(spark, sf):
    return signals(spark, sf).withColumn("idx", F.col("pos")).withColumn("text", F.col("pos").cast("string"))


STAMP = "(floor({0} / 3600)::BIGINT) || ':' || lpad((floor({0} / 60)::BIGINT % 60)::VARCHAR, 2, '0') || ':' || lpad((floor({0})::BIGINT % 60)::VARCHAR, 2, '0')"
LINE = "'[' || " + STAMP.format("start") + " || '] ' || speaker || ': ' || text"

BOUNDS = """
bounds AS (SELECT stream_id, min_by(start, idx) AS s0, max_by("end", idx) AS s1 FROM rows GROUP BY stream_id)"""
EVENT_ROWS = SIGNALS + f""",
rows AS (SELECT *, '[' || {STAMP.format('start')} || '] ' || speaker || ': ' || pos AS line
         FROM (SELECT *, pos AS idx FROM signals))"""


def _slide_sql(size, hop, from_zero, closed):
    anchor = "0" if from_zero else "s0"
    upper = "<=" if closed else "<"
    return f"""
WITH {EVENT_ROWS}, {BOUNDS},
grid AS (SELECT stream_id, {anchor} + k * {hop}e0 AS w_start, least({anchor} + k * {hop}e0 + {size}, s1) AS w_end,
           {anchor} + k * {hop}e0 + {size} AS w_full
         FROM bounds, range(0, 1000) t(k) WHERE {anchor} + k * {hop}e0 < s1),
hit AS (SELECT g.stream_id, g.w_start, g.w_end, count(*) AS turns, string_agg(line, chr(10) ORDER BY idx) AS text
        FROM grid g JOIN rows r ON g.stream_id = r.stream_id AND r.start >= g.w_start
         AND r.start {upper} {'w_end' if closed else 'w_full'} GROUP BY ALL)
SELECT stream_id, row_number() OVER (PARTITION BY stream_id ORDER BY w_start) - 1 AS window_id,
       round(w_start, 4) AS w_start, round(w_end, 4) AS w_end, turns, text FROM hit"""


def _rounded(df, *cols):
    for c in cols:
        df = df.withColumn(c, R(c, 4))
    return df


@query("win2_sliding_windows", _slide_sql(3000, 1800, False, False))
def win2(spark, sf):
    return _rounded(ops.sliding_windows(_event_turns(spark, sf), size=3000.0, hop=1800.0), "w_start", "w_end")


@query("win3_closed_windows", _slide_sql(6000, 4800, True, True))
def win3(spark, sf):
    return _rounded(ops.sliding_windows(_event_turns(spark, sf), size=6000.0, hop=4800.0, from_zero=True,
                                        closed=True), "w_start", "w_end")


CONV_SPANS = """
conv_spans AS (SELECT stream_id, user_id % 4 AS conv_id, min(start) AS s, max("end") AS e FROM signals
               GROUP BY ALL)"""


def _conv_spans(spark, sf):
    return (signals(spark, sf).groupBy("stream_id", (F.col("user_id") % 4).alias("conv_id"))
            .agg(F.min("start").alias("start"), F.max("end").alias("end")))


@query("win4_conversation_chunks", f"""
WITH {EVENT_ROWS}, {CONV_SPANS},
chunks AS (
  SELECT stream_id, conv_id, 0 AS chunk, s AS lo, e AS hi FROM conv_spans WHERE e - s <= 20000
  UNION ALL
  SELECT stream_id, conv_id, k, s + k * 4.8e3, least(s + k * 4.8e3 + 6000, e) FROM conv_spans, range(0, 100) t(k)
  WHERE e - s > 20000 AND s + k * 4.8e3 < e)
SELECT c.stream_id, conv_id, chunk, round(lo, 4) AS lo, round(hi, 4) AS hi, count(*) AS turns,
       string_agg(line, chr(10) ORDER BY idx) AS text
FROM chunks c JOIN rows r ON c.stream_id = r.stream_id AND r.start BETWEEN c.lo AND c.hi
GROUP BY ALL HAVING length(text) >= 40""")
def win4(spark, sf):
    spans = ops.chunk_spans(_conv_spans(spark, sf), conv_id="conv_id", whole_up_to=20_000.0, size=6000.0,
                            overlap=1200.0)
    return _rounded(ops.span_texts(spans, _event_turns(spark, sf), span_id=["conv_id", "chunk"], width=6000.0,
                                   min_chars=40), "lo", "hi")


@query("win5_tumbling_chunks", f"""
WITH {EVENT_ROWS}, {BOUNDS},
hit AS (SELECT r.stream_id, floor((start - s0) / 300) AS k, s0 + floor((start - s0) / 300) * 300 AS c_start,
          least(s0 + (floor((start - s0) / 300) + 1) * 300, s1) AS c_end, count(*) AS turns,
          string_agg(line, chr(10) ORDER BY idx) AS text
        FROM rows r JOIN bounds b ON r.stream_id = b.stream_id WHERE start < s1 GROUP BY ALL),
num AS (SELECT *, row_number() OVER (PARTITION BY stream_id ORDER BY k) - 1 AS chunk_no FROM hit)
SELECT stream_id, round(c_start, 4) AS c_start, round(c_end, 4) AS c_end, turns, text, chunk_no,
       chunk_no // 3 AS batch_no FROM num""")
def win5(spark, sf):
    return _rounded(ops.tumbling_chunks(_event_turns(spark, sf)), "c_start", "c_end")


@query("win8_word_context", f"""
WITH {CHAT_WORDS},
spots AS (SELECT stream_id, pos FROM words WHERE lower(text) IN ('the', 'les', 'und', 'los'))
SELECT s.stream_id, s.pos,
  coalesce(string_agg(w.text, ' ' ORDER BY w.pos) FILTER (WHERE w.pos < s.pos), '') AS context_before,
  coalesce(string_agg(w.text, ' ' ORDER BY w.pos) FILTER (WHERE w.pos > s.pos), '') AS context_after
FROM spots s JOIN words w ON s.stream_id = w.stream_id AND w.pos BETWEEN s.pos - 30 AND s.pos + 30
GROUP BY ALL""")
def win8(spark, sf):
    words = chat_words(spark, sf)
    spots = (words.filter(F.lower("text").isin("the", "les", "und", "los"))
             .select("stream_id", "pos", F.col("pos").alias("first_pos"), F.col("pos").alias("last_pos")))
    return (ops.word_context(words, spots, spot_id="pos")
            .select("stream_id", "pos", "context_before", "context_after"))


@query("win9_char_offsets", f"""
WITH {CHAT_WORDS}
SELECT stream_id, pos, CAST(sum(length(text) + 1) OVER w - length(text) - 1 AS BIGINT) AS char_start,
       CAST(sum(length(text) + 1) OVER w - 1 AS BIGINT) AS char_end
FROM words WINDOW w AS (PARTITION BY stream_id ORDER BY pos)""")
def win9(spark, sf):
    return (ops.char_offsets(chat_words(spark, sf), block=by_position("pos"))
            .select("stream_id", "pos", "char_start", "char_end"))


@query("win11_frame_pairs", f"""
WITH {FRAMES},
f AS (SELECT DISTINCT stream_id, time FROM people),
p AS (SELECT *, row_number() OVER w AS n, lead(time) OVER w AS next_time FROM f WINDOW w AS (PARTITION BY stream_id ORDER BY time))
SELECT stream_id, time, next_time, n - 1 AS pair_no, n * 3e1 AS event_time FROM p WHERE next_time IS NOT NULL""")
def win11(spark, sf):
    return ops.frame_pairs(frames(spark, sf).select("stream_id", "time"), interval=30.0,
                           block=by_time("time", 7200))


@query("flt1_closed_slice", f"""
WITH {TURNS}
SELECT stream_id, idx FROM turns WHERE start BETWEEN 30 AND 90""")
def flt1(spark, sf):
    return turns(spark, sf).filter(F.col("start").between(30, 90)).select("stream_id", "idx")


@query("flt2_half_open_slice", f"""
WITH {TURNS}
SELECT stream_id, idx FROM turns WHERE start >= 30 AND start < 90""")
def flt2(spark, sf):
    return turns(spark, sf).filter("start >= 30 and start < 90").select("stream_id", "idx")


@query("flt3_slack_slice", f"""
WITH {TURNS},
ranges AS (SELECT stream_id, idx AS range_id, start AS lo, "end" + 20 AS hi FROM turns WHERE speaker = 'guest')
SELECT r.stream_id, r.range_id, t.idx FROM ranges r JOIN turns t
  ON r.stream_id = t.stream_id AND t.start >= r.lo AND t."end" <= r.hi + 2""")
def flt3(spark, sf):
    t = turns(spark, sf)
    ranges = t.filter("speaker = 'guest'").select("stream_id", F.col("idx").alias("range_id"),
                                                  F.col("start").alias("lo"), (F.col("end") + 20).alias("hi"))
    side = t.select("stream_id", "idx", F.col("start").alias("_t"), F.col("end").alias("_te"))
    return (band_join(ranges, side, KEY, 60.0, left_range=(F.col("lo"), F.col("hi") + 2),
                      right_range=(F.col("_t"), F.col("_t")), condition=F.col("_te") <= F.col("hi") + 2)
            .select("stream_id", "range_id", "idx"))


@query("flt13_sparse_windows", f"""
SELECT stream_id, window_id, turns FROM ({_slide_sql(3000, 1800, False, False)}) WHERE length(text) >= 30""")
def flt13(spark, sf):
    w = ops.sliding_windows(_event_turns(spark, sf), size=3000.0, hop=1800.0)
    return w.filter(F.length("text") >= 30).select("stream_id", "window_id", "turns")


@query("join5_sentence_before", f"""
WITH {CHAT_WORDS},
p AS (SELECT stream_id, idx, start + 5 AS t FROM turns)
SELECT p.stream_id, p.idx, round(coalesce(
   (SELECT max(w."end") FROM words w WHERE w.stream_id = p.stream_id AND w."end" <= p.t AND right(w.text, 1) IN ('.', '?', '!')),
   (SELECT min(w.start) FROM words w WHERE w.stream_id = p.stream_id)), 4) AS boundary
FROM p""")
def join5_before(spark, sf):
    p = turns(spark, sf).select("stream_id", "idx", (F.col("start") + 5).alias("t"))
    out = ops.sentence_boundary(p, chat_words(spark, sf), point_id="idx", time="t")
    return out.select("stream_id", "idx", R("boundary", 4).alias("boundary"))


@query("join5_sentence_after", f"""
WITH {CHAT_WORDS},
p AS (SELECT stream_id, idx, start + 5 AS t FROM turns)
SELECT p.stream_id, p.idx, round(coalesce(
   (SELECT min(w."end") FROM words w WHERE w.stream_id = p.stream_id AND w.start >= p.t AND right(w.text, 1) IN ('.', '?', '!')),
   (SELECT max(w."end") FROM words w WHERE w.stream_id = p.stream_id)), 4) AS boundary
FROM p""")
def join5_after(spark, sf):
    p = turns(spark, sf).select("stream_id", "idx", (F.col("start") + 5).alias("t"))
    out = ops.sentence_boundary(p, chat_words(spark, sf), point_id="idx", time="t", direction="after")
    return out.select("stream_id", "idx", R("boundary", 4).alias("boundary"))


@query("join12_with_context", f"""
WITH {TURNS},
clips AS (SELECT stream_id, idx AS clip_id, start AS s, "end" AS e FROM turns WHERE speaker = 'host'),
l AS (SELECT stream_id, idx, start AS t, "end" AS te, {LINE} AS line FROM turns)
SELECT c.stream_id, c.clip_id,
  coalesce(string_agg(line, chr(10) ORDER BY idx) FILTER (WHERE t >= greatest(0, s - 40) AND te < s), '') AS text_before,
  coalesce(string_agg(line, chr(10) ORDER BY idx) FILTER (WHERE t >= s AND te <= e + 2), '') AS text_inside,
  coalesce(string_agg(line, chr(10) ORDER BY idx) FILTER (WHERE t > e AND t < e + 40), '') AS text_after
FROM clips c JOIN l ON c.stream_id = l.stream_id GROUP BY ALL""")
def join12(spark, sf):
    t = turns(spark, sf)
    clips = t.filter("speaker = 'host'").select("stream_id", F.col("idx").alias("clip_id"), "start", "end")
    return (ops.with_context(clips, t, clip_id="clip_id", seconds=40.0)
            .select("stream_id", "clip_id", "text_before", "text_inside", "text_after"))


@query("fn12_build_context", f"""
WITH {EVENT_ROWS}, {BOUNDS},
w AS (SELECT * FROM ({_slide_sql(3000, 1800, False, False).replace('round(w_start, 4) AS w_start, round(w_end, 4) AS w_end', 'w_start, w_end')})),
topics AS (SELECT stream_id, 'topic-' || user_id % 6 AS topic_id, 'Topic ' || user_id % 6 AS topic_name, start AS t_start,
             "end" + 60 AS t_end, CASE WHEN user_id % 5 = 0 THEN 'heated' ELSE 'calm' END AS sentiment
           FROM signals WHERE speaker = 'purchase'),
near AS (SELECT w.stream_id, w.window_id, t.*, '[' || {STAMP.format('t_start')} || '-' || {STAMP.format('t_end')} || ']' AS stamp
         FROM w JOIN topics t ON w.stream_id = t.stream_id AND t.t_start <= w.w_end AND w.w_start <= t.t_end),
listed AS (SELECT stream_id, window_id, string_agg('- ' || stamp || ' ' || topic_name || ' (' || topic_id || ') [' || sentiment || ']',
             chr(10) ORDER BY t_start, topic_id) AS txt FROM near GROUP BY ALL),
back1 AS (SELECT stream_id, window_id, topic_id, string_agg(stamp, ' AND ' ORDER BY t_start) AS r, count(*) AS n FROM near GROUP BY ALL),
back2 AS (SELECT stream_id, window_id, string_agg('- ' || topic_id || ': ' || r, chr(10) ORDER BY topic_id) AS txt FROM back1 WHERE n >= 2 GROUP BY ALL)
SELECT w.stream_id, w.window_id, concat_ws(chr(10) || chr(10), 'TOPICS' || chr(10) || coalesce(l.txt, '(none)'),
   'RETURNING' || chr(10) || b.txt, 'REQUEST' || chr(10) || 'prices', 'TURNS' || chr(10) || w.text) AS context
FROM w LEFT JOIN listed l USING (stream_id, window_id) LEFT JOIN back2 b USING (stream_id, window_id)""")
def fn12(spark, sf):
    s = signals(spark, sf)
    group = (F.col("user_id") % 6).cast("string")
    topics = s.filter("speaker = 'purchase'").select(
        "stream_id", F.concat(F.lit("topic-"), group).alias("topic_id"),
        F.concat(F.lit("Topic "), group).alias("topic_name"), F.col("start").alias("t_start"),
        (F.col("end") + 60).alias("t_end"),
        F.when(F.col("user_id") % 5 == 0, "heated").otherwise("calm").alias("sentiment"))
    w = ops.sliding_windows(_event_turns(spark, sf), size=3000.0, hop=1800.0)
    return ops.build_context(w, topics, query="prices")


@query("top3_group_caps", f"""
WITH {TURNS},
r AS (SELECT stream_id, speaker, idx, row_number() OVER (PARTITION BY stream_id, speaker ORDER BY word_count DESC, idx) AS rank FROM turns)
SELECT * FROM r WHERE rank <= 2""")
def top3(spark, sf):
    return (talk.top_per_stream(turns(spark, sf), [F.desc("word_count"), F.asc("idx")], 2, keys=["stream_id", "speaker"])
            .select("stream_id", "speaker", "idx", "rank"))


@query("top4_text_budget", """
SELECT doc_id, CASE WHEN length(text) > 800 THEN left(text, 800) || chr(10) || '[... truncated ...]' ELSE text END AS text
FROM documents""")
def top4(spark, sf):
    return (table(spark, sf, "documents")
            .select("doc_id", ops.budget_text(F.col("text"), 800).alias("text")))
