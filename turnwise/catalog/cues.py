"""Cue queries over the words of the chats."""

from pyspark.sql import functions as F

from turnwise.catalog import query
from turnwise.catalog.bridges import CHAT_WORDS, SIGNALS, TURNS, chat_words, signals, turns
from turnwise.operators import cues as ops

R = F.round

# Phrases made of words that occur in the test texts.
PATTERNS = [
    ops.Pattern("of_the", "intro", r"of\s+the", 0.9),
    ops.Pattern("in_or_by", "welcome", r"(?:in|by)\s+(?:the|of|and)", 0.8),
    ops.Pattern("und_die", "exit", r"und|die", 0.85),
    ops.Pattern("les_la", "farewell", r"(?:les|des)\s+(?:la|le|une)"),
    ops.Pattern("the_x_of", "exit", r"the\s+\S+\s+of", 0.85),
]
LONE = ["und", "die"]


def hits_sql(patterns):
    parts = [f"""
  SELECT stream_id, '{p.name}' AS pattern, '{p.cue_type}' AS cue_type, CAST({p.base} AS DOUBLE) AS base, pos AS first_pos, start, speaker,
         regexp_extract(shingle, '{ops.anchored(p.regex)}', 1) AS phrase
  FROM sh WHERE regexp_matches(shingle, '{ops.anchored(p.regex)}')""" for p in patterns]
    return f"""{CHAT_WORDS},
sh AS (SELECT *, string_agg(text, ' ') OVER (PARTITION BY stream_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND 7 FOLLOWING) AS shingle FROM words),
hits0 AS ({' UNION ALL '.join(parts)}),
hits1 AS (SELECT *, first_pos + len(regexp_extract_all(phrase, '\\S+')) - 1 AS last_pos FROM hits0),
nth AS (SELECT *, row_number() OVER (PARTITION BY stream_id, pattern ORDER BY first_pos) AS n FROM hits1),
walk AS (
  SELECT stream_id, pattern, n, true AS kept, last_pos AS upto FROM nth WHERE n = 1
  UNION ALL
  SELECT x.stream_id, x.pattern, x.n, x.first_pos > w.upto, CASE WHEN x.first_pos > w.upto THEN x.last_pos ELSE w.upto END
  FROM walk w JOIN nth x ON x.stream_id = w.stream_id AND x.pattern = w.pattern AND x.n = w.n + 1),
hits AS (SELECT x.*, (x.last_pos + 1) * 3e-1 AS "end",
    round(CASE WHEN lower(trim(phrase)) IN ('und', 'die') THEN 0.7e0 ELSE 1e0 END
      * CASE WHEN len(regexp_extract_all(phrase, '\\S+')) >= 3 THEN least(1, base + 1e-1) ELSE base END, 3) AS confidence,
    pattern || '/' || x.first_pos AS cue_id
  FROM nth x JOIN walk w USING (stream_id, pattern, n) WHERE w.kept)"""


HITS = hits_sql(PATTERNS)


def _cues(spark, sf):
    words = chat_words(spark, sf)
    return (ops.match_cues(words, PATTERNS)
            .withColumn("confidence", ops.cue_confidence(F.col("phrase"), F.col("base"), LONE))
            .withColumn("cue_id", F.concat_ws("/", F.col("pattern"), F.col("first_pos"))))


@query("scr1_match_cues", f"""
WITH RECURSIVE {HITS}
SELECT stream_id, pattern, cue_type, first_pos, last_pos, round(start, 4) AS start, round("end", 4) AS "end", speaker, phrase
FROM hits""")
def scr1(spark, sf):
    return (_cues(spark, sf).select("stream_id", "pattern", "cue_type", "first_pos", "last_pos",
                                    R("start", 4).alias("start"), R("end", 4).alias("end"), "speaker", "phrase"))


@query("scr2_cue_confidence", f"""
WITH RECURSIVE {HITS}
SELECT pattern, confidence, count(*) AS n FROM hits GROUP BY ALL""")
def scr2(spark, sf):
    return _cues(spark, sf).groupBy("pattern", "confidence").agg(F.count(F.lit(1)).alias("n"))


DEDUP = """
cue_n AS (SELECT *, row_number() OVER (PARTITION BY stream_id ORDER BY start, cue_id) AS k FROM hits),
fold AS (
  SELECT stream_id, k, k AS cur, cue_type, start, confidence, NULL::BIGINT AS closed FROM cue_n WHERE k = 1
  UNION ALL
  SELECT c.stream_id, c.k,
    CASE WHEN near AND c.confidence <= f.confidence THEN f.cur ELSE c.k END,
    CASE WHEN near AND c.confidence <= f.confidence THEN f.cue_type ELSE c.cue_type END,
    CASE WHEN near AND c.confidence <= f.confidence THEN f.start ELSE c.start END,
    CASE WHEN near AND c.confidence <= f.confidence THEN f.confidence ELSE c.confidence END,
    CASE WHEN near THEN NULL ELSE f.cur END
  FROM (SELECT f.*, c.k AS ck, abs(c.start - f.start) < 5 AND c.cue_type = f.cue_type AS near
        FROM fold f JOIN cue_n c ON c.stream_id = f.stream_id AND c.k = f.k + 1) f
  JOIN cue_n c ON c.stream_id = f.stream_id AND c.k = f.ck),
winners AS (
  SELECT stream_id, closed AS k FROM fold WHERE closed IS NOT NULL
  UNION ALL
  SELECT stream_id, max_by(cur, k) FROM fold GROUP BY stream_id),
cues AS (SELECT c.* FROM cue_n c JOIN winners w USING (stream_id, k))"""


@query("seq5_cue_dedup", f"""
WITH RECURSIVE {HITS}, {DEDUP}
SELECT stream_id, cue_id, cue_type, round(start, 4) AS start, confidence FROM cues""")
def seq5(spark, sf):
    return (ops.dedup_cues(_cues(spark, sf))
            .select("stream_id", "cue_id", "cue_type", R("start", 4).alias("start"), "confidence"))


@query("scr3_cue_validation", f"""
WITH RECURSIVE {HITS},
a AS (SELECT *, first_pos % 4 AS m FROM hits)
SELECT stream_id, cue_id, m = 0 OR m = 1 OR (m = 2 AND last_pos % 2 = 0) AS is_genuine,
  round(CASE WHEN m = 0 THEN confidence * 0.7e0 WHEN m = 1 THEN confidence * 0.8e0
       WHEN m = 2 AND last_pos % 2 = 0 THEN coalesce(CASE WHEN last_pos % 3 = 0 THEN 0.55e0 END, confidence) ELSE 0 END, 6) AS final_confidence
FROM a""")
def scr3(spark, sf):
    cues = _cues(spark, sf)
    m = F.col("first_pos") % 4
    answers = cues.filter(m != 0).select(
        "stream_id", "cue_id", (m != 1).alias("readable"),
        F.when(m == 3, "false_positive").alias("verdict"),
        F.when(m == 2, F.col("last_pos") % 2 == 0).alias("genuine"),
        F.when(F.col("last_pos") % 3 == 0, 0.55).alias("sure"))
    return (ops.validate_cues(cues, answers)
            .select("stream_id", "cue_id", "is_genuine", R("final_confidence", 6).alias("final_confidence")))


@query("flt6_confident_cues", f"""
WITH RECURSIVE {HITS}
SELECT stream_id, cue_id FROM hits WHERE confidence >= 0.8""")
def flt6(spark, sf):
    return _cues(spark, sf).filter(F.col("confidence") >= 0.8).select("stream_id", "cue_id")


@query("flt7_cue_groups", f"""
WITH RECURSIVE {HITS}
SELECT stream_id, cue_id, cue_type FROM hits WHERE cue_type IN ('intro', 'welcome') AND start BETWEEN 10 AND 60""")
def flt7(spark, sf):
    return (_cues(spark, sf).filter(F.col("cue_type").isin(*ops.ARRIVALS) & F.col("start").between(10, 60))
            .select("stream_id", "cue_id", "cue_type"))


@query("agg15_cue_counts", f"""
WITH RECURSIVE {HITS}
SELECT stream_id, count(*) FILTER (WHERE cue_type IN ('intro', 'welcome')) AS arrivals,
       count(*) FILTER (WHERE cue_type IN ('exit', 'farewell')) AS departures FROM hits GROUP BY stream_id""")
def agg15(spark, sf):
    return ops.cue_counts(_cues(spark, sf))


@query("join7_correlate", f"""
WITH RECURSIVE {HITS},
c AS (SELECT * FROM hits WHERE cue_type IN ('intro', 'welcome')),
v AS (SELECT stream_id, idx, start AS vt, speaker AS vs FROM turns),
m AS (SELECT c.stream_id, cue_id, cue_type, vt, vs, abs(vt - c.start) AS d,
        row_number() OVER (PARTITION BY c.stream_id, cue_id ORDER BY abs(vt - c.start), vt, idx) AS rk
      FROM c JOIN v ON c.stream_id = v.stream_id AND abs(vt - c.start) <= 9)
SELECT stream_id, cue_id, cue_type, round(vt, 4) AS voice_time, vs AS voice_speaker, round(d, 4) AS distance,
       round(1 - d / 9, 4) AS strength FROM m WHERE rk = 1""")
def join7(spark, sf):
    v = turns(spark, sf).select("stream_id", F.col("idx").alias("v_pos"), F.col("start").alias("v_time"),
                                F.col("speaker").alias("v_speaker"))
    out = ops.correlate(_cues(spark, sf), v, window=9.0)
    for c in ("voice_time", "distance", "strength"):
        out = out.withColumn(c, R(c, 4))
    return out


@query("cue_report", f"""
WITH RECURSIVE {HITS.replace('hits AS (', 'all_hits AS (')},
hits AS (SELECT * FROM all_hits WHERE confidence >= 0.65), {DEDUP}
SELECT c.stream_id, c.cue_id, c.cue_type, c.phrase, c.confidence,
  coalesce(string_agg(w.text, ' ' ORDER BY w.pos) FILTER (WHERE w.pos < c.first_pos), '') AS context_before,
  coalesce(string_agg(w.text, ' ' ORDER BY w.pos) FILTER (WHERE w.pos > c.last_pos), '') AS context_after
FROM cues c JOIN words w ON w.stream_id = c.stream_id AND w.pos BETWEEN c.first_pos - 30 AND c.last_pos + 30 GROUP BY ALL""")
def cue_report(spark, sf):
    """Cues as the detection job delivers them, context included."""
    return (ops.detect_cues(chat_words(spark, sf), PATTERNS, lone=LONE, min_confidence=0.65)
            .select("stream_id", "cue_id", "cue_type", "phrase", "confidence", "context_before", "context_after"))
