"""Scoring and filter queries."""

from pyspark.sql import functions as F

from turnwise.catalog import query
from turnwise.catalog.bridges import CANDIDATES, TOPIC_BLOCKS, TURNS, candidates, table, topic_blocks, turns
from turnwise.catalog.conversations import HINTS, RANGES, chat_hints, chat_ranges
from turnwise.operators import scoring as ops
from turnwise.operators import topics as topic_ops
from turnwise.operators import turns as talk
from turnwise.plans.blocks import ranked

R = F.round

# Criteria made up for these queries: scores are digits of the row's numbers.
PROFILE = [ops.Criterion("evidence", 2, 0), ops.Criterion("novelty", 4, 3), ops.Criterion("tension", 3, 2),
           ops.Criterion("depth", 2, 1), ops.Criterion("humor", 1, 2)]

# ---- talk figures of 60 s ranges -------------------------------------------------------------

FIGURES = f"""
WITH {TURNS}, {RANGES},
m AS (SELECT r.stream_id, r.range_id, r.lo, r.hi, t.idx, t.speaker, t.word_count,
        lag(t.speaker) OVER (PARTITION BY r.stream_id, r.range_id ORDER BY t.idx) AS prev
      FROM ranges r JOIN turns t ON r.stream_id = t.stream_id AND t.start BETWEEN r.lo AND r.hi),
figs AS (SELECT stream_id, range_id, any_value(hi) - any_value(lo) AS duration,
  coalesce(sum(word_count) FILTER (WHERE speaker = 'host'), 0) / greatest(sum(word_count), 1) AS ratio,
  coalesce(sum(word_count) FILTER (WHERE speaker <> 'host'), 0) AS gw,
  1 + count(*) FILTER (WHERE prev <> speaker) AS turns, max_by(speaker = 'host', idx) AS host_last
  FROM m GROUP BY stream_id, range_id),
scored AS (SELECT *, round(least(100, CASE WHEN host_last THEN 20 ELSE 0 END
   + CASE WHEN ratio BETWEEN 0.45 AND 0.75 THEN 25 WHEN ratio <= 0.85 THEN 15 ELSE 0 END + least(25, turns * 2.5e0)
   + CASE WHEN duration BETWEEN 60 AND 180 THEN 15 WHEN duration BETWEEN 30 AND 300 THEN 8 ELSE 0 END
   + CASE WHEN gw >= 30 THEN 15 WHEN gw >= 20 THEN 5 ELSE 0 END), 1) AS programmatic FROM figs)"""


def _figures(spark, sf):
    t = turns(spark, sf)
    f = talk.range_metrics(chat_ranges(t), t, F.col("speaker") == "host", range_id="range_id")
    return f.withColumn("programmatic", ops.programmatic_score(
        F.col("host_last"), F.col("host_ratio"), F.col("turns"), F.col("guest_words"), F.col("end") - F.col("start")))


@query("scr4_programmatic_score", FIGURES + """
SELECT stream_id, range_id, programmatic FROM scored""")
def scr4(spark, sf):
    return _figures(spark, sf).select("stream_id", "range_id", "programmatic")


@query("scr7_blended_rank", FIGURES + """
SELECT stream_id, range_id, round((range_id % 10) * 6 + programmatic / 10 * 4, 4) AS blended FROM scored""")
def scr7(spark, sf):
    return _figures(spark, sf).select(
        "stream_id", "range_id",
        R(ops.blended_rank((F.col("range_id") % 10).cast("double"), F.col("programmatic")), 4).alias("blended"))


@query("top2_candidate_cap", FIGURES + """
SELECT stream_id, range_id, row_number() OVER (PARTITION BY stream_id
   ORDER BY round((range_id % 10) * 6 + programmatic / 10 * 4, 4) DESC, range_id) AS rank
FROM scored QUALIFY rank <= 2""")
def top2(spark, sf):
    f = _figures(spark, sf).withColumn("blended", R(ops.blended_rank(
        (F.col("range_id") % 10).cast("double"), F.col("programmatic")), 4))
    return (talk.top_per_stream(f, [F.desc("blended"), F.asc("range_id")], 2)
            .select("stream_id", "range_id", "rank"))


@query("flt8_hard_filter", FIGURES + """
SELECT stream_id, range_id,
  CASE WHEN (stream_id + range_id) % 11 = 0 THEN 'no segments' WHEN (stream_id + range_id) % 11 = 1 THEN 'invalid timestamps'
       WHEN duration - 4 * ((stream_id + range_id) % 11) < 30 THEN 'too short' WHEN ratio > 0.85 THEN 'monologue'
       WHEN turns < 2 THEN 'not enough back-and-forth' WHEN gw < 20 THEN 'guest barely spoke'
       WHEN range_id % 4 = 0 THEN 'no claim' ELSE 'passed' END AS reason
FROM figs""")
def flt8(spark, sf):
    m = (F.col("stream_id") + F.col("range_id")) % 11
    c = (_figures(spark, sf).withColumn("segments", F.when(m == 0, 0).otherwise(1))
         .withColumn("end", F.when(m != 1, F.col("end") - 4 * m))
         .withColumn("claim", F.when(F.col("range_id") % 4 != 0, "a claim")))
    return ops.hard_filter(c, min_turns=2).select("stream_id", "range_id", "reason")


@query("flt9_energy_filter", f"""
WITH {TURNS},
f AS (SELECT *, lag(speaker) OVER (PARTITION BY stream_id ORDER BY idx) AS prev FROM turns),
e AS (SELECT stream_id, 1 + count(*) FILTER (WHERE prev <> speaker) AS turns,
  coalesce(sum(word_count) FILTER (WHERE speaker = 'host'), 0) / greatest(sum(word_count), 1) AS ratio FROM f GROUP BY stream_id)
SELECT stream_id, turns, round(ratio, 6) AS host_ratio FROM e WHERE ratio >= 0.15 AND turns >= 3""")
def flt9(spark, sf):
    figures = talk.talk_metrics(turns(spark, sf), F.col("speaker") == "host")
    return ops.energetic(figures).select("stream_id", "turns", R("host_ratio", 6).alias("host_ratio"))


# ---- scored candidates: orders with scores derived from their numbers ---------------------------

SCORED = f"""
WITH {CANDIDATES},
c AS (SELECT *, "end" - start AS duration, cand_id % 10 AS novelty, CASE WHEN cand_id % 7 <> 0 THEN stream_id % 10 END AS tension,
        (cand_id // 10) % 10 AS depth, (cand_id // 100) % 10 AS evidence, status = 'F' AS host_last,
        CASE WHEN cand_id % 27 <> 0 THEN (cand_id % 13) / 2e0 END AS preliminary, cand_id % 9 = 0 AS unscored
      FROM candidates),
w AS (SELECT *, (evidence * 2 + novelty * 4 + coalesce(tension, 5) * 3 + depth * 2 + 5) / 12e0 * 10 AS weighted FROM c),
s AS (SELECT *, CASE WHEN unscored THEN coalesce(preliminary, 5) * 10 ELSE weighted
   + CASE WHEN duration BETWEEN 55 AND 1500 THEN 3 WHEN duration > 4000 THEN -10 ELSE 0 END
   + CASE WHEN host_last THEN 2 ELSE 0 END END AS composite FROM w)"""
LENGTHS = ops.Lengths(25.0, 4000.0, 55.0, 1500.0)


def _scored(spark, sf):
    c = candidates(spark, sf)
    given = F.create_map(F.lit("novelty"), (F.col("cand_id") % 10).cast("double"),
                         F.lit("depth"), (F.floor(F.col("cand_id") / 10) % 10).cast("double"),
                         F.lit("evidence"), (F.floor(F.col("cand_id") / 100) % 10).cast("double"))
    tension = F.create_map(F.lit("tension"), (F.col("stream_id") % 10).cast("double"))
    scores = F.when(F.col("cand_id") % 9 == 0, None).when(F.col("cand_id") % 7 != 0, F.map_concat(given, tension)).otherwise(given)
    c = (c.withColumn("scores", scores).withColumn("host_last", F.col("status") == "F")
         .withColumn("preliminary", F.when(F.col("cand_id") % 27 != 0, (F.col("cand_id") % 13) / 2)))
    return c.withColumn("composite", ops.composite(F.col("scores"), F.col("end") - F.col("start"), F.col("host_last"),
                                                   F.col("preliminary"), PROFILE, LENGTHS))


@query("scr5_composite", SCORED + """
SELECT stream_id, cand_id, round(composite, 4) AS composite FROM s""")
def scr5(spark, sf):
    return _scored(spark, sf).select("stream_id", "cand_id", R("composite", 4).alias("composite"))


@query("join11_profile_lookup", SCORED + """
SELECT cand_id, CAST(CASE WHEN unscored THEN 5 ELSE novelty END AS DOUBLE) AS novelty,
       CAST(CASE WHEN unscored THEN 5 ELSE coalesce(tension, 5) END AS DOUBLE) AS tension,
       CAST(5 AS DOUBLE) AS humor FROM s""")
def join11(spark, sf):
    return _scored(spark, sf).select("cand_id", *[ops.score_of(F.col("scores"), n).alias(n) for n in ("novelty", "tension", "humor")])


@query("flt10_dealbreakers", SCORED + """
SELECT cand_id, CASE WHEN NOT unscored AND novelty < 3 THEN 'dealbreaker: novelty' WHEN NOT unscored AND coalesce(tension, 5) < 2 THEN 'dealbreaker: tension'
   WHEN NOT unscored AND depth < 1 THEN 'dealbreaker: depth' WHEN priority = '1-URGENT' THEN 'anti-patterns'
   WHEN status = 'P' THEN 'mandatory requirements' END AS failure FROM s""")
def flt10(spark, sf):
    anti = F.when(F.col("priority") == "1-URGENT", F.array(F.lit("rush"))).otherwise(F.array().cast("array<string>"))
    return _scored(spark, sf).select("cand_id", ops.first_failure(
        F.col("scores"), anti, F.col("status") != "P", PROFILE).alias("failure"))


@query("flt11_score_floor", SCORED + """
SELECT stream_id, cand_id FROM s WHERE composite >= 45""")
def flt11(spark, sf):
    return _scored(spark, sf).filter("composite >= 45").select("stream_id", "cand_id")


@query("scr6_rescore", SCORED + """
SELECT stream_id, cand_id, CASE WHEN cand_id % 4 = 0 THEN start + 5 ELSE start END AS start,
  CASE WHEN cand_id % 4 = 0 THEN start + 65 ELSE "end" END AS "end",
  round(CASE WHEN cand_id % 8 = 0 THEN
     (CASE WHEN unscored THEN 5 * 2 + 5 * 4 + 9 * 3 + 5 * 2 + 1 ELSE evidence * 2 + novelty * 4 + 9 * 3 + depth * 2 + 1 END) / 12e0 * 10
     + CASE WHEN CASE WHEN cand_id % 4 = 0 THEN 60 ELSE duration END BETWEEN 55 AND 1500 THEN 3 ELSE 0 END
     + CASE WHEN host_last THEN 2 ELSE 0 END
   ELSE composite END, 4) AS composite
FROM s WHERE cand_id % 20 <> 10""")
def scr6(spark, sf):
    c = _scored(spark, sf)
    reviews = c.filter(F.col("cand_id") % 2 == 0).select(
        "stream_id", "cand_id", F.when(F.col("cand_id") % 4 == 0, F.col("start") + 5).alias("new_start"),
        F.when(F.col("cand_id") % 4 == 0, F.col("start") + 65).alias("new_end"),
        F.when(F.col("cand_id") % 8 == 0, F.create_map(F.lit("tension"), F.lit(9.0), F.lit("humor"), F.lit(1.0))).alias("new_scores"),
        (F.col("cand_id") % 20 != 10).alias("keep"))
    return (ops.rescore(c, reviews, PROFILE, LENGTHS, cand_id="cand_id")
            .select("stream_id", "cand_id", "start", "end", R("composite", 4).alias("composite")))


@query("scr8_verdict_gate", SCORED + """
, v AS (SELECT *, CASE cand_id % 4 WHEN 0 THEN 'affirm' WHEN 1 THEN 'deny' WHEN 2 THEN 'unclear' END AS verdict, (cand_id % 10) / 1e1 AS conf FROM s)
SELECT stream_id, cand_id, round(composite + CASE WHEN composite < 65 AND verdict = 'affirm' AND conf > 0.7 THEN 5 ELSE 0 END, 4) AS composite,
  CASE WHEN composite >= 65 THEN 'auto_pass' WHEN verdict IS NULL THEN 'skipped' ELSE 'kept' END AS gate
FROM v WHERE NOT (composite < 65 AND coalesce(verdict = 'deny' AND conf >= 0.7, false))""")
def scr8(spark, sf):
    c = _scored(spark, sf)
    m = F.col("cand_id") % 4
    verdicts = c.filter(m != 3).select("stream_id", "cand_id", F.when(m == 0, "affirm").when(m == 1, "deny").otherwise("unclear").alias("verdict"),
                                       ((F.col("cand_id") % 10) / 10).alias("v_confidence"))
    return (ops.verdict_gate(c, verdicts, cand_id="cand_id")
            .select("stream_id", "cand_id", R("composite", 4).alias("composite"), "gate"))


@query("scr6_rescore_talk", f"""
WITH {TURNS}, {RANGES},
e AS (SELECT stream_id, range_id, CASE WHEN range_id % 2 = 0 THEN lo + 7 ELSE lo END AS lo, CASE WHEN range_id % 3 = 0 THEN hi - 11 ELSE hi END AS hi FROM ranges),
m AS (SELECT e.stream_id, e.range_id, t.idx, t.speaker, t.word_count, lag(t.speaker) OVER (PARTITION BY e.stream_id, e.range_id ORDER BY t.idx) AS prev
      FROM e JOIN turns t ON e.stream_id = t.stream_id AND t.start BETWEEN e.lo AND e.hi),
f AS (SELECT stream_id, range_id, coalesce(sum(word_count) FILTER (WHERE speaker = 'host'), 0) / greatest(sum(word_count), 1) AS ratio,
        1 + count(*) FILTER (WHERE prev <> speaker) AS n, max_by(speaker = 'host', idx) AS host_last FROM m GROUP BY stream_id, range_id)
SELECT e.stream_id, e.range_id, round(e.lo, 4) AS start, round(e.hi, 4) AS "end", round(coalesce(ratio, 0), 6) AS host_ratio,
  coalesce(n, 0) AS turns, coalesce(host_last, false) AS host_last, round(50 + CASE WHEN e.hi - e.lo BETWEEN 40 AND 55 THEN 3 ELSE 0 END
    + CASE WHEN coalesce(host_last, false) THEN 2 ELSE 0 END, 4) AS composite
FROM e LEFT JOIN f USING (stream_id, range_id)""")
def scr6_talk(spark, sf):
    """Ranges with ends moved by a review: talk figures and composite are those of the new ends."""
    t = turns(spark, sf)
    host = F.col("speaker") == "host"
    c = talk.range_metrics(chat_ranges(t), t, host, range_id="range_id").withColumns({
        "scores": F.create_map(F.lit("novelty"), F.lit(5.0)), "preliminary": F.lit(5.0), "composite": F.lit(0.0)})
    reviews = c.select("stream_id", "range_id", F.when(F.col("range_id") % 2 == 0, F.col("start") + 7).alias("new_start"),
                       F.when(F.col("range_id") % 3 == 0, F.col("end") - 11).alias("new_end"),
                       F.create_map(F.lit("humor"), F.lit(5.0)).alias("new_scores"), F.lit(True).alias("keep"))
    out = ops.rescore(c, reviews, PROFILE, ops.Lengths(10.0, 300.0, 40.0, 55.0), cand_id="range_id", turns=t, is_host=host)
    return out.select("stream_id", "range_id", R("start", 4).alias("start"), R("end", 4).alias("end"),
                      R("host_ratio", 6).alias("host_ratio"), "turns", "host_last", R("composite", 4).alias("composite"))


STORY = """round(CASE WHEN cand_id % 3 = 0 THEN raw * 0.8e0 WHEN cand_id % 5 = 0 THEN (raw + checked) / 2 * 0.6e0 ELSE (raw + checked) / 2 END, 1)"""


@query("scr9_story_score", SCORED + f"""
, t AS (SELECT cand_id, coalesce(preliminary, 4e0) AS raw, CASE WHEN cand_id % 11 = 0 THEN 5e0 ELSE novelty END AS checked FROM s)
SELECT cand_id, {STORY} AS score FROM t WHERE {STORY} >= 2.5e0""")
def scr9(spark, sf):
    """Every third story is unchecked, every eleventh check gives no score."""
    checked = F.when(F.col("cand_id") % 11 != 0, (F.col("cand_id") % 10).cast("double"))
    score = ops.story_score(F.coalesce("preliminary", F.lit(4.0)), checked, F.col("cand_id") % 5 != 0, F.col("cand_id") % 3 != 0)
    return _scored(spark, sf).select("cand_id", score.alias("score")).filter("score >= 2.5")


@query("flt12_valid_stories", f"""
WITH {CANDIDATES}
SELECT stream_id, count(*) AS segments, round(sum(round(("end" - start) / 10, 2)), 2) AS total_duration FROM candidates
WHERE ("end" - start) / 10 BETWEEN 5 AND 300 GROUP BY stream_id
HAVING count(*) >= 2 AND sum(round(("end" - start) / 10, 2)) BETWEEN 30 AND 600""")
def flt12(spark, sf):
    segs = candidates(spark, sf).select("stream_id", F.lit(0.0).alias("start"), ((F.col("end") - F.col("start")) / 10).alias("end"))
    out = ops.valid_stories(segs, keys=["stream_id"])
    return out.withColumn("total_duration", R("total_duration", 2))


@query("scr22_audit_trail", SCORED + """
, t AS (SELECT *, CASE WHEN NOT unscored AND novelty < 3 THEN 'dealbreaker: novelty' WHEN NOT unscored AND coalesce(tension, 5) < 2 THEN 'dealbreaker: tension'
   WHEN NOT unscored AND depth < 1 THEN 'dealbreaker: depth' WHEN status = 'P' THEN 'mandatory requirements' END AS failure FROM s)
SELECT cand_id, concat_ws(' > ', 'detect FOUND', 'score ' || CASE WHEN unscored THEN 'FALLBACK' ELSE 'SCORED' END,
   CASE WHEN failure IS NULL THEN 'filter PASSED' ELSE 'filter REJECTED ' || failure END,
   CASE WHEN failure IS NULL AND composite >= 65 THEN 'gate AUTO_PASS' END) AS trail FROM t""")
def scr22(spark, sf):
    """Every candidate with the passes it went through."""
    c = _scored(spark, sf)
    failure = ops.first_failure(F.col("scores"), F.array().cast("array<string>"), F.col("status") != "P", PROFILE)
    steps = c.withColumn("failure", failure).select("cand_id", ops.trail(
        ("detect", F.lit("FOUND"), {"preliminary": F.col("preliminary")}),
        ("score", F.when(F.col("scores").isNull(), "FALLBACK").otherwise("SCORED"), {"composite": R("composite", 1)}),
        ("filter", F.when(F.col("failure").isNull(), "PASSED").otherwise("REJECTED"), {"reason": F.col("failure")}),
        ("gate", F.when(F.col("failure").isNull() & (F.col("composite") >= 65), F.lit("AUTO_PASS")), {})).alias("trail"))
    line = F.transform("trail", lambda e: F.concat_ws(" ", e["pass"], e["result"], e["details"]["reason"]))
    return steps.select("cand_id", F.array_join(line, " > ").alias("trail"))


# ---- segments of clips: lines of an order ------------------------------------------------------

SEGS = """
lines AS (SELECT l_orderkey AS stream_id, l_linenumber AS seg_no,
    sum(l_quantity) * 1e1 AS q, min(l_partkey) AS p, max(l_discount) AS d FROM lineitem GROUP BY ALL),
csegs AS (SELECT stream_id, 1 AS cand_id, seg_no, seg_no * 1e2 + p % 40 AS start, seg_no * 1e2 + p % 40 + q / 4 + 10 AS "end",
    CASE p % 5 WHEN 0 THEN 'knockout' WHEN 1 THEN 'counter' WHEN 2 THEN 'setup' ELSE 'exchange' END AS purpose, d FROM lines)"""


def _clip_segments(spark, sf):
    lines = (table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("stream_id"), F.col("l_linenumber").alias("seg_no"))
             .agg((F.sum("l_quantity") * 10).alias("q"), F.min("l_partkey").alias("p"), F.max("l_discount").alias("d")))
    m = F.col("p") % 5
    return lines.select("stream_id", F.lit(1).cast("long").alias("cand_id"), "seg_no",
                        (F.col("seg_no") * 100.0 + F.col("p") % 40).alias("start"),
                        (F.col("seg_no") * 100.0 + F.col("p") % 40 + F.col("q") / 4 + 10).alias("end"),
                        F.when(m == 0, "knockout").when(m == 1, "counter").when(m == 2, "setup").otherwise("exchange").alias("purpose"), "d")


MERGED = """
big AS (SELECT *, CASE WHEN start - lag("end") OVER (PARTITION BY stream_id ORDER BY seg_no) < 20 THEN 0 ELSE 1 END AS new
        FROM {0} WHERE "end" - start >= 15),
grp AS (SELECT *, sum(new) OVER (PARTITION BY stream_id ORDER BY seg_no) AS run FROM big),
seg8 AS (SELECT stream_id, min(seg_no) AS seg_no, min_by(start, seg_no) AS start, max_by("end", seg_no) AS "end",
   coalesce(max_by(purpose, seg_no) FILTER (WHERE purpose IN ('knockout', 'counter')), min_by(purpose, seg_no)) AS purpose,
   round(max_by("end", seg_no) - min_by(start, seg_no), 2) AS duration FROM grp GROUP BY stream_id, run),
kept8 AS (SELECT *, sum(duration) OVER (PARTITION BY stream_id) AS total, count(*) OVER (PARTITION BY stream_id) AS n FROM seg8)"""


@query("seq8_merge_segments", f"""
WITH {SEGS}, {MERGED.format('csegs')}
SELECT stream_id, seg_no, start, "end", purpose, duration, round(total, 2) AS kept,
       CASE WHEN n = 1 THEN 'continuous' ELSE 'composite' END AS assembly FROM kept8 WHERE total >= 30""")
def seq8(spark, sf):
    out = ops.merge_segments(_clip_segments(spark, sf), keys=["stream_id"], overriding=["knockout", "counter"])
    return out.withColumn("kept", R("kept", 2))


@query("scr10_trim", f"""
WITH {SEGS},
answered AS (SELECT * FROM csegs WHERE stream_id % 4 IN (2, 3)), {MERGED.format('answered')}
SELECT stream_id, seg_no, start, "end", purpose, duration, CASE WHEN n = 1 THEN 'continuous' ELSE 'composite' END AS assembly,
  round(CASE WHEN stream_id % 4 = 2 THEN 8.25e0 ELSE (stream_id % 10) / 1e0 END, 1) AS score FROM kept8 WHERE total >= 30
UNION ALL
SELECT stream_id, seg_no, start, "end", purpose, round("end" - start, 2), 'continuous', round((stream_id % 10) * 0.7e0, 1)
FROM csegs WHERE stream_id % 4 = 0 AND "end" - start >= 15
UNION ALL
SELECT stream_id, seg_no, start, "end", purpose, round("end" - start, 2), 'continuous', round((stream_id % 10) * 0.7e0, 1)
FROM csegs c WHERE stream_id % 4 IN (2, 3) AND "end" - start >= 15
 AND NOT EXISTS (SELECT 1 FROM answered a WHERE a.stream_id = c.stream_id AND a."end" - a.start >= 15)
UNION ALL
SELECT stream_id, min(seg_no), 0, 30, 'full_clip', 30, 'continuous', round((stream_id % 10) * 0.7e0, 1)
FROM csegs WHERE stream_id % 4 <> 1 GROUP BY stream_id HAVING max("end" - start) < 15""")
def scr10(spark, sf):
    segs = _clip_segments(spark, sf)
    cands = segs.withColumn("preliminary", (F.col("stream_id") % 10).cast("double"))
    m = F.col("stream_id") % 4
    answers = segs.filter(m != 0).select("stream_id", "cand_id", F.when(m == 1, "reject").otherwise("approve").alias("verdict"),
                                         F.when(m == 2, 8.25).alias("final_score")).distinct()
    out = ops.trim(cands, answers, segs.filter(m >= 2), cand_id="cand_id", overriding=["knockout", "counter"])
    return out.drop("cand_id")


@query("prj2_absolute_times", f"""
WITH {CANDIDATES},
c AS (SELECT cand_id, stream_id % 50 * 1e2 AS conv_start, stream_id % 50 * 1e2 + 3000 AS conv_end, start % 3000 AS s, start % 3000 + 400 AS e FROM candidates),
d AS (SELECT *, s < conv_start AND e < conv_start AS rel FROM c)
SELECT cand_id, greatest(CASE WHEN rel THEN conv_start + s ELSE s END, conv_start) AS start,
       least(CASE WHEN rel THEN conv_start + e ELSE e END, conv_end) AS "end" FROM d""")
def prj2(spark, sf):
    c = candidates(spark, sf)
    clips = c.select("cand_id", (F.col("stream_id") % 50 * 100.0).alias("conv_start"),
                     (F.col("stream_id") % 50 * 100.0 + 3000).alias("conv_end"), (F.col("start") % 3000).alias("start"),
                     (F.col("start") % 3000 + 400).alias("end"))
    return ops.absolute_times(clips).select("cand_id", "start", "end")


@query("prj3_cut_list", f"""
WITH {TURNS}
SELECT stream_id, idx, round(greatest(0, start - 10), 4) AS cut_start, round("end" + 10, 4) AS cut_end,
       round("end" + 10 - greatest(0, start - 10), 4) AS cut_duration FROM turns""")
def prj3(spark, sf):
    return ops.cut_list(turns(spark, sf)).select("stream_id", "idx", *[R(c, 4).alias(c) for c in ("cut_start", "cut_end", "cut_duration")])


@query("prj4_sequential_ids", SCORED + """
SELECT stream_id, cand_id, 'clip_' || row_number() OVER (PARTITION BY stream_id ORDER BY composite DESC, cand_id) AS clip_id
FROM s WHERE composite >= 45""")
def prj4(spark, sf):
    kept = _scored(spark, sf).filter("composite >= 45").select("stream_id", "cand_id", "composite")
    return ranked(kept, ["stream_id"], -F.col("composite"), ["cand_id"], 5.0).select(
        "stream_id", "cand_id", F.concat(F.lit("clip_"), F.col("rank").cast("string")).alias("clip_id"))


ASKED = ["the", "and", "les", "und", "which"]
OVERLAPS = f"""
convs AS (SELECT stream_id // 10 AS grp, stream_id AS conv_id FROM turns GROUP BY ALL),
ov AS (SELECT c.grp, c.conv_id, count(DISTINCT h.term) AS overlap FROM convs c LEFT JOIN hints h
       ON h.stream_id = c.conv_id AND h.term IN ({', '.join(repr(a) for a in ASKED)}) GROUP BY ALL)"""


def _overlaps(spark, sf):
    hints = chat_hints(spark, sf).withColumnRenamed("stream_id", "conv_id")
    asked = spark.createDataFrame([(a,) for a in ASKED], "term string")
    hits = topic_ops.word_hits(hints, asked, keys=["conv_id"])
    convs = turns(spark, sf).select(F.col("stream_id").alias("conv_id")).distinct()
    return (convs.join(hits, "conv_id", "left")
            .select(F.floor(F.col("conv_id") / 10).alias("stream_id"), "conv_id", F.coalesce("overlap", F.lit(0)).alias("overlap")))


@query("scr20_relevant_conversation", f"""
WITH {TURNS}, {HINTS}, {OVERLAPS}
SELECT grp AS stream_id, conv_id, overlap FROM ov WHERE overlap > 0 OR conv_id = 13
QUALIFY row_number() OVER (PARTITION BY grp ORDER BY conv_id = 13 DESC, overlap DESC, conv_id) = 1""")
def scr20(spark, sf):
    return ops.relevant_conversation(_overlaps(spark, sf), target="13")


@query("scr20_by_relevance", f"""
WITH {TURNS}, {HINTS}, {OVERLAPS}
SELECT grp AS stream_id, conv_id, overlap, row_number() OVER (PARTITION BY grp ORDER BY overlap DESC, conv_id) AS rank FROM ov""")
def scr20b(spark, sf):
    return ops.by_relevance(_overlaps(spark, sf))
