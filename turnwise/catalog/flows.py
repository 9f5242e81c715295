"""Whole chains: from the turns of a chat, or from scored candidates, to a ranked list of clips."""

from pyspark.sql import functions as F

from turnwise.catalog import query
from turnwise.catalog.scoring import FIGURES, LENGTHS, PROFILE, SCORED, _figures, _scored
from turnwise.catalog.selection import _suppress_sql
from turnwise.operators import scoring, selection
from turnwise.operators import turns as talk

R = F.round


@query("pipeline_find_clips", "WITH RECURSIVE" + FIGURES.removeprefix("\nWITH") + f""",
passed AS (SELECT *, round((range_id % 10) * 6 + programmatic / 10 * 4, 4) AS blended FROM scored
  WHERE NOT (duration < 30 OR ratio > 0.85 OR turns < 2 OR gw < 20 OR range_id % 4 = 0)),
capped AS (SELECT * FROM passed QUALIFY row_number() OVER (PARTITION BY stream_id ORDER BY blended DESC, range_id) <= 4),
spans AS (SELECT c.*, r.lo, r.hi FROM capped c JOIN ranges r USING (stream_id, range_id)),
trimmed AS (
  SELECT stream_id, range_id, lo + 5 AS start, hi AS "end", round(blended / 10 + 1, 1) AS score FROM spans WHERE range_id % 3 = 2
  UNION ALL SELECT stream_id, range_id, lo, hi, round((range_id % 10) * 0.7e0, 1) FROM spans WHERE range_id % 3 = 0),
pool AS (SELECT stream_id, stream_id * 1000 + range_id AS cand_id, start, "end", score FROM trimmed), {_suppress_sql('stream_id', 0.3)},
left_over AS (SELECT p.* FROM pool p JOIN kept USING (cand_id))
SELECT stream_id, cand_id, round(start, 4) AS start, round("end", 4) AS "end", score,
  row_number() OVER (PARTITION BY stream_id ORDER BY score DESC, cand_id) AS rank FROM left_over""")
def find_clips(spark, sf):
    """Scouted ranges of a chat -> hard filter -> blend -> cap -> trim by the answers -> no overlaps -> rank.

    Answers stand in for a model: every third range is rejected, every third is cut by five seconds, the rest has none.
    """
    scouted = (_figures(spark, sf).withColumns({
        "segments": F.lit(1), "claim": F.when(F.col("range_id") % 4 != 0, "a claim"),
        "preliminary": (F.col("range_id") % 10).cast("double")}))
    passed = scoring.hard_filter(scouted, min_turns=2).filter("passed")
    blended = passed.withColumn("blended", R(scoring.blended_rank(F.col("preliminary"), F.col("programmatic")), 4))
    capped = talk.top_per_stream(blended, [F.desc("blended"), F.asc("range_id")], 4).drop("rank", "turns", "segments")
    m = F.col("range_id") % 3
    cands = capped.select("stream_id", "range_id", "start", "end", "preliminary", F.lit("scout").alias("purpose"), F.lit(1).alias("seg_no"))
    answers = capped.filter(m != 0).select("stream_id", "range_id", F.when(m == 1, "reject").otherwise("approve").alias("verdict"),
                                           (F.col("blended") / 10 + 1).alias("final_score"))
    segments = capped.filter(m == 2).select("stream_id", "range_id", F.lit(1).alias("seg_no"), (F.col("start") + 5).alias("start"), "end",
                                            F.lit("core").alias("purpose"))
    trimmed = scoring.trim(cands, answers, segments, cand_id="range_id", overriding=[])
    pool = trimmed.withColumn("cand_id", F.col("stream_id") * 1000 + F.col("range_id"))
    kept = selection.drop_overlaps(pool, clip_id="cand_id", block_seconds=600.0, width=120.0)
    best = talk.top_per_stream(kept, [F.desc("score"), F.asc("cand_id")], 1_000)
    return best.select("stream_id", "cand_id", R("start", 4).alias("start"), R("end", 4).alias("end"), "score", "rank")


@query("pipeline_find_clips_v3", "WITH RECURSIVE" + SCORED.removeprefix("\nWITH") + f""",
sound AS (SELECT * FROM s WHERE NOT (NOT unscored AND (novelty < 3 OR coalesce(tension, 5) < 2 OR depth < 1)) AND status <> 'P' AND composite >= 45),
reviewed AS (SELECT *, CASE WHEN cand_id % 4 = 0 THEN start + 5 ELSE start END AS s2, CASE WHEN cand_id % 4 = 0 THEN start + 65 ELSE "end" END AS e2,
  CASE WHEN cand_id % 8 = 0 THEN (CASE WHEN unscored THEN 5 * 2 + 5 * 4 + 9 * 3 + 5 * 2 + 1 ELSE evidence * 2 + novelty * 4 + 9 * 3 + depth * 2 + 1 END) / 12e0 * 10
     + 3 + CASE WHEN host_last THEN 2 ELSE 0 END ELSE composite END AS c2 FROM sound WHERE cand_id % 20 <> 10),
v AS (SELECT *, CASE cand_id % 4 WHEN 0 THEN 'affirm' WHEN 1 THEN 'deny' WHEN 2 THEN 'unclear' END AS verdict, (cand_id % 10) / 1e1 AS conf FROM reviewed),
pool AS (SELECT stream_id, cand_id, s2 AS start, e2 AS "end",
    round(c2 + CASE WHEN c2 < 65 AND verdict = 'affirm' AND conf > 0.7 THEN 5 ELSE 0 END, 4) AS score
  FROM v WHERE NOT (c2 < 65 AND coalesce(verdict = 'deny' AND conf >= 0.7, false))), {_suppress_sql('stream_id', 0.3)},
left_over AS (SELECT p.* FROM pool p JOIN kept USING (cand_id))
SELECT stream_id, cand_id, start, "end", score, row_number() OVER (PARTITION BY stream_id ORDER BY score DESC, cand_id) AS rank
FROM left_over QUALIFY rank <= 5""")
def find_clips_v3(spark, sf):
    """Scored windows -> dealbreakers and floor -> reviews -> verdicts -> no overlaps -> the best five of a stream."""
    none = F.array().cast("array<string>")
    scored = _scored(spark, sf)
    sound = scored.filter(scoring.first_failure(F.col("scores"), none, F.col("status") != "P", PROFILE).isNull() & (F.col("composite") >= 45))
    m = F.col("cand_id") % 4
    reviews = sound.filter(F.col("cand_id") % 2 == 0).select(
        "stream_id", "cand_id", F.when(m == 0, F.col("start") + 5).alias("new_start"), F.when(m == 0, F.col("start") + 65).alias("new_end"),
        F.when(F.col("cand_id") % 8 == 0, F.create_map(F.lit("tension"), F.lit(9.0), F.lit("humor"), F.lit(1.0))).alias("new_scores"),
        (F.col("cand_id") % 20 != 10).alias("keep"))
    reviewed = scoring.rescore(sound, reviews, PROFILE, LENGTHS, cand_id="cand_id")
    verdicts = reviewed.filter(m != 3).select("stream_id", "cand_id", F.when(m == 0, "affirm").when(m == 1, "deny").otherwise("unclear").alias("verdict"),
                                              (F.col("cand_id") % 10 / 10).alias("v_confidence"))
    gated = scoring.verdict_gate(reviewed, verdicts, cand_id="cand_id").drop("score").withColumn("score", R("composite", 4))
    kept = selection.drop_overlaps(gated, clip_id="cand_id", block_seconds=86_400.0)
    return (talk.top_per_stream(kept, [F.desc("score"), F.asc("cand_id")], 5)
            .select("stream_id", "cand_id", "start", "end", "score", "rank"))
